"""Folders of files brought into the library: what a card holds, and what a manual import does with each file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactsheet.functions.text import extension
from contactsheet.sources.files import RASTER, RAW


def card_scan(files: DataFrame) -> DataFrame:
    """SRC-03. folder, images and bytes of each folder that has images, and of the whole card, whose folder is null. files: path, length."""
    mine = files.where(extension(F.col("path")).isin(RAW + RASTER)).withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))
    return mine.rollup("folder").agg(F.count(F.lit(1)).alias("images"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def import_plan(files: DataFrame, images: DataFrame) -> DataFrame:
    """SRC-10. path and action of each file: insert or update of an accepted picture, skipped_raw, skipped_other; resource forks aren't listed.

    files: path. images: file_path, the known ones. A path that is there twice is one file.
    """
    ext, name = extension(F.col("path")), F.element_at(F.split("path", "/"), -1)
    paths = files.where(~name.startswith("._")).select("path").distinct()
    known = images.select(F.col("file_path").alias("path"), F.lit(True).alias("known")).distinct()
    action = F.when(ext.isin(RAW), "skipped_raw").when(~ext.isin(RASTER), "skipped_other").when(F.col("known"), "update").otherwise("insert")
    return paths.join(known, "path", "left").select("path", action.alias("action"))


def imported(plan: DataFrame, images: DataFrame, as_of: str, genre: str | None = None) -> DataFrame:
    """SRC-10, MUT-04. The rows that an import leaves for its accepted files: unscored, ready, each pass marked done where it wasn't.

    images: file_path, pass1_status, pass1_at, pass2_at, pass3_at, genre, content_ready, manual_added. A genre that is given counts over
    the old one.
    """
    now = F.lit(as_of).cast("timestamp")
    rows = plan.where(F.col("action").isin("insert", "update")).select(F.col("path").alias("file_path"), "action").join(images, "file_path", "left")
    return rows.select(
        "file_path", "action", F.coalesce("pass1_status", F.lit("pass")).alias("pass1_status"), *(F.coalesce(F.col(c).cast("timestamp"), now).alias(c) for c in ("pass1_at", "pass2_at", "pass3_at")),
        F.coalesce(F.lit(genre), F.col("genre")).alias("genre"), F.lit(True).alias("content_ready"), F.lit(True).alias("manual_added"),
    )


def seeded_assets(old: DataFrame, new: DataFrame, as_of: str) -> DataFrame:
    """MUT-05. Web assets by section and slug: a new one takes all its values and as_of as first and last day, one that is there takes the new
    values and is live again, but keeps its days; the others stay. Columns: section, slug, values, state, first_published_at, last_published_at."""
    key, own = ["section", "slug"], ["state", "first_published_at", "last_published_at"]
    values = [c for c in new.columns if c not in key]
    n = new.select(*key, *(F.col(c).alias(f"new_{c}") for c in values), F.lit(True).alias("is_new"))
    both = old.withColumn("is_old", F.lit(True)).join(n, key, "full_outer")
    now = F.lit(as_of).cast("timestamp")
    return both.select(
        *key, *(F.when(F.col("is_new"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in values), F.when(F.col("is_new"), "live").otherwise(F.col("state")).alias("state"),
        *(F.when(F.col("is_old"), F.col(c).cast("timestamp")).otherwise(now).alias(c) for c in own[1:]),
    )
