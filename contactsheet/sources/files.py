"""Folder scans, baselines, reports, and the gallery's text formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contactsheet.functions.text import extension

#: Extensions of raw and raster images.
RAW = [".arw", ".cr2", ".cr3", ".crw", ".dng", ".nef", ".orf", ".pef", ".raf", ".raw", ".rw2", ".srw"]
RASTER = [".jpg", ".jpeg", ".png", ".tif", ".tiff", ".heic", ".webp"]
#: Parts of paths that hold no photographs.
JUNK = ["Previews.lrdata", ".Trash", "@eaDir", "__MACOSX"]


def listing(spark: SparkSession, folder: str, streaming: bool = False) -> DataFrame:
    """SRC-02. path, length and modificationTime of all files below a folder; contents aren't read."""
    reader = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary") if streaming else spark.read
    return reader.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")


def classified(files: DataFrame, least_bytes: int = 200_000, junk: list[str] | None = None) -> DataFrame:
    """SRC-02, SRC-10. files with reason: accepted, or why a file is skipped; the first reason that holds."""
    name, ext = F.element_at(F.split("path", "/"), -1), extension(F.col("path"))
    in_junk = F.lit(False)
    for j in junk or JUNK:
        in_junk = in_junk | F.col("path").contains(j)
    reason = F.when(name.startswith("."), "hidden").when(in_junk, "junk_path").when(~ext.isin(RAW + RASTER), "extension")
    return files.withColumn("reason", reason.when(ext.isin(RASTER) & (F.col("length") < least_bytes), "too_small").otherwise("accepted"))


def scan_summary(files: DataFrame) -> DataFrame:
    """AGG-44, SRC-03. Files and bytes by reason."""
    return files.groupBy("reason").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def renamed(files: DataFrame, name: str, order: str) -> DataFrame:
    """SRC-11. Names with a number before the extension where an earlier file has the same one."""
    w = Window.partitionBy(name).orderBy(order)
    n = F.row_number().over(w) - 1
    base, ext = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"\.[^.]*$", 0)
    return files.withColumn("target", F.when(n == 0, F.col(name)).otherwise(F.concat(base, F.lit("_"), n.cast("string"), ext)))


def cache_key(path: Column) -> Column:
    """SRC-07. Stem and the start of the parent folder's digest."""
    parent = F.regexp_replace(path, r"/[^/]*$", "")
    return F.concat(F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1), F.lit("_"), F.substring(F.md5(parent), 1, 8))


def read_baseline(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-09. A CSV or JSON baseline with its schema given."""
    return spark.read.json(path, schema=schema, multiLine=True) if path.endswith(".json") else spark.read.csv(path, schema=schema, header=True)


def write_report(report: DataFrame, folder: str, as_of: str) -> None:
    """SNK-02. A snapshot row appended with the whole report as JSON."""
    row = report.select(F.lit(as_of).cast("timestamp").alias("created_at"), F.to_json(F.struct("*")).alias("report_json"))
    row.write.mode("append").parquet(folder)


def write_csv(df: DataFrame, folder: str) -> None:
    """SNK-03."""
    df.write.mode("overwrite").csv(folder, header=True)


def fenced(page: Column, start: str, end: str, block: Column) -> Column:
    """SNK-06. The page with what stands between two marks replaced, and every other byte as it was; null if a mark is missing."""
    a = F.instr(page, start)
    head = F.substring_index(page, start, 1)
    tail = F.substr(page, F.length(head) + len(start) + 1)
    rest = F.substr(tail, F.instr(tail, end))
    return F.when((a > 0) & (F.instr(tail, end) > 0), F.concat(head, F.lit(f"{start}\n"), block, F.lit("\n"), rest))


def ensure_columns(df: DataFrame, schema) -> DataFrame:
    """MUT-19. df with the schema's columns in its order; those it lacks are null."""
    return df.select(*(F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields))
