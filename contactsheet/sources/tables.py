"""Tables that batches change: an upsert by key and an append with ids, whole or not at all for each batch, however often it runs.

A table is a folder bucket=b/batch=n of rows; the rows of a bucket are those of its last batch. A batch writes only the buckets that it
touches, from what earlier batches left, so that running it again replaces what it wrote by the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactsheet.operators.jobs import upsert
from contactsheet.operators.joins import kept
from contactsheet.operators.ranks import numbered

BUCKETS = 64


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def read_table(spark: SparkSession, folder: str, schema: str, before: int | None = None) -> DataFrame:
    """The table's rows, or those it had before a batch. schema: of the rows, without bucket and batch. No rows where nothing was written."""
    empty = spark.createDataFrame([], schema)
    if not exists(spark, folder):
        return empty
    rows = spark.read.schema(f"{schema}, bucket int, batch long").parquet(folder)
    rows = rows if before is None else rows.where(F.col("batch") < before)
    last = rows.groupBy(F.col("bucket").alias("last_bucket")).agg(F.max("batch").alias("last_batch")).collect()  # a row for each bucket
    if not last:
        return empty
    # As conditions on partition columns: other batches' files aren't opened.
    current = F.lit(False)
    by_batch: dict[int, list[int]] = {}
    for r in last:
        by_batch.setdefault(r.last_batch, []).append(r.last_bucket)
    for batch, buckets in by_batch.items():
        current = current | ((F.col("batch") == batch) & F.col("bucket").isin(buckets))
    return rows.where(current).select(empty.columns)


def write_upsert(folder: str, new: DataFrame, key: str, overwrite: list[str], keep: list[str], batch: int, buckets: int = BUCKETS) -> None:
    """SNK-01, as jobs.upsert: the batch's rows go into the table by key. Of several rows for a key the greatest by its columns counts.

    Columns of the table are the key's, overwrite's and keep's. Null keys are one key. Batches come in the order of their numbers. A
    repeated batch looks at earlier batches alone and replaces its own files. An empty batch changes nothing.
    """
    spark = new.sparkSession
    others = [*overwrite, *keep]
    once = new.groupBy(key).agg(F.max(F.struct(*others)).alias("row")).select(key, "row.*")
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")
    once = kept(once.withColumn("bucket", bucket))
    touched = [r.bucket for r in once.select("bucket").distinct().collect()]  # one for each bucket at most
    if not touched:
        return
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in once.drop("bucket").schema.fields)
    old = read_table(spark, folder, schema, batch).where(F.pmod(F.xxhash64(key), F.lit(buckets)).isin(touched))
    merged = kept(upsert(old, once.drop("bucket"), key, overwrite, keep).select("*", bucket, F.lit(batch).cast("long").alias("batch")))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(folder)


def append_log(folder: str, rows: DataFrame, order: list[str], batch: int) -> None:
    """SNK-08, CRUD-03. Adds rows to a log with ids that go on from earlier batches, in the order given; rows that repeat are added as often.

    A repeated batch replaces its own rows and gives the same ids.
    """
    spark = rows.sparkSession
    last = 0
    if exists(spark, folder):
        last = spark.read.schema("id long, batch long").parquet(folder).where(F.col("batch") < batch).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    added = numbered(rows, "id", [F.col(c) for c in order]).withColumn("id", F.col("id") + last)
    added.select("id", *rows.columns, F.lit(batch).cast("long").alias("batch")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(folder)


def read_log(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(f"id long, {schema}, batch long").parquet(folder).drop("batch")
