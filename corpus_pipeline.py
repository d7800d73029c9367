"""A corpus made ready for training: each stage works on all that the one before it kept.

STAGES: (name, function); a function takes (spark, docs, sf_dir). All but the last return the columns of documents.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactsheet.llm import common, decontamination, host_rules, jaccard_join, mixing, sharding

WEIGHTS = [5, 2, 1]
SHARDS = 8
#: Ids of dropped copies that are broadcast at most, 16 MB; more are joined.
BROADCAST_IDS = 1_000_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or whose source does by one rule or by all together, go.

    Null and empty texts fail; documents without a source are one source; repeated rows are judged one by one. An empty table stays empty.
    """
    return host_rules.host_rules(docs, mixed=True).where("kept").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the least doc_id stays; of several with that doc_id, or none, the first by text.

    Null, empty and blank texts are similar to nothing and stay. Rows that share a doc_id are judged each on its own text; of wholly
    equal rows one stays. An empty table stays empty.
    """
    if docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        found = common.checkpointed(jaccard_join.near_duplicates(docs))
        gone = common.fresh("gone", docs)
        copies = found.where("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct()
        copies = F.broadcast(copies) if common.small(copies, BROADCAST_IDS) else copies
        return docs.join(copies, F.col("doc_id") == F.col(gone), "left_anti")
    row, kept = common.fresh("row_of", docs), common.fresh("kept_row", docs)
    rows = common.checkpointed(docs.withColumn(row, F.monotonically_increasing_id()))
    found = jaccard_join.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias("of"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.md5("text"), row)
    ours = rows.select(F.col(row).alias("of"), order.alias("order")).join(found, "of")
    first = ours.groupBy("component_id").agg(F.min("order").getField(row).alias(kept)).select(kept)
    return rows.join(first, F.col(row) == F.col(kept), "left_semi").drop(row)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The benchmark's passages are cut out of the texts, and n_chars follows; documents that were nothing else go.

    Null and empty texts, and all texts if the benchmark is empty, stay as they are; so do repeated rows. An empty table stays empty.
    """
    out = decontamination.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), clean=True)
    hit = F.size("leaks.spans") > 0
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    empty = hit & (F.aggregate("leaks.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]) == F.col("leaks.n_words"))
    return out.where(~empty).select(docs.columns)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; one that it doesn't take goes.

    Rows that share doc_id and source are taken together; null ids and sources are values like others. Documents without words
    are taken whole times only. An empty table stays empty.
    """
    i, s, n, k = (common.fresh(x, docs) for x in ("id_of", "source_of", "copies_of", "copy_of"))
    taken = mixing.mix(docs, WEIGHTS).where("copies > 0").select(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("copies").alias(n))
    same = F.col("doc_id").eqNullSafe(F.col(i)) & F.col("source").eqNullSafe(F.col(s))
    out = docs.join(taken, same).withColumn(k, F.explode(F.array_repeat(F.lit(1), F.col(n))))
    return out.select(docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The manifest: for each row its shard and its place there. Nulls and ties: as sharding.shard has them. An empty table gives an empty one."""
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing_sources", mixing_sources),
    ("sharding", shards),
]
#: The cube method and the packing can't be expressed in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on all documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid4()}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
