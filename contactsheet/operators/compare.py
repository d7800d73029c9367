"""Deltas of many fields between two rows of a key, and differences of sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deltas(before: DataFrame, after: DataFrame, key: str, metrics: list[str], least: float = 0.001) -> DataFrame:
    """PRJ-15, PRJ-16. One row a key and metric with a value on both sides: before, after, delta and its direction."""
    long = lambda df, name: df.unpivot([key], metrics, "metric", name)
    both = long(before, "before").join(long(after, "after"), [key, "metric"]).where("before IS NOT NULL AND after IS NOT NULL")
    d = F.round(F.col("after") - F.col("before"), 6)
    return both.select(key, "metric", "before", "after", d.alias("delta"), F.when(d >= least, "up").when(d <= -least, "down").otherwise("same").alias("direction"))


def verdicts(changes: DataFrame, key: str) -> DataFrame:
    """PRJ-16. improved, regressed, mixed or unchanged for each key of deltas()."""
    up, down = F.count_if(F.col("direction") == "up"), F.count_if(F.col("direction") == "down")
    status = F.when((up > 0) & (down > 0), "mixed").when(up > 0, "improved").when(down > 0, "regressed").otherwise("unchanged")
    return changes.groupBy(key).agg(status.alias("status"))


def union_distinct(*frames: DataFrame) -> DataFrame:
    """SET-01, SET-05."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.distinct()


def difference(all_rows: DataFrame, taken: DataFrame) -> DataFrame:
    """SET-02. Distinct rows of the first that the second lacks; nulls are equal."""
    return all_rows.subtract(taken)


def desired_order(current: str, requested: str):
    """SET-06. The asked items that exist, in that order, then the rest as they were."""
    both = F.array_intersect(F.col(requested), F.col(current))
    return F.concat(both, F.array_except(F.col(current), F.col(requested)))
