"""Filters with optional terms, the reference's predicates, and listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(*terms: Column | None) -> Column:
    """FLT-01. The terms that are given, joined by AND."""
    return reduce(lambda a, b: a & b, [t for t in terms if t is not None], F.lit(True))


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """SRT-06. A page from 1 on; the order ends in a unique key."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_count(df: DataFrame, size: int) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long"))


def not_equal(c: Column, value, nulls: bool) -> Column:
    """FLT-18. Unequal to the value; a null is in only where asked."""
    return c.isNull() | (c != value) if nulls else c != value


def blank(c: Column) -> Column:
    """FLT-17. Null or empty; blanks count as text."""
    return F.nullif(c, F.lit("")).isNull()


def outside(path: Column, *patterns: str) -> Column:
    """FLT-09. A path that none of the LIKE patterns fits in any case; a null path is out."""
    return reduce(lambda a, b: a & b, [~path.ilike(p) for p in patterns])


def in_folder(path: Column, folder: str) -> Column:
    """FLT-12."""
    return path.startswith(folder.rstrip("/") + "/")


def with_fallback(first: DataFrame, second: DataFrame) -> DataFrame:
    """SRT-09. The first, or all of the second where the first is empty; one plan, no action."""
    any_first = first.limit(1).agg(F.count(F.lit(1)).alias("n_first"))
    return first.unionByName(second.crossJoin(F.broadcast(any_first)).where("n_first = 0").drop("n_first"))
