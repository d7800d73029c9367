"""Numbers and running sums over a whole order, without a window that puts all rows into one task.

Rows are dealt into ranges of the order; sums of the ranges tell what comes before each, and a window runs within a range only.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactsheet.operators.joins import kept

#: Range sums that are broadcast at most; more are joined.
BROADCAST_SUMS = 100_000


def ahead(df: DataFrame, name: str, order: list[Column], value: Column | None = None, by: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """df with name: the sum of value (1 if none is given) over the rows that come before, of those with equal by; 0 for the first.

    order should end in a unique key: rows that are wholly equal in it come in any order, and one of its values isn't split over ranges.
    Nulls in by are one value.
    """
    spark, by = df.sparkSession, by or []
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in by]
    own, group, start = (fresh(x, df) for x in ("value_of", "range_of", "start_of"))
    dealt = df.withColumn(own, F.coalesce(value if value is not None else F.lit(1), F.lit(0)).cast("long"))
    dealt = kept(dealt.repartitionByRange(ranges, *keys, *order).withColumn(group, F.spark_partition_id()))
    sums = dealt.groupBy(group, *by).agg(F.sum(own).alias("s"))
    if by:
        before = Window.partitionBy(*by).orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
        starts = sums.select(group, *by, F.coalesce(F.sum("s").over(before), F.lit(0)).alias(start))
        starts = F.broadcast(starts) if starts.limit(BROADCAST_SUMS + 1).count() <= BROADCAST_SUMS else starts
    else:  # a number for each range
        rows, total = [], 0
        for r in sums.orderBy(group).collect():
            rows.append((r[group], total))
            total += r.s
        starts = F.broadcast(spark.createDataFrame(rows, f"{group} int, {start} long"))
    starts = starts.select(*(F.col(c).alias(f"{start}_{c}") for c in (group, *by)), start)
    on = reduce(and_, (F.col(c).eqNullSafe(F.col(f"{start}_{c}")) for c in (group, *by)))
    inside = F.sum(own).over(Window.partitionBy(group, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    out = dealt.withColumn(name, F.coalesce(inside, F.lit(0))).join(starts, on)
    return out.withColumn(name, F.col(name) + F.col(start)).select(*df.columns, name)


def numbered(df: DataFrame, name: str, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """df with name: 1, 2 and so on by order, for each by; the order should end in a unique key."""
    return ahead(df, name, order, by=by).withColumn(name, F.col(name) + 1)


def ranked(df: DataFrame, name: str, order: list[tuple[str, bool]], by: list[str] | None = None) -> DataFrame:
    """df with name: 1 and the number of rows strictly ahead; rows that are equal in order share a place. order: (column, descending), nulls last.

    Equal rows are counted before they are put in order, so that many of them are one row there.
    """
    by, keys = by or [], [c for c, _ in order]
    counts = df.groupBy(*by, *keys).agg(F.count(F.lit(1)).alias("count_of"))
    placed = ahead(counts, name, [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in order], F.col("count_of"), by)
    placed = placed.select(*(F.col(c).alias(f"{name}_{c}") for c in (*by, *keys)), (F.col(name) + 1).alias(name))
    on = reduce(and_, (F.col(c).eqNullSafe(F.col(f"{name}_{c}")) for c in (*by, *keys)))
    return df.join(placed, on).select(*df.columns, name)


def best(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "place", salts: int = 16) -> DataFrame:
    """df's first k rows of each by, by order, with their place from 1. Each group is dealt to so many parts first, of which k rows go on,
    so that one group of all rows isn't one sort; order should end in a unique key."""
    salt = fresh("salt_of", df)
    plain = [c for c, kind in df.dtypes if "map<" not in kind]
    parts = df.withColumn(salt, F.pmod(F.xxhash64(*plain), F.lit(salts)))
    first = Window.partitionBy(*by, salt).orderBy(*order)
    few = parts.withColumn(name, F.row_number().over(first)).where(F.col(name) <= k).drop(name, salt)
    return few.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def fresh(name: str, df: DataFrame) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
