"""Window-like operators. Every order ends in a unique key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactsheet.operators.joins import checked
from contactsheet.operators.ranks import best, fresh, ranked


def share_within(df: DataFrame, group: Column, name: str, value: str) -> DataFrame:
    """WIN-01. Rows by group and value, with percent of the group's."""
    counts = df.where(F.col(value).isNotNull()).groupBy(group.alias(name), value).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(name)), 2))


def top_per_group(df: DataFrame, group: str, score: Column, key: str, top: int) -> DataFrame:
    """WIN-03. The best rows of each group, numbered."""
    w = Window.partitionBy(group).orderBy(score.desc_nulls_last(), key)
    return df.withColumn("rank_in_group", F.row_number().over(w)).where(F.col("rank_in_group") <= top)


def flag_top(df: DataFrame, group: str, score: Column, key: str, top: int, flag: str = "portfolio") -> DataFrame:
    """WIN-02. All rows, flagged if among the best of their group."""
    best = top_per_group(df, group, score, key, top).select(key, F.lit(True).alias(flag))
    return df.join(best, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def stratified(df: DataFrame, tier: Column, key: str, k: int, seed: int = 0) -> DataFrame:
    """WIN-04. So many rows of each tier, by a hash of key and seed: the same at every run. Rows without a tier are left out.

    The rows of each tier are counted by how their hashes begin, and only those that begin low enough are put in order.
    """
    digest, starts = fresh("digest_of", df), fresh("starts_of", df)
    rows = df.withColumn("tier", tier).where("tier IS NOT NULL").withColumn(digest, F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))))
    counts = rows.groupBy("tier", F.substring(digest, 1, 3).alias(starts)).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("tier").orderBy(starts).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = counts.withColumn("before", before).where(F.col("before") < k).groupBy("tier").agg(F.max(starts).alias(starts))
    few = rows.join(checked(last), "tier").where(F.substring(digest, 1, 3) <= F.col(starts)).drop(starts)
    return best(few, ["tier"], [F.col(digest), F.col(key)], k).select(*[c for c in df.columns if c.lower() != "tier"], "tier")


def latest_per_key(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """WIN-05. The row with the greatest order of each key, as one aggregate without a sort."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.col(order)).alias("x")).select(*keys, "x.*")


def queue_position(jobs: DataFrame, group: str | None, priority: str, queued: str) -> DataFrame:
    """WIN-06. 1 and the number of jobs strictly ahead by priority, then time; equal ones share a place, nulls are last. No group is one task."""
    return ranked(jobs, "position", [(priority, True), (queued, False)], [group] if group else [])


def resequence(df: DataFrame, group: str, requested: str, old: str, key: str) -> DataFrame:
    """WIN-10. New indexes from 0: rows asked for in that order first, the rest as before after them."""
    w = Window.partitionBy(group).orderBy(F.col(requested).asc_nulls_last(), old, key)
    return df.withColumn("sort_index", (F.row_number().over(w) - 1).cast("long"))


def next_slug(df: DataFrame, section: str, slug: str, width: int = 2) -> DataFrame:
    """WIN-09. Of each section the next name: the greatest number ever given, and one; padded, never cut."""
    n = F.regexp_extract(slug, r"-(\d+)$", 1)
    top = df.groupBy(section).agg(F.coalesce(F.max(F.when(n != "", n.cast("long"))), F.lit(0)).alias("n"))
    number = (F.col("n") + 1).cast("string")
    return top.select(section, F.concat_ws("-", F.col(section), F.when(F.length(number) < width, F.lpad(number, width, "0")).otherwise(number)).alias("next_slug"))


def next_index(df: DataFrame, section: str, index: str) -> DataFrame:
    """WIN-11. The greatest index and one; 0 where there is none."""
    return df.groupBy(section).agg((F.coalesce(F.max(index), F.lit(-1)) + 1).alias("next_index"))


def tiered_batch(df: DataFrame, tier: Column, score: str, key: str, batch: int) -> DataFrame:
    """WIN-12. A batch filled tier by tier, best score first; each row in its lowest tier only."""
    out = df.withColumn("tier", tier).where("tier IS NOT NULL")
    return out.orderBy("tier", F.desc_nulls_last(score), key).limit(batch)


def grid_fit(candidates: DataFrame, grid: DataFrame, key: str) -> DataFrame:
    """WIN-08, UDF-15. The fit of each candidate with the last nine posts; the grid is one row of nine at most.

    candidates: key, palette, mood, genre, composition. grid: posted (order) and the same columns. An empty grid gives 0.85. Moods,
    genres and compositions are compared in lower case; an empty mood or composition equals none as the last, but in the last three an
    empty mood counts, as an empty genre does. The grid's palette is the most frequent; of equals the one of the newest post.
    """
    low = lambda df: df.withColumns({x: F.lower(F.coalesce(x, F.lit(""))) for x in ("mood", "genre", "composition")})
    last = low(grid).orderBy(F.desc("posted")).limit(9).agg(F.sort_array(F.collect_list(F.struct("posted", "palette", "mood", "genre", "composition")), asc=False).alias("g"))
    g = F.col("g")
    first, three = lambda k: F.get(g, F.lit(0))[k], F.slice(g, 1, 3)
    times = lambda k: F.size(F.filter(three, lambda x: x[k] == F.col(k)))
    palettes = F.transform(g, lambda x: x["palette"])
    counted = F.transform(palettes, lambda p, i: F.struct(F.size(F.filter(palettes, lambda q: q == p)).alias("n"), (-i).alias("at"), p.alias("p")))
    dominant = F.array_max(counted)["p"]
    fit = F.when(F.col("palette") == dominant, 0.9).when(F.col("palette") == "neutral", 0.7).otherwise(0.4)
    fit = F.when((F.col("palette") == first("palette")) & (F.col("palette") != "neutral"), F.greatest(F.lit(0.3), fit - 0.15)).otherwise(fit)
    mood = F.when((F.col("mood") == first("mood")) & (F.col("mood") != ""), 0.3).when(times("mood") > 0, 0.6).otherwise(0.95)
    genre = F.when(times("genre") >= 2, 0.3).when(times("genre") == 1, 0.7).otherwise(0.95)
    composition = F.when((F.col("composition") == first("composition")) & (F.col("composition") != ""), 0.4).otherwise(0.9)
    score = fit * 0.30 + mood * 0.25 + genre * 0.20 + composition * 0.15 + F.lit(0.8) * 0.10
    return low(candidates).crossJoin(F.broadcast(last)).select(key, F.when(F.size("g") == 0, 0.85).otherwise(F.round(score, 3)).alias("grid_fit"))
