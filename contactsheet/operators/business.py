"""Workload, tiers, upsell, editions, slots and the diagnosis of an image: operators of two or three steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days from shoot to delivery.
DELIVERY_DAYS = {"wedding": 28, "portrait": 14, "boudoir": 14, "commercial": 7, "events": 7, "nature": 7}


def workload(shoots: DataFrame, genre: str, shot: Column, delivered: Column, windows: dict[str, int], as_of: str, default: int = 14) -> DataFrame:
    """AGG-30. One row: shoots in the queue, overdue, and due within a week; delivered ones are out."""
    window = F.coalesce(F.create_map(*(F.lit(x) for kv in windows.items() for x in kv))[F.col(genre)], F.lit(default))
    today = F.lit(as_of).cast("date")
    due = F.date_add(shot, window)
    open_ = ~delivered & (shot <= today)
    return shoots.agg(F.count_if(open_).alias("in_queue"), F.count_if(open_ & (due < today)).alias("overdue"), F.count_if(open_ & due.between(today, F.date_add(today, 7))).alias("due_this_week"))


def tier_progress(images: DataFrame, key: str, score: str, picked: Column, done: Column, top: int = 500, least: float = 6.0) -> DataFrame:
    """AGG-15. Total, complete and remaining by priority tier: the top by score, picks, good scores, the rest; each image in its lowest tier."""
    best = images.orderBy(F.desc_nulls_last(score), key).limit(top).select(key, F.lit(True).alias("is_top"))
    tier = F.when(F.col("is_top"), 1).when(picked, 2).when(F.col(score) >= least, 3).otherwise(4)
    rows = images.join(F.broadcast(best), key, "left").groupBy(tier.alias("tier"))
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("complete"), F.count_if(~done).alias("remaining"))


def upsell(bookings: DataFrame, images: DataFrame, on: str, worthy: Column, prices: tuple[float, float]) -> DataFrame:
    """AGG-28. Bookings with worthy images, and what they may bring at the least and the most."""
    n = images.where(worthy).groupBy(on).agg(F.count(F.lit(1)).alias("worthy"))
    return bookings.join(n, on).withColumns({"least": F.round(F.col("worthy") * prices[0], 2), "most": F.round(F.col("worthy") * prices[1], 2)})


def editions(prints: DataFrame, key: str, size: str, sales: DataFrame, sale_key: str, price: Column, cost: Column) -> DataFrame:
    """MUT-07. What is sold, earned and left of each edition, derived from its sales; sold out at its size. Without a cost the price is earned."""
    earned = F.when(cost.isNotNull() & (cost != 0), F.round(price - cost, 2)).otherwise(price)
    s = sales.groupBy(F.col(sale_key).alias(key)).agg(F.count(F.lit(1)).alias("sold"), F.round(F.sum(earned), 2).alias("margin"))
    out = prints.select(key, size).join(s, key, "left").withColumns({"sold": F.coalesce("sold", F.lit(0)).cast("long"), "margin": F.coalesce("margin", F.lit(0.0))})
    return out.withColumns({"left": F.greatest(F.lit(0), F.col(size) - F.col("sold")).cast("long"), "retired": F.col("sold") >= F.col(size)})


def free_slots(requests: DataFrame, posts: DataFrame, slot: list[str], key: str) -> DataFrame:
    """MUT-13. Requests for slots that no post has; of several for one slot the least key."""
    w = Window.partitionBy(*slot).orderBy(key)
    first = requests.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
    return first.join(posts.select(*slot).distinct(), slot, "left_anti")


def season_boosted(rows: DataFrame, score: Column, genre: Column, in_season: list[str], boost: float = 0.25) -> DataFrame:
    """SRT-08. The score with what the season adds."""
    return rows.withColumn("boosted", F.round(score + F.when(genre.isin(in_season), boost).otherwise(0.0), 6))
