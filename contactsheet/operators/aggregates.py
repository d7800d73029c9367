"""Revenue, style, queue and licence aggregates. Each is one conditional aggregate over one scan, unless it needs two grains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactsheet.operators.joins import checked
from contactsheet.operators.ranks import best


def _sum_where(cond: Column, value: Column) -> Column:
    return F.round(F.coalesce(F.sum(F.when(cond, value)), F.lit(0.0)), 2)


def revenue_by_genre(bookings: DataFrame, genre: str, amount: str, paid: Column) -> DataFrame:
    """AGG-02. Count, paid count, paid and pending sums and the paid average of each genre; null genres form one group."""
    return bookings.groupBy(F.col(genre).alias("genre")).agg(
        F.count(F.lit(1)).alias("bookings"),
        F.count_if(paid).alias("paid_bookings"),
        _sum_where(paid, F.col(amount)).alias("paid_revenue"),
        _sum_where(~paid, F.col(amount)).alias("pending_revenue"),
        F.round(F.avg(F.when(paid, F.col(amount))), 2).alias("avg_paid"),
    )


def revenue_totals(bookings: DataFrame, amount: str, paid: Column) -> DataFrame:
    """AGG-01. One row of totals; zero where there is nothing to add."""
    return bookings.agg(
        F.count(F.lit(1)).alias("bookings"),
        _sum_where(paid, F.col(amount)).alias("paid_revenue"),
        _sum_where(~paid, F.col(amount)).alias("pending_revenue"),
        F.round(F.coalesce(F.avg(F.when(paid, F.col(amount))), F.lit(0.0)), 2).alias("avg_paid"),
    )


def revenue_by_month(bookings: DataFrame, day: str, amount: str, paid: Column, as_of: str, months: int = 24) -> DataFrame:
    """AGG-03. Paid revenue by month over the months before as_of, newest first by its key."""
    recent = bookings.where(paid & (F.col(day) >= F.add_months(F.lit(as_of).cast("date"), -months)))
    return recent.groupBy(F.date_format(day, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("bookings"), F.round(F.sum(amount), 2).alias("revenue"))


def busiest_months(bookings: DataFrame, day: str, amount: str) -> DataFrame:
    """AGG-04. Bookings and revenue by calendar month over all years."""
    return bookings.groupBy(F.date_format(day, "MM").alias("month"), F.date_format(day, "MMMM").alias("month_name")).agg(
        F.count(F.lit(1)).alias("bookings"), F.round(F.sum(amount), 2).alias("revenue")
    )


def projection(bookings: DataFrame, day: str, amount: str, label: str, as_of: str, months: int = 3) -> DataFrame:
    """AGG-05. Booked revenue of the months from as_of on, with the labels in it, each once and sorted."""
    start = F.lit(as_of).cast("date")
    ahead = bookings.where((F.col(day) >= start) & (F.col(day) <= F.add_months(start, months)))
    return ahead.groupBy(F.date_format(day, "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("bookings"), F.round(F.sum(amount), 2).alias("revenue"), F.concat_ws(",", F.sort_array(F.collect_set(label))).alias("labels")
    )


def conversion_funnel(bookings: DataFrame, status: str, steps: dict[str, list[str]]) -> DataFrame:
    """AGG-06. One row: how many bookings have reached each step, and the last step's share of all."""
    counts = [F.count_if(F.col(status).isin(values)).alias(name) for name, values in steps.items()]
    last = list(steps)[-1]
    out = bookings.agg(F.count(F.lit(1)).alias("total"), *counts)
    return out.withColumn("conversion_pct", F.round(F.when(F.col("total") > 0, F.col(last) * 100.0 / F.col("total")).otherwise(0.0), 1))


def by_key(sales: DataFrame, key: Column, name: str, price: Column, margin: Column) -> DataFrame:
    """AGG-08. Sales, revenue and margin of each key."""
    return sales.groupBy(key.alias(name)).agg(
        F.count(F.lit(1)).alias("sales"), F.round(F.sum(price), 2).alias("revenue"), F.round(F.sum(margin), 4).alias("margin"), F.round(F.avg(price), 2).alias("avg_price")
    )


def margin_ratio_of_averages(sales: DataFrame, key: str, price: Column, cost: Column) -> DataFrame:
    """AGG-09. Average margin over average price, in percent; null where that is zero."""
    return sales.groupBy(key).agg(F.round(F.avg(price - cost) / F.nullif(F.avg(price), F.lit(0.0)) * 100, 4).alias("margin_pct"))


def margin_average_of_ratios(sales: DataFrame, key: str, price: Column, cost: Column) -> DataFrame:
    """AGG-10. Averages of each sale's margin in percent: a sale without a price counts as 0, or not at all."""
    ratio = (price - cost) / price * 100
    return sales.groupBy(key).agg(
        F.round(F.avg(F.when(price > 0, ratio).otherwise(0.0)), 4).alias("margin_pct_zero"), F.round(F.avg(F.when(price != 0, ratio)), 4).alias("margin_pct_null")
    )


def best_key(sales: DataFrame, key: Column, name: str, value: Column) -> DataFrame:
    """AGG-11. The key with the greatest sum; the least key of several."""
    return sales.groupBy(key.alias(name)).agg(F.round(F.sum(value), 2).alias("revenue")).orderBy(F.desc("revenue"), name).limit(1)


def filtered_counts(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """AGG-12, AGG-14. One row, one scan: how many rows each condition holds for."""
    return df.agg(*(F.count_if(c).alias(name) for name, c in conditions.items()))


def status_counts(jobs: DataFrame, kind: str, status: str, statuses: list[str]) -> DataFrame:
    """AGG-13. A row a kind and a column a known status, zero where there is none."""
    return jobs.groupBy(kind).agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col(status) == s).alias(f"n_{s}") for s in statuses))


def coverage(df: DataFrame, done: Column, per_hour: float = 230.0) -> DataFrame:
    """AGG-16. Total, done, remaining, percent done and hours left; nothing to do is 0 percent and 0 hours."""
    out = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("done"))
    left = F.col("total") - F.col("done")
    pct = F.when(F.col("total") > 0, F.col("done") * 100.0 / F.col("total")).otherwise(0.0)
    return out.select("total", "done", left.alias("remaining"), F.round(pct, 2).alias("pct"), F.round(left / per_hour, 2).alias("eta_hours"))


def top_share(df: DataFrame, value: str, top: int) -> DataFrame:
    """AGG-17. The most frequent values, with percent of all rows that have one. Empty strings count below, not above, the line."""
    known = df.where(F.col(value).isNotNull()).agg(F.count(F.lit(1)).alias("known"))
    counts = df.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    top_n = counts.orderBy(F.desc("n"), "value").limit(top)
    return top_n.crossJoin(F.broadcast(known)).select("value", "n", F.round(F.col("n") * 100.0 / F.col("known"), 2).alias("pct"))


def mode_per_group(df: DataFrame, group: Column, name: str, value: str) -> DataFrame:
    """AGG-18, WIN-07. The most frequent value of each group, the least of several."""
    counts = df.where(F.col(value).isNotNull()).groupBy(group.alias(name), F.col(value).alias("mode")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(name).orderBy(F.desc("n"), "mode")
    return counts.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def share_true(df: DataFrame, group: Column, name: str, flag: Column, score: Column) -> DataFrame:
    """AGG-19. Rows, percent flagged and average score (null as 0) of each group."""
    return df.groupBy(group.alias(name)).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.count_if(flag) * 100.0 / F.count(F.lit(1)), 2).alias("flag_pct"), F.round(F.avg(F.coalesce(score, F.lit(0.0))), 4).alias("avg_score")
    )


def period_compare(df: DataFrame, ts: str, value: str, periods: dict[str, tuple[str, str]]) -> DataFrame:
    """AGG-20. The same aggregates of two half-open periods and the second less the first, from one scan."""
    (a, b) = periods
    inside = {p: (F.col(ts) >= F.lit(lo).cast("timestamp")) & (F.col(ts) < F.lit(hi).cast("timestamp")) for p, (lo, hi) in periods.items()}
    out = df.agg(*(x for p in (a, b) for x in (F.count_if(inside[p]).alias(f"n_{p}"), F.round(F.avg(F.when(inside[p], F.col(value))), 4).alias(f"avg_{p}"))))
    return out.withColumns({"n_delta": F.col(f"n_{b}") - F.col(f"n_{a}"), "avg_delta": F.round(F.col(f"avg_{b}") - F.col(f"avg_{a}"), 4)})


def tag_lift(rows: DataFrame, tags: Column, flag: Column, support: int = 3, floor: float = 0.0001, top: int = 25) -> DataFrame:
    """AGG-21. Tags by how much likelier they are among flagged rows. Occurrences count; denominators are all rows of each kind."""
    counts = rows.agg(F.count_if(flag).alias("n_flag"), F.count_if(~flag).alias("n_other"))
    each = rows.select(flag.alias("flag"), F.explode(tags).alias("tag")).where("tag <> ''")
    each = each.groupBy("tag").agg(F.count_if("flag").alias("in_flag"), F.count_if(~F.col("flag")).alias("in_other")).where(F.col("in_flag") >= support)
    rate = F.when(F.col("n_flag") > 0, F.col("in_flag") / F.col("n_flag")).otherwise(0.0)
    other = F.when(F.col("n_other") > 0, F.col("in_other") / F.col("n_other")).otherwise(0.0)
    out = each.crossJoin(F.broadcast(counts)).select("tag", "in_flag", "in_other", F.round(rate / F.greatest(other, F.lit(floor)), 6).alias("lift"))
    return out.orderBy(F.desc("lift"), "tag").limit(top)


def referral_shares(bookings: DataFrame, source: str, amount: Column, labels: list[str]) -> DataFrame:
    """AGG-22, AGG-25. Bookings and revenue by source, null and 'unknown' apart, with whether the lower-cased label is a referral and its share."""
    by = bookings.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("bookings"), F.round(F.sum(amount), 2).alias("revenue"))
    total = F.col("all_bookings")
    by = by.crossJoin(F.broadcast(bookings.agg(F.count(F.lit(1)).alias("all_bookings"))))  # one row
    return by.select("source", "bookings", "revenue", F.coalesce(F.lower("source").isin(labels), F.lit(False)).alias("is_referral"), F.round(F.col("bookings") * 100.0 / total, 2).alias("pct"))


def content_gaps(posts: DataFrame, genre: str) -> DataFrame:
    """AGG-35. Genres with fewer posts than half the mean over the genres that have any."""
    by = posts.where(F.col(genre).isNotNull()).groupBy(F.col(genre).alias("genre")).agg(F.count(F.lit(1)).alias("posts"))
    mean = by.agg(F.avg("posts").alias("mean"))
    return by.crossJoin(F.broadcast(mean)).where("posts < 0.5 * mean").select("genre", "posts", F.round("mean", 4).alias("mean_posts"))


def turnaround(pairs: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """AGG-29. Mean days, with fractions, from start to end of each group."""
    days = F.timestamp_diff("MICROSECOND", F.col(start), F.col(end)) / 86_400_000_000
    return pairs.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(days), 4).alias("avg_days"))


def estimate_completion(shoots: DataFrame, history: DataFrame, genre: str, windows: dict[str, int], default: int = 14) -> DataFrame:
    """AGG-31. Days to delivery of each shoot: its genre's rounded mean, else its delivery window, else the default."""
    window = F.coalesce(F.create_map(*(F.lit(x) for kv in windows.items() for x in kv))[F.col(genre)], F.lit(default)) if windows else F.lit(default)
    return shoots.join(checked(history), genre, "left").withColumn("estimate_days", F.coalesce(F.round("avg_days").cast("int"), window))


def median_recent(jobs: DataFrame, kind: str, ts: str, key: str, duration: str, last: int = 20) -> DataFrame:
    """AGG-39. The exact median of the positive durations among the last jobs of each kind; the limit comes before the filter."""
    recent = best(jobs.select(kind, ts, key, duration), [kind], [F.desc(ts), F.desc(key)], last).where(F.col(duration) > 0)
    return recent.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.round(F.median(duration), 4).alias("median_duration"))


def lifetime_value(clients: DataFrame, key: str, first: Column, revenue: Column, as_of: str) -> DataFrame:
    """AGG-34. Revenue by year since the first booking, a year at least."""
    years = F.greatest(F.datediff(F.lit(as_of).cast("date"), first) / 365.25, F.lit(1.0))
    return clients.select(key, F.round(revenue, 2).alias("revenue"), F.round(revenue / years, 2).alias("ltv_per_year"))


def repurpose(shoots: DataFrame, images: DataFrame, on: str, ready: Column, posted: Column, score: Column, unused: int) -> DataFrame:
    """AGG-26, JOIN-06. Shoots with at least so many ready and unposted images, with percent posted and average score of the ready ones."""
    by = images.groupBy(on).agg(
        F.count_if(ready).alias("ready"),
        F.count_if(ready & ~posted).alias("unused"),
        F.round(F.count_if(ready & posted) * 100.0 / F.nullif(F.count_if(ready), F.lit(0)), 2).alias("pct_posted"),
        F.round(F.avg(F.when(ready, score)), 4).alias("avg_quality"),
    )
    return shoots.join(by.where(F.col("unused") >= unused), on)
