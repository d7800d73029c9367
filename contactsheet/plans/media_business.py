"""Workload, tiers, upsell, editions, slots, health and diagnosis over the harness tables, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from contactsheet.functions import scoring as S
from contactsheet.functions import text as T
from contactsheet.operators import business as B
from contactsheet.operators import jobs as Q
from contactsheet.plans.media import paid, query, table

c = F.col


@query("""
WITH s AS (SELECT o_orderdate::DATE AS d, o_orderstatus = 'F' AS done, CASE o_orderpriority WHEN '1-URGENT' THEN 7 WHEN '2-HIGH' THEN 28 ELSE 14 END AS w FROM orders)
SELECT count(*) FILTER (WHERE NOT done AND d <= DATE '2001-06-01') AS in_queue, count(*) FILTER (WHERE NOT done AND d <= DATE '2001-06-01' AND d + w < DATE '2001-06-01') AS overdue,
 count(*) FILTER (WHERE NOT done AND d <= DATE '2001-06-01' AND d + w BETWEEN DATE '2001-06-01' AND DATE '2001-06-08') AS due_this_week FROM s""")
def agg_workload(spark, d):
    return B.workload(table(spark, d, "orders"), "o_orderpriority", F.to_date("o_orderdate"), paid(), {"1-URGENT": 7, "2-HIGH": 28}, "2001-06-01")


@query("""
WITH t AS (SELECT p_partkey FROM part ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 100),
x AS (SELECT CASE WHEN p_partkey IN (SELECT * FROM t) THEN 1 WHEN p_type = 'PROMO' THEN 2 WHEN p_retailprice >= 1500 THEN 3 ELSE 4 END AS tier, p_size > 25 AS done FROM part)
SELECT tier, count(*) AS total, count(*) FILTER (WHERE done) AS complete, count(*) FILTER (WHERE NOT done) AS remaining FROM x GROUP BY 1""")
def agg_priority_tiers(spark, d):
    return B.tier_progress(table(spark, d, "part"), "p_partkey", "p_retailprice", c("p_type") == "PROMO", c("p_size") > 25, 100, 1500.0)


@query("""
SELECT l_orderkey, o_custkey, worthy, round(worthy * 85.0::DOUBLE, 2) AS "least", round(worthy * 450.0::DOUBLE, 2) AS most FROM
 (SELECT l_orderkey, count(*) AS worthy FROM lineitem WHERE l_quantity >= 45 GROUP BY 1) JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'""")
def agg_upsell(spark, d):
    bookings = table(spark, d, "orders").where(paid()).select(c("o_orderkey").alias("l_orderkey"), "o_custkey")
    return B.upsell(bookings, table(spark, d, "lineitem"), "l_orderkey", c("l_quantity") >= 45, (85.0, 450.0))


@query("""
WITH s AS (SELECT l_partkey AS p_partkey, count(*) AS sold, round(sum(CASE WHEN l_discount <> 0 THEN round(l_extendedprice - l_quantity, 2) ELSE l_extendedprice END), 2) AS margin FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
SELECT p_partkey, p_size, coalesce(sold, 0)::BIGINT AS sold, coalesce(margin, 0.0) AS margin, greatest(0, p_size - coalesce(sold, 0))::BIGINT AS "left", coalesce(sold, 0) >= p_size AS retired FROM part LEFT JOIN s USING (p_partkey)""")
def mut_edition_sales(spark, d):
    sales = table(spark, d, "lineitem").where("l_returnflag = 'A'")
    return B.editions(table(spark, d, "part"), "p_partkey", "p_size", sales, "l_partkey", c("l_extendedprice"), F.when(c("l_discount") != 0, c("l_quantity")))


@query("""
SELECT o_orderkey FROM (SELECT o_orderkey, o_orderdate::DATE AS day, o_orderpriority, row_number() OVER (PARTITION BY o_orderdate::DATE, o_orderpriority ORDER BY o_orderkey) AS r FROM orders WHERE o_orderstatus = 'O') q
WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_orderstatus = 'F' AND p.o_orderdate::DATE = q.day AND p.o_orderpriority = q.o_orderpriority)""")
def mut_free_slots(spark, d):
    o = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    return B.free_slots(o.where("o_orderstatus = 'O'").select("o_orderkey", "day", "o_orderpriority"), o.where("o_orderstatus = 'F'"), ["day", "o_orderpriority"], "o_orderkey").select("o_orderkey")


@query("""
SELECT p_partkey, round(p_retailprice / 1000 + CASE WHEN p_type IN ('PROMO', 'SMALL') THEN 0.25 ELSE 0 END, 6) AS boosted FROM part""")
def srt_season_boost(spark, d):
    return B.season_boosted(table(spark, d, "part"), c("p_retailprice") / 1000, c("p_type"), ["PROMO", "SMALL"]).select("p_partkey", "boosted")


@query("""
SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE value > 195) AS critical,
 CASE WHEN count(*) FILTER (WHERE value > 195) > 0 THEN 'red' WHEN count(*) FILTER (WHERE event_type = 'error') > 3 THEN 'yellow' ELSE 'green' END AS health FROM events GROUP BY time_bucket(INTERVAL 1 HOUR, ts)""")
def str_health_by_hour(spark, d):
    e = table(spark, d, "events").groupBy(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss").alias("hour"))
    out = e.agg(F.count_if(c("event_type") == "error").alias("errors"), F.count_if(c("value") > 195).alias("critical"))
    return out.withColumn("health", S.ladder([(c("critical") > 0, "red"), (c("errors") > 3, "yellow")], "green"))


@query("""
SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN trim(coalesce(text, '')) = '' THEN 'no caption' END, CASE WHEN length(text) > 220 THEN 'too long' END], lambda x: x IS NOT NULL), ', ') AS issues FROM conversations""")
def fn_caption_issues(spark, d):
    none = F.array().cast("array<string>")
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.caption_issues(c("text"), none, most=220), ", ").alias("issues"))


@query("SELECT p_type AS genre, count(*) AS images, count(*) FILTER (WHERE p_size > 25) AS portfolio, round(avg(0.6::DOUBLE * p_retailprice + 0.4::DOUBLE * p_size), 4) AS avg_score, round(max(0.6::DOUBLE * p_retailprice + 0.4::DOUBLE * p_size), 4) AS best_score FROM part GROUP BY 1")
def agg_portfolio_summary(spark, d):
    score = S.combined(c("p_retailprice"), c("p_size"))
    return table(spark, d, "part").groupBy(c("p_type").alias("genre")).agg(
        F.count(F.lit(1)).alias("images"), F.count_if(c("p_size") > 25).alias("portfolio"), F.round(F.avg(score), 4).alias("avg_score"), F.round(F.max(score), 4).alias("best_score")
    )


@query("""
SELECT p_partkey, len(s) AS n, list_aggregate(s, 'max') AS most FROM (SELECT p_partkey, CASE WHEN p_size >= 40 THEN [450.0, 280.0] WHEN p_size >= 20 THEN [280.0] ELSE [85.0] END::DOUBLE[] AS s FROM part)""")
def prj_suggested_prints(spark, d):
    steps = [(40, [("24x36", 450.0), ("16x24", 280.0)]), (20, [("16x24", 280.0)]), (0, [("8x12", 85.0)])]
    p = table(spark, d, "part").select("p_partkey", S.suggested_prints(c("p_size"), steps).alias("s"))
    return p.select("p_partkey", F.size("s").cast("long").alias("n"), F.array_max(F.transform("s", lambda x: x["price"])).alias("most"))
