"""Filters, projections, functions, sets and the job queue over the harness tables, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from contactsheet.functions import scoring as S
from contactsheet.functions import text as T
from contactsheet.operators import compare as C
from contactsheet.operators import filters as L
from contactsheet.operators import jobs as Q
from contactsheet.plans.media import query, table

c = F.col


@query("""
SELECT p_partkey, p_brand FROM part WHERE p_type = 'ECONOMY' AND p_size >= 10 ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 20""")
def flt_browse_page(spark, d):
    where = L.all_of(c("p_type") == "ECONOMY", None, c("p_size") >= 10)
    return L.page(table(spark, d, "part").where(where), [F.desc("p_retailprice"), c("p_partkey")], 2, 20).select("p_partkey", "p_brand")


@query("SELECT count(*) AS total, greatest(1, ceil(count(*) / 20.0))::BIGINT AS pages FROM part WHERE p_size >= 10")
def flt_page_count(spark, d):
    return L.page_count(table(spark, d, "part").where("p_size >= 10"), 20)


@query("SELECT c_custkey FROM customer WHERE c_name ILIKE '%customer#00000001%' OR c_mktsegment ILIKE '%machin%'")
def flt_client_search(spark, d):
    return table(spark, d, "customer").where(c("c_name").ilike("%customer#00000001%") | c("c_mktsegment").ilike("%machin%")).select("c_custkey")


@query("""
SELECT count(*) FILTER (WHERE x <> 1) AS strict, count(*) FILTER (WHERE x IS NULL OR x <> 1) AS inclusive FROM (SELECT CASE WHEN p_size % 3 > 0 THEN p_size % 3 END AS x FROM part)""")
def flt_null_aware_not_equal(spark, d):
    p = table(spark, d, "part").select(F.expr("CASE WHEN p_size % 3 > 0 THEN p_size % 3 END AS x"))
    return p.agg(F.count_if(L.not_equal(c("x"), 1, False)).alias("strict"), F.count_if(L.not_equal(c("x"), 1, True)).alias("inclusive"))


@query("SELECT page_id FROM pages WHERE url NOT ILIKE '%/EN/%' AND url NOT ILIKE '%utm_%'")
def flt_not_like(spark, d):
    return table(spark, d, "pages").where(L.outside(c("url"), "%/EN/%", "%utm_%")).select("page_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1998-02-01' AND DATE '1998-02-07'")
def flt_between_dates(spark, d):
    return table(spark, d, "orders").where(F.to_date("o_orderdate").between("1998-02-01", "1998-02-07")).select("o_orderkey")


@query("""
SELECT page_id, CASE WHEN regexp_extract(url, '\\.[^./]*$') IN ('.html', '.htm') THEN 'page' ELSE 'other' END AS kind FROM pages""")
def flt_extension_set(spark, d):
    return table(spark, d, "pages").select("page_id", F.when(T.extension(c("url")).isin(".html", ".htm"), "page").otherwise("other").alias("kind"))


@query("""
SELECT p_partkey FROM part WHERE p_retailprice > 1e9 UNION ALL SELECT p_partkey FROM part WHERE p_size = 1 AND NOT EXISTS (SELECT 1 FROM part WHERE p_retailprice > 1e9)""")
def srt_fallback(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    return L.with_fallback(p.where("p_retailprice > 1e9"), p.where("p_size = 1")).select("p_partkey")


@query("SELECT p_partkey FROM part ORDER BY (p_size % 2 = 0) DESC, p_retailprice DESC NULLS LAST, p_partkey LIMIT 50")
def srt_computed_key(spark, d):
    return table(spark, d, "part").orderBy(F.desc(c("p_size") % 2 == 0), F.desc_nulls_last("p_retailprice"), "p_partkey").limit(50).select("p_partkey")


def nima():
    return c("l_quantity") / 5


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN q >= 6.68 THEN 'Exceptional' WHEN q >= 6.52 THEN 'Strong' WHEN q >= 6.22 THEN 'Solid' WHEN q >= 5.99 THEN 'Weak' ELSE 'Low' END AS band,
 CASE WHEN q >= 7 THEN 'fine_art' WHEN q >= 6.5 THEN 'standard' ELSE 'below_threshold' END AS print FROM (SELECT *, l_quantity / 5 AS q FROM lineitem)""")
def prj_tier_bands(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.banded(nima(), S.RESULT_BANDS, "Low").alias("band"), S.banded(nima(), S.PRINT_TIERS, "below_threshold").alias("print"))


@query("""
SELECT o_orderkey, CASE WHEN o_totalprice < 2000 THEN 'Missing' WHEN o_orderstatus = 'P' THEN 'Culled' WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'Posted'
 WHEN o_orderstatus = 'F' THEN 'Ready' ELSE 'Scored' END AS status FROM orders""")
def prj_status_ladder(spark, d):
    s, p = c("o_orderstatus"), c("o_orderpriority")
    steps = [(c("o_totalprice") < 2000, "Missing"), (s == "P", "Culled"), ((s == "F") & (p == "1-URGENT"), "Posted"), (s == "F", "Ready")]
    return table(spark, d, "orders").select("o_orderkey", S.ladder(steps, "Scored").alias("status"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN least(a, b, e) < 5 THEN CASE WHEN a = least(a, b, e) THEN 'dof' WHEN b = least(a, b, e) THEN 'balance' ELSE 'thirds' END END AS weakness
FROM (SELECT l_orderkey, l_linenumber, l_quantity / 5 AS a, l_discount * 100 AS b, CASE WHEN l_tax > 0.02 THEN l_tax * 100 END AS e FROM lineitem)""")
def prj_weakness_argmin(spark, d):
    scores = {"dof": nima(), "balance": c("l_discount") * 100, "thirds": F.when(c("l_tax") > 0.02, c("l_tax") * 100)}
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.weakest(scores).alias("weakness"))


@query("""
SELECT doc_id, substr(coalesce(nullif(CASE WHEN lang = 'en' THEN '' ELSE lang END, ''), text), 1, 180) AS note FROM documents""")
def prj_note_fallback(spark, d):
    return table(spark, d, "documents").select("doc_id", S.note(F.when(c("lang") == "en", "").otherwise(c("lang")), c("text")).alias("note"))


@query("""
SELECT l_orderkey, l_linenumber, round(least((l_linenumber * 2.0::DOUBLE + l_quantity / 5 + l_discount * 100) / 30 * 10, 10), 4) AS trust,
 round(0.6::DOUBLE * (l_quantity / 5) + 0.4::DOUBLE * (l_discount * 100), 6) AS combined FROM lineitem""")
def prj_trust_and_combined(spark, d):
    quality = c("l_discount") * 100
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.trust(c("l_linenumber"), nima(), quality).alias("trust"), F.round(S.combined(nima(), quality), 6).alias("combined"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 7.5 ELSE greatest(0, least(10,
 CASE WHEN f BETWEEN 4 AND 8 THEN 2.5 WHEN f >= 2.8 AND f < 4 OR f > 8 AND f <= 11 THEN 1.5 WHEN f >= 1.4 AND f < 2.8 OR f > 11 AND f <= 16 THEN 0.5 ELSE 0 END
 + CASE WHEN i <= 400 THEN 2.5 WHEN i <= 1600 THEN 1.5 WHEN i <= 3200 THEN 0.5 WHEN i <= 6400 THEN -0.5 ELSE -1 END + 5)) END::DOUBLE AS exif
FROM (SELECT *, l_quantity / 2.5 AS f, l_partkey % 8000 AS i FROM lineitem)""")
def prj_exif_score(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.exif_score(c("l_quantity") / 2.5, c("l_partkey") % 8000, c("l_returnflag") == "R").alias("exif"))


@query("""
SELECT event_id, CASE WHEN h >= 5 AND h < 7 THEN 'blue_hour_morning' WHEN h >= 7 AND h < 9 THEN 'golden_hour_morning' WHEN h >= 9 AND h < 16 THEN 'midday'
 WHEN h >= 16 AND h < 19 THEN 'golden_hour_evening' WHEN h >= 19 AND h < 21 THEN 'blue_hour_evening' ELSE 'night' END AS time_of_day,
 CASE WHEN month(ts) IN (12, 1, 2) THEN 'winter' WHEN month(ts) <= 5 THEN 'spring' WHEN month(ts) <= 8 THEN 'summer' ELSE 'autumn' END AS season FROM (SELECT *, hour(ts) AS h FROM events)""")
def prj_season_and_hour(spark, d):
    return table(spark, d, "events").select("event_id", S.time_of_day(c("ts")).alias("time_of_day"), S.season(c("ts")).alias("season"))


@query("""
SELECT doc_id, CASE WHEN w > k THEN 'warm' WHEN k > w THEN 'cool' ELSE 'neutral' END AS palette FROM (SELECT doc_id,
 contains(lower(text), 'the')::INT + contains(lower(text), 'ion')::INT AS w, contains(lower(text), 'que')::INT + contains(lower(text), 'ung')::INT AS k FROM documents)""")
def prj_palette(spark, d):
    return table(spark, d, "documents").select("doc_id", S.palette(c("text"), ["the", "ion"], ["que", "ung"]).alias("palette"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 17 = 0 OR pct >= 100 THEN 'sold_out' WHEN pct >= 80 THEN 'near_sold_out' WHEN pct >= 50 THEN 'half_sold' END AS alert FROM (SELECT *, p_size * 2.0 AS pct FROM part)""")
def prj_edition_alert(spark, d):
    return table(spark, d, "part").select("p_partkey", S.edition_alert(c("p_size"), F.lit(50), c("p_size") % 17 == 0).alias("alert"))


@query("""
WITH a AS (SELECT l_orderkey AS k, max(l_quantity) AS q, max(l_tax) AS t FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), b AS (SELECT l_orderkey AS k, max(l_quantity) AS q, max(l_tax) AS t FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1),
j AS (SELECT k, unnest([a.q, a.t]) AS x, unnest([b.q, b.t]) AS y FROM a JOIN b USING (k)), e AS (SELECT k, CASE WHEN round(y - x, 6) >= 0.001 THEN 1 WHEN round(y - x, 6) <= -0.001 THEN -1 ELSE 0 END AS s FROM j)
SELECT k, CASE WHEN max(s) > 0 AND min(s) < 0 THEN 'mixed' WHEN max(s) > 0 THEN 'improved' WHEN min(s) < 0 THEN 'regressed' ELSE 'unchanged' END AS status FROM e GROUP BY 1""")
def prj_delta_status(spark, d):
    by = lambda s: table(spark, d, "lineitem").where(c("l_linestatus") == s).groupBy(c("l_orderkey").alias("k")).agg(F.max("l_quantity").alias("q"), F.max("l_tax").alias("t"))
    return C.verdicts(C.deltas(by("F"), by("O"), "k", ["q", "t"]), "k")


@query("SELECT DISTINCT p_type AS g FROM part UNION SELECT DISTINCT c_mktsegment FROM customer")
def set_union_distinct(spark, d):
    return C.union_distinct(table(spark, d, "part").select(c("p_type").alias("g")), table(spark, d, "customer").select(c("c_mktsegment").alias("g")))


@query("SELECT p_brand FROM part EXCEPT SELECT p_brand FROM part WHERE p_retailprice > 1980")
def set_difference(spark, d):
    p = table(spark, d, "part")
    return C.difference(p.select("p_brand"), p.where("p_retailprice > 1980").select("p_brand"))


@query("""
WITH w AS (SELECT doc_id, i, x FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS x, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents)),
f AS (SELECT doc_id, x, i, row_number() OVER (PARTITION BY doc_id, lower(x) ORDER BY i) AS r FROM w)
SELECT doc_id, array_to_string(list(x ORDER BY i), ' ') AS tags FROM f WHERE r = 1 GROUP BY 1""")
def set_ordered_dedup(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.first_wins(F.split("text", " ")), " ").alias("tags"))


@query("SELECT p_partkey, array_to_string(list_concat(list_filter([90, 30, p_size], lambda x: x IN (10, 30, 50 + 10, p_size)), list_filter([10, 30, 60, p_size], lambda x: x NOT IN (90, 30, p_size))), ',') AS wanted FROM (SELECT p_partkey, p_size + 100 AS p_size FROM part)")
def set_desired_order(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.expr("array(90, 30, p_size + 100) AS asked"), F.expr("array(10, 30, 60, p_size + 100) AS now"))
    return p.select("p_partkey", F.array_join(C.desired_order("now", "asked").cast("array<string>"), ",").alias("wanted"))


@query("SELECT event_type, count(*) AS n, sum(k)::BIGINT AS total FROM (SELECT event_type, json_extract(props, '$.k')::BIGINT AS k FROM events) GROUP BY 1")
def fn_json_extract(spark, d):
    e = table(spark, d, "events").withColumn("p", F.from_json("props", "k long"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p.k").alias("total"))


@query("SELECT l_orderkey, x AS part FROM (SELECT l_orderkey, unnest(list_sort(list(l_partkey))) AS x FROM lineitem WHERE l_quantity > 40 GROUP BY 1)")
def fn_json_explode(spark, d):
    """A JSON list of ids, as licences hold them, made and taken apart again."""
    packed = table(spark, d, "lineitem").where("l_quantity > 40").groupBy("l_orderkey").agg(F.to_json(F.collect_list("l_partkey")).alias("ids"))
    return packed.select("l_orderkey", F.explode(F.from_json("ids", "array<long>")).alias("part"))


@query("""
SELECT o_orderkey, ['wedding', 'portrait', 'boudoir', 'commercial', 'events', 'nature'][((week(o_orderdate) - 1) % 6) + 1] AS genre,
 ['transformation', 'genre_spotlight', 'bts', 'social_proof', 'personality', 'flexible', 'flexible'][isodow(o_orderdate)] AS pillar FROM orders""")
def fn_iso_week_rotation(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.iso_week_genre(c("o_orderdate")).alias("genre"), S.pillar(c("o_orderdate")).alias("pillar"))


@query(r"""
SELECT page_id, len(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>')) AS n_links, array_to_string(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1), ' ') AS hrefs FROM pages""")
def fn_html_links(spark, d):
    p = table(spark, d, "pages").select("page_id", T.links(c("html")).alias("l"))
    return p.select("page_id", F.size("l").cast("long").alias("n_links"), F.array_join("l.href", " ").alias("hrefs"))


@query("""
SELECT page_id, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS html,
 page_id || chr(9) || translate(url, chr(9) || chr(10) || chr(13), '   ') AS line FROM pages""")
def fn_escape_and_tsv(spark, d):
    return table(spark, d, "pages").select("page_id", T.escaped(c("url")).alias("html"), T.tsv_line(c("page_id"), c("url")).alias("line"))


@query("""
SELECT c_custkey, CASE WHEN this >= DATE '2001-06-01' THEN this ELSE later END::VARCHAR AS next FROM (SELECT c_custkey,
 try_cast('2001-' || strftime(o, '%m-%d') AS DATE) AS this, try_cast('2002-' || strftime(o, '%m-%d') AS DATE) AS later FROM
 (SELECT o_custkey AS c_custkey, min(o_orderdate) AS o FROM orders GROUP BY 1)) WHERE this IS NOT NULL""")
def fn_next_anniversary(spark, d):
    first = table(spark, d, "orders").groupBy(c("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").alias("o"))
    out = first.select("c_custkey", S.next_anniversary(c("o"), F.lit("2001-06-01").cast("date")).alias("next"))
    return out.where("next IS NOT NULL").withColumn("next", c("next").cast("string"))


@query("""
SELECT conv_id, array_to_string(list(text ORDER BY turn DESC), ' / ') AS recent FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3 GROUP BY 1""")
def win_recent_captions(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = table(spark, d, "conversations").withColumn("r", F.row_number().over(w)).where("r <= 3")
    return last.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "text"))), lambda x: x["text"]), " / ").alias("recent"))


JOB_COLUMNS = [
    "event_id AS id", "event_type AS job_type", "user_id AS image_id",
    "CASE event_id % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'complete' WHEN 3 THEN 'error' ELSE 'queued' END AS status",
    "user_id % 11 AS priority", "event_id % 4 AS attempts", "ts AS queued_at", "ts AS started_at", "CASE WHEN event_id % 3 > 0 THEN ts END AS heartbeat_at",
]
JOBS = f"SELECT {', '.join(JOB_COLUMNS)} FROM events"


def jobs_of(spark, d):
    return table(spark, d, "events").selectExpr(*JOB_COLUMNS)


@query(f"""
WITH j AS ({JOBS}), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, job_type ORDER BY id DESC) AS r FROM j) WHERE r = 1),
q AS (SELECT c_custkey AS image_id, t AS job_type, max(c_custkey % 13) AS asked FROM customer, unnest(['click', 'view', 'print']) u(t) GROUP BY ALL),
m AS (SELECT q.*, l.id, l.priority, CASE WHEN status IS NULL THEN 'insert' WHEN status IN ('complete', 'running') THEN 'reuse' WHEN status = 'error' AND attempts >= 3 THEN 'reuse' WHEN status = 'error' THEN 'requeue'
 WHEN asked > priority THEN 'raise' ELSE 'reuse' END AS action FROM q LEFT JOIN l USING (image_id, job_type))
SELECT image_id, job_type, id AS job_id, action, CASE WHEN action = 'reuse' THEN priority ELSE greatest(asked, coalesce(priority, 0)) END AS new_priority FROM m""")
def mut_enqueue_plan(spark, d):
    asked = table(spark, d, "customer").select(c("c_custkey").alias("image_id"), F.explode(F.array(*map(F.lit, ["click", "view", "print"]))).alias("job_type"), (c("c_custkey") % 13).alias("priority"))
    return Q.enqueue_plan(asked, jobs_of(spark, d))


@query(f"""
WITH j AS ({JOBS}), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, job_type ORDER BY id DESC) AS r FROM j) WHERE r = 1),
q AS (SELECT c_custkey AS image_id, 'click' AS job_type FROM customer)
SELECT image_id, job_type, id AS job_id, CASE WHEN status IS NULL THEN 'create' WHEN status = 'complete' THEN 'noop' WHEN status = 'error' THEN 'requeue' WHEN priority >= 8 THEN 'noop' ELSE 'bump' END AS action FROM q LEFT JOIN l USING (image_id, job_type)""")
def mut_bump_plan(spark, d):
    asked = table(spark, d, "customer").select(c("c_custkey").alias("image_id"), F.lit("click").alias("job_type"))
    return Q.bump_plan(asked, jobs_of(spark, d), 8)


@query(f"""
WITH j AS ({JOBS}) SELECT id FROM j WHERE status = 'running' AND CASE WHEN heartbeat_at IS NOT NULL THEN epoch(TIMESTAMP '2024-01-20') - epoch(date_trunc('second', heartbeat_at)) > 300
 ELSE epoch(TIMESTAMP '2024-01-20') - epoch(date_trunc('second', started_at)) > 900 END""")
def str_stale_heartbeats(spark, d):
    return Q.stuck(jobs_of(spark, d), "2024-01-20 00:00:00").select("id")


@query(f"""
WITH j AS ({JOBS}) SELECT id FROM j WHERE job_type = 'click' AND status = 'queued' AND attempts < 3 AND priority >= 3 AND image_id % 7 <> 0 AND image_id IN (SELECT c_custkey FROM customer) ORDER BY priority DESC, queued_at, id LIMIT 50""")
def mut_fetch_batch(spark, d):
    images = table(spark, d, "customer").select(c("c_custkey").alias("id")).select("id", F.expr("CASE WHEN id % 7 = 0 THEN 'corrupt' WHEN id % 5 = 0 THEN NULL ELSE 'pass' END AS pass1_status"))
    return Q.fetch_batch(jobs_of(spark, d), images, "click", 50, 3).select("id")


@query("""
SELECT coalesce(c_custkey, o_custkey) AS k, CASE WHEN o_custkey IS NOT NULL THEN rating ELSE c_acctbal END AS rating, coalesce(c_name, name) AS name
FROM (SELECT * FROM customer WHERE c_acctbal >= 0) FULL JOIN (SELECT o_custkey, max(o_totalprice) AS rating, max(o_orderpriority) AS name FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def mut_upsert(spark, d):
    old = table(spark, d, "customer").where("c_acctbal >= 0").select(c("c_custkey").alias("k"), c("c_acctbal").alias("rating"), c("c_name").alias("name"))
    new = table(spark, d, "orders").groupBy(c("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("rating"), F.max("o_orderpriority").alias("name"))
    return Q.upsert(old, new, "k", ["rating"], ["name"])


@query("""
SELECT event_type, time_bucket(INTERVAL 5 MINUTE, ts)::VARCHAR AS slot, count(*) AS n FROM events GROUP BY 1, 2""")
def str_throughput_buckets(spark, d):
    e = table(spark, d, "events").withColumn("ts", c("ts").cast("timestamp"))
    out = e.groupBy("event_type", F.window("ts", "5 minutes")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("event_type", F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("slot"), "n")


@query("""
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM
 (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR * i FOR i IN range(0, 8)]) AS s FROM events) GROUP BY 1""")
def str_rolling_throughput(spark, d):
    """STR-03, STR-04: the last eight hours every hour, as a sliding window; the streaming form is in contactsheet.streaming."""
    e = table(spark, d, "events").withColumn("ts", c("ts").cast("timestamp"))
    out = e.groupBy(F.window("ts", "8 hours", "1 hour")).agg(F.count(F.lit(1)).alias("n"), F.count_if(c("event_type") == "error").alias("errors"))
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "n", "errors")


# Kernels and streams


@query("""
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR * i FOR i IN range(0, 8)]) AS s FROM events) GROUP BY 1""")
def str_stream_rolling(spark, d):
    """STR-04 as a stream that runs over all files there are and ends."""
    from uuid import uuid4

    from contactsheet.streaming import streams

    events = table(spark, d, "events")
    base = f"{spark.conf.get('spark.checkpoint.dir')}/stream-{uuid4()}"  # shared by driver and executors; an error where it isn't set
    stream = streams.read_events(spark, d, "events.parquet", events.schema).withColumn("ts", c("ts").cast("timestamp"))
    streams.run_once(streams.rolling(stream, "ts", "8 hours", "1 hour", F.count(F.lit(1)).alias("n")), f"{base}/out", f"{base}/state", "complete")
    return spark.read.parquet(f"{base}/out").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "n")
