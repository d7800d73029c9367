"""Candidates, calendars, ratings, job changes, client and content figures and plain expressions over the harness tables, with SQL.

Images are parts, posts are orders, jobs are events, clients customers; the columns are made by expressions that both engines read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from contactsheet.functions import scoring as S
from contactsheet.functions import text as T
from contactsheet.operators import filters as L
from contactsheet.operators import jobs as Q
from contactsheet.operators import joins as J
from contactsheet.operators import publishing as P
from contactsheet.operators.ranks import numbered
from contactsheet.plans.media import KEEPERS_SQL, bursts, paid, query, table

c = F.col

IMAGE_COLUMNS = [
    "p_partkey AS id",
    "'/lib/' || p_brand || '/' || CASE WHEN p_partkey % 23 = 0 THEN '._' WHEN p_partkey % 29 = 0 THEN '.x' ELSE '' END || 'img' || CAST(p_partkey AS STRING) || CASE p_partkey % 4 WHEN 0 THEN '.ARW' WHEN 1 THEN '.jpg' WHEN 2 THEN '-edit.tif' ELSE '.dng' END AS file_path",
    "CASE WHEN p_size % 9 > 0 THEN p_type END AS genre", "CASE WHEN p_size % 7 > 0 THEN 'mood' || CAST(p_size % 7 AS STRING) END AS mood",
    "CASE WHEN p_partkey % 5 > 0 THEN 1 END AS pass1_at", "CASE p_partkey % 11 WHEN 0 THEN 'fail' WHEN 1 THEN 'raw_review' ELSE 'pass' END AS pass1_status",
    "CASE WHEN p_partkey % 3 > 0 THEN 1 END AS pass2_at", "CASE WHEN p_partkey % 7 = 0 THEN 1 END AS pass3_at",
    "CASE WHEN p_partkey % 13 > 0 THEN 3 + CAST(p_partkey * 37 % 500 AS DOUBLE) / 100 END AS nima", "CASE WHEN p_size % 6 > 0 THEN CAST(p_size AS DOUBLE) / 5 END AS quality",
    "CASE WHEN p_partkey % 4 > 0 THEN CAST(p_partkey * 7 % 100 AS DOUBLE) / 100 END AS grid_fit", "CASE p_size % 5 WHEN 0 THEN 'pick' WHEN 1 THEN 'reject' END AS lr_pick",
    "CASE WHEN p_size % 8 < 3 THEN p_name WHEN p_size % 8 = 3 THEN '' END AS user_context", "p_size % 3 > 0 AS content_ready", "p_size % 4 = 0 AS social_queue", "p_size % 5 > 0 AS print_worthy",
    "CASE p_size % 3 WHEN 0 THEN 'fine_art' WHEN 1 THEN 'standard' END AS print_tier", "CASE WHEN p_size % 10 = 0 THEN 'http://x' WHEN p_size % 10 = 1 THEN '' END AS pixieset_url",
    "CASE WHEN p_partkey % 10 = 0 THEN DATE '2001-05-20' WHEN p_partkey % 10 = 1 THEN DATE '2000-01-01' END AS posted_at", "p_partkey % 17 AS captured_at",
    "CASE WHEN p_partkey % 2 = 0 THEN 'small' ELSE 'large' END AS pass3_model", "p_name AS tags",
]
POST_COLUMNS = [
    "o_orderkey AS post_id", "CASE WHEN o_custkey % 9 > 0 THEN o_custkey END AS image_id", "CASE o_orderstatus WHEN 'F' THEN 'posted' WHEN 'O' THEN 'planned' ELSE 'scheduled' END AS status",
    "CAST(o_orderdate AS DATE) AS post_date", "CASE WHEN o_orderkey % 2 = 0 THEN 'morning' ELSE 'evening' END AS post_time",
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'PROMO' WHEN '2-HIGH' THEN 'LARGE' WHEN '3-MEDIUM' THEN 'SMALL' END AS genre",
]
PASS_COLUMNS = [
    "event_id AS id", "CASE event_type WHEN 'click' THEN 'pass1' WHEN 'view' THEN 'pass2' ELSE 'pass3' END AS job_type", "user_id AS image_id",
    "CASE event_id % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'complete' WHEN 3 THEN 'error' ELSE 'queued' END AS status", "user_id % 11 AS priority", "event_id % 4 AS attempts",
]
WITH = f"""i AS (SELECT {', '.join(IMAGE_COLUMNS)} FROM part), p AS (SELECT {', '.join(POST_COLUMNS)} FROM orders), j AS (SELECT {', '.join(PASS_COLUMNS)} FROM events)"""
RAW_SQL = f"lower(regexp_extract(file_path, '\\.[^./]*$')) IN ({', '.join(repr(x) for x in P.RAW)})"


def images(spark, d):
    return table(spark, d, "part").selectExpr(*IMAGE_COLUMNS)


def posts(spark, d):
    return table(spark, d, "orders").selectExpr(*POST_COLUMNS)


def jobs(spark, d):
    return table(spark, d, "events").selectExpr(*PASS_COLUMNS)


def union(*frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


# Filters and orders


@query(f"WITH {WITH} SELECT id FROM i WHERE NOT starts_with(string_split(file_path, '/')[-1], '._')")
def flt_not_sidecar(spark, d):
    """FLT-10, FLT-11."""
    return images(spark, d).where(~F.element_at(F.split("file_path", "/"), -1).startswith("._")).select("id")


@query(f"WITH {WITH} SELECT id, coalesce(user_context, '') = '' AS no_context FROM i WHERE starts_with(file_path, '/lib/Brand#11/')")
def flt_folder_and_blank(spark, d):
    """FLT-12, FLT-17."""
    return images(spark, d).where(L.in_folder(c("file_path"), "/lib/Brand#11/")).select("id", L.blank(c("user_context")).alias("no_context"))


@query("SELECT event_id FROM events WHERE json_extract(props, '$.k')::BIGINT >= 50 AND event_type IN ('click', 'view')")
def flt_parsed_json(spark, d):
    """FLT-19, as it is meant: the parsed value, and both conditions."""
    return table(spark, d, "events").where((F.from_json("props", "k long")["k"] >= 50) & c("event_type").isin("click", "view")).select("event_id")


@query(f"""
WITH {WITH}, k AS (SELECT id, {RAW_SQL} AS is_raw, EXISTS (SELECT 1 FROM p WHERE p.image_id = i.id AND status <> 'posted') AS scheduled, coalesce(user_context, '') <> '' AS has_user_context,
 coalesce(grid_fit, 0) AS g, coalesce(nima, 0) AS n, captured_at FROM i WHERE content_ready AND posted_at IS NULL),
r AS (SELECT 'grid_fit' AS mode, *, row_number() OVER (ORDER BY is_raw, g DESC, n DESC, id) AS r FROM k UNION ALL SELECT 'nima', *, row_number() OVER (ORDER BY is_raw, n DESC, g DESC, id) FROM k
 UNION ALL SELECT 'recent', *, row_number() OVER (ORDER BY is_raw, captured_at DESC, id DESC) FROM k UNION ALL SELECT 'random', *, row_number() OVER (ORDER BY is_raw, md5('7:' || id), id) FROM k)
SELECT mode, id, is_raw, scheduled, has_user_context FROM r WHERE r <= 40""")
def flt_post_candidates(spark, d):
    """FLT-02, SRT-04: the first forty by each of the four orders."""
    found = P.post_candidates(images(spark, d), posts(spark, d), c("content_ready") & c("posted_at").isNull())
    modes = [found.orderBy(*P.candidate_order(m, 7)).limit(40).withColumn("mode", F.lit(m)) for m in ("grid_fit", "nima", "recent", "random")]
    return union(*modes).select("mode", "id", "is_raw", "scheduled", "has_user_context")


@query(f"""
WITH {WITH}, k AS (SELECT id, social_queue, round(coalesce(grid_fit, 0.6::DOUBLE * coalesce(nima, 0) + 0.4::DOUBLE * coalesce(quality, 0)), 6) AS slot_score FROM i WHERE content_ready AND posted_at IS NULL AND genre IN ('PROMO', 'SMALL'))
SELECT 'ranked' AS mode, id, slot_score FROM k WHERE social_queue UNION ALL SELECT 'never_scheduled', id, slot_score FROM k WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.image_id = k.id) UNION ALL SELECT 'unposted', id, slot_score FROM k""")
def flt_calendar_candidates(spark, d):
    """FLT-03, PRJ-07."""
    of = lambda m: P.calendar_candidates(images(spark, d), posts(spark, d), ["PROMO", "SMALL"], m).select(F.lit(m).alias("mode"), "id", F.round("slot_score", 6).alias("slot_score"))
    return union(*map(of, ("ranked", "never_scheduled", "unposted")))


@query(f"""
WITH {WITH} SELECT id, CASE WHEN print_tier = 'fine_art' THEN 'fine_art' ELSE 'standard' END AS tier, CASE WHEN print_tier = 'fine_art' THEN 450.0 ELSE 85.0 END::DOUBLE AS price, CASE WHEN print_tier = 'fine_art' THEN 25 ELSE 100 END::INT AS edition_size
FROM i WHERE print_worthy AND genre = 'PROMO' AND lower(tags) LIKE '%a%' AND coalesce(pixieset_url, '') = ''""")
def flt_print_candidates(spark, d):
    """FLT-04."""
    prices = spark.createDataFrame([("fine_art", 450.0, 25), ("standard", 85.0, 100)], "tier string, price double, edition_size int")
    return P.print_candidates(images(spark, d), prices, genre="PROMO", tag="A").select("id", "tier", "price", "edition_size")


@query("""
WITH e AS (SELECT event_id, CASE WHEN value > 100 THEN 'high' ELSE 'low' END AS severity, event_id % 3 = 0 AS resolved FROM events WHERE event_type = 'error')
SELECT 'all' AS asked, event_id FROM e UNION ALL SELECT 'open high', event_id FROM e WHERE severity = 'high' AND NOT resolved UNION ALL SELECT 'resolved', event_id FROM e WHERE resolved""")
def flt_errors(spark, d):
    """FLT-05."""
    e = table(spark, d, "events").where("event_type = 'error'").selectExpr("event_id", "CASE WHEN value > 100 THEN 'high' ELSE 'low' END AS severity", "event_id % 3 = 0 AS resolved")
    asked = {"all": (None, None), "open high": ("high", False), "resolved": (None, True)}
    return union(*(P.listed_errors(e, *x).select(F.lit(n).alias("asked"), "event_id") for n, x in asked.items()))


@query("SELECT c_custkey, o_orderkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND n_name ILIKE '%n%'")
def flt_bookings(spark, d):
    """FLT-06, FLT-07: bookings by status and genre with their client, of places whose name has a part."""
    where = L.all_of(c("o_orderstatus") == "F", c("o_orderpriority") == "1-URGENT", None)
    out = table(spark, d, "orders").where(where).join(table(spark, d, "customer"), c("o_custkey") == c("c_custkey"))
    return out.join(table(spark, d, "nation").where(c("n_name").ilike("%n%")), c("c_nationkey") == c("n_nationkey")).select("c_custkey", "o_orderkey", "n_name")


@query("SELECT p_partkey, n FROM (SELECT p_partkey, p_size, count(l_orderkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_returnflag = 'A' GROUP BY ALL) ORDER BY n::DOUBLE / p_size DESC, p_partkey LIMIT 50")
def srt_sold_ratio(spark, d):
    """SRT-05."""
    n = table(spark, d, "lineitem").where("l_returnflag = 'A'").groupBy(c("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    out = table(spark, d, "part").join(n, "p_partkey", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return out.orderBy(F.desc(c("n").cast("double") / c("p_size")), "p_partkey").limit(50).select("p_partkey", "n")


# Jobs


STAGE_SQL = "CASE WHEN pass3_at IS NOT NULL THEN 'complete' WHEN pass1_at IS NULL THEN 'pass1' WHEN pass1_status = 'fail' THEN 'culled' WHEN pass1_status = 'raw_review' THEN 'raw_review' WHEN pass2_at IS NULL THEN 'pass2' ELSE 'pass3' END"
LATEST = "l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, job_type ORDER BY id DESC) AS r FROM j) WHERE r = 1)"


@query(f"WITH {WITH} SELECT id, {STAGE_SQL} AS stage FROM i")
def prj_next_stage(spark, d):
    """PRJ-08."""
    return images(spark, d).select("id", Q.next_stage(c("pass1_status"), c("pass1_at"), c("pass2_at"), c("pass3_at")).alias("stage"))


@query(f"""
WITH {WITH}, {LATEST}, s AS (SELECT id, coalesce(nima, 0) AS nima, {STAGE_SQL} AS stage FROM i WHERE starts_with(file_path, '/lib/Brand#1')),
a AS (SELECT s.*, CASE WHEN NOT starts_with(stage, 'pass') THEN 'none' WHEN status IS NULL THEN 'create' WHEN status = 'complete' THEN 'noop' WHEN status = 'error' THEN 'requeue' WHEN priority >= 8 THEN 'noop' ELSE 'bump' END AS action
 FROM s LEFT JOIN l ON l.image_id = s.id AND l.job_type = s.stage)
SELECT CASE WHEN stage = 'pass3' AND nima < 6 THEN 'pass3_below_threshold' ELSE stage END AS stage, action, count(*) AS n FROM a GROUP BY 1, 2""".replace("starts_with(file_path, '/lib/Brand#1')", "starts_with(file_path, '/lib/Brand#11/')"))
def agg_bumped_folder(spark, d):
    """AGG-45."""
    return Q.bumped_folder(images(spark, d), jobs(spark, d), "/lib/Brand#11", 8, override=True)


@query(f"""
WITH {WITH} SELECT id, CASE WHEN status = 'queued' AND image_id IN (SELECT id FROM i WHERE lr_pick = 'pick') THEN 10 ELSE priority END AS started,
 CASE WHEN priority >= 7 AND status IN ('queued', 'running') THEN 5 ELSE priority END AS cancelled FROM j""")
def mut_priority_mode(spark, d):
    """MUT-11."""
    mine = images(spark, d).where("lr_pick = 'pick'")
    up = Q.raised(jobs(spark, d), mine).select("id", c("priority").cast("long").alias("started"))
    return up.join(Q.lowered(jobs(spark, d), 7).select("id", c("priority").cast("long").alias("cancelled")), "id")


READY = "pass2_at IS NOT NULL AND pass3_at IS NULL AND NOT EXISTS (SELECT 1 FROM j WHERE j.image_id = i.id AND job_type = 'pass3' AND status IN"


@query(f"WITH {WITH} SELECT 'pass3' AS job_type, id AS image_id, 'queued' AS status, 10 AS priority FROM i WHERE nima >= 5 AND nima < 6 AND {READY} ('queued', 'running')) ORDER BY nima DESC, id LIMIT 100")
def mut_promote_tier(spark, d):
    """MUT-14."""
    return Q.promoted_tier(images(spark, d), jobs(spark, d), limit=100)


@query(f"""
WITH {WITH}, b AS (SELECT id FROM i WHERE nima >= 6 AND {READY} ('queued', 'running', 'complete')) ORDER BY nima DESC, id LIMIT 30),
k AS (SELECT id FROM i WHERE lr_pick = 'pick' AND {READY} ('queued', 'running', 'complete')) AND id NOT IN (SELECT id FROM b))
SELECT 'pass3' AS job_type, id AS image_id, 'queued' AS status, 10 AS priority FROM b UNION ALL SELECT 'pass3', id, 'queued', 8 FROM k""")
def mut_seed_queue(spark, d):
    """MUT-18. The waterfall is open: of pass1 and pass2 there are no active jobs among those seen."""
    done = (c("job_type") == "pass3") | ~c("status").isin(Q.ACTIVE)
    return Q.seeded(images(spark, d), jobs(spark, d).where(done), top=30)


@query(f"""
WITH {WITH}, v AS (SELECT * FROM j WHERE image_id % 4 > 1 OR status = 'complete'), o AS (SELECT image_id % 4 AS queue, count(*) FILTER (WHERE job_type IN ('pass1', 'pass2') AND status IN ('queued', 'running')) AS active FROM v GROUP BY 1),
r AS (SELECT id % 4 AS queue, id FROM i WHERE nima >= 6 AND pass2_at IS NOT NULL AND pass3_at IS NULL AND NOT EXISTS (SELECT 1 FROM v WHERE v.image_id = i.id AND job_type = 'pass3' AND status IN ('queued', 'running', 'complete'))
 QUALIFY row_number() OVER (PARTITION BY id % 4 ORDER BY nima DESC, id) <= 20)
SELECT o.queue, active, count(id) AS seeded, min(id) AS first_id FROM o LEFT JOIN r ON r.queue = o.queue AND active = 0 GROUP BY ALL""")
def mut_seed_queue_gated(spark, d):
    """MUT-18. Of four queues two are drained and are seeded; the others have active jobs and add nothing."""
    i, j = images(spark, d).withColumn("lr_pick", F.lit(None).cast("string")), jobs(spark, d).where("image_id % 4 > 1 OR status = 'complete'")
    out = []
    for q in range(4):
        mine = j.where(f"image_id % 4 = {q}")
        new = Q.seeded(i.where(f"id % 4 = {q}"), mine, top=20).agg(F.count(F.lit(1)).alias("seeded"), F.min("image_id").alias("first_id"))
        active = mine.agg(F.lit(q).cast("long").alias("queue"), F.count_if(c("job_type").isin("pass1", "pass2") & c("status").isin(Q.ACTIVE)).alias("active"))
        out.append(active.crossJoin(new))  # one row each
    return union(*out)


@query(f"WITH {WITH} SELECT id FROM i WHERE pass3_model = 'small' AND pass3_at IS NOT NULL AND print_worthy AND nima >= 4 ORDER BY nima DESC, id LIMIT 100")
def mut_retag(spark, d):
    """MUT-16."""
    return Q.retagged(images(spark, d), "small", 4.0, True, 100).select("id")


@query(f"WITH {WITH} SELECT i.id, m AS inherited FROM i LEFT JOIN (SELECT image_id, max(priority) AS m FROM j WHERE job_type = 'pass1' GROUP BY 1) t ON t.image_id = i.id")
def join_inherited_priority(spark, d):
    """JOIN-13."""
    return Q.inherited_priority(images(spark, d), jobs(spark, d)).select("id", "inherited")


@query(f"""
WITH {WITH}, o AS (SELECT count(*) FILTER (WHERE job_type = 'pass1' AND status IN ('queued', 'running')) AS a, count(*) FILTER (WHERE job_type = 'pass2' AND status IN ('queued', 'running')) AS b FROM j WHERE id % 5 = 3),
h AS (SELECT image_id, max(priority) AS m FROM j WHERE job_type = 'pass1' AND id % 5 = 3 GROUP BY 1),
k AS (SELECT i.id, nima, CASE WHEN a = 0 AND pass1_status = 'pass' AND pass2_at IS NULL THEN 'pass2' WHEN a = 0 AND b = 0 AND pass2_at IS NOT NULL AND pass3_at IS NULL AND nima >= 6 THEN 'pass3'
 WHEN pass3_at IS NOT NULL AND (genre = 'PROMO') THEN 'privacy' END AS job_type, m FROM i CROSS JOIN o LEFT JOIN h ON h.image_id = i.id),
q AS (SELECT *, CASE job_type WHEN 'pass2' THEN CASE WHEN m > 5 THEN m ELSE 5 END WHEN 'pass3' THEN CASE WHEN nima >= 6.5 THEN 10 ELSE 3 END ELSE 3 END AS priority FROM k WHERE job_type IS NOT NULL
 AND NOT EXISTS (SELECT 1 FROM j WHERE id % 5 = 3 AND j.image_id = k.id AND j.job_type = k.job_type AND status IN ('queued', 'running', 'error')))
SELECT id AS image_id, job_type, priority::BIGINT AS priority FROM (SELECT *, row_number() OVER (PARTITION BY job_type ORDER BY priority DESC, nima DESC NULLS LAST, id) AS r FROM q) WHERE r <= 60""")
def mut_promotions(spark, d):
    """MUT-09, with the failed jobs alone, so that the waterfall is open."""
    i = images(spark, d).select("id", "pass1_status", "pass2_at", "pass3_at", c("nima").alias("score"), F.when(c("genre") == "PROMO", "boudoir").otherwise(c("genre")).alias("genre"), F.lit(False).alias("faces_present"), F.lit(None).cast("int").alias("privacy_at"))
    return Q.promotions(i, jobs(spark, d).where("id % 5 = 3"), 60).select("image_id", "job_type", c("priority").cast("long").alias("priority"))


@query("""
WITH b AS (SELECT o_orderkey AS booking_id, o_orderstatus AS status, o_orderdate::DATE AS d, datediff('day', DATE '2001-06-01', o_orderdate::DATE) AS days FROM orders WHERE o_orderdate >= TIMESTAMP '2001-04-01'),
r(sequence, rs, a, z, anchor, offs) AS (VALUES ('welcome', 'O', -60, 60, 'now', [0, 24]), ('prep', 'O', 0, 14, 'shoot', [-48]), ('review', 'F', -30, -1, 'shoot', [24, 72])),
h AS (SELECT * FROM b JOIN r ON status = rs AND days BETWEEN a AND z WHERE NOT (booking_id % 4 = 0 AND sequence = 'welcome'))
SELECT booking_id, sequence, (k - 1)::INT AS step_index, strftime(CASE WHEN anchor = 'shoot' THEN d::TIMESTAMP ELSE TIMESTAMP '2001-06-01' END + INTERVAL 1 HOUR * offs[k], '%Y-%m-%d %H:%M') AS due FROM h, range(1, 3) t(k) WHERE k <= len(offs)""")
def mut_sequence_steps(spark, d):
    """MUT-15."""
    b = table(spark, d, "orders").where("o_orderdate >= TIMESTAMP '2001-04-01'").select(c("o_orderkey").alias("booking_id"), c("o_orderstatus").alias("status"), F.to_date("o_orderdate").alias("shoot_date"))
    rules = spark.createDataFrame([("welcome", "O", -60, 60, "now", [0, 24]), ("prep", "O", 0, 14, "shoot", [-48]), ("review", "F", -30, -1, "shoot", [24, 72])], "sequence string, status string, from_days int, to_days int, anchor string, offsets array<int>")
    sent = b.where("booking_id % 4 = 0").select("booking_id", F.lit("welcome").alias("sequence"))
    return Q.sequence_steps(b, sent, rules, "2001-06-01").select("booking_id", "sequence", "step_index", F.date_format("due_at", "yyyy-MM-dd HH:mm").alias("due"))


@query("SELECT o_custkey AS k, min(o_orderkey) AS first FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 5000) GROUP BY 1")
def mut_insert_ignore(spark, d):
    """MUT-03, CRUD-03, SNK-08: the rows that an append adds, their ids from the caller."""
    old = table(spark, d, "customer").where("c_acctbal < 5000").select(c("c_custkey").alias("k"))
    return Q.insert_ignore(old, table(spark, d, "orders").select(c("o_custkey").alias("k"), c("o_orderkey").alias("first")), "k")


@query(f"""
WITH {WITH}, o AS (SELECT job_type, count(*) FILTER (WHERE status = 'queued') AS queued, count(*) FILTER (WHERE status = 'running') AS running FROM j WHERE status IN ('queued', 'running') GROUP BY 1)
SELECT job_type, queued, running, job_type = (SELECT min(job_type) FROM o) AS may_start FROM o""")
def str_drain_order(spark, d):
    """STR-07: the gate of one step of the drain loop."""
    return Q.dispatchable(jobs(spark, d))


@query("SELECT event_id, CASE WHEN value * 5 >= 600 THEN 3 WHEN value * 5 >= 120 THEN 1 ELSE 0 END AS workers, CASE WHEN event_id % 5 < 3 THEN 'queued' ELSE 'error' END AS retry FROM events")
def str_workers_and_retry(spark, d):
    """STR-08, STR-09."""
    return table(spark, d, "events").select("event_id", Q.workers(c("value") * 5).alias("workers"), Q.retried(c("event_id") % 5).alias("retry"))


@query("SELECT o_orderkey FROM orders WHERE abs(epoch(o_orderdate) - epoch(TIMESTAMP '2001-06-01 00:10:00')) <= 900")
def str_due_posts(spark, d):
    """STR-06, JOIN-27: one tick of the publisher."""
    return J.due_within(table(spark, d, "orders"), "o_orderdate", "2001-06-01 00:10:00").select("o_orderkey")


# Calendar, ratings and shares


@query(f"""
WITH {WITH}, i2 AS (SELECT * REPLACE (CASE WHEN id % 5 = 1 THEN 'Boudoir' ELSE genre END AS genre) FROM i), w AS (SELECT row_number() OVER (ORDER BY (p_partkey * 31) % 997, p_partkey) AS n, CASE WHEN p_partkey % 6 = 0 THEN '/gone/' || p_partkey ELSE file_path END AS file_path FROM part JOIN i2 i ON i.id = p_partkey),
f AS (SELECT DISTINCT post_date FROM p WHERE status IN ('posted', 'scheduled') AND post_time = 'morning' AND post_id % 64 < 4),
k AS (SELECT n, w.file_path, CASE WHEN n <= 30 THEN DATE '2001-06-01' + (n - 1)::INT END AS post_date, i.id AS image_id, i.genre FROM w LEFT JOIN i2 i ON i.file_path = w.file_path)
SELECT n AS position, file_path, k.post_date::VARCHAR AS post_date, image_id, CASE WHEN n > 30 THEN 'overflow' WHEN image_id IS NULL THEN 'unresolved' WHEN lower(k.genre) = 'boudoir' THEN 'private' WHEN f.post_date IS NOT NULL THEN 'protected' ELSE 'created' END AS disposition
FROM k LEFT JOIN f ON f.post_date = k.post_date""")
def mut_month_sync(spark, d):
    """MUT-12, JOIN-29."""
    i = images(spark, d).withColumn("genre", F.expr("CASE WHEN id % 5 = 1 THEN 'Boudoir' ELSE genre END"))
    put = numbered(i, "position", [c("id") * 31 % 997, c("id")])  # the order in which a person has put them
    wanted = put.select("position", F.when(c("id") % 6 == 0, F.concat(F.lit("/gone/"), c("id").cast("string"))).otherwise(c("file_path")).alias("file_path"))
    return P.month_plan(wanted, i, posts(spark, d).where("post_id % 64 < 4"), "2001-06-01").withColumn("post_date", c("post_date").cast("string"))


@query(f"""
WITH {WITH}, t AS (SELECT '/lib/' || o_custkey AS file_path, o_orderkey AS n, CASE WHEN o_orderkey % 4 > 0 THEN (o_orderkey % 6)::INT END AS rating, CASE o_orderkey % 5 WHEN 0 THEN 'reject' WHEN 1 THEN 'pick' END AS pick FROM orders),
l AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY n DESC) = 1),
o AS (SELECT '/lib/' || id AS file_path, nima, quality, id % 3 = 0 AS portfolio, pass1_status, (id % 5)::INT AS rating, lr_pick AS pick, (id % 4)::INT AS star_rating, lr_pick AS pick_flag FROM i)
SELECT coalesce(o.file_path, l.file_path) AS file_path, CASE WHEN l.n IS NOT NULL THEN l.rating ELSE o.rating END AS rating, CASE WHEN l.n IS NOT NULL THEN l.pick ELSE o.pick END AS pick, coalesce(l.rating, star_rating) AS star_rating,
 coalesce(l.pick, pick_flag) AS pick_flag, CASE WHEN l.n IS NOT NULL THEN round(least((coalesce(l.rating * 2.0::DOUBLE, 0) + coalesce(nima, 0) + coalesce(quality, 0)) / 30 * 10, 10), 4) END AS trust_score,
 coalesce(portfolio, false) OR coalesce(l.rating >= 4, false) AS portfolio, CASE WHEN l.pick = 'reject' THEN 'fail' ELSE pass1_status END AS pass1_status, NOT coalesce(portfolio, false) AND coalesce(l.rating >= 4, false) AS promoted
FROM o FULL JOIN l ON o.file_path = l.file_path""")
def mut_rating_sync(spark, d):
    """MUT-06."""
    items = table(spark, d, "orders").selectExpr("concat('/lib/', o_custkey) AS file_path", "o_orderkey AS n", "CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderkey % 6 AS INT) END AS rating", "CASE o_orderkey % 5 WHEN 0 THEN 'reject' WHEN 1 THEN 'pick' END AS pick")
    old = images(spark, d).selectExpr("concat('/lib/', id) AS file_path", "nima", "quality", "id % 3 = 0 AS portfolio", "pass1_status", "CAST(id % 5 AS INT) AS rating", "lr_pick AS pick", "CAST(id % 4 AS INT) AS star_rating", "lr_pick AS pick_flag")
    return P.synced_ratings(old, items)


@query("""
WITH s AS (SELECT p_partkey AS id, p_brand AS section, p_size AS idx, CASE WHEN p_size % 7 = 0 THEN 'retired' ELSE 'live' END AS state FROM part), r AS (SELECT id, section, idx, CASE WHEN id % 5 = 0 THEN 'retired' ELSE state END AS state FROM s)
SELECT id, section, state, CASE WHEN state <> 'retired' THEN row_number() OVER (PARTITION BY section, state ORDER BY idx, id) - 1 END::INT AS idx FROM r""")
def mut_soft_delete(spark, d):
    """MUT-17."""
    items = table(spark, d, "part").selectExpr("p_partkey AS id", "p_brand AS section", "p_size AS idx", "CASE WHEN p_size % 7 = 0 THEN 'retired' ELSE 'live' END AS state")
    return P.retired(items, items.where("id % 5 = 0"), "section", "idx", "id").select("id", "section", "state", c("idx").cast("int").alias("idx"))


# Aggregates


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS bookings, round(coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 0), 2) AS paid, round(coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus <> 'F'), 0), 2) AS pending FROM orders WHERE o_orderpriority = '2-HIGH' GROUP BY 1")
def agg_genre_months(spark, d):
    """AGG-07."""
    by = table(spark, d, "orders").where("o_orderpriority = '2-HIGH'").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    total = lambda cond: F.round(F.coalesce(F.sum(F.when(cond, c("o_totalprice"))), F.lit(0.0)), 2)
    return by.agg(F.count(F.lit(1)).alias("bookings"), total(paid()).alias("paid"), total(~paid()).alias("pending"))


@query("""
WITH g AS (SELECT o_custkey AS shoot_id, count(*) AS gallery_count, sum(o_orderkey % 100)::BIGINT AS total_views, sum(o_orderkey % 7)::BIGINT AS total_downloads, max(o_orderdate) AS m, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM orders GROUP BY 1)
SELECT shoot_id, gallery_count, total_views, total_downloads, m::DATE::VARCHAR AS last_accessed, (SELECT count(*) FROM lineitem WHERE l_orderkey = k) AS image_count FROM g""")
def agg_gallery_stats(spark, d):
    """AGG-33."""
    g = table(spark, d, "orders").selectExpr("o_orderkey AS gallery_id", "o_custkey AS shoot_id", "o_orderkey % 100 AS views", "o_orderkey % 7 AS downloads", "o_orderdate AS last_accessed", "o_orderdate AS created_at")
    return P.gallery_stats(g, table(spark, d, "lineitem").select(c("l_orderkey").alias("gallery_id"))).withColumn("last_accessed", F.to_date("last_accessed").cast("string"))


@query("""
WITH b AS (SELECT o_custkey, o_totalprice, o_orderdate::DATE AS d, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS genre FROM orders),
t AS (SELECT o_custkey, count(*) AS bookings, round(sum(o_totalprice), 2) AS revenue, min(d)::VARCHAR AS first_booked, max(d)::VARCHAR AS last_booked FROM b GROUP BY 1),
f AS (SELECT o_custkey, genre FROM (SELECT o_custkey, genre, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, genre) AS r FROM b WHERE genre IS NOT NULL GROUP BY o_custkey, genre) WHERE r = 1)
SELECT c_custkey, coalesce(bookings, 0) AS bookings, coalesce(revenue, 0.0) AS revenue, first_booked, last_booked, genre AS favorite_genre FROM customer LEFT JOIN t ON t.o_custkey = c_custkey LEFT JOIN f ON f.o_custkey = c_custkey""")
def mut_client_totals(spark, d):
    """MUT-08, AGG-34."""
    b = table(spark, d, "orders").withColumn("genre", F.when(c("o_orderkey") % 5 > 0, c("o_orderpriority")))
    out = P.client_totals(table(spark, d, "customer"), "c_custkey", b, "o_custkey", "o_totalprice", F.to_date("o_orderdate"))
    return out.withColumns({x: c(x).cast("string") for x in ("first_booked", "last_booked")})


@query(f"""
WITH i0 AS (SELECT {', '.join(IMAGE_COLUMNS)} FROM part), i AS (SELECT * FROM i0 WHERE posted_at IS NULL OR mood <> 'mood3'), p0 AS (SELECT {', '.join(POST_COLUMNS)} FROM orders), p AS (SELECT * FROM p0 WHERE genre <> 'SMALL' OR post_id % 8 = 0), g(genre) AS (VALUES ('PROMO'), ('LARGE'), ('SMALL'), ('FILM')), r AS (SELECT genre FROM i WHERE posted_at >= DATE '2001-05-01' AND genre IS NOT NULL UNION SELECT genre FROM p WHERE status = 'posted' AND post_date >= DATE '2001-05-01' AND genre IS NOT NULL),
c AS (SELECT genre, count(*) AS n FROM p WHERE post_date >= DATE '2001-05-01' AND genre IS NOT NULL GROUP BY 1), y AS (SELECT genre, count(*) AS ready FROM i WHERE content_ready AND genre IS NOT NULL GROUP BY 1)
SELECT 'missing_genre' AS kind, g.genre AS name, coalesce(ready, 0) AS ready FROM g LEFT JOIN y ON y.genre = g.genre WHERE g.genre NOT IN (SELECT genre FROM r)
UNION ALL SELECT 'underrepresented_genre', g.genre, coalesce(ready, 0) FROM g LEFT JOIN y ON y.genre = g.genre LEFT JOIN c ON c.genre = g.genre WHERE g.genre IN (SELECT genre FROM r) AND coalesce(n, 0) < coalesce((SELECT avg(n) FROM c), 0) * 0.5
UNION ALL SELECT 'unexplored_mood', mood, count(*) FROM i WHERE content_ready AND mood IS NOT NULL AND mood NOT IN (SELECT mood FROM i WHERE posted_at >= DATE '2001-05-01' AND mood IS NOT NULL) GROUP BY mood""")
def agg_library_gaps(spark, d):
    """AGG-35."""
    return P.content_gaps(images(spark, d).where("posted_at IS NULL OR mood <> 'mood3'"), posts(spark, d).where("genre <> 'SMALL' OR post_id % 8 = 0"), ["PROMO", "LARGE", "SMALL", "FILM"], "2001-05-01")


@query(f"""
WITH {WITH}, g(genre) AS (VALUES ('PROMO'), ('LARGE'), ('SMALL'), ('FILM')), r AS (SELECT genre FROM i WHERE posted_at >= DATE '2001-05-01' AND genre IS NOT NULL UNION SELECT genre FROM p WHERE status = 'posted' AND post_date >= DATE '2001-05-01' AND genre IS NOT NULL),
c AS (SELECT genre, count(*) AS n FROM p WHERE post_date >= DATE '2001-05-01' AND genre IS NOT NULL GROUP BY 1), y AS (SELECT genre, count(*) AS ready FROM i WHERE content_ready AND genre IS NOT NULL GROUP BY 1)
SELECT 'missing_genre' AS kind, g.genre AS name, coalesce(ready, 0) AS ready FROM g LEFT JOIN y ON y.genre = g.genre WHERE g.genre NOT IN (SELECT genre FROM r)
UNION ALL SELECT 'underrepresented_genre', g.genre, coalesce(ready, 0) FROM g LEFT JOIN y ON y.genre = g.genre LEFT JOIN c ON c.genre = g.genre WHERE g.genre IN (SELECT genre FROM r) AND coalesce(n, 0) < coalesce((SELECT avg(n) FROM c), 0) * 0.5
UNION ALL SELECT 'unexplored_mood', mood, count(*) FROM i WHERE content_ready AND mood IS NOT NULL AND mood NOT IN (SELECT mood FROM i WHERE posted_at >= DATE '2001-05-01' AND mood IS NOT NULL) GROUP BY mood""")
def agg_content_gaps(spark, d):
    """AGG-35."""
    return P.content_gaps(images(spark, d), posts(spark, d), ["PROMO", "LARGE", "SMALL", "FILM"], "2001-05-01")


@query(f"WITH {WITH} SELECT 'ready' AS what, genre AS name, count(*) AS n FROM i WHERE content_ready AND posted_at IS NULL GROUP BY genre UNION ALL SELECT 'calendar', post_time, count(*) FROM p WHERE status <> 'posted' GROUP BY post_time")
def agg_queue_depth(spark, d):
    """AGG-36."""
    ready = images(spark, d).where("content_ready AND posted_at IS NULL").groupBy(c("genre").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    open_ = posts(spark, d).where("status <> 'posted'").groupBy(c("post_time").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return union(ready.select(F.lit("ready").alias("what"), "name", "n"), open_.select(F.lit("calendar").alias("what"), "name", "n"))


@query("""
WITH e AS (SELECT CASE WHEN l_tax >= 0.08 THEN 'long_exposure_intentional' WHEN l_tax <= 0.001 THEN 'motion_freeze' WHEN l_quantity <= 2 THEN 'shallow_dof_portrait_or_low_light' WHEN l_quantity >= 8 AND l_linenumber <= 3 THEN 'landscape_deep_focus' ELSE 'standard' END AS intent,
 CASE WHEN month(l_shipdate) IN (12, 1, 2) THEN 'winter' WHEN month(l_shipdate) <= 5 THEN 'spring' WHEN month(l_shipdate) <= 8 THEN 'summer' ELSE 'autumn' END AS season FROM lineitem)
SELECT 'intent' AS what, intent AS name, count(*) AS n FROM e GROUP BY 2 UNION ALL SELECT 'season', season, count(*) FROM e GROUP BY 2""")
def agg_capture_breakdown(spark, d):
    """AGG-37, PRJ-13."""
    intent = S.creative_intent(F.when(c("l_tax") >= 0.08, 1.0).otherwise(c("l_tax")), c("l_quantity"), F.when(c("l_linenumber") <= 3, 35).otherwise(50))
    e = table(spark, d, "lineitem").select(intent.alias("intent"), S.season(c("l_shipdate")).alias("season"))
    by = lambda k: e.groupBy(c(k).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("what"), "name", "n")
    return union(by("intent"), by("season"))


@query(f"""
WITH {WITH}, g AS (SELECT coalesce(i.genre, 'unknown') AS genre, coalesce(mood, 'unknown') AS mood FROM p JOIN i ON i.id = p.image_id WHERE status = 'posted' ORDER BY post_date DESC, post_id DESC LIMIT 9)
SELECT 'genre' AS what, genre AS name, count(*) AS n FROM g GROUP BY 2 UNION ALL SELECT 'mood', mood, count(*) FROM g GROUP BY 2""")
def agg_grid_histogram(spark, d):
    """AGG-41."""
    i = images(spark, d).select(c("id").alias("image_id"), F.coalesce("genre", F.lit("unknown")).alias("genre_of"), F.coalesce("mood", F.lit("unknown")).alias("mood_of"))
    last = posts(spark, d).where("status = 'posted'").join(i, "image_id").orderBy(F.desc("post_date"), F.desc("post_id")).limit(9)
    both = last.select(F.inline(F.array(F.struct(F.lit("genre").alias("what"), c("genre_of").alias("name")), F.struct(F.lit("mood").alias("what"), c("mood_of").alias("name")))))
    return both.groupBy("what", "name").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH e AS (SELECT CASE WHEN l_linenumber <= 3 THEN l_returnflag END AS u, l_extendedprice AS a, l_shipdate FROM lineitem), l AS (SELECT * FROM e WHERE l_shipdate >= TIMESTAMP '2001-01-01')
SELECT 'year' AS period, coalesce(u, 'unspecified') AS usage_type, count(*) AS licenses, round(coalesce(sum(a), 0), 2) AS revenue, round(coalesce(avg(a), 0), 2) AS mean FROM l GROUP BY 2 UNION ALL SELECT 'year', NULL, count(*), round(coalesce(sum(a), 0), 2), round(coalesce(avg(a), 0), 2) FROM l
UNION ALL SELECT 'all_time', NULL, count(*), round(coalesce(sum(a), 0), 2), round(coalesce(avg(a), 0), 2) FROM e""")
def agg_license_totals(spark, d):
    """AGG-42."""
    licenses = table(spark, d, "lineitem").withColumn("usage", F.when(c("l_linenumber") <= 3, c("l_returnflag")))
    return P.license_totals(licenses, "usage", "l_extendedprice", c("l_shipdate"), "2001-06-01")


@query("""
WITH w AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_quantity >= 45 GROUP BY 1)
SELECT count(*) AS bookings, sum(n)::BIGINT AS worthy, round(sum(n) * 85.0::DOUBLE, 2) AS "least", round(sum(n) * 450.0::DOUBLE, 2) AS most, round((sum(n) * 85.0::DOUBLE + sum(n) * 450.0::DOUBLE) / 2, 2) AS middle FROM w JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'""")
def agg_upsell_summary(spark, d):
    """AGG-28, its summary."""
    from contactsheet.operators import business as B

    bookings = table(spark, d, "orders").where(paid()).select(c("o_orderkey").alias("l_orderkey"))
    u = B.upsell(bookings, table(spark, d, "lineitem"), "l_orderkey", c("l_quantity") >= 45, (85.0, 450.0))
    out = u.agg(F.count(F.lit(1)).alias("bookings"), F.sum("worthy").alias("worthy"), F.round(F.sum("least"), 2).alias("least"), F.round(F.sum("most"), 2).alias("most"))
    return out.withColumn("middle", F.round((c("least") + c("most")) / 2, 2))


@query(f"""
WITH {WITH} SELECT id, r FROM (SELECT id, row_number() OVER (ORDER BY coalesce(quality, nima, 0) DESC, id) AS r FROM i JOIN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#11') ON id = p_partkey WHERE content_ready) WHERE r <= 20""")
def join_client_samples(spark, d):
    """JOIN-15: the twenty best images of a client's shoots."""
    mine = table(spark, d, "part").where("p_brand = 'Brand#11'").select("p_partkey")
    best = images(spark, d).where("content_ready").join(mine, c("id") == c("p_partkey")).orderBy(F.coalesce("quality", "nima", F.lit(0.0)).desc(), "id").limit(20)
    return best.select(F.row_number().over(_by(F.coalesce("quality", "nima", F.lit(0.0)).desc(), "id")).cast("long").alias("r"), "id")


def _by(*order):
    """A window over a few rows."""
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0)).orderBy(*order)


@query(f"SELECT keeper AS burst, min(vec_id) AS first_id, max(vec_id) AS last_id, count(*) AS frames FROM ({KEEPERS_SQL}) GROUP BY keeper HAVING count(*) > 1")
def str_bursts(spark, d):
    """STR-10. A burst is a keeper and the images that are duplicates of it."""
    found = J.hamming_keepers(bursts(spark, d).select("vec_id", "bits"), "vec_id", "bits", 8)
    return J.burst_sizes(found, "vec_id")


# Expressions


@query(r"""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS captured, round(CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END * ((o_orderkey % 90) + (o_custkey % 60) / 60.0::DOUBLE + 30.5::DOUBLE / 3600.0::DOUBLE), 7) AS degrees,
 CASE WHEN o_orderkey % 9 - 3 > 0 THEN '1/' || (1 << (o_orderkey % 9 - 3))::VARCHAR ELSE (1 << (3 - o_orderkey % 9))::DOUBLE::VARCHAR END AS shutter FROM orders""")
def fn_exif_values(spark, d):
    """date-exif, gps/apex."""
    o = table(spark, d, "orders")
    return o.select(
        "o_orderkey", F.date_format(S.exif_time(F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss")), "yyyy-MM-dd HH:mm:ss").alias("captured"),
        S.degrees(c("o_orderkey") % 90, c("o_custkey") % 60, F.lit(30.5), F.when(c("o_orderkey") % 2 == 0, "S").otherwise("N")).alias("degrees"), S.apex_shutter((c("o_orderkey") % 9 - 3).cast("double")).alias("shutter"),
    )


@query("""
WITH d AS (SELECT o_orderkey, o_orderdate::DATE AS d, CASE WHEN o_orderkey % 2 = 0 THEN 9 ELSE 18 END AS h FROM orders),
s AS (SELECT *, make_date(year(d), 4, 1) AS a, make_date(year(d), 10, 31) AS z FROM d)
SELECT o_orderkey, strftime(d::TIMESTAMP + INTERVAL 1 HOUR * (h + CASE WHEN d >= a + ((7 - isodow(a)) % 7)::INT AND d < z - (isodow(z) % 7)::INT THEN 4 ELSE 5 END), '%Y-%m-%d %H:%M') AS scheduled FROM s""")
def fn_slot_instant(spark, d):
    """date-zone: a slot of New York's day as an instant; before 2007 summer time began on April's first Sunday."""
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.date_format(S.slot_time(F.to_date("o_orderdate"), F.when(c("o_orderkey") % 2 == 0, "morning").otherwise("evening")), "yyyy-MM-dd HH:mm").alias("scheduled"))


@query("""
WITH t AS (SELECT o_orderkey, o_orderdate::DATE AS d, 2 * pi() / 365 * (dayofyear(o_orderdate) - 1) AS g FROM orders),
e AS (SELECT *, 229.18 * (0.000075 + 0.001868 * cos(g) - 0.032077 * sin(g) - 0.014615 * cos(2 * g) - 0.04089 * sin(2 * g)) AS q,
 0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g) - 0.002697 * cos(3 * g) + 0.00148 * sin(3 * g) AS l FROM t),
a AS (SELECT *, degrees(acos(greatest(-1, least(1, cos(radians(90.833)) / (cos(radians(41.9)) * cos(l)) - tan(radians(41.9)) * tan(l))))) AS h FROM e),
m AS (SELECT o_orderkey, d, floor((round(720 + 4 * 73.9 - q - 4 * h, 4) + CASE WHEN month(d) BETWEEN 4 AND 10 THEN -240 ELSE -300 END + 1440) % 1440)::INT AS up, floor((round(720 + 4 * 73.9 - q + 4 * h, 4) + CASE WHEN month(d) BETWEEN 4 AND 10 THEN -240 ELSE -300 END + 1440) % 1440)::INT AS down FROM a),
k AS (SELECT o_orderkey, unnest(['sunrise', 'morning_end', 'evening_start', 'sunset']) AS what, unnest([up, (up + 45) % 1440, (down + 1380) % 1440, down]) AS x FROM m)
SELECT o_orderkey, what, (CASE WHEN x // 60 % 12 = 0 THEN 12 ELSE x // 60 % 12 END)::VARCHAR || ':' || lpad((x % 60)::VARCHAR, 2, '0') || CASE WHEN x < 720 THEN ' AM' ELSE ' PM' END AS clock FROM k""")
def fn_golden_hours(spark, d):
    """date-solar."""
    o = table(spark, d, "orders").select("o_orderkey", S.golden_hours(F.lit(41.9), F.lit(-73.9), F.to_date("o_orderdate")).alias("g"))
    names = ("sunrise", "morning_end", "evening_start", "sunset")
    return o.select("o_orderkey", F.inline(F.array(*(F.struct(F.lit(n).alias("what"), c("g")[n].alias("clock")) for n in names))))


@query(r"""
WITH t AS (SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) || ' &#8217;&#x1F600;&copy;&notit;&amp;lt;' AS t FROM pages)
SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(t, '&#8217;', chr(8217)), '&#x1F600;', chr(128512)), '&copy;', chr(169)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', chr(160)), '&amp;', '&') AS title FROM t""")
def fn_html_unescape(spark, d):
    """str-html: all titles, with references by name and by number; a name that there isn't stays, and nothing is decoded twice."""
    p = table(spark, d, "pages").select("page_id", F.concat(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1), F.lit(" &#8217;&#x1F600;&copy;&notit;&amp;lt;")).alias("t"))
    return p.select("page_id", T.unescaped(c("t")).alias("title"))


@query("""
SELECT event_id, json_extract(regexp_extract('answer: ' || props || ' done.', '\\{.*\\}', 0, 's'), '$.k')::BIGINT AS k, format('{:,.2f}', value * 1000) AS thousands FROM events""")
def fn_json_in_text(spark, d):
    """str-regex, str-thousands: JSON inside a model's answer; a number with separators."""
    e = table(spark, d, "events")
    return e.select("event_id", F.from_json(T.embedded_json(F.concat(F.lit("answer: "), "props", F.lit(" done."))), "k long")["k"].alias("k"), T.money(c("value") * 1000).alias("thousands"))


@query(r"""
SELECT id, lower(CASE WHEN b = '' THEN n ELSE b END) AS stem FROM (SELECT id, n, regexp_replace(n, '[-_\s](edit|edited|edits|final|export|exported|v\d+|hires|hi-res|web|print|color|bw|b&w|retouched|enhanced)$', '', 'i') AS b
 FROM (SELECT p_partkey AS id, 'IMG_' || p_partkey || ['', '-edit', '_Final', ' v12', '-print', '-copy', '-B&W', '_hi-res'][p_partkey % 8 + 1] AS n FROM part))""")
def fn_edit_stem(spark, d):
    """The key of JOIN-25."""
    marks = F.array(*map(F.lit, ["", "-edit", "_Final", " v12", "-print", "-copy", "-B&W", "_hi-res"]))
    path = F.concat(F.lit("/a.b/IMG_"), c("p_partkey").cast("string"), F.element_at(marks, (c("p_partkey") % 8 + 1).cast("int")), F.lit(".tif"))
    return table(spark, d, "part").select(c("p_partkey").alias("id"), T.stem(path).alias("stem"))


@query("SELECT l_orderkey, l_linenumber, round(least(10, greatest(0, 0.30::DOUBLE * (l_quantity / 5) + 0.35::DOUBLE * (l_discount * 100) + 0.20::DOUBLE * coalesce(CASE WHEN l_tax > 0.02 THEN l_tax * 100 END, 5.0) + 0.15::DOUBLE * 7.5)), 3) AS composite FROM lineitem")
def udf_ensemble(spark, d):
    """UDF-12."""
    parts = {"technical": c("l_quantity") / 5, "aesthetic": c("l_discount") * 100, "composition": F.when(c("l_tax") > 0.02, c("l_tax") * 100), "exif": F.lit(7.5)}
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.blend(parts, S.ENSEMBLE_WEIGHTS, 5.0).alias("composite"))
