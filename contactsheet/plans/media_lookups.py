"""Joins of rows with their image, client or shoot, and what they are listed by; over the harness tables, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from contactsheet.operators import lookups as K
from contactsheet.plans.media import query, table
from contactsheet.plans.media_ops import WITH, images, jobs, posts

c = F.col
LICENCES = ["l_orderkey * 8 + l_linenumber AS license_id", "l_suppkey AS client_id", "CASE WHEN l_linenumber < 3 THEN l_orderkey END AS shoot_id", "CASE WHEN l_partkey % 7 > 0 THEN CAST(l_shipdate AS DATE) END AS expires_at"]
CLIENTS, SHOOTS = "s_suppkey AS client_id, s_name AS client_name", "o_orderkey AS shoot_id, o_orderpriority AS shoot_genre"


def licence_sql(days: str, where: str) -> str:
    return f"""WITH l AS (SELECT {', '.join(LICENCES)} FROM lineitem), k AS (SELECT {CLIENTS} FROM supplier WHERE s_suppkey % 5 > 0), s AS (SELECT {SHOOTS} FROM orders)
SELECT license_id, client_name, shoot_genre, expires_at::VARCHAR AS expires_at, {days} AS days FROM l JOIN k USING (client_id) LEFT JOIN s USING (shoot_id) WHERE {where}"""


def _licences(spark, d, ahead):
    rows = table(spark, d, "lineitem").selectExpr(*LICENCES)
    clients = table(spark, d, "supplier").where("s_suppkey % 5 > 0").selectExpr(*CLIENTS.split(", "))
    out = K.licences(rows, clients, table(spark, d, "orders").selectExpr(*SHOOTS.split(", ")), "2001-06-01", ahead)
    return out.select("license_id", "client_name", "shoot_genre", c("expires_at").cast("string").alias("expires_at"), "days")


@query(licence_sql("(expires_at - DATE '2001-06-01')::INT", "expires_at BETWEEN DATE '2001-06-01' AND DATE '2001-06-01' + 30"))
def join_licences_ending(spark, d):
    """JOIN-07."""
    return _licences(spark, d, 30)


@query(licence_sql("(DATE '2001-06-01' - expires_at)::INT", "expires_at < DATE '2001-06-01'"))
def join_licences_ended(spark, d):
    """JOIN-07."""
    return _licences(spark, d, None)


def _named(i):
    return i.select(c("id").alias("image_id"), "file_path", c("genre").alias("image_genre"), "mood")


@query(f"WITH {WITH} SELECT post_id, post_date::VARCHAR AS post_date, p.image_id, file_path, i.genre AS image_genre, mood FROM p LEFT JOIN i ON i.id = p.image_id WHERE post_date BETWEEN DATE '2001-05-28' AND DATE '2001-06-03'")
def join_calendar_week(spark, d):
    """JOIN-09."""
    out = K.posts_of(posts(spark, d), _named(images(spark, d)), "2001-05-28", "2001-06-03")
    return out.select("post_id", c("post_date").cast("string").alias("post_date"), "image_id", "file_path", "image_genre", "mood")


@query(f"WITH {WITH}, q AS (SELECT *, CASE WHEN post_id % 3 > 0 THEN post_date END AS posted_at FROM p) SELECT post_id, i.genre AS image_genre, mood FROM q JOIN i ON i.id = q.image_id WHERE status = 'posted' AND q.posted_at IS NOT NULL ORDER BY q.posted_at DESC, post_id DESC LIMIT 9")
def join_posted_grid(spark, d):
    """JOIN-10."""
    mine = posts(spark, d).withColumn("posted_at", F.when(c("post_id") % 3 > 0, c("post_date")))
    return K.posted_grid(mine, _named(images(spark, d))).select("post_id", "image_genre", "mood")


@query(f"WITH {WITH}, q AS (SELECT j.*, ts AS started_at FROM j JOIN events ON event_id = id) SELECT q.id, job_type, file_path FROM q JOIN i ON i.id = q.image_id WHERE status = 'running' AND job_type IN ('pass1', 'pass3') ORDER BY started_at DESC, q.id DESC LIMIT 1")
def join_running_job(spark, d):
    """JOIN-12."""
    j = jobs(spark, d).join(table(spark, d, "events").select(c("event_id").alias("id"), c("ts").alias("started_at")), "id")
    return K.running_job(j, _named(images(spark, d)), ["pass1", "pass3"]).select("id", "job_type", "file_path")


@query(f"WITH {WITH} SELECT file_path FROM i WHERE id % 2 = 0 AND file_path IN (SELECT file_path FROM j JOIN i ON i.id = j.image_id WHERE job_type = 'pass1') GROUP BY 1")
def join_paths_with_job(spark, d):
    """JOIN-12."""
    i = images(spark, d)
    return K.paths_with_job(jobs(spark, d), _named(i), i.where("id % 2 = 0"))


PROFILES = ["c_custkey AS client_id", "c_custkey % 4 = 1 AS vip_worthy", "CASE c_custkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' END AS likelihood"]
BOOKED = "SELECT c_custkey AS client_id, sum(o_totalprice) AS total_revenue, max(o_orderdate)::DATE AS last_booked FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 10 > 0 GROUP BY 1"


def _clients(spark, d):
    k, o = table(spark, d, "customer").where("c_custkey % 10 > 0"), table(spark, d, "orders")
    by = o.groupBy(c("o_custkey").alias("client_id")).agg(F.sum("o_totalprice").alias("total_revenue"), F.max("o_orderdate").cast("date").alias("last_booked"))
    return k.select(c("c_custkey").alias("client_id")).join(by, "client_id", "left")


@query(f"WITH f AS (SELECT {', '.join(PROFILES)} FROM customer), b AS ({BOOKED}) SELECT client_id, round(total_revenue, 2) AS total_revenue FROM f JOIN b USING (client_id) WHERE vip_worthy")
def join_vip_clients(spark, d):
    """JOIN-14."""
    return K.vip_clients(table(spark, d, "customer").selectExpr(*PROFILES), _clients(spark, d)).select("client_id", F.round("total_revenue", 2).alias("total_revenue"))


@query(f"WITH f AS (SELECT {', '.join(PROFILES)} FROM customer), b AS ({BOOKED}) SELECT client_id, (DATE '2001-06-01' - last_booked)::INT AS days_since FROM f JOIN b USING (client_id) WHERE likelihood = 'high' AND (last_booked IS NULL OR DATE '2001-06-01' - last_booked >= 90)")
def join_rebooking(spark, d):
    """JOIN-14."""
    return K.rebooking(table(spark, d, "customer").selectExpr(*PROFILES), _clients(spark, d), "2001-06-01").select("client_id", "days_since")


@query(f"WITH {WITH} SELECT l_orderkey AS image_id, l_shipdate::DATE::VARCHAR AS added_at, file_path, nima FROM lineitem LEFT JOIN i ON i.id = l_orderkey WHERE l_suppkey = 3")
def join_gallery_images(spark, d):
    """JOIN-16. A supplier's line items are a gallery; orders beyond the last part have no image."""
    rows = table(spark, d, "lineitem").select(c("l_suppkey").alias("gallery_id"), c("l_orderkey").alias("image_id"), F.to_date("l_shipdate").alias("added_at"))
    out = K.gallery_images(rows, images(spark, d).select(c("id").alias("image_id"), "file_path", "nima"), 3)
    return out.select("image_id", c("added_at").cast("string").alias("added_at"), "file_path", "nima")


@query("SELECT event_id AS reminder_id, c_name FROM events LEFT JOIN customer ON c_custkey = user_id AND c_custkey % 4 > 0 WHERE event_type <> 'error' AND ts <= TIMESTAMP '2024-01-10 12:00:00' + INTERVAL 48 HOUR")
def join_pending_reminders(spark, d):
    """JOIN-17."""
    r = table(spark, d, "events").select(c("event_id").alias("reminder_id"), c("user_id").alias("client_id"), F.when(c("event_type") == "error", "sent").otherwise("pending").alias("status"), c("ts").alias("due_at"))
    clients = table(spark, d, "customer").where("c_custkey % 4 > 0").select(c("c_custkey").alias("client_id"), "c_name")
    return K.pending_reminders(r, clients, "2024-01-10 12:00:00", 48).select("reminder_id", "c_name")


@query(f"WITH {WITH}, r AS (SELECT '/lib/' || o_custkey AS file_path, arg_max(o_totalprice, o_orderkey) AS score FROM orders GROUP BY 1) SELECT id, score, score IS NOT NULL AS found FROM i LEFT JOIN r ON r.file_path = '/lib/' || i.id")
def join_by_path(spark, d):
    """JOIN-31."""
    photos = images(spark, d).select("id", F.concat(F.lit("/lib/"), c("id").cast("string")).alias("file_path"))
    results = table(spark, d, "orders").select(F.concat(F.lit("/lib/"), c("o_custkey").cast("string")).alias("file_path"), c("o_orderkey").alias("n"), c("o_totalprice").alias("score"))
    return K.merged_by_path(photos, results).select("id", "score", "found")


@query(f"WITH {WITH} SELECT max(posted_at)::VARCHAR AS last_push, count(*) FILTER (WHERE posted_at >= DATE '2001-05-25' - 7) AS pushed_this_week, count(*) FILTER (WHERE print_worthy AND posted_at IS NULL) AS waiting FROM i")
def agg_push_status(spark, d):
    """AGG-40."""
    return K.push_status(images(spark, d).withColumnRenamed("posted_at", "pushed_at"), "2001-05-25").withColumn("last_push", c("last_push").cast("string"))


@query(f"""
WITH {WITH}, r AS (SELECT id AS image_id FROM i WHERE pass3_model = 'small' AND pass3_at IS NOT NULL AND print_worthy AND nima >= 4 ORDER BY nima DESC, id LIMIT 100), l AS (SELECT * FROM j WHERE job_type = 'pass3' QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY id DESC) = 1)
SELECT image_id, l.id AS job_id, CASE WHEN status IS NULL THEN 'insert' WHEN status IN ('complete', 'running') THEN 'reuse' WHEN status = 'error' AND attempts >= 3 THEN 'reuse' WHEN status = 'error' THEN 'requeue' WHEN 3 > priority THEN 'raise' ELSE 'reuse' END AS action
FROM r LEFT JOIN l USING (image_id)""")
def mut_retag_plan(spark, d):
    """MUT-16 with the jobs it enqueues."""
    return K.retag_plan(images(spark, d), jobs(spark, d), "small", 4.0, True, 100).select("image_id", "job_id", "action")


@query(f"WITH {WITH}, x AS (SELECT o_orderkey + 7 AS post_id FROM orders WHERE o_orderkey % 3 = 0) SELECT x.post_id, CASE WHEN p.post_id IS NULL THEN 'missing' WHEN status IN ('planned', 'scheduled') THEN 'applied' ELSE 'refused' END AS outcome FROM x LEFT JOIN p ON p.post_id = x.post_id")
def mut_guarded_update(spark, d):
    """CRUD-02."""
    asked = table(spark, d, "orders").where("o_orderkey % 3 = 0").select((c("o_orderkey") + 7).alias("post_id"))
    return K.guarded(posts(spark, d), asked, "post_id", c("status").isin("planned", "scheduled"))


# Lists by what is most urgent (SRT-07): a position makes the order part of the rows.


@query("""
WITH s AS (SELECT o_orderkey, (DATE '2001-06-01' - o_orderdate::DATE - 14)::INT AS days_overdue FROM orders WHERE o_orderstatus <> 'F') SELECT o_orderkey, days_overdue, row_number() OVER (ORDER BY days_overdue DESC, o_orderkey) AS place FROM s WHERE days_overdue > 0""")
def srt_days_overdue(spark, d):
    """SRT-07."""
    from contactsheet.operators.ranks import numbered

    o = table(spark, d, "orders").where("o_orderstatus <> 'F'").select("o_orderkey", (F.datediff(F.lit("2001-06-01").cast("date"), F.to_date("o_orderdate")) - 14).alias("days_overdue"))
    return numbered(o.where("days_overdue > 0"), "place", [F.desc("days_overdue"), c("o_orderkey")])


@query("""
WITH a AS (SELECT c_custkey, min(o_orderdate)::DATE AS first FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1),
n AS (SELECT c_custkey, try_cast(CASE WHEN strftime(first, '%m-%d') >= '06-01' THEN 2001 ELSE 2002 END || strftime(first, '-%m-%d') AS DATE) AS next FROM a),
s AS (SELECT c_custkey, (next - DATE '2001-06-01')::INT AS days_away FROM n WHERE next IS NOT NULL AND next - DATE '2001-06-01' <= 60) SELECT c_custkey, days_away, row_number() OVER (ORDER BY days_away, c_custkey) AS place FROM s""")
def srt_days_away(spark, d):
    """SRT-07: the next anniversary of each client's first booking, nearest first; the 29th of February only where the year has one."""
    from contactsheet.operators.ranks import numbered

    first = table(spark, d, "orders").join(table(spark, d, "customer"), c("o_custkey") == c("c_custkey")).groupBy("c_custkey").agg(F.min("o_orderdate").cast("date").alias("first"))
    md = F.date_format("first", "MM-dd")
    nxt = F.try_to_date(F.concat(F.when(md >= "06-01", "2001").otherwise("2002"), F.lit("-"), md), "yyyy-MM-dd")
    days = first.select("c_custkey", F.datediff(nxt, F.lit("2001-06-01").cast("date")).alias("days_away")).where("days_away <= 60")
    return numbered(days, "place", [c("days_away"), c("c_custkey")])


@query(f"WITH {WITH}, s AS (SELECT coalesce(genre, 'none') AS genre, count(*) FILTER (WHERE posted_at IS NULL) AS unused FROM i WHERE content_ready GROUP BY 1) SELECT genre, unused, row_number() OVER (ORDER BY unused DESC, genre) AS place FROM s")
def srt_unused_by_genre(spark, d):
    """SRT-07."""
    from contactsheet.operators.ranks import numbered

    by = images(spark, d).where("content_ready").groupBy(F.coalesce("genre", F.lit("none")).alias("genre")).agg(F.count_if(c("posted_at").isNull()).alias("unused"))
    return numbered(by, "place", [F.desc("unused"), c("genre")])
