"""What keeps state: the diagnosis of the queue, streams, tables that batches change; over the harness tables, with SQL."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from contactsheet.functions import composition as C
from contactsheet.functions import kernels as K
from contactsheet.functions import scoring as S
from contactsheet.operators import diagnosis as D
from contactsheet.operators import lineage as L
from contactsheet.plans import media_more  # noqa: F401  (registers mut_upsert)
from contactsheet.plans.media import KEEPERS_SQL, SQL, bursts, query, table
from contactsheet.plans.media_ops import IMAGE_COLUMNS, PASS_COLUMNS
from contactsheet.sources import files as R
from contactsheet.sources import gallery as G
from contactsheet.sources import imports as I
from contactsheet.sources import tables as T
from contactsheet.streaming import drain, keepers, streams

c = F.col


def scratch(spark) -> str:
    """A new folder in the shared one; an error where that isn't set."""
    return f"{spark.conf.get('spark.checkpoint.dir')}/state-{uuid4()}"


DIAGNOSED = [
    "c_custkey AS image_id", "CASE c_custkey % 11 WHEN 0 THEN 'fail' WHEN 1 THEN 'raw_review' WHEN 2 THEN NULL ELSE 'pass' END AS pass1_status", "CASE WHEN c_custkey % 5 > 0 THEN 1 END AS pass1_at",
    "CASE WHEN c_custkey % 3 > 0 THEN 1 END AS pass2_at", "CASE WHEN c_custkey % 13 > 0 THEN 4 + CAST(c_custkey * 37 % 500 AS DOUBLE) / 100 END AS score", "CASE WHEN c_custkey % 7 = 0 THEN 1 END AS pass3_at",
]
TIMES = "ts AS queued_at, CASE WHEN event_id % 5 = 2 THEN ts END AS completed_at"


def diagnosis_sql(library: int, jobs: str, mode: str) -> str:
    return f"""(WITH i AS (SELECT {', '.join(DIAGNOSED)} FROM customer WHERE c_custkey % 2 = {library}), j AS (SELECT {', '.join(PASS_COLUMNS)}, {TIMES} FROM events WHERE user_id % 2 = {library} AND ({jobs})),
w AS (SELECT count(*) FILTER (WHERE job_type = 'pass1' AND status IN ('queued', 'running')) AS a, count(*) FILTER (WHERE job_type = 'pass2' AND status IN ('queued', 'running')) AS b,
 count(*) FILTER (WHERE job_type = 'pass3' AND status = 'complete' AND completed_at >= TIMESTAMP '2024-01-30 23:00:00' - INTERVAL 1 HOUR) AS h FROM j),
l AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY image_id, job_type ORDER BY id DESC) = 1),
q AS (SELECT id, rank() OVER (ORDER BY priority DESC, queued_at) AS position FROM j WHERE job_type = 'pass3' AND status = 'queued'),
r AS (SELECT i.*, w.*, x.status AS s1, x.priority AS p1, x.attempts AS t1, y.status AS s2, y.priority AS p2, y.attempts AS t2, z.status AS s3, z.priority AS p3, z.attempts AS t3, position FROM i, w
 LEFT JOIN l x ON x.image_id = i.image_id AND x.job_type = 'pass1' LEFT JOIN l y ON y.image_id = i.image_id AND y.job_type = 'pass2' LEFT JOIN l z ON z.image_id = i.image_id AND z.job_type = 'pass3' LEFT JOIN q ON q.id = z.id),
d AS (SELECT *, unnest(CASE
 WHEN pass3_at IS NOT NULL THEN [['complete', 'complete']] WHEN pass1_at IS NULL AND s1 = 'queued' THEN [['pass1_pending', 'queued']] WHEN pass1_at IS NULL AND s1 = 'running' THEN [['pass1_pending', 'running']]
 WHEN pass1_at IS NULL AND s1 = 'error' THEN [['pass1_failed', 'error']] WHEN pass1_at IS NULL THEN [['pass1_pending', 'no_job']]
 WHEN pass1_status = 'fail' THEN [['pass1_failed', 'culled']] WHEN pass1_status = 'raw_review' THEN [['raw_review', 'raw_review']]
 WHEN pass2_at IS NULL AND s2 = 'queued' THEN [['pass2_pending', 'queued']] WHEN pass2_at IS NULL AND s2 = 'running' THEN [['pass2_pending', 'running']] WHEN pass2_at IS NULL AND s2 = 'error' THEN [['pass2_pending', 'error']]
 WHEN pass2_at IS NULL THEN [['pass2_pending', 'no_job']] WHEN s3 = 'queued' THEN [['pass3_pending', 'queued']] WHEN s3 = 'running' THEN [['pass3_pending', 'running']] WHEN s3 = 'error' THEN [['pass3_pending', 'error']]
 WHEN score IS NULL THEN [['pass3_pending', 'no_score']] WHEN score < 6 THEN [['below_threshold', 'below_threshold']] WHEN a > 0 OR b > 0 THEN [['pass3_pending', 'gated']] ELSE [['pass3_pending', 'eligible']] END) AS d FROM r),
e AS (SELECT *, d[1] AS stage, d[2] AS reason FROM d)
SELECT image_id, stage, reason, stage = 'pass3_pending' AND reason = 'queued' AND {mode not in D.VISION_MODES} AS paused,
 CASE WHEN reason <> 'queued' THEN false WHEN stage = 'pass3_pending' THEN a > 0 OR b > 0 WHEN stage = 'pass2_pending' THEN a > 0 ELSE false END AS gated,
 CASE WHEN reason IN ('queued', 'running', 'error') THEN CASE stage WHEN 'pass2_pending' THEN p2 WHEN 'pass3_pending' THEN p3 ELSE p1 END END AS priority,
 CASE WHEN reason = 'error' THEN CASE stage WHEN 'pass2_pending' THEN t2 WHEN 'pass3_pending' THEN t3 ELSE t1 END END AS attempts,
 CASE WHEN stage = 'pass3_pending' AND reason = 'queued' THEN position END AS position, CASE WHEN h > 0 AND stage = 'pass3_pending' AND reason = 'queued' THEN round(position / (h / 60.0::DOUBLE), 1) END AS eta_minutes FROM e)"""


OPEN, DRAINED = "true", "event_type NOT IN ('click', 'view') OR event_id % 5 IN (2, 3)"


@query(f"{diagnosis_sql(0, DRAINED, 'auto')} UNION ALL {diagnosis_sql(1, OPEN, 'text')}")
def prj_why_blocked(spark, d):
    """PRJ-09. Two libraries: one is drained and in the mode in which all runs, the other has active jobs and doesn't load the model."""
    i, e = table(spark, d, "customer"), table(spark, d, "events")
    out = []
    for library, kept, mode in ((0, DRAINED, "auto"), (1, OPEN, "text")):
        jobs = e.where(f"user_id % 2 = {library} AND ({kept})").selectExpr(*PASS_COLUMNS, *TIMES.split(", ", 1))
        out.append(D.why_blocked(i.where(f"c_custkey % 2 = {library}").selectExpr(*DIAGNOSED), jobs, "2024-01-30 23:00:00", mode))
    return out[0].unionByName(out[1])


@query(f"""
WITH i AS (SELECT {', '.join(IMAGE_COLUMNS)}, p_partkey % 17 = 5 AS is_duplicate, p_size % 6 = 2 AS portfolio_worthy,
 CASE p_partkey % 19 WHEN 0 THEN 'missing' WHEN 1 THEN 'corrupt' WHEN 2 THEN 'video' WHEN 3 THEN 'sidecar' WHEN 4 THEN 'duplicate' WHEN 5 THEN 'fail' WHEN 6 THEN NULL ELSE 'pass' END AS outcome FROM part)
SELECT id, CASE outcome WHEN 'missing' THEN 'Missing' WHEN 'corrupt' THEN 'Corrupt' WHEN 'video' THEN 'Video' WHEN 'sidecar' THEN 'Sidecar' ELSE CASE WHEN is_duplicate OR coalesce(outcome = 'duplicate', false) THEN 'Burst' WHEN coalesce(outcome = 'fail', false) THEN 'Culled'
 WHEN posted_at IS NOT NULL THEN 'Posted' WHEN print_worthy THEN 'Print' WHEN portfolio_worthy THEN 'Portfolio' WHEN content_ready THEN 'Ready' WHEN nima IS NULL THEN 'Pending' ELSE 'Scored' END END AS status FROM i""")
def prj_photo_status(spark, d):
    """PRJ-02. All twelve steps of the ladder."""
    outcome = "CASE p_partkey % 19 WHEN 0 THEN 'missing' WHEN 1 THEN 'corrupt' WHEN 2 THEN 'video' WHEN 3 THEN 'sidecar' WHEN 4 THEN 'duplicate' WHEN 5 THEN 'fail' WHEN 6 THEN NULL ELSE 'pass' END AS outcome"
    i = table(spark, d, "part").selectExpr(*IMAGE_COLUMNS, "p_partkey % 17 = 5 AS is_duplicate", "p_size % 6 = 2 AS portfolio_worthy", outcome)
    return i.select("id", S.photo_status(c("outcome"), c("is_duplicate"), c("posted_at"), c("print_worthy"), c("portfolio_worthy"), c("content_ready"), c("nima")).alias("status"))


# Streams


@query()
def str_drain_starts(spark, d):
    """STR-07 as a stream: each user's events queue a job, keep it alive or end it; five queues. Held against a plain loop in the tests."""
    e, folder = table(spark, d, "events"), scratch(spark)
    s = streams.read_events(spark, d, "events.parquet", e.schema).withColumn("ts", c("ts").cast("timestamp"))
    kinds = F.create_map(*map(F.lit, ["click", "queued", "view", "queued", "purchase", "queued", "signup", "beat", "error", "done"]))
    passes = F.create_map(*map(F.lit, ["click", "pass1", "view", "pass2", "purchase", "pass3", "signup", "pass1", "error", "pass1"]))
    rows = s.select((c("user_id") % 5).alias("queue"), "event_id", "ts", c("user_id").alias("job_id"), kinds[c("event_type")].alias("kind"), passes[c("event_type")].alias("job_type"), (c("event_id") % 3).alias("priority"))
    streams.run_once(drain.starts(rows), f"{folder}/out", f"{folder}/state")
    return spark.read.schema(drain.STARTS).parquet(f"{folder}/out")


@query("""
WITH t AS (SELECT DISTINCT time_bucket(INTERVAL 5 MINUTE, ts) AS tick FROM events WHERE event_type = 'view'), p AS (SELECT event_id AS post_id, ts, CASE WHEN user_id % 10 = 0 THEN 'Boudoir' WHEN user_id % 10 > 1 THEN 'nature' END AS genre FROM events WHERE event_type = 'purchase')
SELECT post_id, genre FROM p WHERE coalesce(genre <> 'Boudoir', true) AND EXISTS (SELECT 1 FROM t WHERE abs(epoch(date_trunc('second', ts)) - epoch(tick)) <= 900)""")
def str_publisher_ticks(spark, d):
    """STR-06 as a stream: a tick for each five minutes with a view; purchases are the posts."""
    e, folder = table(spark, d, "events"), scratch(spark)
    s = streams.read_events(spark, d, "events.parquet", e.schema).where("event_type = 'view'")
    ticks = s.select(F.window(c("ts").cast("timestamp"), "5 minutes").start.alias("tick"))
    posts = e.where("event_type = 'purchase'").selectExpr("event_id AS post_id", "CAST(ts AS TIMESTAMP) AS scheduled_at", "CASE WHEN user_id % 10 = 0 THEN 'Boudoir' WHEN user_id % 10 > 1 THEN 'nature' END AS genre")
    streams.run_once(streams.due_posts(ticks, posts, "tick"), f"{folder}/out", f"{folder}/state")
    return spark.read.schema("post_id long, scheduled_at timestamp, genre string").parquet(f"{folder}/out").select("post_id", "genre")


@query(KEEPERS_SQL.replace("SELECT id AS vec_id, coalesce(", "SELECT id AS vec_id, CASE WHEN id % 9 > 0 THEN coalesce(").replace(", id) AS keeper FROM n, k", ", id) END AS keeper FROM n, k").replace("list_append(keepers, id) END FROM s", "CASE WHEN id % 9 = 0 THEN keepers ELSE list_append(keepers, id) END END FROM s"))
def str_incremental_keepers(spark, d):
    """JOIN-23 in four batches by id, each against the bands that those before have left; culled images are no keepers."""
    images, folder = bursts(spark, d).select(c("vec_id").alias("id"), "bits", (c("vec_id") % 9 == 0).alias("culled")), scratch(spark)
    step = images.agg(F.coalesce(F.max("id"), F.lit(0)) / 4 + 1).first()[0]
    for n in range(4):
        keepers.assign(spark, folder, images.where((c("id") >= n * step) & (c("id") < (n + 1) * step)), n)
    return keepers.assigned(spark, folder).withColumnRenamed("id", "vec_id")


# Tables


@query(SQL["mut_upsert"])
def snk_upsert_batches(spark, d):
    """SNK-01, twin of mut_upsert: two batches by key, the second of which runs twice."""
    folder = scratch(spark)
    old = table(spark, d, "customer").where("c_acctbal >= 0").select(c("c_custkey").alias("k"), c("c_acctbal").alias("rating"), c("c_name").alias("name"))
    new = table(spark, d, "orders").groupBy(c("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("rating"), F.max("o_orderpriority").alias("name"))
    for number, rows in ((0, old), (1, new), (1, new)):
        T.write_upsert(folder, rows, "k", ["rating"], ["name"], number, buckets=16)
    return T.read_table(spark, folder, "k long, rating double, name string")


@query("""
SELECT row_number() OVER (ORDER BY b, ts, k) AS id, kind, ts FROM (SELECT event_type AS kind, date_trunc('day', ts) AS ts, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 0 ELSE 1 END AS b, event_type AS k FROM events WHERE event_type IN ('error', 'signup'))""")
def snk_append_log(spark, d):
    """SNK-08, CRUD-03: a log in two batches, the second of which runs twice; equal entries stay, ids go on."""
    e, folder = table(spark, d, "events").where("event_type IN ('error', 'signup')"), scratch(spark)
    rows = lambda where: e.where(where).select(c("event_type").alias("kind"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"))
    for number, where in ((0, "ts < '2024-01-15'"), (1, "ts >= '2024-01-15'"), (1, "ts >= '2024-01-15'")):
        T.append_log(folder, rows(where), ["ts", "kind"], number)
    return T.read_log(spark, folder, "kind string, ts timestamp_ntz")


# Pictures


def tiled(spark, d, channels: int):
    """id, width, height and pixels of pictures of 64 x 64: 64 vectors are tiles of 8 x 8 each, of every channel in another order."""
    e = table(spark, d, "embeddings").select(F.expr("vec_id div 64 AS id"), F.expr("vec_id % 64 AS tile"), "embedding")
    grey = F.transform("embedding", lambda x: F.lpad(F.hex(F.least(F.greatest(F.round(x * F.lit(400).cast("float") + F.lit(128).cast("float")), F.lit(0)), F.lit(255)).cast("int")), 2, "0"))
    e = e.select("id", F.explode(F.sequence(F.lit(0), F.lit(channels - 1))).alias("channel"), "tile", grey.alias("g"))
    e = e.select("id", "channel", ((c("tile") + 21 * c("channel")) % 64).alias("tile"), F.posexplode("g").alias("i", "byte"))
    at = F.expr("(tile div 8 * 8 + i div 8) * 64 + tile % 8 * 8 + i % 8")
    rows = e.groupBy("id", (F.expr("tile div 8 * 8 + i div 8")).alias("y")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(at.alias("at"), "channel", "byte"))), lambda x: x["byte"]), "").alias("row"))
    whole = rows.groupBy("id").agg(F.count(F.lit(1)).alias("rows"), F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y", "row"))), lambda x: x["row"]), "")).alias("pixels"))
    return whole.where(F.octet_length("pixels") == 64 * 64 * channels).select("id", F.lit(64).alias("width"), F.lit(64).alias("height"), "pixels")


@query()
def udf_cull_scores(spark, d):
    """UDF-01 to UDF-09, with all 5 x 5 zones: no SQL, tests hold the kernels against brute force."""
    scored = K.cull_scores(K.signals(tiled(spark, d, 1), "id"))
    blend = S.blend({k: c(k) for k in S.CULL_WEIGHTS}, S.CULL_WEIGHTS)
    out = scored.withColumn("cull_score", F.when(c("blank_frame"), 0.0).otherwise(blend))
    return out.select("id", "cull_score", S.cull_status(c("cull_score"), c("id") % 2 == 0).alias("status"), "whole_zone", "zone_sharpness", "phash")


@query()
def udf_composition(spark, d):
    """UDF-10: all eight signals; every third picture comes with a face and its score, as a detector would give them."""
    images = tiled(spark, d, 3).withColumns({"face_placement": F.when(c("id") % 3 == 0, 6.5), "face": F.when(c("id") % 3 == 0, F.array(F.lit(10), F.lit(12), F.lit(16), F.lit(18)))})
    return C.scores(images, "id")


@query("""
WITH v AS (SELECT vec_id // 64 AS id, vec_id % 64 AS tile, [least(greatest(round(x * 400 + 128), 0), 255)::INT for x in embedding] AS g FROM embeddings),
p AS (SELECT id, tile // 8 * 2 + (i // 8) // 4 AS y, tile % 8 * 2 + (i % 8) // 4 AS x, g[i + 1] AS b FROM v, range(0, 64) r(i)),
m AS (SELECT id, y, x, round_even(avg(b), 0)::INT AS b, count(*) OVER (PARTITION BY id) AS n FROM p GROUP BY 1, 2, 3)
SELECT id, 16 AS width, 16 AS height, string_agg(printf('%02X', b), '' ORDER BY y, x) AS pixels FROM m WHERE n = 256 GROUP BY id""")
def src_previews(spark, d):
    """SRC-07: pictures of 64 x 64 reduced to 16 x 16 by area."""
    return K.previews(tiled(spark, d, 1), "id", 16).select("id", "width", "height", F.hex("pixels").alias("pixels"))


# Lineage and galleries

SCORED = ["p_partkey AS id", "CASE WHEN p_partkey % 4 > 0 THEN p_partkey - p_partkey % 4 + p_partkey % 4 - 1 WHEN p_partkey % 28 = 0 THEN -1 END AS edited_from_id"] + [
    f"CASE WHEN (p_partkey + {i}) % 7 > 0 THEN CAST((p_partkey * {37 + i}) % 1000 AS DOUBLE) / 100 END AS {f}" for i, f in enumerate(L.FIELDS)
] + [f"CASE WHEN (p_partkey + {i}) % 5 > 0 THEN (p_partkey * {i + 3}) % 8 < 3 END AS {f}" for i, f in enumerate(L.FLAGS)]


@query(f"""
WITH i AS (SELECT {', '.join(SCORED)} FROM part), x AS (SELECT id, edited_from_id, unnest([{', '.join(repr(f) for f in [*L.FIELDS, *L.FLAGS])}]) AS field, unnest([{', '.join(f'{f}::DOUBLE' for f in L.FIELDS)}, {', '.join(f'{f}::INT::DOUBLE' for f in L.FLAGS)}]) AS s FROM i)
SELECT a.id, a.edited_from_id, a.field, b.s AS before, a.s AS after, round(a.s - b.s, 6) AS delta, round(a.s - b.s, 6) > 0 AS improved FROM x a JOIN x b ON b.id = a.edited_from_id AND b.field = a.field WHERE a.s IS NOT NULL AND b.s IS NOT NULL""")
def prj_lineage_deltas(spark, d):
    """PRJ-15: all eleven fields of edits, and edits of edits, against what they were made from."""
    return L.lineage_deltas(table(spark, d, "part").selectExpr(*SCORED))


@query(f"""
WITH RECURSIVE i AS (SELECT {', '.join(SCORED[:2])} FROM part), p AS (SELECT id, CASE WHEN edited_from_id IN (SELECT id FROM i) THEN edited_from_id END AS up FROM i),
w AS (SELECT id, id AS top, 0::BIGINT AS steps FROM p UNION ALL SELECT w.id, up, steps + 1 FROM w JOIN p ON p.id = w.top WHERE up IS NOT NULL)
SELECT id, arg_max(top, steps) AS original, max(steps) AS steps FROM w GROUP BY id""")
def prj_lineage_originals(spark, d):
    """PRJ-15: the first of each chain of edits."""
    return L.originals(table(spark, d, "part").selectExpr(*SCORED[:2]), "id", "edited_from_id")


ASSETS = [
    "p_brand AS section", "'img-' || p_partkey AS slug", "'img-' || p_partkey || '.jpg' AS file_name", "CASE p_partkey % 5 WHEN 0 THEN 'wide' WHEN 1 THEN 'tall' WHEN 2 THEN 'reveal-x' ELSE 'standard' END AS layout",
    "p_name || ' <b> & \"' || p_type || '\" it' || chr(39) || 's' AS alt", "p_name || ' &amp; <i> > \"x\"' AS caption", "CASE WHEN p_partkey % 3 > 0 THEN CAST(p_partkey % 9 AS VARCHAR(9)) ELSE '2' END AS version",
    "CASE WHEN p_partkey % 2 = 0 THEN 100 + p_size END AS width", "CASE WHEN p_partkey % 2 = 0 THEN 50 + p_size END AS height",
]


@query(f"SELECT {', '.join(ASSETS)}, (row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) - 1)::INT AS sort_index FROM part")
def src_gallery_round_trip(spark, d):
    """SRC-08, SNK-05: figures of all parts rendered by section, set into a page, and parsed again: what went in, in the page's order."""
    from contactsheet.operators.ranks import numbered

    parts = numbered(table(spark, d, "part"), "n", [F.desc("p_retailprice"), c("p_partkey")], ["p_brand"])
    assets = parts.selectExpr(*ASSETS, "n * 3 AS sort_index")
    pages = G.render_galleries(assets, True).withColumn("html", F.concat(F.lit("<html><body><figure>none</figure>"), "html", F.lit('<div class="x">\n </div></body></html>')))
    return G.parse_galleries(pages).where("error IS NULL").select("section", "slug", "file_name", "layout", "alt", "caption", "version", "width", "height", "sort_index")


# Files


@query("SELECT s_suppkey, s_name, s_nationkey, round(s_acctbal, 2) AS s_acctbal FROM supplier")
def snk_csv_round_trip(spark, d):
    """SNK-03, SRC-09: a table as CSV with a header, read again as a baseline with its schema given."""
    folder = scratch(spark)
    R.write_csv(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", F.round("s_acctbal", 2).alias("s_acctbal")), folder)
    return R.read_baseline(spark, folder, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")


@query("SELECT day, n FROM (VALUES ('2001-06-01'), ('2001-06-02')) v(day), (SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F')")
def snk_report_snapshots(spark, d):
    """SNK-02: the report of two days, each a row of JSON that is added; read back from it."""
    folder = scratch(spark)
    report = table(spark, d, "orders").where("o_orderstatus = 'F'").agg(F.count(F.lit(1)).alias("n"))
    for day in ("2001-06-01", "2001-06-02"):
        R.write_report(report, folder, day)
    return spark.read.parquet(folder).select(F.date_format("created_at", "yyyy-MM-dd").alias("day"), F.from_json("report_json", "n long")["n"].alias("n"))


@query(f"""
WITH i AS (SELECT {', '.join(IMAGE_COLUMNS)} FROM part)
SELECT id, regexp_extract(file_path, '([^/]*?)(\\.[^./]*)?$', 1) || '_' || substr(md5(regexp_replace(file_path, '/[^/]*$', '')), 1, 8) AS cache_key, sha256(file_path) AS digest FROM i""")
def src_cache_keys(spark, d):
    """SRC-07's key, and str-hash: the digest of what a file holds, here its path."""
    i = table(spark, d, "part").selectExpr(*IMAGE_COLUMNS)
    return i.select("id", R.cache_key(c("file_path")).alias("cache_key"), F.sha2(c("file_path").cast("binary"), 256).alias("digest"))


@query("SELECT s_suppkey, NULL::VARCHAR AS note, s_name, NULL::DOUBLE AS score FROM supplier")
def mut_ensure_columns(spark, d):
    """MUT-19: a table brought to a wider schema."""
    schema = spark.createDataFrame([], "s_suppkey long, note string, s_name string, score double").schema
    return R.ensure_columns(table(spark, d, "supplier"), schema)


@query("""
WITH e AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS h, event_type, value FROM events)
SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS hour, count(*) FILTER (WHERE event_type = 'signup' AND value > 150) AS critical, count(*) FILTER (WHERE event_type = 'error') AS errors,
 CASE WHEN count(*) FILTER (WHERE event_type = 'signup' AND value > 150) > 0 THEN 'red' WHEN count(*) FILTER (WHERE event_type = 'error') > 3 THEN 'yellow' ELSE 'green' END AS health FROM e GROUP BY h""")
def str_stream_health(spark, d):
    """STR-05 as a stream that runs over all files there are and ends."""
    e, folder = table(spark, d, "events"), scratch(spark)
    s = streams.read_events(spark, d, "events.parquet", e.schema).withColumn("ts", c("ts").cast("timestamp"))
    kinds = s.withColumn("kind", F.when((c("event_type") == "signup") & (c("value") > 150), "critical").when(c("event_type") == "error", "error"))
    streams.run_once(streams.health(kinds, "ts", "kind"), f"{folder}/out", f"{folder}/state", "complete")
    return spark.read.parquet(f"{folder}/out").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "critical", "errors", "health")


@query(f"""
WITH i AS (SELECT {', '.join(IMAGE_COLUMNS)}, p_size * 1000 AS length FROM part), f AS (SELECT regexp_replace(file_path, '/[^/]*$', '') AS folder, length FROM i WHERE file_path NOT LIKE '%.txt' AND id % 10 > 0)
SELECT folder, count(*) AS images, sum(length)::BIGINT AS bytes FROM f GROUP BY 1 UNION ALL SELECT NULL, count(*), sum(length)::BIGINT FROM f""")
def src_card_scan(spark, d):
    """SRC-03. Parts are the files of a card; every tenth is no picture."""
    i = table(spark, d, "part").selectExpr(*IMAGE_COLUMNS, "p_size * 1000 AS length")
    files = i.select(F.when(c("id") % 10 == 0, F.concat("file_path", F.lit(".txt"))).otherwise(c("file_path")).alias("path"), c("length").cast("long").alias("length"))
    return I.card_scan(files)


IMPORTED_SQL = f"""i AS (SELECT {', '.join(IMAGE_COLUMNS)} FROM part), k AS (SELECT *, pass1_status AS s FROM i WHERE id % 3 = 0),
f AS (SELECT DISTINCT file_path AS path FROM i WHERE id % 2 = 0 OR id % 3 = 0), a AS (SELECT path, CASE WHEN regexp_matches(lower(path), '\\.(arw|dng)$') THEN 'skipped_raw' WHEN NOT regexp_matches(lower(path), '\\.(jpg|tif)$') THEN 'skipped_other'
 WHEN path IN (SELECT file_path FROM k) THEN 'update' ELSE 'insert' END AS action FROM f WHERE NOT regexp_matches(path, '/\\._[^/]*$'))"""


@query(f"WITH {IMPORTED_SQL} SELECT path, action FROM a")
def src_import_plan(spark, d):
    """SRC-10."""
    i = table(spark, d, "part").selectExpr(*IMAGE_COLUMNS)
    return I.import_plan(i.where("id % 2 = 0 OR id % 3 = 0").select(c("file_path").alias("path")), i.where("id % 3 = 0"))


@query(f"""
WITH {IMPORTED_SQL} SELECT path AS file_path, action, coalesce(s, 'pass') AS pass1_status, CASE WHEN pass2_at IS NULL THEN '2001-06-01' ELSE '1999-01-01' END AS pass2_day, coalesce(genre, 'none') AS genre
FROM a LEFT JOIN k ON k.file_path = a.path WHERE action IN ('insert', 'update')""")
def mut_manual_import(spark, d):
    """SRC-10, MUT-04."""
    i = table(spark, d, "part").selectExpr(*IMAGE_COLUMNS)
    at = lambda name: F.when(c(name).isNotNull(), F.lit("1999-01-01").cast("timestamp")).alias(name)
    known = i.where("id % 3 = 0").select("file_path", "pass1_status", at("pass1_at"), at("pass2_at"), at("pass3_at"), "genre", F.lit(False).alias("content_ready"), F.lit(False).alias("manual_added"))
    plan = I.import_plan(i.where("id % 2 = 0 OR id % 3 = 0").select(c("file_path").alias("path")), known)
    out = I.imported(plan, known, "2001-06-01 00:00:00")
    return out.select("file_path", "action", "pass1_status", F.date_format("pass2_at", "yyyy-MM-dd").alias("pass2_day"), F.coalesce("genre", F.lit("none")).alias("genre"))


@query("""
WITH o AS (SELECT p_brand AS section, p_partkey AS slug, p_size AS sort_index, CASE WHEN p_size % 2 = 0 THEN 'retired' ELSE 'live' END AS state FROM part WHERE p_partkey % 3 > 0), n AS (SELECT p_brand AS section, p_partkey AS slug, p_size + 1 AS sort_index FROM part WHERE p_partkey % 4 > 0)
SELECT coalesce(o.section, n.section) AS section, coalesce(o.slug, n.slug) AS slug, coalesce(n.sort_index, o.sort_index) AS sort_index, CASE WHEN n.slug IS NOT NULL THEN 'live' ELSE state END AS state, CASE WHEN o.slug IS NOT NULL THEN '1999-05-05' ELSE '2001-06-01' END AS first_day
FROM o FULL JOIN n ON o.section = n.section AND o.slug = n.slug""")
def mut_seed_assets(spark, d):
    """MUT-05."""
    p = table(spark, d, "part").select(c("p_brand").alias("section"), c("p_partkey").alias("slug"), c("p_size").alias("sort_index"))
    then = F.lit("1999-05-05").cast("timestamp")
    old = p.where("slug % 3 > 0").select("*", F.when(c("sort_index") % 2 == 0, "retired").otherwise("live").alias("state"), then.alias("first_published_at"), then.alias("last_published_at"))
    out = I.seeded_assets(old, p.where("slug % 4 > 0").withColumn("sort_index", c("sort_index") + 1), "2001-06-01")
    return out.select("section", "slug", "sort_index", "state", F.date_format("first_published_at", "yyyy-MM-dd").alias("first_day"))
