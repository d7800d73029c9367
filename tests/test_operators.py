"""Small tables for what the queries' data don't hold: nulls, ties, edges, empty tables."""

import datetime as dt
import os

import numpy as np
from pyspark.sql import functions as F

from contactsheet.functions import composition, kernels, scoring, text
from contactsheet.operators import compare, filters, jobs, joins, windows
from contactsheet.sources import files
from contactsheet.streaming import streams


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


JOBS = "id long, job_type string, image_id long, status string, priority int, attempts int, queued_at timestamp, started_at timestamp, heartbeat_at timestamp"


def job(i, image, status, priority=5, attempts=0, kind="pass1", beat=None, start=None):
    return (i, kind, image, status, priority, attempts, dt.datetime(2024, 1, 1), start, beat)


def test_enqueue_actions(spark):
    old = spark.createDataFrame([job(1, 1, "complete"), job(2, 2, "running"), job(3, 3, "queued", 5), job(4, 4, "error", 5, 3), job(5, 5, "error", 5, 1), job(6, 6, "error"), job(7, 6, "queued", 9)], JOBS)
    asked = spark.createDataFrame([(i, "pass1", 7) for i in range(1, 8)] + [(7, "pass1", 9)], "image_id long, job_type string, priority int")
    plan = {r.image_id: (r.action, r.new_priority) for r in jobs.enqueue_plan(asked, old).collect()}
    assert plan == {1: ("reuse", 5), 2: ("reuse", 5), 3: ("raise", 7), 4: ("reuse", 5), 5: ("requeue", 7), 6: ("reuse", 9), 7: ("insert", 9)}
    forced = {r.image_id: r.action for r in jobs.enqueue_plan(asked, old, force=True).collect()}
    assert forced[1] == "insert" and forced[2] == "reuse"


def test_enqueue_twice_changes_nothing(spark):
    asked = spark.createDataFrame([(1, "pass1", 7)], "image_id long, job_type string, priority int")
    after = spark.createDataFrame([job(1, 1, "queued", 7)], JOBS)
    assert values(jobs.enqueue_plan(asked, after), "action") == [("reuse",)]


def test_stuck_edges(spark):
    t = dt.datetime(2024, 1, 1, 12)
    m = lambda n: t - dt.timedelta(minutes=n)
    rows = [job(1, 1, "running", beat=m(5)), job(2, 2, "running", beat=m(6)), job(3, 3, "running", start=m(15)), job(4, 4, "running", start=m(16)), job(5, 5, "queued", beat=m(60)), job(6, 6, "running", beat=m(1), start=m(99))]
    assert sorted(values(jobs.stuck(spark.createDataFrame(rows, JOBS), "2024-01-01 12:00:00"), "id")) == [(2,), (4,)]


def test_promotions_wait_for_the_gate(spark):
    images = spark.createDataFrame(
        [(1, "pass", None, None, None, None, "wedding", None), (2, "pass", 1, None, None, 6.5, "wedding", None), (3, "pass", 1, None, None, 5.9, "x", None), (4, "pass", 1, 1, None, 6.9, "boudoir", None)],
        "id long, pass1_status string, pass2_at int, pass3_at int, privacy_at int, score double, genre string, faces_present boolean",
    )
    done = spark.createDataFrame([job(1, 1, "complete", 8)], JOBS)
    assert sorted(values(jobs.promotions(images, done), "image_id", "job_type", "priority")) == [(1, "pass2", 8), (2, "pass3", 10), (4, "privacy", 3)]
    busy = spark.createDataFrame([job(1, 9, "queued")], JOBS)
    assert values(jobs.promotions(images, busy), "image_id", "job_type") == [(4, "privacy")]


def test_upsert_keeps_and_overwrites(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "y")], "k int, o string, c string")
    new = spark.createDataFrame([(1, None, "n"), (2, "z", "n"), (3, "q", "n")], "k int, o string, c string")
    assert sorted(values(jobs.upsert(old, new, "k", ["o"], ["c"]), "k", "o", "c")) == [(1, None, "n"), (2, "z", "y"), (3, "q", "n")]


def test_sequences_once(spark):
    b = spark.createDataFrame([(1, "booked", dt.date(2024, 1, 6)), (2, "booked", dt.date(2024, 1, 20)), (3, "booked", dt.date(2024, 1, 2))], "booking_id long, status string, shoot_date date")
    rules = spark.createDataFrame([("pre_shoot", "booked", 0, 8, [-48, -24], "shoot")], "sequence string, status string, from_days int, to_days int, offsets array<int>, anchor string")
    sent = spark.createDataFrame([(3, "pre_shoot")], "booking_id long, sequence string")
    out = jobs.sequence_steps(b, sent, rules, "2024-01-01 00:00:00")
    assert sorted(values(out, "booking_id", "step_index", "due_at")) == [(1, 0, dt.datetime(2024, 1, 4)), (1, 1, dt.datetime(2024, 1, 5))]


def test_bands_and_weakness(spark):
    df = spark.createDataFrame([(6.5, 4.0, 4.0), (7.0, 5.0, None), (None, None, None), (6.49, 6.0, 3.0)], "x double, a double, b double")
    out = df.select(scoring.banded(F.col("x"), scoring.PRINT_TIERS, "below").alias("t"), scoring.weakest({"a": F.col("a"), "b": F.col("b")}).alias("w"))
    assert [tuple(r) for r in out.collect()] == [("standard", "a"), ("fine_art", None), (None, None), ("below", "b")]


def test_anniversary_of_a_leap_day(spark):
    df = spark.createDataFrame([(dt.date(2020, 2, 29),), (dt.date(2019, 3, 1),), (dt.date(2019, 1, 1),)], "d date")
    got = df.select(scoring.next_anniversary(F.col("d"), F.lit("2023-02-01").cast("date")).alias("n")).collect()
    assert [r.n for r in got] == [None, dt.date(2023, 3, 1), dt.date(2024, 1, 1)]


def test_tags_in_both_dialects(spark):
    df = spark.createDataFrame([('["a","B"]',), ("x, y",), ("",), (None,), ("[broken",)], "t string")
    assert [r.l for r in df.select(text.list_or_csv(F.col("t")).alias("l")).collect()] == [["a", "B"], ["x", "y"], [], [], []]


def test_first_wins(spark):
    df = spark.createDataFrame([(["b", "A", "a", "B", "c"],), ([],)], "t array<string>")
    assert [r.l for r in df.select(text.first_wins(F.col("t")).alias("l")).collect()] == [["b", "A", "c"], []]


def test_fallback_and_nulls(spark):
    a, b = spark.createDataFrame([], "x int"), spark.createDataFrame([(1,), (None,)], "x int")
    assert len(values(filters.with_fallback(a, b), "x")) == 2
    assert values(filters.with_fallback(b.where("x = 1"), b), "x") == [(1,)]
    assert len(values(b.where(filters.not_equal(F.col("x"), 2, True)), "x")) == 2


def test_season_over_new_year(spark):
    seasons = spark.createDataFrame([("winter", "11-20", "01-05"), ("leap", "02-29", "03-02")], "label string, start_md string, end_md string")
    got = sorted(values(joins.windows_in_horizon(seasons, "2023-12-01", 120), "label", "start"))
    assert got == [("leap", dt.date(2024, 2, 29)), ("winter", dt.date(2023, 11, 20))]


def test_deltas(spark):
    a = spark.createDataFrame([(1, 1.0, None), (2, 1.0, 1.0)], "k int, x double, y double")
    b = spark.createDataFrame([(1, 2.0, 3.0), (2, 2.0, 0.5)], "k int, x double, y double")
    assert sorted(values(compare.verdicts(compare.deltas(a, b, "k", ["x", "y"]), "k"), "k", "status")) == [(1, "improved"), (2, "mixed")]


def test_empty_grid(spark):
    cols = "palette string, mood string, genre string, composition string"
    c, g = spark.createDataFrame([(1, "warm", "m", "g", "c")], f"id int, {cols}"), spark.createDataFrame([], f"posted int, {cols}")
    assert values(windows.grid_fit(c, g, "id"), "grid_fit") == [(0.85,)]


def test_kernels():
    flat, checker = np.full((64, 64), 128, np.uint8), (np.indices((64, 64)).sum(axis=0) % 2 * 255).astype(np.uint8)
    assert kernels.cull_signals(flat)["std"] == 0 and kernels.edge_fraction(flat) == 0
    assert kernels.cull_signals(checker)["highlight_pct"] == 50 and kernels.cull_signals(checker)["tonal_range"] == 255
    ramp = np.tile(np.arange(64, dtype=np.uint8) * 4, (64, 1))
    image = np.random.default_rng(4).integers(0, 200, (64, 64)).astype(np.uint8)
    bits = lambda a, b: bin((kernels.perceptual_hash(a) ^ kernels.perceptual_hash(b)) % (1 << 64)).count("1")
    assert bits(image, image + 20) <= 2 and bits(image, image[:, ::-1]) > 8
    assert abs(composition.similarity(ramp, ramp) - 1) < 1e-9
    step = np.zeros((40, 40), np.uint8)
    step[:, 20:] = 255
    assert 0 < kernels.edge_fraction(step) < 0.1


def test_signals_report_bad_images(spark):
    df = spark.createDataFrame([(1, 2, 2, bytes([0, 255, 0, 255])), (2, 3, 3, b"x"), (3, None, 1, None)], "id long, width int, height int, pixels binary")
    got = {r.id: (r.error is None, r.std) for r in kernels.signals(df, "id").collect()}
    assert got[1] == (True, 127.5) and not got[2][0] and not got[3][0]


def test_scan_and_names(spark, tmp_path):
    for name, n in (("a/x.jpg", 300_000), ("b/x.jpg", 10), ("b/.h.jpg", 5), ("b/y.CR2", 5), ("b/z.txt", 5)):
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_bytes(b"0" * n)
    scan = files.classified(files.listing(spark, str(tmp_path)))
    assert {r.reason: r.files for r in files.scan_summary(scan).collect()} == {"accepted": 2, "too_small": 1, "extension": 1}  # Spark's listing leaves hidden files out by itself
    names = spark.createDataFrame([("x.jpg", 1), ("x.jpg", 2), ("y", 3)], "name string, o int")
    assert sorted(values(files.renamed(names, "name", "o"), "target")) == [("x.jpg",), ("x_1.jpg",), ("y",)]


def test_fence_leaves_other_bytes(spark):
    page = "top\r\n<!--a-->\nold\n<!--b-->\n tail  "
    df = spark.createDataFrame([(page, "new"), ("no fence", "new")], "p string, b string")
    got = [r.x for r in df.select(files.fenced(F.col("p"), "<!--a-->", "<!--b-->", F.col("b")).alias("x")).collect()]
    assert got == [page.replace("old", "new"), None]


def test_ingest_once(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    os.makedirs(src)
    (tmp_path / "in/a.jpg").write_bytes(b"1")
    streams.ingest(files.listing(spark, src, streaming=True), out, state).awaitTermination()
    (tmp_path / "in/b.jpg").write_bytes(b"1")
    streams.ingest(files.listing(spark, src, streaming=True), out, state).awaitTermination()
    assert spark.read.parquet(out).count() == 2


def test_stale_jobs_once(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 12)
    at = lambda n: t + dt.timedelta(minutes=n)
    schema = "job long, ts timestamp"
    for i, rows in enumerate(([(1, at(0)), (2, at(0))], [(2, at(4)), (2, at(30))], [(3, at(60))], [(3, at(61))])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        streams.run_once(streams.stale_jobs(stream, "job", "ts"), str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted(r.job for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [1, 2]


def test_hamming_bands_miss_nothing(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(6, 64))
    rows = [(int(i * 10 + k), [float(x) for x in (b * np.where(rng.random(64) < 0.06 * k, -1, 1))]) for i, b in enumerate(base) for k in range(4)]
    h = spark.createDataFrame(rows, "id long, v array<double>").select("id", joins.bits_of(F.col("v")).alias("bits"))
    reps = {r.id: r.rep for r in joins.hash_classes(h, "id", "bits").collect()}
    got = {(r.a, r.b, r.distance) for r in joins.hamming_pairs(h, "id", "bits", 8).collect()}
    sign = {i: np.array(v) > 0 for i, v in rows}
    keep = sorted(set(reps.values()))
    want = {(a, b, int((sign[a] != sign[b]).sum())) for a in keep for b in keep if a < b and (sign[a] != sign[b]).sum() <= 8}
    assert got == want
