"""Streams with state, keepers by batch and tables that batches change, against plain loops."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from contactsheet.functions import text
from contactsheet.operators import joins
from contactsheet.plans import media, media_state  # noqa: F401
from contactsheet.sources import tables
from contactsheet.streaming import drain, keepers, streams

US = 1_000_000
EPOCH = datetime.datetime(1970, 1, 1)


def drained(rows, until, period=900 * US, stale=1800 * US, slots=4, most=3):
    """Starts by a plain loop over polls. rows: (us, event_id, job, kind, pass, priority)."""
    rows, jobs, out, i = sorted(rows), {}, [], 0
    if not rows:
        return out
    t = -(-rows[0][0] // period) * period
    while t < until and (i < len(rows) or jobs):
        while i < len(rows) and rows[i][0] <= t:
            us, _, job, kind, kind_of, priority = rows[i]
            i += 1
            if kind == "queued":
                jobs.setdefault(job, {"pass": kind_of, "key": (-priority, us, job), "seen": None, "tries": 0})
            elif job in jobs and jobs[job]["seen"] is not None:
                if kind == "done":
                    jobs.pop(job)
                else:
                    jobs[job]["seen"] = max(us, jobs[job]["seen"])
        for job in [j for j, v in jobs.items() if v["seen"] is not None and v["seen"] < t - stale]:
            if jobs[job]["tries"] >= most:
                jobs.pop(job)
            else:
                jobs[job]["seen"] = None
        if jobs:
            now = min(v["pass"] for v in jobs.values())
            free = slots - sum(v["seen"] is not None for v in jobs.values())
            ready = sorted((v["key"], j) for j, v in jobs.items() if v["pass"] == now and v["seen"] is None)
            for _, j in ready[: max(0, free)]:
                jobs[j]["seen"], jobs[j]["tries"] = t, jobs[j]["tries"] + 1
                out.append((t, j, now, jobs[j]["tries"]))
        t += period
    return out


SCHEMA = "queue long, event_id long, ts timestamp, job_id long, kind string, job_type string, priority long"


def write(spark, folder, rows, number):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_drain_over_batches_and_a_restart(spark, tmp_path):
    """The same starts however the stream is cut, with a stop between; no later pass starts while an earlier one has jobs."""
    rng = random.Random(8)
    start = datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(900):
        us = int((start - EPOCH).total_seconds()) * US + i * 60 * US + rng.randrange(60 * US)
        rows.append((us, i, i % 3, rng.randrange(40), rng.choice(["queued", "queued", "beat", "done"]), rng.choice(drain.PASSES), rng.randrange(3)))
    as_rows = [(q, i, EPOCH + datetime.timedelta(microseconds=us), j, k, p, n) for us, i, q, j, k, p, n in rows]
    odd = [(None, 1, start, 1, "queued", "pass1", 1), (0, 2, start, 1, "other", "pass1", 1), (0, 3, start, 1, "queued", "pass9", 1)]
    until = (max(r[0] for r in rows) // 1000 - 600_000) * 1000
    want = sorted((q, *x) for q in range(3) for x in drained([(us, i, j, k, p, n) for us, i, g, j, k, p, n in rows if g == q], until))
    for name, cuts in (("whole", [0, 900]), ("parts", [0, 200, 450, 900])):
        src, out, state = f"{tmp_path}/{name}/in", f"{tmp_path}/{name}/out", f"{tmp_path}/{name}/state"
        for n, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            write(spark, src, as_rows[a:b] + (odd if n == 0 else []), n)
            s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
            streams.run_once(drain.starts(s), out, state)
        got = spark.read.schema(drain.STARTS).parquet(out).select("queue", F.unix_micros("poll").alias("us"), "job_id", "job_type", "attempt").collect()
        assert sorted((r.queue, r.us, r.job_id, r.job_type, r.attempt) for r in got) == want and len(want) > 50


def test_publisher_ticks_each_post_once(spark, tmp_path):
    start = datetime.datetime(2024, 5, 1)
    at = lambda m: start + datetime.timedelta(minutes=m)
    posts = spark.createDataFrame([(i, at(i * 7), "boudoir" if i % 10 == 3 else None if i % 10 == 4 else "nature") for i in range(120)], "post_id long, scheduled_at timestamp, genre string")
    ticks = [m for m in range(0, 700, 5) if not 200 < m < 330]
    for n in range(4):
        spark.createDataFrame([(at(m),) for m in ticks[n * 30 : (n + 1) * 30]], "tick timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        s = spark.readStream.schema("tick timestamp").parquet(f"{tmp_path}/in")
        due = streams.due_posts(s, posts, "tick")
        streams.run_once(due, f"{tmp_path}/out", f"{tmp_path}/state")
    got = sorted(r.post_id for r in spark.read.schema("post_id long").parquet(f"{tmp_path}/out").collect())
    assert got == [i for i in range(120) if i % 10 != 3 and any(abs(i * 7 - m) <= 15 for m in ticks[:120])]
    still = streams.due_posts(spark.read.parquet(f"{tmp_path}/in"), posts, "tick")
    assert "NestedLoop" not in still._jdf.queryExecution().toString() and "Cartesian" not in still._jdf.queryExecution().toString()


def hashes(n=240):
    rng = random.Random(5)
    words, out = [rng.getrandbits(64) for _ in range(30)], []
    for i in range(n):
        w = rng.choice(words)
        for b in rng.sample(range(64), rng.randrange(0, 7)):
            w ^= 1 << b
        out.append((i, w, i % 11 == 0))
    return out


def test_keepers_by_batch_are_those_of_the_whole(spark, tmp_path):
    rows = hashes()
    near, keeping, want = lambda a, b: bin(a ^ b).count("1") <= 8, [], {}
    for i, w, culled in rows:
        first = next((k for k, x in keeping if near(w, x)), None)
        want[i] = None if culled else i if first is None else first
        if want[i] == i:
            keeping.append((i, w))
    df = spark.createDataFrame([(i, [w >> 32, w & 0xFFFFFFFF], c) for i, w, c in rows], "id long, bits array<long>, culled boolean")
    for n, (a, b) in enumerate(((0, 100), (100, 101), (101, 240))):
        for _ in range(1 + (n == 2)):  # the last batch runs twice
            keepers.assign(spark, str(tmp_path), df.where((F.col("id") >= a) & (F.col("id") < b)), n)
    assert {r.id: r.keeper for r in keepers.assigned(spark, str(tmp_path)).collect()} == want
    whole = joins.hamming_keepers(df.where("NOT culled"), "id", "bits", 8)
    assert {r.id: r.keeper for r in whole.collect()} == {i: k for i, k in want.items() if k is not None}
    assert sum(k not in (None, i) for i, k in want.items()) > 100


def test_keepers_from_a_stream(spark, tmp_path):
    df = spark.createDataFrame([(i, [w >> 32, w & 0xFFFFFFFF], c) for i, w, c in hashes(60)], "id long, bits array<long>, culled boolean")
    df.where("id < 30").coalesce(1).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        s = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        keepers.stream(s, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        df.where("id >= 30").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    whole = joins.hamming_keepers(df.where("NOT culled AND id < 60"), "id", "bits", 8)
    got = {r.id: r.keeper for r in keepers.assigned(spark, f"{tmp_path}/out").where("keeper IS NOT NULL").collect()}
    assert got == {r.id: r.keeper for r in whole.collect()}


def test_schedule_positions_beyond_the_month_and_repeated(spark):
    df = spark.createDataFrame([(i // 2, "x") for i in range(80)], "id long, name string")
    got = joins.schedule_positions(df, [F.col("id")], "2001-02-10").orderBy("position").collect()
    assert [r.position for r in got] == list(range(1, 81)) and [r.id for r in got] == [i // 2 for i in range(80)]
    assert [r.disposition for r in got] == ["planned"] * 28 + ["overflow"] * 52 and str(got[27].post_date) == "2001-02-28" and got[28].post_date is None


def test_names_of_queries_are_taken_once():
    with pytest.raises(ValueError):
        media.query()(media.QUERIES["agg_turnaround"])


def test_upsert_batches(spark, tmp_path):
    folder, schema = f"{tmp_path}/t", "k string, v long, note string"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    assert tables.read_table(spark, folder, schema).count() == 0
    tables.write_upsert(folder, frame([("a", 1, None), ("b", 2, "x"), (None, 3, "n")]), "k", ["v"], ["note"], 0, buckets=4)
    for _ in range(2):
        tables.write_upsert(folder, frame([("a", 9, "new"), ("b", None, "y"), ("c", 5, None), ("c", 4, "z")]), "k", ["v"], ["note"], 1, buckets=4)
    tables.write_upsert(folder, frame([]), "k", ["v"], ["note"], 2, buckets=4)
    got = {r.k: (r.v, r.note) for r in tables.read_table(spark, folder, schema).collect()}
    assert got == {"a": (9, "new"), "b": (None, "x"), "c": (5, None), None: (3, "n")}
    assert {r.k for r in tables.read_table(spark, folder, schema, before=1).collect()} == {"a", "b", None}


def test_append_log(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "t long, m string")
    for number, rows in ((0, [(1, "a"), (1, "a"), (2, "b")]), (1, [(1, "z"), (0, "y")]), (1, [(1, "z"), (0, "y")])):
        tables.append_log(str(tmp_path / "log"), frame(rows), ["t", "m"], number)
    got = sorted(map(tuple, tables.read_log(spark, str(tmp_path / "log"), "t long, m string").collect()))
    assert got == [(1, 1, "a"), (2, 1, "a"), (3, 2, "b"), (4, 0, "y"), (5, 1, "z")]


def test_unescaped_as_the_standard_library(spark):
    import html

    cases = ["a &amp;lt; b", "&lt;&gt;&quot;&#39;&apos;", "&#8217;&#x1F600;&#X41;", "&copy;&nbsp;&eacute;", "&zzz; & &; &#; &#x;", "no reference", "", "&#1114112;", "&#xD800;", "&amp;&amp;#65;"]
    got = [r.x for r in spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string").orderBy("i").select(text.unescaped(F.col("t")).alias("x")).collect()]
    assert got == [html.unescape(t) for t in cases]


@pytest.mark.parametrize("name", ["str_drain_starts"])
def test_drain_query(spark, name):
    d = "/root/testdata/sf0.001"
    kinds = {"click": ("queued", "pass1"), "view": ("queued", "pass2"), "purchase": ("queued", "pass3"), "signup": ("beat", "pass1"), "error": ("done", "pass1")}
    rows = spark.read.parquet(f"{d}/events.parquet").selectExpr("user_id % 5 AS q", "unix_micros(CAST(ts AS TIMESTAMP)) AS us", "event_id", "user_id", "event_type").collect()
    until = (max(r.us for r in rows) // 1000 - 600_000) * 1000
    want = sorted((q, *x) for q in range(5) for x in drained([(r.us, r.event_id, r.user_id, *kinds[r.event_type], r.event_id % 3) for r in rows if r.q == q], until))
    got = media.QUERIES[name](spark, d).select("queue", F.unix_micros("poll").alias("us"), "job_id", "job_type", "attempt").collect()
    assert sorted((r.queue, r.us, r.job_id, r.job_type, r.attempt) for r in got) == want and want


def test_drain_state_by_blocks():
    """Ten thousand rows of three periods and their waiting jobs are few calls to the state, and a poll doesn't look at what waits."""
    import numpy as np
    import pandas as pd

    calls = []

    class State(dict):
        exists = lambda self: 0 in self
        get = lambda self: self[0]
        update = lambda self, v: self.updateValue(0, v)
        getValue = dict.__getitem__
        iterator = dict.items
        removeKey = dict.__delitem__

        def updateValue(self, k, v):
            calls.append(k)
            self[k] = v

    class Handle:
        getMapState = lambda self, *a: State()
        getValueState = lambda self, *a: State()
        registerTimer = lambda self, ms: calls.append(ms)

    class Watermark:
        getCurrentWatermarkInMs = lambda self: 3000 * 1000

    d = drain.Drain(900, 1800, 4, 3)
    d.init(Handle())
    i = np.arange(10_000)
    frames = [pd.DataFrame({"us": i * 270_000, "event_id": i, "job_id": i, "kind": 0, "stage": i % 3, "priority": i % 7})]
    assert list(d.handleInputRows((0,), iter(frames), None)) == [] and len(calls) < 10
    (out,) = d.handleExpiredTimer((0,), Watermark(), None)
    rows = [(int(k) * 270_000, int(k), int(k), "queued", drain.PASSES[k % 3], int(k % 7)) for k in i]
    assert [(j, t, n) for j, t, n in zip(out["job_id"], out["job_type"], out["attempt"])] == [x[1:] for x in drained(rows, 3000 * US)]
    assert len(calls) < 20
