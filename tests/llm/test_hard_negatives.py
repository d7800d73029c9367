"""Hard negatives against brute force: ties, copies, odd vectors, small blocks, large numbers."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from contactsheet.llm import hard_negatives, queries

SCHEMA = "vec_id long, embedding array<float>, label int, key long, q int, leaf int, uid int"


def brute(rows, scale=256, positives=5, negatives=10, low=30, high=90):
    ok = [(k, lab, [math.floor(scale * float(x)) for x in v]) for k, v, lab in rows if k is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, (a, lab, q) in enumerate(ok):
        if a % 100:
            continue
        score = [(-sum(x * y for x, y in zip(q, p, strict=False)), k, m == lab) for j, (k, m, p) in enumerate(ok) if j != i]
        for ps, pid, _ in sorted(s for s in score if s[2])[:positives]:
            ns = sorted(s for s in score if not s[2] and low * -ps <= 100 * -s[0] <= high * -ps)[:negatives]
            out += [(a, pid, r, k, -ps, -s) for r, (s, k, _) in enumerate(ns, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(k, v, lab, 1, 2, 3, 4) for k, v, lab in rows], SCHEMA).repartition(3)


def edge_rows(n=900, dim=6):
    rng = np.random.default_rng(3)
    f = lambda v: [float(np.float32(x)) for x in v]
    rows = [(i, f(rng.normal(size=dim) * (1 + i % 3)), int(rng.integers(0, 4))) for i in range(n)]
    rows += [(1000 + i, f([1.0] * dim), i % 2) for i in range(150)]  # one vector that many share
    rows += [rows[100], rows[100], rows[7], (7, f([2.0] * dim), 1)]  # repeated rows, and a key with two vectors
    rows += [(None, f([1.0] * dim), 1), (5000, None, 1), (5001, [1.0, None], 1), (5002, [float("nan")] * dim, 1), (5003, [float("inf")] * dim, 1), (5004, f([1.0] * dim), None)]
    return rows + [(5005, [], 2), (5100, f([3.0, 1.0]), 3), (5200, f([1.0] * dim), 9), (5300, [0.0] * dim, 1)]


@pytest.mark.parametrize("block", [20, 4096])
def test_against_brute_force(spark, block):
    rows = edge_rows()
    got = hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 100 == 0, block=block).collect()
    assert sorted(map(tuple, got)) == brute(rows) and len(got) > 300


def test_large_numbers_and_empty(spark):
    rows = [(i, [float(200_000 + i % 7), float(i % 5) * 5e4], i % 2) for i in range(300)]
    got = hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 100 == 0).collect()
    assert sorted(map(tuple, got)) == brute(rows)
    none = hard_negatives.mine(frame(spark, []), F.col("vec_id") % 100 == 0)
    assert none.count() == 0 and none.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_groups_leave_out_far_leaves():
    rng = np.random.default_rng(1)
    at = lambda k: 40 * np.array([k & 1, k >> 1 & 1, k >> 2, 0.5, 0.5, 0.5, 0.5, 0.5]) - 20
    x = np.concatenate([rng.normal(size=(500, 8)) + at(k) for k in range(8)])
    planes = hard_negatives.Planes.fit(x, 6, 8)
    leaf = planes.leaf(x)
    radius = np.array([np.linalg.norm(x[leaf == i] - planes.centers[i], axis=1).max(initial=-1) for i in range(64)])
    balls = hard_negatives.Balls(planes, radius)
    anchors = x[:40]
    low = np.full(40, 1000.0)
    met = balls.meet(anchors, low, np.full(40, math.inf))
    seen = {(int(a), int(f)) for own, leaves in met for a in own for f in leaves}
    need = {(i, int(leaf[j])) for i in range(40) for j in np.flatnonzero(x @ anchors[i] >= 1000)}
    assert need <= seen and len(seen) < 40 * 64 / 3


def test_query_against_sql(spark, tmp_path):
    for name, rows in (("edge", edge_rows()), ("given", None)):
        path = f"{tmp_path}/{name}" if rows else "/root/testdata/sf0.001"
        if rows:
            frame(spark, [r for r in rows if r[1] is None or len(r[1]) == 6]).select("vec_id", "embedding", "label").coalesce(1).write.parquet(f"{path}/embeddings.parquet")
        got = queries.QUERIES["op12_hard_negatives"](spark, path)
        c = duckdb.connect()
        c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet{'/*.parquet' if rows else ''}'")
        rel = c.sql(queries.SQL["op12_hard_negatives"])
        assert got.columns == rel.columns and sorted(map(tuple, got.collect())) == sorted(rel.fetchall())
