"""Numbers by range counts against plain sorting, with ties, nulls and hot groups."""

import random

import pytest
from pyspark.sql import functions as F

from contactsheet.operators import ranks


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    return [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 1, 2, 3]), rng.randrange(5)) for i in range(500)]


def test_numbered_and_ahead(spark, rows):
    df = spark.createDataFrame(rows, "id long, g string, x int, v long").repartition(7)
    order = [F.desc_nulls_last("x"), F.col("id")]
    plain = sorted(rows, key=lambda r: (-(r[2] or 0), r[0]))
    got = {r.id: r.n for r in ranks.numbered(df, "n", order).collect()}
    assert got == {r[0]: i for i, r in enumerate(plain, 1)}
    for g in ("a", "b", None):
        mine = [r for r in plain if r[1] == g]
        got = {r.id: r.s for r in ranks.ahead(df, "s", order, F.col("v"), by=["g"]).collect() if r.g == g}
        assert got == {r[0]: sum(x[3] for x in mine[:i]) for i, r in enumerate(mine)}


def test_ranked_shares_places(spark, rows):
    df = spark.createDataFrame([*rows, rows[0]], "id long, g string, x int, v long").repartition(3)
    got = ranks.ranked(df, "n", [("x", True), ("v", False)]).collect()
    key = lambda r: (-(r.x or 0), r.v)
    assert len(got) == 501 and all(r.n == 1 + sum(key(q) < key(r) for q in got) for r in got[::23])


def test_empty(spark):
    assert ranks.numbered(spark.createDataFrame([], "id long, g string"), "n", [F.col("id")]).count() == 0


def test_best_of_a_hot_group(spark, rows):
    df = spark.createDataFrame(rows, "id long, g string, x int, v long").repartition(5)
    got = {(r.g, r.place): r.id for r in ranks.best(df, ["g"], [F.desc_nulls_last("x"), F.col("id")], 7, salts=4).collect()}
    for g in ("a", "b", None):
        mine = sorted((r for r in rows if r[1] == g), key=lambda r: (-(r[2] or 0), r[0]))[:7]
        assert [got[g, i] for i in range(1, 8)] == [r[0] for r in mine]
