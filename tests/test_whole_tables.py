"""Queries held against their SQL on rows that small tables lack."""

import hashlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from contactsheet.operators import joins, windows


def both(spark, folder, name, **tables):
    """Rows of a query and of its SQL over tables that are given as SQL."""
    con = duckdb.connect()
    for t, sql in tables.items():
        con.sql(f"COPY ({sql}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got, want = queries()[name](spark, str(folder)), con.sql(oracle_sql()[name])
    assert got.columns == want.columns
    return Counter(map(tuple, got.collect())), Counter(want.fetchall())


@pytest.mark.parametrize(
    ("name", "table", "at"),
    [("join_interval_due", "SELECT i AS event_id, i AS user_id, ts AS ts FROM t", "2024-01-10"), ("str_due_posts", "SELECT i AS o_orderkey, ts AS o_orderdate FROM t", "2001-06-01")],
)
def test_fractions_of_seconds_at_both_ends(spark, tmp_path, name, table, at):
    first, last = ("11:44:5", "12:15:0") if name == "join_interval_due" else ("23:54:5", "00:25:0")
    early = at if name == "join_interval_due" else "2001-05-31"
    times = [f"{early} {first}{x}" for x in ("8.999999", "9", "9.000001", "9.5", "9.999999")] + [f"{at} {last}{x}" for x in ("0", "0.000001", "0.5", "0.999999", "1")]
    rows = ", ".join(f"({i}, TIMESTAMP '{x}')" for i, x in enumerate([*times, f"{early} {first[:-1].replace('44:', '45:').replace('54:', '55:')}00"]))
    got, want = both(spark, tmp_path, name, **{"events" if "events" in oracle_sql()[name] else "orders": f"WITH t(i, ts) AS (VALUES {rows}) {table}"})
    assert got == want and 0 < len(want) < len(times)


def test_shades_are_rounded_in_single_precision(spark, tmp_path):
    """0.14125 is 56.49999976 at 400 times, and 56.5 as a float."""
    tiles = "SELECT i AS vec_id, list_transform(range(64), lambda j: (CASE WHEN (i + j) % 3 > 0 THEN 0.14125 ELSE -0.16125 END)::FLOAT) AS embedding, 0 AS label FROM range(130) t(i)"
    got, want = both(spark, tmp_path, "src_previews", embeddings=tiles)
    assert got == want and len(want) == 2


def test_content_gaps_read_all_posts_and_brands(spark, tmp_path):
    """Genres and brands whose rows lie outside of what the queries once kept: sizes of 45 at most, and moods and genres of all kinds."""
    parts = """SELECT i AS p_partkey, 'part ' || i AS p_name, CASE WHEN i < 4 THEN 'Brand#1' ELSE 'Brand#2' END AS p_brand, 'PROMO STEEL' AS p_type, (i % 45)::INT AS p_size, 1000.0::DOUBLE + i AS p_retailprice
     FROM range(90) t(i)"""
    orders = "SELECT i AS o_orderkey, i AS o_custkey, 'F' AS o_orderstatus, 100.0::DOUBLE AS o_totalprice, TIMESTAMP '2001-05-20' AS o_orderdate, '1-URGENT' AS o_orderpriority FROM range(40) t(i)"
    got, want = both(spark, tmp_path, "agg_brand_gaps", part=parts)
    assert got == want == {("Brand#1", 4, 45.0): 1}
    got, want = both(spark, tmp_path, "agg_content_gaps", part=parts, orders=orders)
    assert got == want and want


def test_near_words_over_several_blocks(spark, tmp_path, monkeypatch):
    """Blocks of a few words, copies, and rows without a label, a pair or a match."""
    monkeypatch.setattr(joins, "BLOCK", 7)
    monkeypatch.setattr(joins, "SCANNED", 20)
    e = """SELECT i AS vec_id, list_transform(range(64), lambda j: (CASE WHEN hash(i % 6, j) % 2 = (hash(i % 40, j, 1) % 7 = 0)::INT THEN 1 ELSE -1 END)::FLOAT) AS embedding,
     CASE WHEN i % 11 > 0 THEN i % 3 END::INT AS label FROM range(90) t(i)"""
    for name in ("join_hamming_pairs_k16", "join_hamming_nearest", "join_hamming_keepers"):
        got, want = both(spark, tmp_path, name, embeddings=e)
        assert got == want and want, name


def test_near_words_shuffle_blocks_and_not_bands(spark):
    """Each word goes out once for each block that it meets, and not for each value of a band."""
    n = 3000
    words = spark.range(n).select("id", F.array(F.hash("id").cast("long").bitwiseAND(F.lit(2**32 - 1)), F.hash("id", "id").cast("long").bitwiseAND(F.lit(2**32 - 1))).alias("bits"), F.lit(1).alias("label"))
    xs = joins.blocks(words.select("label", F.col("id").alias("k"), joins.word("bits").alias("w")), ["label"], "k")
    met = joins.grid(xs, xs, ["label"])
    assert met.agg(F.sum(F.size("xs") + F.size("ys"))).first()[0] == 2 * n
    plan = joins.nearest_in_section(words, words.withColumnRenamed("id", "other"), "label", 24)._jdf.queryExecution().toString()
    assert "band" not in plan


def test_a_sample_has_equal_lines(spark, tmp_path):
    """Lines that are there twice are two rows of their tier, as in the SQL."""
    lines = "SELECT i // 2 AS l_orderkey, 1::INT AS l_linenumber, CASE WHEN i < 6 THEN 5 WHEN i < 900 THEN 20 WHEN i % 9 > 0 THEN 40 END::DOUBLE AS l_quantity FROM range(3000) t(i)"
    got, want = both(spark, tmp_path, "win_stratified_sample", lineitem=lines)
    assert got == want and max(want.values()) == 2


def test_a_sample_by_how_hashes_begin(spark):
    rows = spark.range(20_000).selectExpr("id", "IF(id < 3, 'few', IF(id % 7 = 0, NULL, 'many')) AS t", "id % 5000 AS k")
    for k in (1, 40, 6000):
        got = windows.stratified(rows, F.col("t"), "k", k)
        digest = lambda r: (hashlib.md5(f"0:{r.k}".encode()).hexdigest(), r.k)
        for tier in ("few", "many"):
            want = sorted((r for r in rows.collect() if r.t == tier), key=digest)[:k]
            assert sorted(r.k for r in got.where(F.col("tier") == tier).collect()) == sorted(r.k for r in want)
