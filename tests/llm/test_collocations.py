"""Collocations against brute force, and sketches that are far too small."""

import random
import re
from collections import Counter

import duckdb
import pytest

from contactsheet.llm import collocations, queries


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute(rows, least, top, percent=80):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text or "")):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            f.update((lang, tuple(ws[i : i + k])) for k in range(1, 5) for i in range(len(ws) - k + 1))
    out = []
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = {(lang, q[i : i + k]) for (lang, q), b in cand.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if 100 * b >= percent * f[lang, q[i : i + k]]}
    for lang in n:
        mine = []
        for (x, p), a in cand.items():
            if x == lang and (x, p) not in gone:
                score, _, left, right = min((2_000_000 * a // (f[x, p[:k]] + f[x, p[k:]]), k, f[x, p[:k]], f[x, p[k:]]) for k in range(1, len(p)))
                mine.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, le, r, n[lang], -s) for i, (s, a, p, le, r) in enumerate(sorted(mine)[:top], 1)]
    return sorted(out)


def edge_rows():
    rng = random.Random(2)
    parts = ["New York", "new york city", "in order to", "a b c d", "a b c d e", "über Straße", "漢字 🙂", "x", "the", "the end", "no.break", "tab\tbed", "two  spaces", "line\nfeed", "\x0bvt", "a,b", "É", "of the"]
    rows = [(rng.choice(["en", "en", "de", None, "und"]), rng.choice([" ", ". ", "\n", " "]).join(rng.choices(parts, k=rng.randrange(1, 40)))) for _ in range(150)]
    return rows + [("en", None), ("en", ""), ("fr", " \t. "), (None, None), ("en", "w " * 3000), ("en", "same words here"), ("en", "same words here"), ("", "empty lang name " * 9)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(*r, 1, 2, "p") for r in edge_rows()], "lang string, text string, n int, words int, phrase string").repartition(5).cache()


@pytest.mark.parametrize(("least", "top", "counters"), [(3, 2000, None), (5, 7, 1 << 16), (2, 2000, 1 << 3)])
def test_against_brute_force(frame, monkeypatch, least, top, counters):
    if counters == 8:
        counters = 64  # nearly all is let through
        monkeypatch.setattr(collocations, "LEAST_COUNTERS", 64)
    got = collocations.collocations(frame, least=least, top=top, counters=counters).collect()
    assert sorted(map(tuple, got)) == brute(edge_rows(), least, top) and len(got) > 10


def made(plan):
    """Rows that each MapInArrow of a plan that has run made, from the last one back."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from made(plan.executedPlan())
    elif name.endswith("QueryStageExec"):
        yield from made(plan.plan())
    else:
        if name == "MapInArrowExec":
            yield plan.metrics().apply("pythonNumRowsReceived").value()
        children = plan.children()
        for i in range(children.size()):
            yield from made(children.apply(i))


def test_phrases_leave_tasks_in_blocks(spark):
    """Each of 16 tasks finds all of 8,000 phrases twice; what it makes are blocks, no more than there are owners, and not rows of phrases."""
    text = " ".join(f"w{i}" for i in range(2000))
    rows = spark.range(32, numPartitions=16).selectExpr("'en' AS lang", f"'{text}' AS text")
    got = collocations.frequent_phrases(rows)
    counts = {r.phrase: (r.words, r.n) for r in got.collect()}
    assert len(counts) == 7995 and counts.pop("") == (0, 64_000)
    assert all(n == 32 and words == p.count(" ") + 1 for p, (words, n) in counts.items())
    assert sum(made(got._jdf.queryExecution().executedPlan())) <= 7995 + 16 * 17


@pytest.mark.parametrize(("phrases", "together"), [(1, 1), (50, 1), (1, 4 << 20)])
def test_blocks_of_any_size(frame, monkeypatch, phrases, together):
    monkeypatch.setattr(collocations, "PHRASES", phrases)
    monkeypatch.setattr(collocations, "ADDED", together)
    assert sorted(map(tuple, collocations.collocations(frame, least=3).collect())) == brute(edge_rows(), 3, 2000)


def test_langs_and_white_space_in_blocks(spark):
    rows = [(lang, text) for lang in ("a\nb", "a\tb", "", " ", "漢") for text in ["New\t \tYork\t", "new york", "é\u00a0x  É y", "no"] * 3]
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string").repartition(7), least=3)
    assert sorted(map(tuple, got.collect())) == brute(rows, 3, 2000)


def test_large_counts_are_exact(spark):
    big = 10**13
    rows = [("en", "a", 1, big + 1), ("en", "b", 1, big + 3), ("en", "c", 1, big), ("en", "a b", 2, big - 1), ("en", "b c", 2, big - 7), ("en", "a b c", 3, big // 2)]
    got = {r.phrase: (r.score, r.l, r.r) for r in collocations.scored(spark.createDataFrame(rows, "lang string, phrase string, words int, n long")).collect()}
    cuts = [(2_000_000 * (big // 2) // (x + y), x, y) for x, y in ((big + 1, big - 7), (big - 1, big))]
    assert got["a b c"] == min(cuts, key=lambda c: c[0]) and got["a b"] == (2_000_000 * (big - 1) // (2 * big + 4), big + 1, big + 3)


def test_query_against_sql(spark, frame, tmp_path):
    frame.select("lang", "text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for path, files in ((str(tmp_path), "/*.parquet"), ("/root/testdata/sf0.001", "")):
        c = duckdb.connect()
        c.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet{files}'")
        rel = c.sql(queries.SQL["op11_collocations"])
        got = queries.QUERIES["op11_collocations"](spark, path)
        assert sorted(got.columns) == sorted(rel.columns) and sorted(map(tuple, got.select(*rel.columns).collect())) == sorted(rel.fetchall())


def test_empty(empty):
    assert collocations.collocations(empty).count() == 0
