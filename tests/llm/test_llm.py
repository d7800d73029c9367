"""The operators against brute force, exact round trips and invariants, over edge cases and empty tables."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from contactsheet.llm import common, decontamination, host_rules, html_extraction, jaccard_join, lm_scoring, mixing, packing, queries, quality_classifier, sharding, token_counts, url_filter
from contactsheet.llm import words as words_module
from contactsheet.llm.components import components
from contactsheet.llm.fm_index import FMIndex

from .conftest import PASSAGE

WORD = re.compile("[^\x20\x09-\x0d]+")
LEAK = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def words(t):
    return WORD.findall(t) if t else []


@pytest.fixture(scope="module")
def tables(spark, docs, tmp_path_factory):
    """The edge rows as a folder of tables, for whole queries."""
    d = str(tmp_path_factory.mktemp("tables"))
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, "one two three"), (3, None), (4, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    urls = [None, "", "no scheme", "http://", "https://Example.ORG/es/1", "http://a.example.org/en/12?x=/de/", "http://x.org", "http://b.com/fr/1#f", "http://b.com/de/1", "http://ads-track.example.net/q", "ftp://u://v/w", "http://" + "a." * 3000 + "org/z", "http://example.org/en/2", "http://example.orga/es/"]
    spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)] + [(3, "http://", None)], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return d


def against_sql(tables, name, got):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet/*.parquet'")
    rel = c.sql(queries.SQL[name])
    columns = sorted(rel.columns)
    key = lambda r: [(x is None, str(x)) for x in r]
    want = sorted((tuple(dict(zip(rel.columns, r, strict=True))[k] for k in columns) for r in rel.fetchall()), key=key)
    assert sorted((tuple(r[k] for k in columns) for r in got), key=key) == want


def test_quality_rules_against_sql(spark, tables):
    got = queries.QUERIES["op10_quality_rules"](spark, tables).collect()
    against_sql(tables, "op10_quality_rules", got)


def test_quality_rules_of_a_bad_host(spark):
    rows = [(i, "short", "bad") for i in range(60)] + [(100, " ".join(f"g{i}h" for i in range(50)), "bad")] + [(200 + i, " ".join(f"g{i}h{j}" for j in range(50)), "good") for i in range(60)]
    got = {r.doc_id: r.kept for r in host_rules.host_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[100] and all(got[200 + i] for i in range(60))


def test_quality_rules_of_a_mixed_host(spark):
    import corpus_pipeline

    long = lambda i: " ".join(f"g{i}h{j}" for j in range(50))
    fails = [lambda i: long(i) + " " + "#" * 50, lambda i: "\n".join([long(i)] + [f"same {i}"] * 3), lambda i: " ".join(f"g{i}h{j}" + "y" * 20 for j in range(50))]
    rows = [(i, fails[i % 3](i), "mixed") for i in range(300)] + [(1000 + i, long(i), f"good{i % 5}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    alone = {r.doc_id for r in host_rules.host_rules(docs).where("kept").collect()}
    got = {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, "").collect()}
    assert alone == {r[0] for r in rows} and got == {1000 + i for i in range(300)}


def test_quality_rules_many_hosts_are_joined(spark, docs, monkeypatch):
    wide = sorted((str(r.doc_id), r.kept) for r in host_rules.host_rules(docs).collect())
    monkeypatch.setattr(host_rules, "BROADCAST_HOSTS", 1)
    assert sorted((str(r.doc_id), r.kept) for r in host_rules.host_rules(docs).collect()) == wide


def test_token_counts(spark, docs):
    import public_tokenizers
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    got = token_counts.count_tokens(docs, model, frequent=50).collect()
    assert len(got) == docs.count() and all(r.n_tokens == len(sp.encode(r.text or "")) for r in got)
    lengths, rng = token_counts.Lengths(model), random.Random(1)
    for _ in range(4000):
        t = "".join(rng.choice(" \n\tab.é▁()\r;{<s>") for _ in range(rng.randint(0, 14)))
        assert lengths.of(t) == len(sp.encode(t)), repr(t)


def test_url_filter_against_sql(spark, tables):
    got = queries.QUERIES["op4_url_filter"](spark, tables).collect()
    against_sql(tables, "op4_url_filter", got)


def test_url_filter_long_lists_are_several_cascades(spark, tables, monkeypatch):
    pages, listed = spark.read.parquet(f"{tables}/pages.parquet"), spark.createDataFrame([("ads-track.example.net",), ("x.org",)], "host string")
    pages = pages.withColumns({c: F.lit(1) for c in ("keys_of", "kept_of", "host", "k", "key", "tag")})
    key = lambda df: sorted((str(tuple(r)) for r in df.select("page_id", "url", "rule", "verdict").collect()))
    want = key(url_filter.judge_urls(pages, queries.URL_RULES, listed))
    monkeypatch.setattr(url_filter, "PASS_CASCADES", 2)
    assert key(url_filter.judge_urls(pages, queries.URL_RULES, listed, max_bits=25)) == want and any("block" in x for x in want)


def test_long_list_of_keys(spark):
    ids = spark.range(0, 4000).select("id", *url_filter.hashed(F.col("id").cast("string")))
    cascades = url_filter.build_cascades(ids.where("id % 5 = 0"), ids, 3000)
    rows = ids.toPandas()
    got = np.zeros(len(rows), bool)
    for i, cascade in enumerate(cascades):
        at = rows.h1.to_numpy() % len(cascades) == i
        got[at] = cascade.listed(rows.h1.to_numpy()[at], rows.h2.to_numpy()[at])
    assert len(cascades) == 3 and (got == (rows.id % 5 == 0)).all()


def test_cascade_is_exact(spark):
    ids = spark.range(0, 3000).select("id", *url_filter.hashed(F.col("id").cast("string")))
    cascade = url_filter.build_cascade(ids.where("id % 7 = 0"), ids)
    rows = ids.toPandas()
    assert (cascade.listed(rows.h1.to_numpy(), rows.h2.to_numpy()) == (rows.id % 7 == 0)).all() and len(cascade.levels) > 1
    assert url_filter.build_cascade(ids.where("id < 0"), ids).levels == []


def level(sizes, weights, share, most):
    by = {s: n for s, n in sorted(sizes.items(), key=lambda x: (x[0] is None, x[0] or ""))}
    w = {s: weights[i % len(weights)] for i, s in enumerate(by)}
    full, total = set(), share * sum(by.values())
    while True:
        free = [s for s in by if s not in full]
        at = (total - sum(most * by[s] for s in full)) / sum(w[s] for s in free) if free else 0
        more = {s for s in free if at * w[s] > most * by[s] + 1e-9}
        if not more:
            return {s: most * by[s] if s in full else at * w[s] for s in by}
        full |= more


def test_mixing(spark, docs):
    got = mixing.mix(docs, [5, 2, 1]).collect()
    sizes, units = collections.Counter(), collections.Counter()
    for r in docs.collect():
        sizes[r.source] += len(words(r.text))
        units[r.doc_id, r.source] += len(words(r.text))
    assert {(r.doc_id, r.source): r["size"] for r in got} == units
    targets, taken = level(sizes, [5, 2, 1], 1.5, 2), collections.Counter()
    for r in got:
        assert math.isclose(r.target, targets[r.source], rel_tol=1e-9, abs_tol=1e-6) and r.source_size == sizes[r.source] and 0 <= r.copies <= 2
        taken[r.source] += r.copies * r["size"]
    assert all(abs(taken[s] - targets[s]) <= max(0.02 * targets[s], max(n for (_, x), n in units.items() if x == s) / 2 + 1) for s in sizes)
    assert sorted(map(str, mixing.mix(docs, [5, 2, 1]).collect())) == sorted(map(str, got))


def test_mixing_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 40)
    docs = spark.range(0, 3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, "hot").otherwise("b").alias("source"), F.repeat(F.lit("w "), (F.col("id") % 50).cast("int")).alias("text"))
    got = mixing.mix(docs, [1, 3], share=0.6).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("n"), F.first("target").alias("t"), F.count("*").alias("docs")).collect()
    assert {r.source: r.docs for r in got} == {"hot": 2000, "b": 1000} and all(abs(r.n - r.t) <= 0.01 * r.t for r in got)


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(5)
    size, p = rng.integers(1, 900, 4000).astype(float), rng.random(4000)
    out = mixing.flight(size, p, rng, 14)
    open_ = (out > 1e-9) & (out < 1 - 1e-9)
    assert open_.sum() <= 14 and abs(out.sum() - p.sum()) < 1e-6 and abs(size @ out - size @ p) < 1e-3
    assert abs(size @ mixing.landing(size, out) - size @ p) < 5


def test_lm_scores(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [([*words(lower(t or "")), "</s>"], held(i)) for i, t in rows]
    one, two = collections.Counter(), collections.Counter()
    for t, h in tokens:
        if not h:
            one.update(t)
            two.update(zip(["</s>", *t[:-1]], t, strict=True))
    n, v, mu = sum(one.values()), len(one), lm_scoring.MU

    def scored(t):
        p = [(one[w] + 1) / (n + v + 1) for w in t]
        base = sum(map(math.log10, p))
        full = sum(math.log10((two[h, w] + mu * q) / (one[h] + mu)) for h, w, q in zip(["</s>", *t[:-1]], t, p, strict=True))
        return (len(t), sum(one[w] > 0 for w in t), n, round(base, 5), round(full, 5))

    want = sorted((str(i), h, *scored(t)) for (i, _), (t, h) in zip(rows, tokens, strict=True))
    got = lm_scoring.score_texts(docs, queries.remainder(7) == 2, order=2).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in got) == want


@pytest.mark.parametrize(("order", "stretch"), [(1, 256), (3, 256), (4, 256), (3, 7), (4, 5)])
def test_lm_scores_of_other_orders(spark, docs, monkeypatch, order, stretch):
    monkeypatch.setattr(lm_scoring, "STRETCH", stretch)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [(["</s>", *words(lower(t or "")), "</s>"], held(i)) for i, t in rows]
    seen = collections.Counter()  # n-grams; a history is counted where a token follows it
    for t, h in tokens:
        if not h:
            seen.update(tuple(t[i - n + 1 : i + 1]) for i in range(1, len(t)) for n in range(1, order + 1) if n <= i + 1)
    n, v, mu = sum(c for g, c in seen.items() if len(g) == 1), sum(len(g) == 1 for g in seen), lm_scoring.MU

    def scored(t):
        total = 0.0
        for i in range(1, len(t)):
            p = (seen[t[i],] + 1) / (n + v + 1)
            for k in range(2, min(order, i + 1) + 1):
                g = tuple(t[i - k + 1 : i + 1])
                p = (seen[g] + mu * p) / (seen[g[:-1]] + mu)
            total += math.log10(p)
        return round(total, 5)

    want = sorted((str(i), scored(t)) for (i, _), (t, _) in zip(rows, tokens, strict=True))
    got = lm_scoring.score_texts(docs, queries.remainder(7) == 2, order=order).collect()
    assert sorted((str(r.doc_id), round(r.score, 5)) for r in got) == want


@pytest.mark.parametrize("texts", [[], [None], [None, ""], ["a"], ["w"] * 30, [f"w{i}" for i in range(40)], ["a b", "c"], ["x " * 3000, "x"]])
def test_lm_scores_of_small_corpora(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for held in (F.lit(False), F.lit(True), F.col("doc_id") % 2 == 0):
        got = {r.doc_id: r for r in lm_scoring.score_texts(docs, held).collect()}
        assert sorted(got) == list(range(len(texts))) and all(math.isfinite(r.score) and r.score <= 1e-9 for r in got.values())
        assert all(got[i].n_tokens == len(words(t or "")) + 1 for i, t in enumerate(texts))


def test_packed_numbers_round_trip():
    rng = np.random.default_rng(2)
    for x in (rng.integers(0, 2**64, n, dtype=np.uint64) for n in (0, 1, 5, 3000)):
        assert (packing.inflated(packing.deflated(x)) == x).all() and (packing.inflated(packing.deflated(x >> np.uint64(50))) == x >> np.uint64(50)).all()


def test_word_hashes():
    rng = random.Random(1)
    voc = ["a", "B", "b", "Ünï", "x" * 8, "x" * 9, "x" * 64, "x" * 65, "x" * 66, "abcdefghi", " ", "漢字", "\xa0"]
    texts = [None, "", " \n", "a", "b ", " c", *(" ".join(rng.choice(voc) for _ in range(rng.randint(0, 9))) for _ in range(300))]
    seen = {}
    for column in (pa.array(texts), pa.array(texts).slice(4, 200), pa.array(texts, pa.large_string()), pa.array([], pa.string())):
        own, before = words_module.word_hashes(column)
        for i, t in enumerate(column.to_pylist()):
            found = words(lower(t or ""))
            assert before[i + 1] - before[i] == len(found)
            assert all(seen.setdefault(x, h) == h for x, h in zip(found, own[before[i] : before[i + 1]].tolist(), strict=True))
    keys = np.sort(np.array(list(seen.values()), np.uint64))
    assert len(np.unique(keys)) == len(keys)
    lookup = words_module.Lookup(keys)
    assert (lookup.find(keys[::-1]) == np.arange(len(keys))[::-1]).all() and (lookup.find(keys + np.uint64(1)) == -1).all()
    assert (words_module.Lookup(keys[:0]).find(keys) == -1).all()


def test_cut_texts():
    def cut(text, *spans):
        data = text.encode()
        begin, end, _ = words_module.spans(np.frombuffer(data, np.uint8), np.array([0, len(data)]), decontamination.INSIDE)
        return decontamination.without(data, begin, end, [{"start": a, "end": b} for a, b in spans])

    assert cut("a b c d", (1, 3)) == "a d" and cut("a b c d", (0, 1)) == "b c d" and cut("a b c d", (3, 4)) == "a b c" and cut(" a ", (0, 1)) == ""
    assert cut("one\n\ntwo three\n\nfour", (1, 3)) == "one\n\nfour" and cut("one\n\ntwo three. four  five", (1, 3)) == "one\n\n. four  five"
    assert cut("a, b (c) d", (1, 2), (2, 3)) == "a, () d" and cut("x a b y c z", (1, 2), (4, 5)) == "x b y z"


def brute_leaks(texts, bench, window=10):
    wins = collections.defaultdict(set)
    for i, t in bench:
        w = LEAK.findall(lower(t or ""))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins[tuple(w[k : k + window])].add(i)
    out = []
    for t in texts:
        w = LEAK.findall(lower(t or ""))
        hit, items = [0] * len(w), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if found := wins.get(tuple(w[k : k + n])):
                    items |= found
                    hit[k : k + n] = [1] * n
        out.append((len(w), sum(hit), sorted(items)))
    return out


def test_shard_search_against_brute_force():
    rng = random.Random(2)
    for _ in range(150):
        voc = ["a", "B", "é", "c1"][: rng.randint(1, 4)]
        bench = [(str(i), " ".join(rng.choice(voc) for _ in range(rng.randint(1, 14)))) for i in range(rng.randint(0, 4))]
        texts = [" .".join(rng.choice([*voc, "zz"]) for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 5))] + [None, ""]
        w = decontamination.Windows.of(bench)
        own, at = words_module.word_hashes(pa.array(texts), decontamination.INSIDE)
        hit, items = decontamination.search_shard(own, at, w, words_module.Lookup(w.vocabulary))
        got = [(int(at[i + 1] - at[i]), int(hit[at[i] : at[i + 1]].sum()), sorted(w.ids[x] for x in items[i])) for i in range(len(texts))]
        assert got == brute_leaks(texts, bench)


def test_fm_index_finds_all_places():
    rng = np.random.default_rng(3)
    text = np.concatenate([np.append(rng.integers(1, 4, n), 0) for n in (50, 1, 200, 7)])
    index = FMIndex(text, 3)
    for n in (1, 2, 4):
        grams = np.unique(np.lib.stride_tricks.sliding_window_view(text, n), axis=0)
        grams = grams[(grams > 0).all(axis=1)]
        lo, hi = index.search(grams)
        for g, a, b in zip(grams, lo, hi, strict=True):
            want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == g).all()]
            assert sorted(index.locate(np.arange(a, b))) == want


@pytest.mark.parametrize("block_bytes", [8 << 20, 400])
def test_decontamination(spark, docs, tables, block_bytes):
    bench = spark.read.parquet(f"{tables}/benchmark.parquet")
    got = decontamination.find_leaks(docs, bench, block_bytes=block_bytes).collect()
    items = [(str(r.item_id), r.text) for r in bench.collect()]
    want = brute_leaks([r.text for r in got], items)
    assert [(r.leaks.n_words, sum(s.end - s.start for s in r.leaks.spans), list(r.leaks["items"])) for r in got] == want
    clean = {str(r.doc_id): r.text for r in decontamination.find_leaks(docs, bench, clean=True).collect()}
    assert clean["12"] == "start here and an end" and clean["10"] == "" and clean["9"] == next(r.text for r in got if r.doc_id == 9)


def test_sharding(spark, docs):
    got = sharding.shard(docs, 8).collect()
    want = sorted((str(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == want
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(8)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    by = collections.defaultdict(set)
    for r in got:
        by[r.text_crc32, r["size"]].add(r.shard)
    assert all(len(s) == 1 for k, s in by.items() if k[1] > 1)
    assert sorted(map(str, sharding.shard(docs, 8).collect())) == sorted(map(str, got))


def test_sharding_is_even_with_a_hot_group(spark):
    docs = spark.range(0, 6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.lit("t"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")), F.col("id").cast("string"))).alias("text"))
    got = sharding.shard(docs, 8).groupBy("shard").agg(F.sum("size").alias("n"), F.count("*").alias("rows"), F.max("slot").alias("top")).collect()
    n = [r.n for r in got]
    assert len(n) == 8 and max(n) <= 1.03 * min(n) and all(r.rows == r.top + 1 for r in got)


def test_sharding_keeps_a_group_over_the_mean_whole(spark):
    """4,000 wholly equal rows and 1,000 others: the group has a shard alone and the others share the rest evenly."""
    docs = spark.range(0, 5000).select(F.when(F.col("id") < 4000, 1).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 4000, "abc").otherwise(F.col("id").cast("string")).alias("text"))
    got = sharding.shard(docs, 8).groupBy("shard").agg(F.sum("size").alias("n"), F.count("*").alias("rows"), F.max("slot").alias("top"), F.count_distinct("slot").alias("slots")).collect()
    n = sorted(r.n for r in got)
    assert len(n) == 8 and n[-1] == 16_000 and max(n[:-1]) <= 1.06 * min(n[:-1]) and all(r.rows == r.top + 1 == r.slots for r in got)


def test_packing():
    rng = random.Random(4)
    tree = sharding.Tree()
    held = sorted((rng.randint(0, 500), i) for i in range(3000))
    for x in rng.sample(held, len(held)):
        tree.add(x)
    for _ in range(2500):
        size = rng.randint(0, 520)
        want = next((x for x in held if x[0] >= size), None)
        assert tree.take_least(size) == want
        if want:
            held.remove(want)
    sizes = [rng.randint(1, 60) for _ in range(400)]
    bins = sharding.pack(sizes, 100)
    load = np.bincount(bins, sizes)
    assert load.max() <= 100 and len(load) <= math.ceil(sum(sizes) / 100 * 11 / 9) + 1
    assert max(sharding.pack_into(sizes, 8)) < 8 and sharding.pack_into([], 8) == [] and sharding.pack_into([3], 8) == [0] and sharding.pack_into([5, 1, 1], 1) == [0, 0, 0]
    bins = sharding.pack_into([1000, 10, 10, 500, 10, 10], 4)
    assert len({bins[0], bins[3], bins[1], bins[2]}) == 4 or bins[0] != bins[3] and len(set(bins)) == 4


def test_classifier_learns(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    labels = queries.table(spark, "/root/testdata/sf0.01", "labels")
    got = quality_classifier.classify(docs, labels, queries.remainder(3) == 1).join(labels, "doc_id").where("held_out").toPandas()
    assert ((got.predicted == got.quality).mean()) > 0.93 and got.score.between(0, 1).all()


def test_classifier_sample_is_bounded(spark, monkeypatch):
    """A doc_id that repeats a thousand times is one row of the sample."""
    rows = [(1, "the same good text here", 1)] * 1000 + [(2, f"text number {i % 3}", 0) for i in range(1000)] + [(i, f"word{i} and more", i % 2) for i in range(3, 60)]
    seen = []
    monkeypatch.setattr(quality_classifier, "_fit_on", lambda ratio: lambda frames: (pd.DataFrame({"weight": [ratio.tobytes()], "bias": [float(n)], "slope": [1.0], "shift": [0.0]}) for n in [sum(map(len, frames))]))
    labelled = spark.createDataFrame(rows, "doc_id long, text string, label int")
    seen = [quality_classifier.fit(labelled, sample).bias for sample in (20, 1000)]
    assert seen == [20, 1 + 3 + 57]


def test_classifier_counts(spark):
    rows = [(i, t, label) for i, (t, label) in enumerate([("a b", 1), ("a c", 0), ("a b", 1), (None, 0), ("", 1)] * 5)]
    model = quality_classifier.fit(spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(4))
    good, bad = np.zeros(quality_classifier.DIMENSIONS), np.zeros(quality_classifier.DIMENSIONS)
    for _, t, label in rows:
        (good if label else bad)[quality_classifier.Features().of(t)] += 1
    assert np.allclose(model.ratio, quality_classifier.ratios(good, bad))


def test_classifier_edges(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (4, 0), (7, None), (None, 1)], "doc_id long, quality int")
    got = quality_classifier.classify(docs, labels, F.col("doc_id") == 13).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert quality_classifier.classify(empty, labels, F.lit(False)).count() == 0
    assert {r.score for r in quality_classifier.classify(docs, labels.where("false"), F.lit(False)).collect()} == {0.5}


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = words(lower(t or ""))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted((str(i), len(sets[k]), str(least.get(find(k)))) for k, (i, _) in enumerate(rows))


def test_near_duplicates(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = jaccard_join.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(rows)


def mutated(rng, base, n):
    out = list(base)
    for _ in range(n):
        k = rng.randrange(len(out))
        out[k : k + rng.randint(0, 1)] = [f"m{rng.randrange(10**6)}"]
    return " ".join(out)


def test_near_duplicates_of_many_sizes(spark):
    rng, rows = random.Random(6), []
    for size in [*range(1, 40), 60, 90, 140, 230, 400]:
        base = [f"b{rng.randrange(10**6)}" for _ in range(size)]
        rows += [mutated(rng, base, rng.choice([0, 0, 1, 1, 2, max(1, size // 50), max(1, size // 28)])) for _ in range(6)]
    rows = list(enumerate(rows))
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(rows)


@pytest.mark.parametrize("block", [2048, 40, 7])
def test_large_group_of_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "LIST_BLOCK", block)
    monkeypatch.setattr(jaccard_join, "EVERY_BLOCK", max(1, block // 3))
    rng = random.Random(7)
    base = [f"b{i}" for i in range(100)]
    rows = list(enumerate(mutated(rng, base, rng.randint(0, 4)) for _ in range(150)))
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(rows)


@pytest.mark.parametrize("block", [1, 3, 100])
def test_pairs_of_blocks_are_all_pairs(spark, block, monkeypatch):
    """In the last turn the blocks of a list give each pair of sets in different components that the bound leaves."""
    monkeypatch.setattr(jaccard_join, "LIST_BLOCK", block)
    monkeypatch.setattr(jaccard_join, "EVERY_BLOCK", max(1, block // 3))
    rng = np.random.default_rng(11)
    base = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
    sets = [np.unique(np.concatenate([base[rng.permutation(300)[: 300 - k]], rng.integers(0, 2**63, k, dtype=np.uint64)])) for k in (0, 3, 5, 8, 10, 40, 150) * 2]
    roots = [0, 0, 0, 3, 3, 5, 6] * 2
    members = spark.createDataFrame([(9, i, r, len(sets), 0, 8) for i, r in enumerate(roots)], "list_id long, set_id long, root long, n int, main long, out long")
    bits = spark.createDataFrame([(i, bytearray(jaccard_join.parity_bits(s)), len(s)) for i, s in enumerate(sets)], "set_id long, bits binary, n_shingles long")
    got = {(r.a, r.b) for r in jaccard_join._dealt(members, bits, 0, True).mapInArrow(jaccard_join._pairs, "a long, b long").collect()}
    like = {(i, j) for i in range(14) for j in range(i + 1, 14) if roots[i] != roots[j] and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert like and like <= got


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(8)
    for size in [5, 6, 9, 13, 20, 33, 64, 100, 250, 600]:
        for _ in range(12):
            a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            differ = jaccard_join.MOST[np.searchsorted(jaccard_join.BANDS, size, side="right") - 1]
            gone = int(rng.integers(0, differ // 2 + 1))
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[gone:]], rng.integers(0, 2**64, gone, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 80 * (len(a) + len(b) - both) and gone:
                sig, of = jaccard_join.signatures([a, b])
                assert len(np.intersect1d(sig[of == 0], sig[of == 1])), (size, gone)


@pytest.mark.parametrize("one_task", [0, 1_000_000])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr("contactsheet.llm.components.ONE_TASK", one_task)
    rng = random.Random(9)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{x:y}</style><script>if (a<b) x("</p>")</script></head><body>
<header>Site</header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div><!-- <p>gone</p> -->
<article><h1>Head &lt;1&gt;</h1><p>One <b>bold</b>
 text&nbsp;here<br>next<p>Two &#233; &copy 3<ul><li>item</li></ul><aside>side</aside><div id="comments"><p>me too</p></div></article><footer>f</footer></body></html>"""


def test_html_structure():
    page = html_extraction.parse(PAGE)
    text = "\n\n".join(t for t, k in zip(page.texts, page.kinds, strict=True) if k == html_extraction.MARKED)
    assert text == "Head <1>\n\nOne bold text here next\n\nTwo é © 3\n\nitem"
    for bad in ("", None, "<", "<p", "a < b", "<a href='x>y", "</div></div>x", "<!--", "<script>x", "&#xffffffff;", "<" * 5000, "<div>" * 5000 + "x", '<a b="' * 2000, "<a b='x\"", "<p>a<br/>b<x-y/>c"):
        html_extraction.parse(bad)
    assert html_extraction.parse("a &lt; b").texts == ["a < b"]


def test_html_closing_tags_at_any_depth():
    def kept(html):
        page = html_extraction.parse(html)
        return [t for t, k in zip(page.texts, page.kinds, strict=True) if k == html_extraction.MARKED]

    for open_ones in ("<ul>" + "<li>item" * 100 + "</ul>", "<b>ad" * 100, "<table>" + "<tr><td>a<td>b" * 100 + "</table>", "<ul><li>" * 100, "<dl>" + "<dt>a<dd>b" * 100):
        assert kept(f"<nav>{open_ones}</nav><article><p>Text</p></article>") == ["Text"], open_ones[:20]
    after = html_extraction.parse("<div><article><p>Text" + "<b>more" * 100 + "</article><p>Plain</p></div>")
    assert after.kinds == [html_extraction.MARKED, html_extraction.PLAIN]
    assert kept('<article><ul><li class="ad">buy<li>one<ul><li class="ad">two</ul></li><li>three</ul></article>') == ["one", "three"]
    assert kept('<article><table><tr><td class="ad">buy<td>one<table><tr><td>in</table><tr><td>two</table></article>') == ["one", "in", "two"]
    assert kept('<article><dl><dt class="ad">buy<dd>one</dl><p>x</p></article>') == ["one", "x"]


def test_repeated_against_brute_force():
    rng = np.random.default_rng(10)
    for _ in range(60):
        tokens, pages = rng.integers(0, 3, 80), np.sort(rng.integers(0, 6, 80))
        seen = collections.defaultdict(set)
        grams = [(i, tuple(tokens[i : i + 4])) for i in range(77) if pages[i] == pages[i + 3]]
        for i, g in grams:
            seen[g].add(pages[i])
        want = np.zeros(80, bool)
        for i, g in grams:
            if len(seen[g]) >= 3:
                want[i : i + 4] = True
        assert (html_extraction.repeated(tokens, pages, 4, 3) == want).all()


def test_html_boilerplate_of_a_host(spark):
    rows = [(i, f"http://h.org/{i}", f"<div>Welcome to our lovely site about all sorts of things</div><div>number{i} is the text of page{i * 7}</div>") for i in range(12)]
    rows += [(50, "http://h.org/a", "<article><p>Welcome to our lovely site about all sorts of things</p></article>"), (51, None, None), (52, "http://z.org", "")]
    got = {r.page_id: r for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 15 and all(got[i].text == f"number{i} is the text of page{i * 7}" and got[i].n_repeated == 10 for i in range(12))
    assert got[50].text.startswith("Welcome") and got[51].text == "" == got[52].text and got[50].n_chars == len(got[50].text)


def test_html_boilerplate_does_not_depend_on_shards(spark, monkeypatch):
    """A notice on 5 % of a host's pages goes as on a small host, wherever its pages are dealt; what two pages have stays."""
    notice, both = "<div>this notice is on some of the pages only</div>", "<div>these words are on two of the pages only</div>"
    rows = [(i, f"http://h.org/{i}", f"<div>is a text number{i}</div>{notice * (i % 20 == 0)}{both * (i in (5, 77))}") for i in range(100)]
    rows += [(None, None, f"<div>text{i}</div>{notice}") for i in range(20)]
    want = sorted([f"is a text number{i}" + "\n\nthese words are on two of the pages only" * (i in (5, 77)) for i in range(100)] + [f"text{i}" for i in range(20)])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for size in (1 << 20, 4000, 320):
        monkeypatch.setattr(html_extraction, "SHARD_BYTES", size)
        got = html_extraction.extract(pages).collect()
        assert sorted(r.text for r in got) == want and sum(r.n_repeated for r in got) == 25 * 9, size


@pytest.mark.parametrize("size", [1 << 20, 3000])
def test_html_boilerplate_in_marked_articles(spark, monkeypatch, size):
    """The suffix array decides in marked articles too: what most of the host's pages have goes, a line that many have stays."""
    monkeypatch.setattr(html_extraction, "SHARD_BYTES", size)
    text = lambda i, n=30: " ".join(f"w{i}x{k}" for k in range(n))
    line, often = "subscribe to our letter and read more of this each week", "a line that many texts of this host have inside"
    rows = [(i, f"http://h.org/{i}", f"<article><p>{text(i)}</p><p>{line}</p>{f'<p>{often}</p>' * (i % 3 == 0)}</article>") for i in range(50)]
    rows += [(100 + i, f"http://h.org/c{i}", f"<article><p>{text(99)}</p></article>") for i in range(15)]  # copies of an article
    rows += [(200 + i, f"http://h.org/f{i}", f"<main><p>{text(200 + i)}</p><p>{text(98, 12)}</p></main>") for i in range(5)]  # a text that a few pages share
    rows += [(300, "http://h.org/t", f"<article>teaser</article><div>{text(300)}</div><div>{line}</div><div>short one</div>")]
    rows += [(301, "http://h.org/u", f"<article>{text(301)}</article><div>{text(302)}</div>")]
    rows += [(400 + i, f"http://c.org/{i}", f"<article>{text(97)}</article>") for i in range(30)]  # a host of copies
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r for r in html_extraction.extract(pages).collect()}
    assert all(got[i].text == text(i) + f"\n\n{often}" * (i % 3 == 0) and got[i].n_repeated == 11 for i in range(50))
    assert all(got[100 + i].text == text(99) for i in range(15)) and all(got[400 + i].text == text(97) for i in range(30))
    assert all(got[200 + i].text == f"{text(200 + i)}\n\n{text(98, 12)}" for i in range(5))
    assert got[300].text == f"teaser\n\n{text(300)}" and got[301].text == text(301)


def test_html_repeated_rows_are_one_page(spark):
    rows = [(1, "http://h.org/1", "<div>these are the words of the only page here</div>")] * 3
    rows += [(None, "http://h.org/1", f"<div>what three pages without an id have in common is gone text{i}</div>") for i in range(3)]
    got = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r.text for r in got) == sorted(["these are the words of the only page here"] * 3 + [f"text{i}" for i in range(3)])


def test_html_names_and_tags():
    def kept(html):
        page = html_extraction.parse(html)
        return [t for t, k in zip(page.texts, page.kinds, strict=True) if k == html_extraction.MARKED]

    assert kept("<article><nav data-x=/a/>menu link</nav><script src=/a/>var y=2</script><p>t</article>") == ["t"]
    assert kept('<article>a<article class="comment">I disagree</article></article>') == ["a"]
    assert kept("<article><header>by X share now<h1>Title</h1> more</header><p>x</article>") == ["Title", "x"]
    assert kept('<article><h2 id="header-1">Title</h2><section class="social-policy">s</section><div id=comments>c</div></article>') == ["Title", "s"]
    assert kept('<article>a<div class="comment-list">c</div><div class="big cookie-notice">c</div><div class="ad">d</div><p data-id="comments">k</article>') == ["a", "k"]
    assert kept("<form><article>in form<form>x</form></article>y</form>") == ["in form"]
    assert kept('<article><a title="a > b">one</a> <b data-x=">">two</b></article>') == ["one two"]
    page = html_extraction.parse("<nav>" + "<span>" * 70 + "menu</nav><p>Body text here</p>")
    assert (page.texts, page.kinds) == (["menu", "Body text here"], [html_extraction.CHROME, html_extraction.PLAIN])


@pytest.mark.parametrize("part", ['<a "', '<a b="', "<svg>", "<textarea>", "<b", "<!--", "<![", "</", "<a   ", '<p class="', "<div id=a>", "</x y", "<li>", "<td>", "&amp", "<a b='\""])
def test_html_parse_time_is_linear(part):
    def took(n):
        began = time.perf_counter()
        html_extraction.parse(part * n)
        return time.perf_counter() - began

    took(1000)
    assert took(40_000) < 2 + 40 * took(4_000)


def test_empty_tables(spark, empty):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    bench = spark.createDataFrame([], "item_id long, text string")
    listed = spark.createDataFrame([], "host string")
    import public_tokenizers

    import corpus_pipeline

    quality = spark.createDataFrame([], "doc_id long, quality int")
    frames = [
        token_counts.count_tokens(empty, public_tokenizers.path("piece_bpe_32k.model")), quality_classifier.classify(empty, quality, F.lit(False)),
        corpus_pipeline.quality_rules(spark, empty, ""), corpus_pipeline.near_duplicates(spark, empty, ""), corpus_pipeline.mixing_sources(spark, empty, ""), corpus_pipeline.shards(spark, empty, ""),
        host_rules.host_rules(empty), mixing.mix(empty, [1]), sharding.shard(empty, 8), jaccard_join.near_duplicates(empty), lm_scoring.score_texts(empty, F.lit(False)),
        decontamination.find_leaks(empty, bench, clean=True), html_extraction.extract(pages), url_filter.judge_urls(pages, queries.URL_RULES, listed),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)


TYPES = {
    "op1_html_extraction": "page_id bigint, url string, text string, n_chars bigint, n_repeated bigint",
    "op2_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op3_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op4_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op5_lm_scoring": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op6_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op7_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op8_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op9_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op10_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
}


@pytest.fixture(scope="module")
def results(spark, tables):
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (7, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tables}/labels.parquet")
    return {name: (df.dtypes, df.collect()) for name in TYPES for df in [queries.QUERIES[name](spark, tables)]}


def test_registered_queries(spark, tables, results):
    docs = spark.read.parquet(f"{tables}/documents.parquet").collect()
    for name, (dtypes, rows) in results.items():
        assert ", ".join(f"{c} {t}" for c, t in dtypes) == TYPES[name], name
        assert len(rows) == (15 if name in ("op1_html_extraction", "op4_url_filter") else len(docs)), name
        if name not in ("op1_html_extraction", "op4_url_filter"):
            assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in docs), name


def test_registered_digests(spark, tables, docs, results):
    text = {str(r.doc_id): r.text for r in docs.collect() if r.doc_id is not None}
    for r in results["op2_token_counts"][1]:
        if r.doc_id is not None:
            assert r.n_bytes == len((text[str(r.doc_id)] or "").encode()) and r.over_limit == (r.n_tokens > 4096)
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    for r in results["op6_decontamination"][1]:
        if r.doc_id is not None:
            n, hit, found = brute_leaks([text[str(r.doc_id)]], items)[0]
            assert (r.n_words, r.n_hit, r.n_items, r.contaminated, r.items_sha256) == (n, hit, len(found), hit > 0, hashlib.sha256(",".join(found).encode()).hexdigest())
    mixed = [r for r in results["op3_mixing"][1] if r.doc_id == 12]  # a row that is there twice
    assert len(mixed) == 2 and mixed[0] == mixed[1] and mixed[0]["size"] == len(words(text["12"])) and all(r.taken <= 2 * r["size"] for r in results["op3_mixing"][1])
    assert {r.law for r in results["op7_sharding"][1]} == {"bytes"} and {r.grown_shard for r in results["op7_sharding"][1]} == {None}


def test_slices():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 5, None, "b" * 100, "", "c"])], names=["t"])
    assert [s.num_rows for s in common.slices(batch, 0, 10)] == [2, 1, 2]
    assert sum(s.num_rows for s in common.slices(batch, 0, 1)) == 5


def test_pipeline_stage_by_stage(spark, tables):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    before, columns = docs, docs.columns
    frames = {}
    for name, stage in p.STAGES:
        out = stage(spark, before, tables)
        frames[name] = (before.toPandas(), out.toPandas())
        before = out
    a, b = frames["quality_rules"]
    ok = lambda t: len(words(t)) >= 20 and t is not None and not t.startswith("same")
    assert sorted(b.doc_id.fillna(-1)) == sorted(a[a.text.map(ok)].doc_id.fillna(-1)) and list(b.columns) == columns
    a, b = frames["near_duplicates"]
    least = {i: c for i, _, c in brute_components([(None if pd.isna(i) else int(i), t) for i, t in zip(a.doc_id, a.text, strict=True)])}
    assert sorted(b.doc_id) == sorted({int(i) for i, c in least.items() if i == c})
    a, b = frames["benchmark_decontamination"]
    assert sorted(b.doc_id) == sorted(a.doc_id) and not b.text.str.contains("pass3 of").any()
    assert (b.n_chars == b.text.str.len()).all() and sorted(b[b.doc_id != 12].text) == sorted(a[a.doc_id != 12].text)
    a, b = frames["mixing_sources"]
    assert set(b.doc_id) <= set(a.doc_id) and b.groupby("doc_id").size().max() <= 2 and list(b.columns) == columns
    a, b = frames["sharding"]
    assert len(a) == len(b) and b.groupby("doc_id").shard.nunique().max() == 1
    assert p.run(spark, tables).count() == len(b)


def test_packing_leaves_no_shard_empty():
    for n in (8, 9, 12, 20, 33):
        bins = sharding.pack_into([151] * n, 8)
        counts = np.bincount(bins, minlength=8)
        assert counts.min() >= 1 and counts.max() - counts.min() <= 1
    rng = random.Random(6)
    for _ in range(40):
        sizes = [rng.choice([1, 2, 5, 9, 30, 100]) for _ in range(rng.randrange(3, 9))]
        bins = sharding.pack_into(sizes, 3)
        spread = lambda bs: (lambda c: max(c) - min(c))([sum(s for s, b in zip(sizes, bs, strict=True) if b == k) for k in range(3)])
        least = min(spread([(x // 3**i) % 3 for i in range(len(sizes))]) for x in range(3 ** len(sizes)))
        assert len(set(bins)) == 3 and spread(bins) <= least + sorted(sizes)[-2]


@pytest.mark.parametrize(
    ("html", "kept"),
    [
        ('<section class="how-to-login"><p>Text one.</p></section><section id="menu"><p>Two.</p></section>', ["Text one.", "Two."]),
        ('<p class="market-share">Market share grew</p><div class="chart-widget">Chart</div>', ["Market share grew", "Chart"]),
        ('<div class="entry-header"><h1>Title</h1><span>by me</span></div><p>B</p>', ["Title", "B"]),
        ('<p>See <a class="share">shared link</a> and <span class="ad">AD</span> end.</p>', ["See shared link and AD end."]),
        ('<p>A</p><section id="comments-list"><p>c1</p></section><div id="disqus_thread">c2</div><ul class="commentlist"><li>c3</li></ul>', ["A"]),
        ('<p>A</p><div class="CommentThread">c4</div><p style="display: none">c5</p><div class="ad-slot">c6</div><div class="share">c7</div>', ["A"]),
        ('<section class="commentary"><p>A view</p></section><div class="related-posts">r</div><div class="newsletter">n</div>', ["A view"]),
    ],
)
def test_names_in_articles(html, kept):
    page = html_extraction.parse(f"<nav>n</nav><article>{html}</article><div class='site-header'>h</div>")
    assert [t for t, k in zip(page.texts, page.kinds, strict=True) if k == html_extraction.MARKED] == kept
    assert "h" not in [t for t, k in zip(page.texts, page.kinds, strict=True) if k != html_extraction.CHROME]
