"""Token files against the tokenizer itself, and Elias-Fano lists against the numbers they hold."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from contactsheet.llm import queries, token_files
from contactsheet.llm.elias_fano import EliasFano, encoded

FILE = public_tokenizers.path("byte_bpe_50k.json")


@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 1 << 40)), max_size=700))
@settings(max_examples=60, deadline=None)
def test_elias_fano(gaps):
    values = np.cumsum(np.array(gaps, np.int64))
    found = EliasFano(encoded(values))
    assert len(found) == len(values) and found.values().tolist() == values.tolist()
    assert [found.select(i) for i in range(0, len(values), 7)] == values[::7].tolist()


def test_elias_fano_is_small_and_checks():
    values = np.cumsum(np.random.default_rng(1).integers(0, 1000, 100_000))
    assert len(encoded(values)) * 8 < 100_000 * (np.log2(values[-1] / 100_000) + 2.3)
    with pytest.raises(ValueError):
        encoded(np.array([3, 2]))
    with pytest.raises(IndexError):
        EliasFano(encoded(np.array([1]))).select(1)


white = st.sampled_from(list(" \n\t\r\x0b\x0c\x1c\x1f\x85\xa0\u1680\u2000\u2003\u200a\u200b\u2028\u2029\u202f\u205f\u3000") + ["  ", "\n\n", "\n\n\n", " \n "])
bits = st.one_of(white, st.sampled_from(["don't", "'s", "über", "漢字", "🙂", "x1", "42", "$$$", "a.b", "<|endoftext|>", "<|endof", "́", "é"]), st.text(max_size=4))


@given(st.lists(bits, max_size=14).map("".join))
@settings(max_examples=400, deadline=None)
def test_chunks_have_the_ids_of_the_whole(text):
    assert token_files.encoder(FILE).of(text) == np.array(whole().encode(text, add_special_tokens=False).ids, "<u2").tobytes()


@pytest.mark.parametrize("text", ["don't\n\n<|endoftext|>", "a \n<|endoftext|>b", "a\n <|endoftext|>", "a  <|endoftext|><|endoftext|>\n\nb", "a\n\n<|endof", "a\n\nb<|endoftext|>"])
def test_white_space_before_special_strings(text):
    assert token_files.encoder(FILE).of(text) == np.array(whole().encode(text, add_special_tokens=False).ids, "<u2").tobytes()


def whole(made=[]):  # noqa: B006
    return made[0] if made else made.append(Tokenizer.from_file(FILE)) or made[0]


def brute(rows, end=(0,)):
    """(key, start, ids) of rows (key, text) by key, null ones last, then as write_tokens orders them."""
    ids = [(k, whole().encode(t or "", add_special_tokens=False).ids + list(end)) for k, t in rows]
    pack = lambda x: np.array(x, "<u2").tobytes()
    ids.sort(key=lambda r: (r[0] is None, r[0] or 0, len(r[1]), zlib.crc32(pack(r[1])), pack(r[1])))
    starts = np.concatenate([[0], np.cumsum([len(x) for _, x in ids])]).tolist()
    return [(k, s, x) for (k, x), s in zip(ids, starts, strict=False)]


def test_files_round_trip(spark, docs, tmp_path):
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    for name, size in (("small", 50), ("large", 1 << 20)):
        folder = f"{tmp_path}/{name}"
        token_files.write_tokens(docs, folder, FILE, block_ids=size, shard_bytes=200)
        got = token_files.read_tokens(spark, folder).orderBy("position").collect()
        assert [(r.doc_id, r.position, r.start, r.n_tokens) for r in got] == [(k, i, s, len(x)) for i, (k, s, x) in enumerate(want)]
        assert all(np.frombuffer(r.ids, "<u4").tolist() == x and r.ids_crc32 == zlib.crc32(r.ids) for r, (_, _, x) in zip(got, want, strict=True))
        asked = [0, 7, len(want) - 1]
        some = {r.position: r for r in token_files.ids_at(spark, folder, [*asked, 10**9]).collect()}
        assert sorted(some) == asked and all((some[p].doc_id, some[p].start, some[p].ids) == want[p] for p in asked)
    blocks = spark.read.parquet(f"{tmp_path}/small/blocks").collect()
    assert len(blocks) > 20 and all(b.n_docs == 1 or b.n_ids <= 50 for b in blocks)


def test_query_and_empty_table(spark, docs, empty, tmp_path):
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op13_token_files"](spark, str(tmp_path)).collect()
    want = [(k, s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, s, x in brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])]
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    none = token_files.token_table(empty, FILE)
    assert none.count() == 0 and none.columns == ["doc_id", "position", "start", "n_tokens", "ids_crc32"]


def test_keys_of_other_kinds_and_no_end(spark):
    df = spark.createDataFrame([("b", "two words"), ("a", None), ("c", "")], "key string, body string")
    got = token_files.token_table(df, FILE, text="body", key="key", end=None).orderBy("position").collect()
    assert [(r.key, r.start, r.n_tokens) for r in got] == [("a", 0, 0), ("b", 0, 2), ("c", 2, 0)]
