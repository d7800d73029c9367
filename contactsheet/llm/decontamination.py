"""Benchmark decontamination (6): an FM-index for each shard of the training texts, searched for the benchmark's windows.

A shard is a stretch of a task's documents. Its index holds their runs of words that the benchmark has too and that are long enough
for a window: no other place can match. All windows are searched backward at once, through the ranks of a wavelet matrix; sampled
suffix positions give the places, which merge into spans of words to remove. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactsheet.llm.common import bounded_batches, slices, tidy
from contactsheet.llm.fm_index import FMIndex
from contactsheet.llm.words import LOWER, Lookup, hashes, spans, utf8, word_hashes

WINDOW = 10
#: Bytes of a shard's texts; bytes of benchmark texts that are one broadcast. A larger benchmark makes more of them.
SHARD_BYTES, BLOCK_BYTES = 4 << 20, 8 << 20
#: Bytes of a word: letters, digits and all beyond ASCII.
INSIDE = np.array([48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)])
OF_DOC = "struct<n_words:bigint,spans:array<struct<start:int,end:int>>,items:array<string>>"


@dataclass
class Windows:
    """vocabulary: sorted hashes of the items' words. patterns: by length, a window of word numbers (from 1) a row. items: by length,
    the item numbers of each window. ids: of the items."""

    vocabulary: np.ndarray
    patterns: dict[int, np.ndarray]
    items: dict[int, list[list[int]]]
    ids: list[str]

    @classmethod
    def of(cls, benchmark: list[tuple[str, str | None]], window: int = WINDOW) -> Windows:
        own, before = word_hashes(pa.array([t for _, t in benchmark], pa.string()), INSIDE)
        vocabulary, number = np.unique(own, return_inverse=True)
        found: dict[tuple[int, ...], list[int]] = {}
        for item in range(len(benchmark)):
            ids = (number[before[item] : before[item + 1]] + 1).tolist()
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                of = found.setdefault(tuple(ids[i : i + window]), [])
                if not of or of[-1] != item:
                    of.append(item)
        by: dict[int, list[tuple[int, ...]]] = {}
        for w in found:
            by.setdefault(len(w), []).append(w)
        return cls(vocabulary, {n: np.array(by[n], np.int32) for n in sorted(by)}, {n: [found[x] for x in by[n]] for n in by}, [i for i, _ in benchmark])


def search_shard(own: np.ndarray, starts: np.ndarray, windows: Windows, lookup: Lookup) -> tuple[np.ndarray, list[set[int]]]:
    """own: hashes of the words of some texts; starts: where each text's begin, and their number. Which words are hit, and of each text the item numbers found."""
    total = len(own)
    hit, items = np.zeros(total, bool), [set() for _ in starts[1:]]
    if not total or not windows.patterns:
        return hit, items
    ids = lookup.find(own).astype(np.int32) + 1
    # Runs of known words within a document, as [from, to).
    edge = np.zeros(total + 1, bool)
    edge[starts] = True
    known = ids > 0
    begins = np.flatnonzero(known & (edge[:-1] | ~np.concatenate([[False], known[:-1]])))
    ends = np.flatnonzero(known & (edge[1:] | ~np.concatenate([known[1:], [False]]))) + 1
    long = ends - begins >= min(windows.patterns)
    begins, ends = begins[long], ends[long]
    if not len(begins):
        return hit, items
    size = ends - begins + 1  # with an end each
    offset = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(offset[-1]) - np.repeat(offset[:-1], size) + np.repeat(begins, size)
    text = ids[np.minimum(place, total - 1)]
    text[offset[1:] - 1] = 0
    index = FMIndex(text, len(windows.vocabulary))
    cover = np.zeros(total + 1, np.int64)
    for n, patterns in windows.patterns.items():
        lo, hi = index.search(patterns)
        count = hi - lo
        which = np.repeat(np.arange(len(patterns)), count)
        rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        at = place[index.locate(rows)]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + n, -1)
        doc = np.searchsorted(starts, at, side="right") - 1
        for d, w in np.unique(np.stack([doc, which], axis=1), axis=0).tolist():
            items[d].update(windows.items[n][w])
    return np.cumsum(cover[:-1]) > 0, items


def spans_of(hit: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def without(data: bytes, begin: np.ndarray, end: np.ndarray, cut: list[dict[str, int]]) -> str:
    """A text, as bytes, without the words of some spans and what is between a span's words. begin, end: where its words do.

    All else stays, but of the white space before and after a span only one part: that with more lines, or else the longer one; at the
    text's ends neither.
    """
    out, last = b"", 0
    for s in cut:
        before, gap = data[last : begin[s["start"]]], b""
        last = int(end[s["end"] - 1])
        kept = before.rstrip()
        after = data[last:][: len(data[last:]) - len(data[last:].lstrip())]
        if (out or kept) and last + len(after) < len(data):
            gap = max(before[len(kept) :], after, key=lambda x: (x.count(b"\n"), len(x)))
        out, last = out + kept + gap, last + len(after)
    return (out + data[last:]).decode()


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, clean: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with a struct column leaks: n_words, spans of hit words (from, to in words) and the sorted ids of the items found.

    clean: text also loses those spans. Null and empty texts have no words. Rows stay as they are, repeated ones too; a column leaks
    of docs is replaced. Items without words and an empty benchmark find nothing; an empty table gives an empty table. Items are
    broadcast in blocks of bounded size; a text is read once and its words are looked up in each block.
    """
    bounded_batches(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), "text").where("id IS NOT NULL AND text <> ''")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("n")).first().n
    blocks, shared = max(1, math.ceil(total / block_bytes)), []
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block)
        shared.append(docs.sparkSession.sparkContext.broadcast(Windows.of(sorted((r.id, r.text) for r in mine.collect()), window)))
    docs = docs.drop("leaks").withColumn("leaks", F.lit(None).cast(OF_DOC))
    names = docs.columns
    at = names.index("text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [(x.value, Lookup(x.value.vocabulary)) for x in shared]
        for batch in batches:
            kind = batch.schema.field("leaks").type
            for part in slices(batch, at, SHARD_BYTES):
                data, bounds = utf8(part.column(at))
                lowered = LOWER[data]
                begin, end, starts = spans(lowered, bounds, INSIDE)
                own = hashes(lowered, begin, end)
                hit, found = np.zeros(len(own), bool), [set() for _ in bounds[1:]]
                for windows, lookup in search:
                    more, items = search_shard(own, starts, windows, lookup)
                    hit |= more
                    for ids, x in zip(found, items, strict=True):
                        ids.update(windows.ids[i] for i in x)
                leaks = [{"n_words": int(n), "spans": [], "items": sorted(x)} for n, x in zip(np.diff(starts), found, strict=True)]
                touched = np.unique(np.searchsorted(starts, np.flatnonzero(hit), side="right") - 1).tolist()
                for i in touched:
                    leaks[i]["spans"] = spans_of(hit[starts[i] : starts[i + 1]])
                columns = dict(zip(names, part.columns, strict=True)) | {"leaks": pa.array(leaks, kind)}
                if clean and touched:
                    texts = part.column(at).to_pylist()
                    for i in touched:
                        own_words = slice(starts[i], starts[i + 1])
                        texts[i] = without(data[bounds[i] : bounds[i + 1]].tobytes(), begin[own_words] - bounds[i], end[own_words] - bounds[i], leaks[i]["spans"])
                    columns["text"] = pa.array(texts, part.column(at).type)
                yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return docs.mapInArrow(run, docs.schema)
