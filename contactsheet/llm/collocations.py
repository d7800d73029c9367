"""Collocations (11): frequent phrases by merged count-min sketches and one exact pass over what survives them.

A sketch has ROWS rows of counters; an n-gram adds to one counter of each row, so that the least of its counters is never below its
count. Tasks send the counters they touched, sorted and packed, to the owners of slices of the sketch, who add them up and hand on
which reach the threshold, a bit each. The first sketch is of words and pairs; the second of runs of three and four all of whose pairs
survive, as a phrase is never more frequent than its parts. The last pass counts survivors exactly: tasks send what they found in blocks
to the owners of phrases, who add up and hand on what is frequent: nothing frequent is lost, and what a sketch let through by chance falls
out there. Phrases are then scored, subsumed and ranked as tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactsheet.llm import words as W
from contactsheet.llm.common import shuffle_partitions, slices, small, stored, tidy
from contactsheet.llm.packing import deflated, inflated
from contactsheet.operators.ranks import numbered

U = np.uint64
ROWS = 2
#: Counters of a slice; counters of a row of a sketch at least and at most (a bit of each is broadcast, 2**29 are 64 MB); bytes of text a counter.
SLICE, LEAST_COUNTERS, MOST_COUNTERS, TEXT_A_COUNTER = 1 << 22, 1 << 16, 1 << 29, 16
#: Bytes of text that a task looks at together; counters that it sorts together; phrases that it finds before it hands them on.
TOGETHER, SORTED, PHRASES = 4 << 20, 1 << 23, 1 << 21
#: Owners of phrases at most, unless there are more tasks; bytes of counted phrases that an owner's task adds up together; rows that it hands on at once.
MOST_OWNERS, ADDED, BATCH_ROWS = 1024, 16 << 20, 10_000
#: Langs whose word counts are broadcast at most.
BROADCAST_LANGS = 10_000
LONGEST = 4
_BREAK = np.isin(np.arange(256), [*b".,;:!?", 10, 11, 12, 13])
_INSIDE = ~(_BREAK | np.isin(np.arange(256), [9, 32]))


class Grams:
    """The n-grams of a batch of texts: words, which of them follow each other in one piece, and hashes that the lang is part of."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        data, starts = W.utf8(texts)
        self.data = W.LOWER[data]
        self.begin, self.end, before = W.spans(self.data, starts, _INSIDE)
        self.langs = langs.to_pylist()
        self.text = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(before))
        breaks = np.cumsum(_BREAK[self.data], dtype=np.int32)
        # A break between two words is counted at the latter's first byte, which is none itself.
        self.joined = (breaks[self.begin[1:]] == breaks[self.end[:-1] - 1]) & (self.text[1:] == self.text[:-1])
        self.hash = W.hashes(self.data, self.begin, self.end)
        seeds = {x: xxhash.xxh64_intdigest(x.encode()) for x in set(self.langs)}
        self.seed = np.array([seeds[x] for x in self.langs], U)

    def of(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, hashes, whether the words are of one piece) by where an n-gram begins."""
        if not len(self.hash):
            return
        g, ok = W.mix(self.hash ^ self.seed[self.text]), np.ones(len(self.hash), bool)
        yield 1, g, ok
        for n in range(2, LONGEST + 1):
            if len(self.hash) < n:
                return
            g = W.mix(g[:-1] * U(0x9E3779B97F4A7C15) + self.hash[n - 1 :])
            ok = ok[:-1] & self.joined[n - 2 :]
            yield n, g, ok

    def spaced(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes with one space between two words of a piece and one byte after the last word, and where in them each word begins and ends."""
        keep = _INSIDE[self.data]
        keep[1:] |= keep[:-1].copy()
        place = np.cumsum(keep, dtype=np.int32)
        data = np.append(self.data[keep], np.uint8(32))
        data[data == 9] = 32
        return data, place[self.begin] - 1, place[self.end - 1]


def cells(g: np.ndarray, counters: int, row: int) -> np.ndarray:
    """The counter of each hash in a row of a sketch."""
    h = W.mix(g ^ U(0xC2B2AE3D27D4EB4F)) if row else g
    return (h >> U(65 - counters.bit_length())).astype(np.uint32)


class Heavy:
    """What a merged sketch tells: of each counter whether it reaches the threshold."""

    def __init__(self, counters: int, found: list[tuple[int, bytes]]):
        self.counters, size = counters, min(SLICE, counters)
        self.bits = np.zeros((ROWS, counters // 8), np.uint8)
        for number, gaps in found:
            row, at = divmod(number * size, counters)
            full = np.zeros(size, bool)
            full[np.cumsum(inflated(gaps)).astype(np.int64)] = True
            self.bits[row, at // 8 : (at + size) // 8] = np.packbits(full, bitorder="little")

    def has(self, g: np.ndarray) -> np.ndarray:
        out = np.ones(len(g), bool)
        for row in range(ROWS):
            at = np.flatnonzero(out)
            c = cells(g[at], self.counters, row)
            out[at] = (self.bits[row, c >> 3] >> (c & 7).astype(np.uint8)) & 1
        return out


def survivors(grams: Grams, heavy: list[Heavy]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, hashes, which are left) for the lengths that the sketches so far are of; runs of three and four are left as far as their pairs are."""
    pairs = before = None
    for n, g, ok in grams.of():
        if n <= 2:
            if heavy:
                ok[ok] = heavy[0].has(g[ok])
            pairs = ok if n == 2 else None
        elif not heavy:
            return
        else:
            ok = ok & before[: len(ok)] & before[1 : 1 + len(ok)] & pairs[n - 2 :]
            if len(heavy) > 1:
                ok[ok] = heavy[1].has(g[ok])
        before = ok
        yield n, g, ok


def _touched(counters: int, earlier, size: int):
    """The counters that a task's n-grams add to, by slice: sorted, as gaps, with what they add."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = [Heavy(*h.value) for h in earlier]
        waiting: list[np.ndarray] = []

        def send() -> Iterator[pa.RecordBatch]:
            g = np.concatenate(waiting) if waiting else np.zeros(0, U)
            waiting.clear()
            for row in range(ROWS):
                c = np.sort(cells(g, counters, row))
                new = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, np.int64)
                at, n = c[new].astype(np.int64), np.diff(np.append(new, len(c)))
                edges = np.searchsorted(at, np.arange(0, counters + 1, size))
                for s in np.flatnonzero(np.diff(edges)).tolist():
                    mine = at[edges[s] : edges[s + 1]] - s * size
                    columns = [[row * (counters // size) + s], [deflated(np.diff(mine, prepend=0))], [deflated(n[edges[s] : edges[s + 1]])]]
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(x, pa.binary()) for x in columns[1:])], names=["slice", "gaps", "adds"])

        for batch in batches:
            for part in slices(batch, 1, TOGETHER):
                waiting += [g[ok] for n, g, ok in survivors(Grams(*part.columns), heavy) if (n > 2) == bool(heavy)]
                if sum(map(len, waiting)) > SORTED:
                    yield from send()
        yield from send()

    return run


def _merged(size: int, least: int):
    """Adds up the counters of slices, and hands on which reach the threshold. Counters stop at their type's largest number, which is above it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                mine = sums.setdefault(r["slice"], np.zeros(size, np.uint16))
                at = np.cumsum(inflated(r["gaps"])).astype(np.int64)
                mine[at] = np.minimum(mine[at].astype(np.int64) + inflated(r["adds"]).astype(np.int64), 65535)
        for number, mine in sums.items():
            at = np.flatnonzero(mine >= least)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([deflated(np.diff(at, prepend=0))], pa.binary())], names=["slice", "gaps"])

    return run


def sketch(rows: DataFrame, counters: int, least: int, earlier: list) -> tuple[int, list[tuple[int, bytes]]]:
    """The heavy counters of a sketch of rows (lang, text): of words and pairs, or, after that one, of longer runs."""
    size = min(SLICE, counters)
    touched = rows.mapInArrow(_touched(counters, earlier, size), "slice int, gaps binary, adds binary")
    merged = touched.repartition(shuffle_partitions(rows.sparkSession), "slice").mapInArrow(_merged(size, least), "slice int, gaps binary")
    return counters, [(r.slice, bytes(r.gaps)) for r in merged.collect()]  # no more than a bit for each counter, of which there are at most MOST_COUNTERS a row


def _apart(g: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes, sorted, the place of one of each, and the sum of times of each; by default how often it is there."""
    order = np.argsort(g)
    g = g[order]
    new = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    return g[new], order[new], np.diff(np.append(new, len(g))) if times is None else np.add.reduceat(times[order], new)


def _runs(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of runs of data in a row."""
    ends = np.cumsum(size, dtype=np.int64)
    wide = np.int32 if max(ends[-1], len(data)) < 1 << 31 else np.int64
    return data[np.repeat((start - ends + size).astype(wide), size) + np.arange(ends[-1], dtype=wide)]


def _counted(earlier, owners: int, most: int):
    """Blocks of the survivors in a task, one for each owner of phrases: the phrases, each with a line feed after it, which none has
    inside, the places of their langs in langs, and how often they were found. The empty phrase stands for all words of a lang.

    most: phrases that the slices of text find apart before they are put together and sent.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = [Heavy(*h.value) for h in earlier]
        langs: dict[str, int] = {}
        total: dict[str, int] = {}
        waiting: list[tuple[np.ndarray, ...]] = []  # hashes, how often, lang, bytes of each phrase; all their bytes

        def block(owner: int, names: list[str], lang: np.ndarray, text: bytes, adds: np.ndarray) -> pa.RecordBatch:
            columns = [pa.array([owner], pa.int32()), pa.array([names], pa.list_(pa.string())), *(pa.array([x], pa.binary()) for x in (deflated(lang), zstandard.compress(text, 1), deflated(adds)))]
            return pa.RecordBatch.from_arrays(columns, names=["owner", "langs", "lang", "phrases", "adds"])

        def send() -> Iterator[pa.RecordBatch]:
            if not waiting:
                return
            g, times, lang, size, data = (np.concatenate(x) for x in zip(*waiting, strict=True))
            waiting.clear()
            names, start = np.array(list(langs), object), np.cumsum(size, dtype=np.int64) - size
            g, order, times = _apart(g, times)
            edges = np.searchsorted((g >> U(40)).astype(np.int64) * owners >> 24, np.arange(owners + 1))
            for owner in np.flatnonzero(np.diff(edges)).tolist():
                mine = order[edges[owner] : edges[owner + 1]]
                used, place = np.unique(lang[mine], return_inverse=True)
                yield block(owner, names[used].tolist(), place, _runs(data, start[mine], size[mine]).tobytes(), times[edges[owner] : edges[owner + 1]])

        for batch in batches:
            for part in slices(batch, 1, TOGETHER):
                grams = Grams(*part.columns)
                for t, n in zip(*np.unique(grams.text, return_counts=True), strict=True):
                    total[grams.langs[t]] = total.get(grams.langs[t], 0) + int(n)
                number = np.array([langs.setdefault(x, len(langs)) for x in grams.langs], np.int32)
                data, begin, end = grams.spaced()
                for n, g, ok in survivors(grams, heavy):
                    if len(at := np.flatnonzero(ok)):
                        keys, first, times = _apart(g[at])
                        at = at[first]
                        size = end[at + n - 1] - begin[at] + 1
                        text = _runs(data, begin[at], size)
                        text[np.cumsum(size, dtype=np.int64) - 1] = 10
                        waiting.append((keys, times, number[grams.text[at]], size, text))
                if sum(len(x[0]) for x in waiting) > most or sum(len(x[4]) for x in waiting) > 32 * most:
                    yield from send()
        yield from send()
        for name, n in total.items():
            yield block(xxhash.xxh64_intdigest(name.encode()) % owners, [name], np.zeros(1, np.int64), b"\n", np.array([n]))

    return run


def _lines(text: bytes) -> pa.Array:
    """Texts with a line feed after each as a column."""
    data = np.frombuffer(text, np.uint8)
    feeds = np.flatnonzero(data == 10)
    starts = np.append(0, feeds - np.arange(len(feeds))).astype(np.int32)
    return pa.StringArray.from_buffers(len(feeds), pa.py_buffer(starts.tobytes()), pa.py_buffer(data[data != 10].tobytes()))


def _summed(least: int, together: int):
    """(lang, phrase, words, n) from blocks of some owners: the phrases found least times or more; words 0 for all words of a lang."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []
        before = more = 0

        def added() -> pa.Table:
            return pa.concat_tables(waiting).group_by(["lang", "phrase"], use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})

        for batch in batches:
            for part in slices(batch, 3, together):
                for r in part.to_pylist():
                    langs = pa.array(r["langs"], pa.string()).take(pa.array(inflated(r["lang"])))
                    waiting.append(pa.table({"lang": langs, "phrase": _lines(zstandard.decompress(r["phrases"])), "n": inflated(r["adds"]).astype(np.int64)}))
                    more += waiting[-1].nbytes
                    if more > max(together, before):  # so that what is known already isn't added up again for little
                        waiting[:] = [added()]
                        before, more = waiting[0].nbytes, 0
        if waiting:
            out = added()
            out = out.filter(pc.or_(pc.greater_equal(out["n"], least), pc.equal(out["phrase"], "")))
            words = pc.if_else(pc.equal(out["phrase"], ""), 0, pc.add(pc.count_substring(out["phrase"], " "), 1))
            yield from out.add_column(2, "words", words.cast(pa.int32())).to_batches(max_chunksize=BATCH_ROWS)

    return run


def frequent_phrases(docs: DataFrame, least: int = 30, text: str = "text", lang: str = "lang", counters: int | None = None) -> DataFrame:
    """lang, phrase, words, n: all runs of one to four words of one piece that occur least times or more in their lang, with their exact
    number; and for each lang a row of words 0, an empty phrase and the number of all its words.

    counters: of a row of the first sketch, a power of two; by default by the bytes of the texts. Fewer let more through to the exact
    count, and never lose any.
    """
    if not 0 < least < 65536:
        raise ValueError("least must be from 1 to 65535")
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if counters is None:
        size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // TEXT_A_COUNTER
        counters = min(MOST_COUNTERS, max(LEAST_COUNTERS, 1 << int(size).bit_length()))
    heavy = [spark.sparkContext.broadcast(sketch(rows, counters, least, []))]
    heavy.append(spark.sparkContext.broadcast(sketch(rows, max(LEAST_COUNTERS, counters // 2), least, heavy)))
    tasks = shuffle_partitions(spark)
    counted = rows.mapInArrow(_counted(heavy, max(tasks, min(MOST_OWNERS, 4 * tasks)), PHRASES), "owner int, langs array<string>, lang binary, phrases binary, adds binary")
    return counted.repartition(tasks, "owner").mapInArrow(_summed(least, ADDED), "lang string, phrase string, words int, n long")


def scored(phrases: DataFrame, most: int = 2_000_000) -> DataFrame:
    """lang, phrase, words, a, l, r, score of the phrases of two words or more: their weakest cut, in whole numbers of any size.

    phrases: as frequent_phrases() gives them; the parts of a phrase are there, as they are no less frequent.
    """
    parts = F.split("phrase", " ")
    both = phrases.where("words >= 2").select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    both = both.select("*", F.array_join(F.slice(parts, F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice(parts, F.col("k") + 1, F.col("words")), " ").alias("tail"))
    for part, name in (("head", "l"), ("tail", "r")):
        both = both.join(phrases.select("lang", F.col("phrase").alias(part), F.col("n").alias(name)), ["lang", part])
    score = F.expr(f"CAST({most} * CAST(a AS DECIMAL(28,0)) AS DECIMAL(38,0)) div (CAST(l AS DECIMAL(38,0)) + CAST(r AS DECIMAL(20,0)))")
    cut = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return both.groupBy("lang", "phrase", "words", "a").agg(cut).select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def subsumed(phrases: DataFrame, percent: int = 80) -> DataFrame:
    """lang and phrase of those whose words stand in a row in a longer one that is at least so many percent as frequent."""
    parts, n = F.split("phrase", " "), F.col("words")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), n - 1), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(parts, i, k), " "))))
    longest = phrases.where("words >= 3").select("lang", F.explode(inner).alias("phrase"), F.col("n").alias("of")).groupBy("lang", "phrase").agg(F.max("of").alias("of"))
    return phrases.where("words >= 2").join(longest, ["lang", "phrase"]).where(F.col("of").cast("decimal(38,0)") * 100 >= F.col("n").cast("decimal(38,0)") * percent).select("lang", "phrase")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, percent: int = 80, text: str = "text", lang: str = "lang", counters: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's best phrases of two to four words.

    Texts have A-Z lower-cased and end pieces at . , ; : ! ? and line breaks; words are what stands between spaces and tabs. Null texts are
    empty, a null lang is und. Rows that repeat count again. An empty table, or texts without frequent phrases, give no rows. A text of
    any length is taken whole. Words are told apart by 64-bit hashes within a task, and as texts after that.
    """
    phrases = stored(frequent_phrases(docs, least, text, lang, counters))
    left = scored(phrases).join(subsumed(phrases, percent), ["lang", "phrase"], "left_anti")
    placed = numbered(left, "rank", [F.desc("score"), F.desc("a"), F.col("phrase")], by=["lang"]).where(F.col("rank") <= top)
    totals = phrases.where("words = 0").select("lang", "n")
    totals = F.broadcast(totals) if small(totals, BROADCAST_LANGS) else totals
    return placed.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
