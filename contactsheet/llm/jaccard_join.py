"""N-gram Jaccard join (9) by PartEnum signatures.

Two sets of sizes a and b with a Jaccard similarity of 0.8 or more differ in at most (a + b) / 9 elements and their sizes are in
one band or in two that adjoin; so each set takes part in two instances, its band's and the next one's. An instance for at most k
differences cuts the domain of the elements into n1 partitions by a hash; at most k // 2 of them have two differences or more. Each
partition is cut again into three, and for each subset of two of these a signature stands for the set's elements in it. A partition
with one difference at most has a subset without any, so that similar sets have a signature in common.

Signatures of no elements are left out. That is safe for a set of which no more partitions than the spare ones have such a
subset. Two sets that both have more are found by another exact way: a token, in the instance, of each of
their first a - ceil(0.8 a) + 1 elements.

Elements that very many documents share, a bounded list of them, are left out of the signatures: what is left of two similar sets
differs in no more elements than they do, so nothing is lost, and passages that documents share make no candidates.

Equal sets are one class from the start. Sets that share a signature form a list. Of a list's pairs those are left which the sizes
and an exact bound from bitmaps don't exclude; these are checked on whole sets. In a large group of near copies they are many, though a
few join the group. So lists are cut into blocks of bounded size, and each set is first checked with the nearest one of its block of
its longest list, and with one that is near to most; for large lists once more in other blocks. Then lists that are in one component are done; in the others, cut anew, each set
outside the block's largest component is checked so with sets of other components. At last, where components of a list still differ,
each block of the sets outside its largest component meets each block of the list, and all pairs between components are checked.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactsheet.llm.common import bounded_batches, checkpointed, slices, small, tidy
from contactsheet.llm.components import components
from contactsheet.llm.words import word_hashes

SHINGLE = 5
#: Text of which signatures are made at once, signatures that one task groups on average.
SLICE_BYTES, BUCKET_SETS = 1 << 20, 2 << 20
#: Cells of the filter for each candidate; cells at most, 32 MB of bits: with more than four million candidates it lets more other sets through.
CANDIDATE_CELLS, MOST_CELLS = 64, 1 << 28
#: Bytes of a signature that are kept: two different ones of a bucket may then be equal, two in a million, which only makes a candidate more.
#: With four it would be one in two thousand, and a set has hundreds: every fifth set would be a candidate. Bytes of an element in the comparison.
SIG_BYTES, ELEMENT_BYTES = 5, 6
#: Ids of sets to compare that are broadcast at most, 16 MB. Pairs of a task on average, when they are dealt to their sets.
BROADCAST_IDS, TASK_PAIRS = 1_000_000, 20_000
#: Members of lists in a task on average, where they are only looked up: few rows in many tasks are many small files.
TASK_MEMBERS = 100_000
#: Buckets of small corpora.
LEAST_BUCKETS = 24
#: An element counts as common if it is in this many documents of a slice; those that a slice reports, and those that are broadcast, at most.
COMMON, SLICE_COMMON, ALL_COMMON = 3, 4_000, 200_000
#: Pairs a set that a list may have to be checked at once. Cells of a bitmap for each element. Sets of a list that are compared in one block.
FEW, CELLS, LIST_BLOCK, EVERY_BLOCK = 1, 1, 2048, 4096
CACHED = 200_000
U = np.uint64
#: Odd multipliers, one for each place of a shingle.
PLACES = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) | 1 for i in range(SHINGLE)], U)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them."""
    x = (x ^ U(salt * 0x632BE59BD9B4E019 % (1 << 64))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(30))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(h: np.ndarray) -> np.ndarray:
    """The set of a text, given the hashes of its words, as sorted 64-bit hashes: of five words each, or of all if there are fewer."""
    if not len(h):
        return np.zeros(0, U)
    if len(h) < SHINGLE:
        return mix(np.array([(h * PLACES[: len(h)]).sum() + U(len(h))], U), 1)
    n = len(h) - SHINGLE + 1
    out = h[:n] * PLACES[0]
    for i in range(1, SHINGLE):
        out += h[i : i + n] * PLACES[i]
    out = mix(out, 2)
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def sets_of(texts: pa.Array) -> list[np.ndarray]:
    """The set of each text of a column."""
    own, before = word_hashes(texts)
    return [shingles(own[a:b]) for a, b in zip(before[:-1], before[1:], strict=True)]


def set_id(s: np.ndarray) -> int:
    return int(mix(np.array([mix(s, 3).sum() + U(len(s))], U), 4).view(np.int64)[0])


def parity_bits(s: np.ndarray) -> bytes:
    """Which cells have an odd number of elements; two sets differ in at least as many elements as their bits."""
    cells = max(64, 1 << (CELLS * len(s) - 1).bit_length())
    return np.packbits(np.bincount((mix(s, 5) % U(cells)).astype(np.int64), minlength=cells) & 1, bitorder="little").tobytes()


def _bands() -> np.ndarray:
    """The least size of each band; its largest is 5 / 4 of that."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 5 // 4 + 1)
    return np.array(out)


BANDS = _bands()
MOST = (BANDS * 5 // 4) * 2 // 9  # differences in an instance
SPARE = 2 + (MOST // 2 + 1) // 5
PARTS = MOST // 2 + 1 + SPARE


def signatures(sets: list[np.ndarray], common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of some sets, none empty, and the number of the set of each. common: sorted elements to leave out."""
    sizes = np.array([len(s) for s in sets])
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    band = np.searchsorted(BANDS, sizes, side="right") - 1
    if common is not None and len(common):
        rare = common[np.minimum(np.searchsorted(common, every), len(common) - 1)] != every
        every, owner = every[rare], owner[rare]
    value, first, second = mix(every, 6), mix(every, 7), (mix(every, 8) % U(3)).astype(np.int64)
    out, of = [], []
    for instance in (band, band + 1):
        used = MOST[instance] > 0
        parts = np.where(used, PARTS[instance], 0)
        base = np.concatenate([[0], np.cumsum(parts)])
        on = used[owner]
        own = owner[on]
        part = base[own] + (first[on] % parts[own].astype(U)).astype(np.int64)
        cell = part * 3 + second[on]
        order = np.argsort(cell, kind="stable")
        count = np.bincount(cell, minlength=3 * base[-1])
        ends = np.cumsum(count)
        sums = np.concatenate([np.zeros(1, U), np.cumsum(value[on][order], dtype=U)])
        total = (sums[ends] - sums[ends - count]).reshape(-1, 3)
        count = count.reshape(-1, 3)
        docs = np.repeat(np.arange(len(sets)), parts)
        tag = mix(instance[docs].astype(U) * U(1 << 40) + (np.arange(base[-1]) - base[docs]).astype(U) * U(4), 9)
        hollow = np.zeros(base[-1], bool)
        for gone in range(3):
            some = count.sum(axis=1) - count[:, gone]
            hollow |= some == 0
            sig = mix((total.sum(axis=1, dtype=U) - total[:, gone]) ^ (tag + U(gone)), 10) + some.astype(U)
            out.append(mix(sig, 11)[some > 0])
            of.append(docs[some > 0])
        for i in np.flatnonzero(used & (np.bincount(docs[hollow], minlength=len(sets)) > SPARE[instance])):
            first_few = sets[i][: len(sets[i]) - math.ceil(len(sets[i]) * 4 / 5) + 1]
            out.append(mix(first_few + U(instance[i]), 12))
            of.append(np.full(len(first_few), i))
    return np.concatenate(out), np.concatenate(of)


@tidy
def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for batch in batches for part in slices(batch, 1, SLICE_BYTES)):
        sets = sets_of(batch.column(1))
        n, ids = [len(s) for s in sets], [set_id(s) if len(s) else None for s in sets]
        bits = [parity_bits(s) if len(s) else None for s in sets]
        # One row more for the slice's common elements; equal sets count once.
        distinct = {i: s for i, s in zip(ids, sets, strict=True) if i is not None}
        found, count = np.unique(np.concatenate([np.zeros(0, U), *distinct.values()]), return_counts=True)
        order = np.argsort(-count, kind="stable")[:SLICE_COMMON]
        order = order[count[order] >= COMMON]
        doc_id = pa.concat_arrays([batch.column(0), pa.nulls(1, batch.column(0).type)])
        bits.append(found[order].tobytes())
        yield pa.RecordBatch.from_arrays([doc_id, pa.array([*n, -1], pa.int64()), pa.array([*ids, None], pa.int64()), pa.array(bits, pa.binary())], names=["doc_id", "n_shingles", "set_id", "bits"])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.frombuffer(x, np.int64) for x in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], names=["element"])


def _emit(buckets: int, common):
    """Signatures as rows of packed arrays: bucket, the sets' ids, how many signatures each has there, the signatures."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for part in slices(batch, 0, SLICE_BYTES):
                sets, ids = [], []
                for s in sets_of(part.column(0)):
                    if len(s) and (i := set_id(s)) not in seen:
                        seen.add(i)
                        sets.append(s)
                        ids.append(i)
                if len(seen) > CACHED:
                    seen = set()
                if not sets:
                    continue
                sig, of = signatures(sets, common.value)
                bucket = (sig >> U(44)) % U(buckets)
                order = np.lexsort((of, bucket))
                sig, of, bucket = sig[order], of[order], bucket[order]
                own = np.array(ids, np.int64)
                edges = np.flatnonzero(np.diff(bucket)) + 1
                rows = [[], [], [], []]
                for a, b in zip([0, *edges], [*edges, len(sig)], strict=True):
                    if a == b:
                        continue
                    starts = np.concatenate([[0], np.flatnonzero(np.diff(of[a:b])) + 1, [b - a]])
                    for column, x in zip(rows, (int(bucket[a]), own[of[a:b][starts[:-1]]].tobytes(), zlib.compress(np.diff(starts).astype(np.uint32).tobytes(), 1), sig[a:b].view(np.uint8).reshape(-1, 8)[:, :SIG_BYTES].tobytes()), strict=True):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(x, pa.binary()) for x in rows[1:])], names=["bucket", "ids", "counts", "sigs"])

    return run


def _lists(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: the lists of two sets or more that share a signature, each once, packed."""
    counts = [np.frombuffer(zlib.decompress(c), np.uint32) for c in pdf["counts"]]
    ids = np.concatenate([np.repeat(np.frombuffer(i, np.int64), c) for i, c in zip(pdf["ids"], counts, strict=True)])
    packed = np.concatenate([np.frombuffer(x, np.uint8) for x in pdf["sigs"]]).reshape(-1, SIG_BYTES)
    wide = np.zeros((len(packed), 8), np.uint8)
    wide[:, :SIG_BYTES] = packed
    sig = wide.view(U).ravel()
    order = np.argsort(sig, kind="stable")
    sig, ids = sig[order], ids[order]
    starts = np.concatenate([[0], np.flatnonzero(np.diff(sig)) + 1, [len(sig)]])
    many = np.flatnonzero(np.diff(starts) > 1)
    lists = {np.unique(ids[starts[i] : starts[i + 1]]).tobytes() for i in many}
    return pd.DataFrame({"members": sorted(x for x in lists if len(x) > 8)}, dtype=object)


def _cells(doc_ids: np.ndarray, cells: int) -> np.ndarray:
    return (mix(doc_ids.astype(np.int64).view(U), 13) % U(cells)).astype(np.int64)


def _filter(doc_ids: DataFrame) -> np.ndarray:
    """A bitmap with the cells of the ids set; it lets through some other documents too."""
    n = doc_ids.count()
    cells = min(MOST_CELLS, 1 << max(16, (CANDIDATE_CELLS * n).bit_length()))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(cells // 8, np.uint8)
        for b in batches:
            at = np.unique(_cells(b.column(0).to_numpy(zero_copy_only=False), cells))
            np.bitwise_or.at(found, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(cells // 8, np.uint8)
    for row in doc_ids.coalesce(4).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(row.bits, np.uint8)
    return out


def _sets(shared):
    """The packed sets of the documents that the filter lets through, and of those without an id."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in (part for batch in batches for part in slices(batch, 1, SLICE_BYTES)):
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            cell = _cells(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), 8 * len(bits))
            take = np.flatnonzero(~known | ((bits[cell >> 3] >> (cell & 7)) & 1).astype(bool))
            ids, sets = [], []
            for s in sets_of(batch.column(1).take(pa.array(take))):
                if len(s):
                    ids.append(set_id(s))
                    sets.append(s.view(np.uint8).reshape(-1, 8)[:, 8 - ELEMENT_BYTES :].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["set_id", "elements"])

    return run


def _elements_of(data: bytes) -> np.ndarray:
    """A packed set's elements, by their first bytes."""
    out = np.zeros((len(data) // ELEMENT_BYTES, 8), np.uint8)
    out[:, 8 - ELEMENT_BYTES :] = np.frombuffer(data, np.uint8).reshape(-1, ELEMENT_BYTES)
    return out.view(U).ravel()


@tidy
def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns a, b, and both sets; adds whether 100 times their intersection is 80 times their union or more."""
    for batch in batches:
        linked = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = _elements_of(x), _elements_of(y)
            both = len(np.intersect1d(x, y, assume_unique=True))
            linked.append(100 * both >= 80 * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs with whether they are linked. Where their sets are few, only these are shuffled."""
    pairs = checkpointed(pairs.select("a", "b"))
    n = pairs.count()
    tasks = max(1, math.ceil(n / TASK_PAIRS))
    pairs = pairs.coalesce(tasks)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    sets = sets.join(F.broadcast(wanted), "set_id", "left_semi") if 2 * n <= BROADCAST_IDS or small(wanted, BROADCAST_IDS) else sets
    one, two = (sets.select(F.col("set_id").alias(k), F.col("elements").alias(f"of_{k}")) for k in ("a", "b"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "of_a", "of_b")
    return checkpointed(both.mapInArrow(_similar, "a long, b long, linked boolean")).coalesce(tasks)


def _near(ids: np.ndarray, size: np.ndarray, comp: np.ndarray, bits: list[bytes], asks: np.ndarray | None) -> tuple[list[tuple[int, int]], bool]:
    """Pairs of some sets of a list, in different components, that may be similar, and whether these are all.

    asks: of which sets all such pairs with the others are wanted. None: all if they are few, else of each set outside the largest
    component that with the nearest, and that with the set which has the most such pairs.
    """
    cells = min(map(len, bits)) // 8
    rows = []
    for x in bits:
        x = np.frombuffer(x, U)
        while len(x) > cells:  # cells of a bitmap twice as long come together
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        rows.append(x)
    grid, every = np.stack(rows), asks is not None
    if not every:
        kinds, which, count = np.unique(comp, return_inverse=True, return_counts=True)
        asks = which != np.argmax(count) if len(kinds) < len(comp) else np.ones(len(ids), bool)
    outside, others = np.flatnonzero(asks), np.flatnonzero(~asks) if every else np.arange(len(ids))
    block = max(1, (1 << 20) // max(1, grid[others].size))
    found = [(np.zeros(0, np.int64),) * 3]
    for a in range(0, len(outside), block):
        o = outside[a : a + block]
        far = np.bitwise_count(grid[o, None, :] ^ grid[None, others, :]).sum(axis=2, dtype=np.int64)
        both = size[o, None] + size[None, others]
        ok = (comp[o, None] != comp[None, others]) & (9 * far <= both) & (9 * np.minimum(size[o, None], size[None, others]) >= 4 * both)
        i, j = np.nonzero(ok)
        found.append((o[i], others[j], far[i, j]))
    i, j, far = (np.concatenate(x) for x in zip(*found, strict=True))
    whole = every or len(i) <= 2 * FEW * len(ids)
    if not whole:
        hub = np.argmax(np.bincount(i, minlength=len(ids)))
        order = np.lexsort((j, far, i))
        i, j = i[order], j[order]
        take = (np.diff(i, prepend=-1) != 0) | (j == hub)
        i, j = i[take], j[take]
    x, y = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
    return list({*zip(x.tolist(), y.tolist(), strict=True)}), whole


@tidy
def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows list_id, row, column, asks, set_id, root, n_shingles, bits, those of a list's block together: its pairs (a, b), and a row
    (list_id, null) for a list of which there may be more. asks: null, or whether a set asks for all its pairs with those that don't.
    """
    seen: set[tuple[int, int | None]] = set()
    for block in _blocks(batches):
        if block.num_rows < 2:
            continue
        ids, roots, size = (block.column(k).to_numpy() for k in (4, 5, 6))
        asks = block.column(3)
        got, whole = _near(ids, size, roots, block.column(7).to_pylist(), None if asks.null_count else asks.to_numpy())
        out = {(a, b) for a, b in got} | ({(block.column(0)[0].as_py(), None)} if asks.null_count and (not whole or block.column(1)[0].as_py() > 1) else set())
        new = sorted(out - seen, key=lambda x: (x[0], x[1] is None, x[1] or 0))
        seen = set(new) if len(seen) > CACHED else seen.union(new)
        if new:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in new], pa.int64()), pa.array([y for _, y in new], pa.int64())], names=["a", "b"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each block, which come one after another; a block may go over several batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if held and keys[a].tolist() != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            last = keys[a].tolist()
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _dealt(members: DataFrame, bits: DataFrame, seed: int, every: bool) -> DataFrame:
    """members (list_id, set_id, root, n: the list's sets; every: out and main too) in blocks of about LIST_BLOCK sets, as _pairs takes them.

    Every: each block of the sets outside of the list's main component meets each block of EVERY_BLOCK sets of the list. Their number is a power of two
    and blocks of one number of lists with one main component come to one task, which hands on each pair once.
    """
    deal = lambda n: F.pmod(F.xxhash64("set_id", F.lit(seed)), n)
    blocks = lambda n: F.ceil(F.col(n) / LIST_BLOCK)
    every_blocks = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("n") / EVERY_BLOCK)))).cast("long")
    rows = members.join(bits, "set_id")
    if every:
        here = rows.withColumns({"column": deal(every_blocks), "row": F.explode(F.sequence(F.lit(0).cast("long"), blocks("out") - 1)), "asks": F.lit(False)})
        rows = rows.where("root <> main").withColumns({"row": deal(blocks("out")), "column": F.explode(F.sequence(F.lit(0).cast("long"), every_blocks - 1)), "asks": F.lit(True)})
        rows = rows.unionByName(here).repartition("main", "row", "column")
    else:
        rows = rows.withColumns({"row": blocks("n"), "column": deal(blocks("n")), "asks": F.lit(None).cast("boolean")}).repartition("list_id", "row", "column")
    return rows.select("list_id", "row", "column", "asks", "set_id", "root", "n_shingles", "bits").sortWithinPartitions("list_id", "row", "column", "asks", "set_id")


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id, the least doc_id that a document reaches over similar ones, itself included.

    Null, empty and blank texts have no shingles and link with nothing. Texts are read whole; repeated rows and equal texts are of one
    component. Rows with a null doc_id take part, but give no name to a component. Shingles and sets are told apart by 64-bit hashes:
    for n different ones the chance that some two are taken for one is about n * n / 2 ** 65; in the comparison of two sets by 48 bits. An empty table gives an empty table.
    """
    bounded_batches(docs.sparkSession)
    described = checkpointed(docs.select("doc_id", text).mapInArrow(_describe, "doc_id long, n_shingles long, set_id long, bits binary"))
    rows = described.where("n_shingles >= 0")
    top = described.where("n_shingles < 0").select("bits").mapInArrow(_elements, "element long").groupBy("element").agg(F.count(F.lit(1)).alias("n"))
    top = top.orderBy(F.desc("n"), "element").limit(ALL_COMMON)
    common = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r.element for r in top.toLocalIterator()], np.int64).view(U)))
    sets = rows.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("first_doc"), F.first("n_shingles").alias("n_shingles"))
    total = rows.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("n")).first().n
    buckets = max(LEAST_BUCKETS, math.ceil(total / BUCKET_SETS))
    emitted = docs.select(text).mapInArrow(_emit(buckets, common), "bucket int, ids binary, counts binary, sigs binary")
    lists = emitted.groupBy("bucket").applyInPandas(_lists, "members binary").withColumn("list_id", F.xxhash64("members"))
    members = checkpointed(lists.dropDuplicates(["list_id"]).select("members", "list_id").mapInArrow(_unpacked, "list_id long, set_id long, n int"))
    tasks = max(1, math.ceil(members.count() / TASK_MEMBERS))
    members = members.coalesce(tasks)
    named_by = checkpointed(sets.join(members.select("set_id").distinct(), "set_id").select("first_doc").where("first_doc IS NOT NULL"))
    shared = docs.sparkSession.sparkContext.broadcast(_filter(named_by))
    wanted = docs.select("doc_id", text).mapInArrow(_sets(shared), "set_id long, elements binary")
    elements = checkpointed(wanted.groupBy("set_id").agg(F.first("elements").alias("elements")))
    bits = rows.where("set_id IS NOT NULL").groupBy("set_id").agg(F.first("bits").alias("bits"), F.first("n_shingles").alias("n_shingles"))
    bits = checkpointed(bits.join(members.select("set_id").distinct(), "set_id", "left_semi")).coalesce(tasks)
    longest = members.groupBy("set_id").agg(F.max_by(F.struct("list_id", "n"), F.struct("n", "list_id")).alias("of")).select("set_id", "of.*")
    # Lists of several blocks are cut anew for a second turn: the blocks' components come together before the many lists of a large group are looked at.
    large = longest.where(F.col("n") > LIST_BLOCK)
    aims = ["longest", "all", "every"] if large.isEmpty() else ["longest", "large", "all", "every"]
    now, checked, roots = longest.withColumn("root", F.col("set_id")), None, None
    for turn, aim in enumerate(aims):
        found = checkpointed(_dealt(now, bits, turn, aim == "every").mapInArrow(_pairs, "a long, b long").distinct())
        pairs = found.where("b IS NOT NULL")
        new = _verify(pairs if checked is None else pairs.join(checked, ["a", "b"], "left_anti"), elements)
        checked = new if checked is None else checked.unionByName(new)
        roots = components(checked.where("linked"))
        if aim == "every":
            break
        after = aims[turn + 1]
        more = found.where("b IS NULL").select(F.col("a").alias("list_id")).distinct()
        left = large if after == "large" else members if after == "all" else members.join(more, "list_id", "left_semi")
        at = checkpointed(left.join(roots, F.col("set_id") == F.col("node"), "left").select("list_id", "set_id", "n", F.coalesce("root", "set_id").alias("root")).coalesce(tasks))
        by = at.groupBy("list_id", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("list_id")
        split = by.agg(F.max_by("root", F.struct("k", "root")).alias("main"), (F.sum("k") - F.max("k")).alias("out")).where("out > 0")
        now = at if after == "large" else checkpointed(at.join(split, "list_id").coalesce(tasks))
        if now.isEmpty():
            break
    named = sets.join(roots, F.col("set_id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "set_id"))
    named = checkpointed(named.select("set_id", "root", "first_doc"))
    least = named.groupBy("root").agg(F.min("first_doc").alias("component"))
    named = named.join(least, "root").select("set_id", "component")
    return rows.join(named, "set_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [np.frombuffer(x, np.int64) for x in batch.column(0).to_pylist()]
        if lists:
            n = np.array([len(x) for x in lists], np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(1).to_numpy(), n)), pa.array(np.concatenate(lists)), pa.array(np.repeat(n, n))], names=["list_id", "set_id", "n"])
