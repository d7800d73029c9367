"""Token files (13): token ids of whole documents in a row, with Elias-Fano lists of where each document begins.

A folder of token files has two tables. blocks: rows of about BLOCK_IDS ids, each with whole documents in order: shard, block, n_docs,
n_ids, width (bytes of an id), doc_ids, bounds (the Elias-Fano list of the n_docs + 1 places where documents begin and end) and ids
(little-endian). index: for each block the number of the documents and of the ids before it. Tables are Spark's, so that a write that
ends is whole, on any store and whatever executors are lost.

Texts are encoded where they are read; only ids are shuffled, to put documents in order by ranges.
"""

from __future__ import annotations

import math
import os
import re
import string
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contactsheet.llm.common import shared_folder, shuffle_partitions, small
from contactsheet.llm.elias_fano import EliasFano, encoded

#: Ids of a block, about; bytes of ids of a shard, about; bytes that leave a task for Spark at once.
BLOCK_IDS, SHARD_BYTES, BATCH_BYTES = 1 << 18, 64 << 20, 8 << 20
#: Chunks of text of each of a worker's two generations of cache, and the longest chunk that it keeps.
CACHED, LONGEST = 400_000, 48
#: Shards whose ids are added up in one task for the index.
INDEX_SHARDS = 64
#: Blocks whose index is broadcast at most, 32 bytes each; more are joined.
BROADCAST_BLOCKS = 500_000
#: Unicode's white space, as the tokenizer's pattern knows it.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Marks that only ever follow letters as a pre-token of their own: ASCII's but for the apostrophe, which also begins short endings.
MARKS = "".join(c for c in string.punctuation if c != "'")
_CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_ODD = tuple("\t\x0b\x0c\r\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") + tuple(map(chr, range(0x2000, 0x200B)))
_PAIRS = ("  ", " \n", "\n ", "\n\n")
_RUNS = tuple(a + b + c for a in " \n" for b in " \n" for c in " \n")


class Encoder:
    """Ids of texts as bytes, by a cache of chunks and the tokenizer for those it lacks.

    The tokenizer's pattern never matches across the place where white space begins after something else, and special strings have no
    white space, so the ids of a text are those of its chunks in a row. Chunks that begin with one space are kept without it. Before a
    special string the pattern's text ends, so that two white spaces there are one pre-token: such texts aren't cut between them.
    """

    def __init__(self, file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        if self.tokenizer.normalizer is not None or type(self.tokenizer.pre_tokenizer).__name__ != "ByteLevel":
            raise ValueError("texts can be cut into chunks for byte-level tokenizers without normalizer alone")
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.model, self.special = self.tokenizer.model, [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.signs = {b: c for b, c in zip(*_byte_signs(), strict=True)}
        self.after_space, self.as_is = _Generations(lambda x: self.chunk(x, " " if x[:1] != "\n" else "")), _Generations(lambda x: self.chunk(x, ""))

    def packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def chunk(self, chunk: str, space: str) -> bytes:
        """The ids of a chunk after a space or none. Letters and marks that follow them are pre-tokens of their own, and so is a first
        line feed, so that a word isn't encoded again for each mark at its end; all else is left to the library as it is."""
        if chunk[:1] == "\n" and chunk[1:].isalpha():
            return self.as_is["\n"] + self.as_is[chunk[1:]]
        word = chunk.rstrip(MARKS)
        if word.isalpha() and word not in self.special:
            if len(word) == len(chunk):
                signs = word if word.isascii() else "".join(self.signs[b] for b in word.encode())
                return self.packed([t.id for t in self.model.tokenize(self.signs[32] + signs if space else signs)])
            return (self.after_space if space else self.as_is)[word] + self.as_is[chunk[len(word) :]]
        return self.packed(self.tokenizer.encode(space + chunk, add_special_tokens=False).ids)

    def of(self, text: str) -> bytes:
        if not text:
            return b""
        plain = text[0] not in " \n" and text[-1] not in " \n" and not (any(r in text for r in _PAIRS) and any(r in text for r in (*_RUNS, *self.special))) and not any(o in text for o in (_ODD[:4] if text.isascii() else _ODD))
        if not plain:
            return b"".join(map(self.as_is.__getitem__, _CHUNK.findall(text)))
        first, *rest = text.replace("\n", " \n").split(" ")
        return self.as_is[first] + b"".join(map(self.after_space.__getitem__, rest))


def _byte_signs() -> tuple[list[int], list[str]]:
    """All bytes and the signs that stand for them in a byte-level vocabulary: printable ones of Latin-1 for themselves, the others from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b != 173]
    others = [b for b in range(256) if b not in own]
    return own + others, [*map(chr, own), *(chr(256 + i) for i in range(len(others)))]


class _Generations(dict):
    """A cache of bounded size: what is asked for goes on, what wasn't since the last change of generations is forgotten."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, chunk: str) -> bytes:
        if (found := self.old.get(chunk)) is None:
            found = self.make(chunk)
        if len(chunk) <= LONGEST:
            if len(self) >= CACHED:
                self.old = dict(self)
                self.clear()
            self[chunk] = found
        return found


@lru_cache(2)
def encoder(file: str) -> Encoder:
    """A worker's encoder; it stays for later tasks."""
    return Encoder(file)


def _encode(file: str, end: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(file)
        last = b"" if end is None else np.array([end], f"<u{enc.width}").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [enc.of(t or "") + last for t in part.column(1).to_pylist()]
                n = pa.array([len(x) // enc.width for x in ids], pa.int64())
                crc = pa.array([zlib.crc32(x) for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), n, crc, pa.array(ids, pa.binary())], names=["key", "n", "crc", "ids"])

    return run


def _blocks(width: int, block_ids: int):
    """Documents in order to blocks; the shard is the task's number, which a task that runs again keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, keys, ids, ends = TaskContext.get().partitionId(), 0, [], [], [0]

        def row(kind: pa.DataType) -> pa.RecordBatch:
            values = [[shard], [block], [len(keys)], [ends[-1]], [width], pa.array([keys], pa.list_(kind)), [encoded(np.array(ends))], [b"".join(ids)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), None, pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([v if k is None else pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=BLOCK_COLUMNS)

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for key, doc in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if keys and ends[-1] + len(doc) // width > block_ids:
                    yield row(kind)
                    block, keys, ids, ends = block + 1, [], [], [0]
                keys.append(key)
                ids.append(doc)
                ends.append(ends[-1] + len(doc) // width)
        if keys:
            yield row(kind)

    return run


BLOCK_COLUMNS = ["shard", "block", "n_docs", "n_ids", "width", "doc_ids", "bounds", "ids"]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, text: str = "text", key: str = "doc_id", end: int | None = 0, block_ids: int = BLOCK_IDS, shard_bytes: int = SHARD_BYTES) -> None:
    """Writes the token files of docs to a folder that has none yet, documents by ascending key.

    Null and empty texts have the end id alone (nothing if end is None). Null keys come last. Rows that share a key are documents of
    their own, by their number of ids, then by a checksum and the ids. A document is never split, whatever its length: its block is as
    long. Of an empty table the files have no rows. Other columns of docs are left out.
    tokenizer: the file of a byte-level tokenizer, at the same place on every executor; end: the id after each document.
    """
    spark = docs.sparkSession
    schema = docs.select(F.col(key).alias("key"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("crc"), F.lit(b"").alias("ids")).schema
    docs.select(key, text).mapInArrow(_encode(tokenizer, end), schema).write.option("compression", "zstd").parquet(f"{folder}/encoded")
    rows = spark.read.parquet(f"{folder}/encoded")
    width = encoder(tokenizer).width
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(shuffle_partitions(spark), math.ceil(total * width / shard_bytes))
    order = [F.col("key").asc_nulls_last(), F.col("n"), F.col("crc")]
    dealt = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order, "ids")
    kind = schema["key"].dataType.simpleString()
    made = f"shard int, block int, n_docs long, n_ids long, width int, doc_ids array<{kind}>, bounds binary, ids binary"
    dealt.select("key", "ids").mapInArrow(_blocks(width, block_ids), made).write.option("compression", "zstd").parquet(f"{folder}/blocks")
    _write_index(spark, folder)


def _write_index(spark: SparkSession, folder: str) -> None:
    """What comes before each block: sums of groups of shards on the driver, one number for INDEX_SHARDS shards, and running sums in each group."""
    blocks = spark.read.parquet(f"{folder}/blocks").select("shard", "block", "n_docs", "n_ids")
    group = (F.col("shard") / INDEX_SHARDS).cast("int").alias("group")
    first, docs, ids = [], 0, 0
    for r in blocks.groupBy(group).agg(F.sum("n_docs").alias("d"), F.sum("n_ids").alias("n")).orderBy("group").collect():
        first.append((r.group, docs, ids))
        docs, ids = docs + r.d, ids + r.n
    before = spark.createDataFrame(first, "group int, d long, n long")
    w = Window.partitionBy("group").orderBy("shard", "block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = lambda c, start: (F.coalesce(F.sum(c).over(w), F.lit(0)) + F.col(start)).alias(f"first_{c[2:]}")
    out = blocks.withColumn("group", group).join(F.broadcast(before), "group")
    out.select("shard", "block", ahead("n_docs", "d"), ahead("n_ids", "n")).write.parquet(f"{folder}/index")


def _read(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, bounds, ids, width, first_doc, first_id = (batch.column(c)[i] for c in range(6))
                at, ids = EliasFano(bounds.as_py()).values(), np.frombuffer(ids.as_buffer(), f"<u{width.as_py()}")
                step = max(1, math.ceil((len(at) - 1) * BATCH_BYTES / max(1, 4 * len(ids))))
                for a in range(0, len(at) - 1, step):
                    b = min(a + step, len(at) - 1)
                    docs = [ids[x:y].astype("<u4").tobytes() for x, y in zip(at[a:b].tolist(), at[a + 1 : b + 1].tolist(), strict=True)]
                    columns = [doc_ids.values.slice(a, b - a), pa.array(np.arange(a, b) + first_doc.as_py()), pa.array(at[a:b] + first_id.as_py()), pa.array(np.diff(at[a : b + 1])), pa.array([zlib.crc32(x) for x in docs], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns + [pa.array(docs, pa.binary())] * with_ids, names=["doc_id", "position", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    return run


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """The documents of token files: doc_id (the key), position (documents before it), start (ids of all documents before it), n_tokens,
    ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and, if asked for, ids, as those bytes."""
    blocks, index = spark.read.parquet(f"{folder}/blocks"), spark.read.parquet(f"{folder}/index")
    index = F.broadcast(index) if small(index, BROADCAST_BLOCKS) else index
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    schema = f"doc_id {kind}, position long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return blocks.join(index, ["shard", "block"]).select("doc_ids", "bounds", "ids", "width", "first_docs", "first_ids").mapInArrow(_read(with_ids), schema)


def ids_at(spark: SparkSession, folder: str, positions: list[int]) -> DataFrame:
    """Some documents by their position: position, doc_id, start and ids (an array). The blocks alone that hold them are read, and of a
    block's list of bounds two numbers are selected for each document."""
    wanted = spark.createDataFrame([(int(p),) for p in positions], "position long")
    index, blocks = spark.read.parquet(f"{folder}/index"), spark.read.parquet(f"{folder}/blocks")
    sizes = blocks.select("shard", "block", "n_docs").join(index, ["shard", "block"])
    inside = (F.col("position") >= F.col("first_docs")) & (F.col("position") < F.col("first_docs") + F.col("n_docs"))
    hit = sizes.join(F.broadcast(wanted), inside).groupBy("shard", "block", "first_docs", "first_ids").agg(F.collect_set("position").alias("wanted"))
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                bounds, ids = EliasFano(r["bounds"]), np.frombuffer(r["ids"], f"<u{r['width']}")
                for p in r["wanted"]:
                    i = p - r["first_docs"]
                    a, b = bounds.select(i), bounds.select(i + 1)
                    columns = [[p], [r["doc_ids"][i]], [r["first_ids"] + a], [ids[a:b].tolist()]]
                    kinds = [pa.int64(), batch.schema.field("doc_ids").type.value_type, pa.int64(), pa.list_(pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names=["position", "doc_id", "start", "ids"])

    rows = blocks.join(F.broadcast(hit), ["shard", "block"]).select("doc_ids", "bounds", "ids", "width", "first_docs", "first_ids", "wanted")
    return rows.mapInArrow(pick, f"position long, doc_id {kind}, start long, ids array<long>")


def token_table(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", end: int | None = 0) -> DataFrame:
    """docs written as token files to a folder of their own in the shared one, and read back without their ids."""
    folder = f"{shared_folder(docs.sparkSession)}/tokens-{uuid4()}"
    write_tokens(docs, folder, tokenizer, text, key, end)
    out = read_tokens(docs.sparkSession, folder, with_ids=False)
    return out.withColumnRenamed("doc_id", key) if key != "doc_id" else out
