"""URL filters (4): a cascade of Bloom filters over the corpus's complete key universe.

The first filter holds the listed keys, the second those other keys of the universe that the first takes in wrongly, the third the
listed keys that the second takes in, and so on until none is wrong. A key is listed if it is in an odd number of filters from the
first on. For every key of the universe this is exact, and a lookup is a few bits: URLs are judged where they lie, with no join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactsheet.llm.common import checkpointed, fresh

#: Bits of one filter at most, 8 MB. The keys of longer lists are dealt by their hash to several cascades, of which so many are broadcast at once.
MAX_BITS, PASS_CASCADES = 1 << 26, 8
#: Bits a key for the first filter and for the others.
FIRST_BITS, OTHER_BITS = 10, 4
MAX_LEVELS = 40
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """host and path as in a list; a host stands for its subdomains too. verdict: allow or block."""

    host: str
    path: str
    verdict: str


@dataclass
class Cascade:
    """levels: the bits of each filter, and how many of them a key sets."""

    levels: list[tuple[np.ndarray, int]] = field(default_factory=list)

    @staticmethod
    def bits(h1: np.ndarray, h2: np.ndarray, level: int, size: int, k: int) -> np.ndarray:
        a = (h1.astype(np.uint64) ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        b = (h2.astype(np.uint64) + np.uint64(level)) * np.uint64(0x94D049BB133111EB) | np.uint64(1)
        i = np.arange(k, dtype=np.uint64)[:, None]
        return ((a ^ (a >> np.uint64(31)))[None, :] + i * (b ^ (b >> np.uint64(29)))[None, :]) % np.uint64(size)

    def holds(self, h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
        words, k = self.levels[level]
        at = self.bits(h1, h2, level, len(words) * 8, k)
        return ((words[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)

    def listed(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        depth, alive = np.zeros(len(h1), np.int64), np.arange(len(h1))
        for level in range(len(self.levels)):
            if not len(alive):
                break
            alive = alive[self.holds(h1[alive], h2[alive], level)]
            depth[alive] += 1
        return depth % 2 == 1


def hashed(key: Column) -> list[Column]:
    """Two 64-bit hashes that stand for a key."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")]


def _filter_of(keys: DataFrame, level: int, size: int, k: int) -> np.ndarray:
    """The bits that the keys set; each task hands over one bitmap."""

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(size, np.uint8)
        for b in batches:
            h1, h2 = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            words[Cascade.bits(h1, h2, level, size, k).ravel().astype(np.int64)] = 1
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(words, bitorder="little").tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(size // 8, np.uint8)
    for row in keys.repartition(8).mapInArrow(bitmaps, "bits binary").toLocalIterator():
        out |= np.frombuffer(row.bits, np.uint8)
    return out


def _taken(cascade: Cascade, level: int):
    @F.pandas_udf("boolean")
    def taken(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(cascade.holds(h1.to_numpy(np.int64), h2.to_numpy(np.int64), level))

    return taken


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """A cascade that is exact for every key of the universe and of the list.

    listed, universe: columns h1, h2 of hashed(). Keys with null hashes don't occur; either table may be empty or repeat keys.
    """
    inside = checkpointed(listed.select("h1", "h2").distinct())
    outside = universe.select("h1", "h2").distinct().join(inside, ["h1", "h2"], "left_anti")
    cascade = Cascade()
    wrong, right = inside, outside  # what the next filter must hold, and what it may take in wrongly
    for level in range(MAX_LEVELS):
        n = wrong.count()
        if not n:
            return cascade
        per_key = OTHER_BITS if level else FIRST_BITS
        size = max(64, math.ceil(n * per_key / 8) * 8)
        k = max(1, round(per_key * math.log(2)))
        cascade.levels.append((_filter_of(wrong, level, size, k), k))
        taken = _taken(Cascade([*cascade.levels]), level)
        wrong, right = checkpointed(right.filter(taken("h1", "h2"))), wrong
    raise ValueError("two different keys have equal hashes")


def build_cascades(listed: DataFrame, universe: DataFrame, max_bits: int = MAX_BITS) -> list[Cascade]:
    """Cascades for the keys with h1 of 0, 1, 2 ... modulo their number, which is the least at which no filter has many more than max_bits."""
    pieces = max(1, math.ceil(listed.select("h1", "h2").distinct().count() * FIRST_BITS / max_bits))
    mine = lambda df, i: df.where(F.pmod("h1", F.lit(pieces)) == i) if pieces > 1 else df
    return [build_cascade(mine(listed, i), mine(universe, i)) for i in range(pieces)]


def _kept(cascades: dict[int, object], pieces: int):
    """Of arrays of keys' hashes: which keys are listed, or of a piece that isn't among these cascades (broadcasts, by piece)."""

    @F.pandas_udf("array<boolean>")
    def kept(h1: pd.Series, h2: pd.Series) -> pd.Series:
        ends = np.cumsum([0, *map(len, h1)])
        if not ends[-1]:
            return pd.Series([np.zeros(0, bool)] * len(h1))
        one, two, out = np.concatenate(h1.to_list()).astype(np.int64), np.concatenate(h2.to_list()).astype(np.int64), np.ones(ends[-1], bool)
        piece = one % pieces
        for number, shared in cascades.items():
            at = np.flatnonzero(piece == number)
            out[at] = shared.value.listed(one[at], two[at])
        return pd.Series([out[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)])

    return kept


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, with A to Z lower-cased, and path; both empty if the url is null or has no ://."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    part = lambda i: F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", i)
    return F.translate(part(1), UPPER, LOWER), part(2)


def judge_urls(pages: DataFrame, rules: list[Rule], listed_hosts: DataFrame, url: str = "url", max_bits: int = MAX_BITS) -> DataFrame:
    """pages with host, path, rule (host and path of the longest rule that fits, else null) and verdict.

    Where no rule fits, the verdict is block if the host or a domain above it is in listed_hosts (a column host), else allow. Null
    urls have an empty host and path. Rows stay as they are, repeated ones too; columns of these names in pages are replaced. An empty
    table gives an empty table. Of a host only the ends with as many labels as some listed host are looked up, and of a path only as
    long starts as some rule has: no other key can be listed. A list of more than max_bits of filter is several cascades, and of more
    than PASS_CASCADES of these the keys are looked up in several passes; no join at any length.
    """
    host, path = split_url(F.col(url))
    pages = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    keys_of, kept_of = fresh("keys_of", pages), fresh("kept_of", pages)
    listed_hosts = listed_hosts.select(F.translate("host", UPPER, LOWER).alias("host")).where("host <> ''")
    depths = sorted({r.host.count(".") + 1 for r in rules})
    listed_depths = sorted(r.n for r in listed_hosts.select(F.size(F.split("host", r"\.")).alias("n")).distinct().collect())
    labels = F.size(F.split("host", r"\."))
    end = lambda n: F.substring_index("host", ".", -n)
    blank = F.col("host") == ""
    of_rules = [
        F.when(~blank & (labels >= n) & (F.length("path") >= k), F.struct(F.lit(tag).alias("tag"), F.concat(end(n), F.substring("path", 1, k)).alias("key")))
        for tag in sorted({r.verdict for r in rules})
        for n in depths
        for k in sorted({len(r.path) for r in rules if r.host.count(".") + 1 == n and r.verdict == tag})
    ]
    of_lists = [F.when(~blank & (labels >= n), F.struct(F.lit("listed").alias("tag"), end(n).alias("key"))) for n in listed_depths]
    none = F.lit(None).cast("struct<tag:string,key:string>")
    hits = pages.withColumn(keys_of, F.array_compact(F.array(*of_rules, *of_lists, none)))
    tagged = lambda k: F.concat(k["tag"], F.lit("|"), k["key"])
    spark = pages.sparkSession
    rows = [(r.verdict, r.host.translate(str.maketrans(UPPER, LOWER)) + r.path) for r in rules]
    listed = spark.createDataFrame(rows, "tag string, key string").unionByName(listed_hosts.select(F.lit("listed").alias("tag"), F.col("host").alias("key")))
    listed = listed.select(F.concat("tag", F.lit("|"), "key").alias("key")).distinct()
    universe = hits.select(F.explode(keys_of).alias("k")).select(tagged(F.col("k")).alias("key"))
    cascades = build_cascades(listed.select(*hashed(F.col("key"))), universe.select(*hashed(F.col("key"))), max_bits)
    hashes = [F.transform(keys_of, lambda k: hashed(tagged(k))[0]), F.transform(keys_of, lambda k: hashed(tagged(k))[1])]
    for first in range(0, len(cascades), PASS_CASCADES):
        shared = {i: spark.sparkContext.broadcast(c) for i, c in enumerate(cascades[first : first + PASS_CASCADES], first)}
        hits = hits.withColumn(kept_of, _kept(shared, len(cascades))(*hashes))
        hits = hits.withColumn(keys_of, F.filter(keys_of, lambda k, i: F.get(F.col(kept_of), i))).drop(kept_of)
        hits = checkpointed(hits) if first + PASS_CASCADES < len(cascades) else hits
    fits = F.filter(keys_of, lambda k: k["tag"] != "listed")
    best = F.array_max(F.transform(fits, lambda k: F.struct(F.length(k["key"]).alias("n"), k["key"].alias("key"), k["tag"].alias("tag"))))
    other = F.when(F.exists(keys_of, lambda k: k["tag"] == "listed"), "block").otherwise("allow")
    hits = hits.withColumn(kept_of, best)
    return hits.withColumns({"rule": F.col(f"{kept_of}.key"), "verdict": F.coalesce(f"{kept_of}.tag", other)}).drop(keys_of, kept_of)
