"""Mixing sources to target weights (3): balanced sampling by the cube method.

A source that is to give r times its words has each document taken floor(r) times, and once more with the fractional probability
that is left. The cube method rounds these probabilities: it moves them, three documents at a time, along the null space of the
constraints (the source's words and its documents), until each is 0 or 1 and both totals have stayed as they were. Chunks of a
source move on their own; what each leaves unsettled, a few documents, meets in the next round, until a source is one chunk. The
landing then picks, among all ways to settle its last documents, that with words and documents nearest to the totals.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactsheet.llm.common import SPACE, checkpointed, small

#: Documents of a chunk on average, and those it leaves for the next round or the landing.
CHUNK, LANDING = 20_000, 14
#: Sources of at most so many are broadcast; more are joined.
BROADCAST_SOURCES = 100_000
TINY = 1e-9


def word_count(text: Column) -> Column:
    return F.when(F.btrim(text, F.lit(SPACE)) != "", F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))).otherwise(0).cast("long")


def targets(units: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """source, source_size, docs and target of each source.

    Sources by code point, null last, get the weights in turn. Targets split share times all words by weight; none is over most times
    its source's words, and what is cut there is split among the others in the same way.
    """
    by = units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    by = checkpointed(by)  # a row for each source
    first = F.col("source").asc_nulls_last()
    # Numbers of sources: counted by range of the name and then in each range, not in one window over all of them.
    ranged = checkpointed(by.repartitionByRange(first).sortWithinPartitions(first).withColumn("range", F.spark_partition_id()))
    before, n = {}, 0
    for r in ranged.groupBy("range").count().orderBy("range").collect():
        before[r["range"]], n = n, n + r["count"]
    starts = units.sparkSession.createDataFrame([*before.items()], "range int, start long")
    rank = F.col("start") + F.row_number().over(Window.partitionBy("range").orderBy(first)) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank % len(weights) + 1).cast("int"))
    by = ranged.join(F.broadcast(starts), "range").withColumn("weight", weight).drop("range", "start")
    by = checkpointed(by)
    total = by.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first().n * share
    # The water level: target = min(most * size, level * weight), with the sources fixed that are full at the level so far.
    level = 0.0
    while True:  # each pass fixes a source more, at least
        full = F.col("weight") * level >= most * F.col("source_size")
        r = by.agg(
            F.coalesce(F.sum(F.when(full, most * F.col("source_size"))), F.lit(0.0)).alias("held"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open"),
        ).first()
        if not r.open or (new := (total - r.held) / r.open) <= level * (1 + 1e-12):
            break
        level = new
    return by.select("source", "source_size", "docs", F.least(most * F.col("source_size"), level * F.col("weight")).alias("target"))


def flight(size: np.ndarray, p: np.ndarray, rng: np.random.Generator, leave: int) -> np.ndarray:
    """p with all but a few entries moved to 0 or 1; the sums of p and of size * p stay. The first entries settle first."""
    p = p.astype(float).copy()
    queue = [i for i in range(len(p)) if TINY < p[i] < 1 - TINY]
    draws = iter(rng.random(2 * len(queue) + 8))
    left, at, held = len(queue), 0, []
    while left > max(leave, 2):
        while len(held) < 3 and at < len(queue):
            held.append(queue[at])
            at += 1
        if len(held) < 3:
            break
        a, b, c = held
        u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
        u = u if any(u) else (1.0, -1.0, 0.0)
        up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(held, u, strict=True) if x)
        down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(held, u, strict=True) if x)
        step = up if next(draws) * (up + down) < down else -down
        rest = []
        for i, x in zip(held, u, strict=True):
            p[i] += step * x
            if p[i] < TINY or p[i] > 1 - TINY:
                p[i] = round(p[i])
                left -= 1
            else:
                rest.append(i)
        held = rest
    return p


def landing(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The 0 or 1 of each entry at which the sum of size * p, and then that of p, is nearest to what it was."""
    open_ = np.flatnonzero((p > TINY) & (p < 1 - TINY))
    if not len(open_):
        return np.round(p)
    ways = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    words = np.abs(ways @ size[open_] - float(size[open_] @ p[open_]))
    docs = np.abs(ways.sum(axis=1) - p[open_].sum())
    p = p.copy()
    p[open_] = ways[np.lexsort((docs, np.round(words, 6)))[0]]
    return np.round(p)


def _round(last: bool, seed: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "doc_id"], kind="stable").reset_index(drop=True)
        # What is left for the landing has sizes from small to large, so that its sums lie close to each other.
        by_size = np.argsort(pdf["size"].to_numpy(), kind="stable")
        kept = np.zeros(len(pdf), bool)
        kept[by_size[np.linspace(0, 0.9 * (len(pdf) - 1), LANDING - 2).astype(int)]] = True
        pdf = pdf.iloc[np.argsort(kept, kind="stable")].reset_index(drop=True)
        size, p = pdf["size"].to_numpy(float), pdf["p"].to_numpy(float)
        p = flight(size, p, np.random.default_rng([seed, int(key[1]), len(pdf)]), LANDING)
        return pdf.assign(p=landing(size, p) if last else p)

    return run


def mix(docs: DataFrame, weights: list[int], share: float = 1.5, most: float = 2.0, seed: int = 7, text: str = "text") -> DataFrame:
    """doc_id and source of docs once each, with size (words), source_size, target (the source's) and copies, the times it is taken.

    Rows that share doc_id and source are one document and are taken together. Documents without words have size 0; a null doc_id
    or source is a value like others. Each run gives the same result. An empty table gives an empty table.
    """
    units = docs.select("doc_id", "source", word_count(F.col(text)).alias("size")).groupBy("doc_id", "source").agg(F.sum("size").alias("size"))
    units = checkpointed(units)
    goals = targets(units, weights, share, most)
    goals = checkpointed(goals)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.floor(rate + TINY)
    goals = goals.withColumns({"base": base.cast("int"), "p": F.greatest(F.lit(0.0), rate - base), "chunks": F.ceil(F.col("docs") / CHUNK).cast("int")})
    shown = goals.select(F.col("source").alias("source_of"), "source_size", "target", "base", "p", "chunks")
    shown = F.broadcast(shown) if small(shown, BROADCAST_SOURCES) else shown
    rows = units.join(shown, F.col("source").eqNullSafe(F.col("source_of"))).drop("source_of")
    rows = rows.withColumn("order", F.xxhash64(F.lit(seed), "doc_id", "source"))
    settled = rows.where((F.col("p") <= TINY) | (F.col("size") == 0)).withColumn("p", F.lit(0.0)).drop("chunks", "order")
    moving = rows.where((F.col("p") > TINY) & (F.col("size") > 0))
    out, rounds = settled, 0
    chunks = goals.agg(F.max("chunks").alias("n")).first().n or 1
    while True:
        last = chunks == 1
        schema = moving.schema
        chunk = F.pmod(F.xxhash64(F.lit(rounds), "order"), "chunks")
        moved = moving.groupBy("source", chunk.alias("chunk_of")).applyInPandas(_round(last, seed + rounds), schema)
        if last:
            return out.unionByName(moved.drop("chunks", "order")).select("doc_id", "source", "size", "source_size", "target", (F.col("base") + F.round("p").cast("int")).alias("copies"))
        moved = checkpointed(moved)
        unsettled = (F.col("p") > TINY) & (F.col("p") < 1 - TINY)
        out = out.unionByName(moved.where(~unsettled).drop("chunks", "order"))
        chunks = math.ceil(chunks * (LANDING + 1) / CHUNK)
        moving = moved.where(unsettled).withColumn("chunks", F.ceil(F.col("chunks") * (LANDING + 1) / CHUNK).cast("int"))
        rounds += 1
