"""Connected components of an edge list: forests of tasks, merged by rounds of shuffles and pointer jumps."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactsheet.llm.common import checkpointed

#: Edges that a task joins at once; with more it hands on several forests.
TASK_EDGES = 4_000_000
#: Edges of a task between rounds, on average: few edges in many tasks are many small files.
ROUND_EDGES = 100_000
#: As many edges, 16 MB, are one forest of one task, which needs no rounds.
ONE_TASK = 1_000_000


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges that isn't the least of its tree, with the least."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root, (x, y) = np.arange(len(nodes)), at.reshape(2, -1)
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        for end in (x, y):
            np.minimum.at(new, root[end], low)
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def out() -> pa.RecordBatch:
        a, b = _forest(*(np.concatenate([x.column(i).to_numpy(zero_copy_only=False) for x in held]) for i in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n > TASK_EDGES:
            yield out()
            held, n = [], 0
    if n:
        yield out()


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of all edges each node with its root."""
    held = [b for b in batches if b.num_rows]
    if held:
        a, b = _forest(*(np.concatenate([x.column(i).to_numpy(zero_copy_only=False) for x in held]) for i in (0, 1)))
        roots = np.unique(b)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, roots])), pa.array(np.concatenate([b, roots]))], names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """edges: columns a, b, any order and repeats. Returns node and root, the least node it reaches, for each node with an edge.

    Nothing is collected. A round brings a node's edges together, where each task makes one forest of all that it has, and then lets
    each node point to what its root points to. It ends when nothing changes: each node has one root, and no root points on. The
    number of tasks follows that of the edges, which no round adds to. Where all edges are few enough for one task, its forest is the
    answer.
    """
    n = edges.count()
    if n <= ONE_TASK:
        whole = edges.where("a <> b").select("a", "b").coalesce(1).mapInArrow(_rooted, "node long, root long")
        return checkpointed(whole)
    tasks = math.ceil(n / ROUND_EDGES)
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).coalesce(tasks)
    state = None
    while True:
        joined = now.repartition("a").mapInArrow(_join, "a long, b long").coalesce(tasks)
        joined = checkpointed(joined)
        up = joined.select(F.col("a").alias("b"), F.col("b").alias("root"))
        now = joined.join(up, "b", "left").select("a", F.coalesce("root", "b").alias("b")).coalesce(tasks).distinct()
        now = checkpointed(now.coalesce(tasks))
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        state = new
