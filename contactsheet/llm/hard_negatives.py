"""Hard negatives (12): a dual-tree search for the largest inner products of integer vectors.

Candidates and anchors have trees over the same halving planes, fitted on a bounded sample; each node has the ball of its own rows, over
all of them. For balls (a, r) of anchors and (c, s) of candidates every inner product lies within r |c| + s |a| + r s of <a, c>, so a
whole group of anchors leaves out what can't reach its bounds. Bounds come from the sample first: the k-th best of some rows is never
better than the k-th best of all. What is left goes to the candidates' leaves, dealt in blocks of bounded size, where anchors and rows
are scored exactly; of each block an anchor takes as many rows as it could need at most, and these meet by anchor.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactsheet.llm.common import shuffle_partitions, stored

#: Rows and bytes of the sample, at most; leaves of the trees, at most; rows of a block of candidates, about.
SAMPLE, SAMPLE_BYTES, LEAVES, BLOCK = 8192, 16 << 20, 4096, 4096
#: Anchors that meet one block in one task, about; of a group that is bounded as a whole; and of its smallest part.
MEET, GROUP, PART = 32_768, 256, 16
#: Components after scaling are at most so large: scores of all vectors fit a long.
LARGEST = 1 << 26
CLEAN = "key long, label long, anchor boolean, q binary"


def _clean(scale: float):
    """Rows with whole numbers for components; those that take no part go."""

    def run(batches):
        for batch in batches:
            key, label, anchor, vectors = batch.columns
            ok = np.ones(batch.num_rows, bool)
            for c in (key, label, vectors):
                ok &= c.is_valid().to_numpy(zero_copy_only=False)
            out = []
            for i in np.flatnonzero(ok).tolist():
                v = vectors[i].values
                x = np.floor(scale * v.to_numpy(zero_copy_only=False).astype(np.float64)) if not v.null_count else np.array([np.nan])
                ok[i] = np.isfinite(x).all()
                if ok[i]:
                    if len(x) and np.abs(x).max() > LARGEST:
                        raise ValueError(f"components times {scale:g} must not exceed {LARGEST}")
                    out.append(x.astype("<i4").tobytes())
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([key.filter(keep), label.filter(keep), anchor.filter(keep), pa.array(out, pa.binary())], names=["key", "label", "anchor", "q"])

    return run


def matrix(q: pa.Array, dim: int) -> np.ndarray:
    """Packed vectors as rows of doubles, shorter ones filled up with zeros."""
    out = np.zeros((len(q), dim))
    for i, b in enumerate(q):
        v = np.frombuffer(b.as_buffer(), "<i4")
        out[i, : len(v)] = v
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products, exactly: as doubles where all sums are below 2**53, else as Python's whole numbers."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    return (a @ b.T).astype(np.int64) if most < 1 << 53 else (a.astype(np.int64).astype(object) @ b.astype(np.int64).astype(object).T).reshape(len(a), len(b))


@dataclass
class Planes:
    """A complete tree of halving planes: inner node i has children 2 i + 1 and 2 i + 2; leaves are numbered from left to right."""

    depth: int
    normal: np.ndarray
    bound: np.ndarray
    centers: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, depth: int, dim: int) -> Planes:
        """Each plane halves the sample's rows of its node along the line through two far ones; centers are the means of the leaves' rows."""
        normal, bound, parts = np.zeros(((1 << depth) - 1, dim)), np.zeros((1 << depth) - 1), [x]
        for i in range(len(bound)):
            rows = parts[i]
            if len(rows) > 1:
                far = rows[((rows - rows.mean(0)) ** 2).sum(1).argmax()]
                normal[i] = far - rows[((rows - far) ** 2).sum(1).argmax()]
                bound[i] = np.median(rows @ normal[i])
            right = rows @ normal[i] > bound[i]
            parts += [rows[~right] if len(rows) else rows, rows[right] if right.any() else rows[:0]]
        leaves = parts[-(1 << depth) :]
        return cls(depth, normal, bound, np.array([p.mean(0) if len(p) else np.zeros(dim) for p in leaves]))

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + ((x * self.normal[node]).sum(1) > self.bound[node])
        return node - len(self.bound)


class Balls:
    """The candidates' nodes: leaves' centers, and how far their rows are from them; inner nodes hold their children. A node without rows has radius -1."""

    def __init__(self, planes: Planes, radius: np.ndarray):
        inner, dim = len(planes.bound), planes.centers.shape[1]
        self.inner, self.center = inner, np.concatenate([np.zeros((inner, dim)), planes.centers])
        self.radius = np.concatenate([np.full(inner, -1.0), radius])
        for i in range(inner - 1, -1, -1):
            full = [k for k in (2 * i + 1, 2 * i + 2) if self.radius[k] >= 0]
            if full:
                self.center[i] = self.center[full].mean(0)
                self.radius[i] = max(np.linalg.norm(self.center[k] - self.center[i]) + self.radius[k] for k in full)
        self.norm = np.linalg.norm(self.center, axis=1)

    def interval(self, nodes: np.ndarray, a: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest inner product that rows of the nodes may have with those of a ball, with room for rounding."""
        s, at = self.radius[nodes], self.center[nodes] @ a
        reach = (r * self.norm[nodes] + s * np.linalg.norm(a) + r * s) * (1 + 1e-9) + 1 + 1e-9 * np.abs(at)
        return at - reach, at + reach

    def meet(self, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For parts of a group of anchors x the leaves that may hold products from low to high of some of them: (anchors' places, leaves).

        Both trees go down together: a part that is large is halved, and its nodes are replaced by their children.
        """
        out, open_ = [], [(np.arange(len(x)), np.array([0]))]
        while open_:
            own, nodes = open_.pop()
            nodes = nodes[self.radius[nodes] >= 0]
            a = x[own].mean(0)
            least, most = self.interval(nodes, a, np.sqrt(((x[own] - a) ** 2).sum(1).max()))
            nodes = nodes[(most >= low[own].min()) & (least <= high[own].max())]
            if not len(nodes):
                continue
            below = nodes[nodes < self.inner]
            if len(own) <= PART and not len(below):
                out.append((own, nodes - self.inner))
                continue
            nodes = np.concatenate([2 * below + 1, 2 * below + 2]) if len(below) else nodes
            if len(own) > PART:
                along = x[own] @ (x[own][((x[own] - a) ** 2).sum(1).argmax()] - a)
                order = own[np.argsort(along, kind="stable")]
                open_ += [(order[: len(own) // 2], nodes), (order[len(own) // 2 :], nodes)]
            else:
                open_.append((own, nodes))
        return out


def best(scores: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """The places of the k greatest scores, ties by smaller key."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((keys[at], -scores[at]))[:k]]


def _met(trees, dim: int, windows: bool, k: int):
    """Adds to each anchor of a group the leaves to look at, and the bound that the sample gives it."""

    def run(group: pa.Table) -> pa.Table:
        balls, sample, labels = trees.value
        x, own = matrix(group["q"].combine_chunks(), dim), group["label"].to_numpy()
        ranges = [list(zip(r["low"], r["high"], strict=True)) for r in group.select(["low", "high"]).to_pylist()] if windows else [[(-math.inf, math.inf)]] * len(x)
        floors = []
        for i in range(0, len(x), PART):
            for j, s in enumerate(products(x[i : i + PART], sample), i):
                mine = s[(labels != own[j]) if windows else (labels == own[j])]
                inside = [mine[(mine >= a) & (mine <= b)] for a, b in ranges[j]]
                floors.append([int(np.partition(m, len(m) - k)[len(m) - k]) if len(m) >= k else (a if windows else None) for m, (a, _) in zip(inside, ranges[j], strict=True)])
        low = np.array([min((-math.inf if f is None else f) for f in fs) for fs in floors], float)
        high = np.array([max(b for _, b in r) for r in ranges], float)
        leaves: list[list[int]] = [[] for _ in range(len(x))]
        for places, found in balls.meet(x, low, high):
            for p in places.tolist():
                leaves[p] = found.tolist()
        return group.append_column("floor", pa.array(floors, pa.list_(pa.int64()))).append_column("leaves", pa.array(leaves, pa.list_(pa.int32())))

    return run


def _scored(dim: int, k: int, windows: bool):
    """Of one block of candidates the best for each anchor that came, within each of its ranges."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and anchors.num_rows:
            c, keys, labels = matrix(rows["q"].combine_chunks(), dim), rows["key"].to_numpy(), rows["label"].to_numpy()
            for i in range(0, anchors.num_rows, PART):
                some = anchors.slice(i, PART).combine_chunks()
                for r, s in zip(some.drop(["q"]).to_pylist(), products(matrix(some["q"].combine_chunks(), dim), c), strict=True):
                    mine = np.flatnonzero((labels != r["label"]) if windows else (labels == r["label"]))
                    s, ids = s[mine], keys[mine]
                    for w in range(len(r["low"]) if windows else 1):
                        floor = r["floor"][w]
                        inside = np.flatnonzero((s >= floor) & (s <= r["high"][w])) if windows else np.arange(len(s)) if floor is None else np.flatnonzero(s >= floor)
                        top = inside[best(s[inside], ids[inside], k)]
                        out += [(r["uid"], w, int(s[t]), int(ids[t])) for t in top.tolist()]
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.table({n: pa.array(v, t) for n, v, t in zip(("uid", "w", "score", "other"), columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)})

    return run


class Search:
    """The trees over a table of clean rows (CLEAN, and row long), and searches in it for some anchors."""

    def __init__(self, rows: DataFrame, dim: int, total: int, block: int = BLOCK, leaves: int = LEAVES):
        self.rows, self.dim, self.spark = rows, dim, rows.sparkSession
        most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * max(1, dim))))
        sample = rows.orderBy(F.xxhash64("key", "row"), "row").limit(most).select("q", "label").toArrow()
        x = matrix(sample["q"].combine_chunks(), dim)
        wanted = max(total / block, min(2 * shuffle_partitions(self.spark), total / 16))
        planes = Planes.fit(x, min(int(math.log2(leaves)), max(0, math.ceil(math.log2(max(1, wanted))))), dim)
        shared = self.spark.sparkContext.broadcast(planes)

        def placed(batches):
            for batch in batches:
                v = matrix(batch.column(3), dim)
                leaf = shared.value.leaf(v)
                away = np.sqrt(((v - shared.value.centers[leaf]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32()), pa.array(away)], names=[*batch.schema.names, "leaf", "away"])

        self.placed = rows.mapInArrow(placed, f"{CLEAN}, row long, leaf int, away double")
        radius, self.parts = np.full(1 << planes.depth, -1.0), [1] * (1 << planes.depth)
        for r in self.placed.groupBy("leaf").agg(F.max("away").alias("away"), F.count(F.lit(1)).alias("n")).collect():  # a row for each leaf
            radius[r.leaf], self.parts[r.leaf] = r.away * (1 + 1e-9) + 1e-6, math.ceil(r.n / (2 * block)) if r.n > 2 * block else 1
        self.trees = self.spark.sparkContext.broadcast((Balls(planes, radius), x, sample["label"].to_numpy()))
        self.planes = shared

    def best(self, anchors: DataFrame, k: int, windows: bool) -> DataFrame:
        """uid, w, score, other: for each anchor and range at most k rows of each block, the k best of all among them.

        anchors: uid, label, q and, for windows, low and high, arrays of the ends of ranges of scores. Without windows the rows of the
        anchor's label are asked for, itself included, else the rows of other labels.
        """
        n = anchors.count()
        chunks, groups = max(1, math.ceil(n / MEET)), max(1, math.ceil(n / GROUP))
        dim, planes = self.dim, self.planes

        def near(batches):
            for batch in batches:
                v = matrix(batch.column(batch.schema.names.index("q")), dim)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(planes.value.leaf(v), pa.int32())], names=[*batch.schema.names, "leaf"])

        grouped = anchors.mapInArrow(near, anchors.withColumn("leaf", F.lit(0)).schema).withColumn("part", F.pmod(F.xxhash64("uid"), F.lit(groups)) if n > GROUP * len(self.parts) else F.lit(0))
        schema = grouped.withColumns({"floor": F.array().cast("array<bigint>"), "leaves": F.array().cast("array<int>")}).schema
        met = grouped.groupBy("leaf", "part").applyInArrow(_met(self.trees, dim, windows, k), schema)
        parts = F.array(*map(F.lit, self.parts))
        columns = ["uid", "label", "q", "floor", *(["low", "high"] if windows else [])]
        met = met.select(*columns, F.explode("leaves").alias("leaf"))
        met = met.select(*columns, "leaf", F.explode(F.sequence(F.lit(0), F.get(parts, F.col("leaf")) - 1)).alias("part"), F.pmod(F.xxhash64("uid"), F.lit(chunks)).cast("int").alias("chunk"))
        rows = self.placed.select("key", "label", "q", "leaf", F.pmod(F.xxhash64("row"), F.get(parts, F.col("leaf"))).cast("int").alias("part"))
        rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
        by = ["leaf", "part", "chunk"]
        found = rows.groupBy(*by).cogroup(met.groupBy(*by)).applyInArrow(_scored(dim, k, windows), "uid long, w int, score long, other long")
        order = Window.partitionBy("uid", "w").orderBy(F.desc("score"), "other")
        return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def mine(rows: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: float = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its positives the best rows of other labels
    whose score is from low to high percent of the positive's.

    Components become floor(scale * x); scores are exact inner products. Positives are the anchor's best other rows of its label, ties by
    smaller key; fewer, if there aren't so many. Rows with a null key, label, vector or component, or one that isn't finite, take no
    part. Of vectors of several lengths the shorter ones count as filled up with zeros; an empty one is all zeros. Rows that repeat a key
    are rows of their own. A positive whose score is below 0 has no such range. Where nothing fits, and for an empty table, there are no
    rows. Components beyond 2**26 after scaling are an error, as scores might not fit a long. Other columns are left out.
    """
    asked = rows.select(F.col(key).cast("long").alias("key"), F.col(label).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector).alias("q"))
    clean = stored(asked.mapInArrow(_clean(scale), CLEAN).withColumn("row", F.monotonically_increasing_id()))
    size = clean.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.octet_length("q")), F.lit(0)).alias("bytes")).first()
    search = Search(clean, size.bytes // 4, size.n, block)
    anchors = clean.where("anchor").select(F.col("row").alias("uid"), "key", "label", "q")
    # One more than asked for, as the anchor itself may be among them; it goes from its place.
    near = search.best(anchors.drop("key"), positives + 1, False)
    dim = size.bytes // 4

    def own(batches):
        for batch in batches:
            v = matrix(batch.column(2), dim)
            s = [int(products(v[i : i + 1], v[i : i + 1])[0, 0]) for i in range(len(v))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.int64())], names=["uid", "anchor_id", "own"])

    ids = anchors.select("uid", "key", "q").mapInArrow(own, "uid long, anchor_id long, own long")
    near = near.join(ids, "uid").withColumn("itself", (F.col("other") == F.col("anchor_id")) & (F.col("score") == F.col("own")))
    at = F.min(F.when(F.col("itself"), F.col("place"))).over(Window.partitionBy("uid"))
    near = near.withColumn("at", F.coalesce(at, F.lit(positives + 1))).where("place <> at")
    found = stored(near.select("uid", "anchor_id", F.col("other").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("place") - (F.col("place") > F.col("at")).cast("int") - 1).alias("w")))
    # Whole numbers from low to high percent: the first rounded up, the last down; 128 bits wide.
    percent = lambda p: F.col("positive_score").cast("decimal(19,0)") * F.lit(p)
    ends = found.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("w", F.ceil(percent(low) / 100).cast("long").alias("a"), F.floor(percent(high) / 100).cast("long").alias("b")))).alias("e"))
    ranged = ends.join(anchors.drop("key"), "uid").select("uid", "label", "q", F.col("e.a").alias("low"), F.col("e.b").alias("high"))
    far = search.best(ranged, negatives, True)
    return far.join(found, ["uid", "w"]).select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
