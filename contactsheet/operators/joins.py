"""Joins of the reference: filters inside ON, self joins, anti and semi joins, intervals, spines, ranked matches."""

from __future__ import annotations

from calendar import monthrange
from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a block and pairs of words that are looked at in one step, so that these stay in a processor's cache; tasks of a scan at most.
BLOCK, SCANNED, TASKS = 16_384, 1 << 18, 1000


def left_filtered_on(left: DataFrame, right: DataFrame, on: Column, keep: Column) -> DataFrame:
    """JOIN-03. A left join with a condition on the right side inside ON: left rows without a match stay."""
    return left.join(right.where(keep), on, "left")


def referrers(clients: DataFrame, key: str, referred_by: str, bookings: DataFrame, client: str, paid: Column, amount: str) -> DataFrame:
    """JOIN-04, AGG-23. Clients who referred others: distinct clients, the rows that a plain count would give, and their paid revenue."""
    ref = clients.select(F.col(key).alias("referrer"))
    of = clients.select(F.col(key).alias("referred"), F.col(referred_by).alias("referrer"))
    pay = bookings.where(paid).select(F.col(client).alias("referred"), F.col(amount).alias("amount"))
    out = of.join(ref, "referrer").join(pay, "referred", "left")
    return out.groupBy("referrer").agg(F.count_distinct("referred").alias("referrals"), F.count("referred").alias("referral_rows"), F.round(F.coalesce(F.sum("amount"), F.lit(0.0)), 2).alias("revenue"))


def vendor_attribution(vendors: DataFrame, key: str, name: str, bookings: DataFrame, source: Column, detail: str, amount: str) -> DataFrame:
    """JOIN-05, AGG-24. Bookings that name a vendor, by vendor; vendors without any stay with zeros."""
    mine = bookings.where(source).groupBy(F.col(detail).alias(key)).agg(F.count(F.lit(1)).alias("bookings"), F.sum(amount).alias("revenue"))
    out = vendors.select(key, name).join(mine, key, "left")
    return out.select(key, name, F.coalesce("bookings", F.lit(0)).cast("long").alias("bookings"), F.round(F.coalesce("revenue", F.lit(0.0)), 2).alias("revenue"))


def not_queued(images: DataFrame, key: str, jobs: DataFrame, job_key: str) -> DataFrame:
    """JOIN-18, JOIN-19, JOIN-22. Rows without a job; jobs without a key exclude nothing."""
    return images.join(jobs.select(F.col(job_key).alias(key)), key, "left_anti")


def outside_top(images: DataFrame, key: str, score: str, top: int) -> DataFrame:
    """JOIN-20. Rows that aren't among the top by score; the bounded list of those is what is broadcast."""
    best = images.orderBy(F.desc_nulls_last(score), key).limit(top).select(key)
    return images.join(F.broadcast(best), key, "left_anti")


def having_any(images: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """JOIN-21, FLT-14. Rows whose key the other side has, once each."""
    return images.join(other.select(F.col(other_key).alias(key)), key, "left_semi")


def due_within(posts: DataFrame, scheduled: str, as_of: str, minutes: int = 15, whole_seconds: bool = False) -> DataFrame:
    """JOIN-27. Posts scheduled within so many minutes before or after as_of, a time in whole seconds, both ends included; whole_seconds:
    by the second in which they are scheduled."""
    apart = F.timestamp_diff("MICROSECOND", F.lit(as_of).cast("timestamp_ntz"), F.col(scheduled))
    if whole_seconds:
        apart -= F.pmod(apart, F.lit(1_000_000))
    return posts.where(F.abs(apart) <= minutes * 60_000_000)


def calendar_spine(posts: DataFrame, day: Column, start: str, end: str) -> DataFrame:
    """JOIN-30. Every day of a range with its number of posts; empty days stay."""
    spark = posts.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))
    counts = posts.where((day >= F.lit(start).cast("date")) & (day <= F.lit(end).cast("date"))).groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("posts"))
    return days.join(counts, "day", "left").select("day", F.coalesce("posts", F.lit(0)).cast("long").alias("posts"))


def windows_in_horizon(seasons: DataFrame, as_of: str, horizon_days: int) -> DataFrame:
    """JOIN-28, SET-04. Yearly windows (label, start_md, end_md as MM-dd) that overlap the horizon, this year's and next year's, once each.

    A window that ends before it starts runs into the next year. A day that a year lacks (02-29) leaves that year's window out.
    """
    today = F.lit(as_of).cast("date")
    spread = seasons.withColumn("year", F.explode(F.array(F.year(today), F.year(today) + 1)))
    at = lambda md, year: F.try_to_date(F.concat_ws("-", year.cast("string"), md), "yyyy-MM-dd")
    turns = F.when(F.col("end_md") < F.col("start_md"), 1).otherwise(0)
    dated = spread.withColumns({"start": at(F.col("start_md"), F.col("year")), "end": at(F.col("end_md"), F.col("year") + turns)})
    inside = dated.where((F.col("end") >= today) & (F.col("start") <= F.date_add(today, horizon_days)))
    return inside.select("label", "start", "end", F.greatest(F.datediff("start", today), F.lit(0)).alias("days_away")).dropDuplicates(["label", "start"])


def schedule_positions(photos: DataFrame, order: list, start: str) -> DataFrame:
    """JOIN-29. The n-th photo goes to the n-th day of the month of start; what doesn't fit is overflow. All have their position.

    order should end in a unique key; rows that repeat are photos of their own, each with its position.
    """
    from contactsheet.operators.ranks import numbered

    first = F.trunc(F.lit(start).cast("date"), "month")
    fits = F.col("position") <= days_of_month(start)
    day = F.date_add(first, (F.col("position") - 1).cast("int"))
    return numbered(photos, "position", order).withColumns({"post_date": F.when(fits, day), "disposition": F.when(fits, "planned").otherwise("overflow")})


def days_of_month(start: str) -> int:
    """The days of the month of a date, as YYYY-MM-DD."""
    year, month = map(int, start.split("-")[:2])
    return monthrange(year, month)[1]


def edit_parents(edits: DataFrame, originals: DataFrame) -> DataFrame:
    """JOIN-25. The original of each edit: the same stem, best in the same folder, then in a sibling folder, then anywhere.

    edits: edit_id, folder, stem. originals: original_id, folder, stem, rated_at. Among equals the latest rated, nulls last, then the least id.
    The best original of each stem and folder, of each stem and folder above, and of each stem are one row each before the joins, so that
    a stem which many share makes no pairs.
    """
    up = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    best = F.max_by("original_id", F.struct(F.col("rated_at").isNotNull(), "rated_at", -F.col("original_id")))
    o, out = originals.withColumn("above", up(F.col("folder"))), edits.withColumn("above", up(F.col("folder")))
    for name, keys in (("here", ["stem", "folder"]), ("beside", ["stem", "above"]), ("anywhere", ["stem"])):
        out = out.join(o.groupBy(*keys).agg(best.alias(name)), keys, "left")
    found = out.withColumn("tier", F.when(F.col("here").isNotNull(), 0).when(F.col("beside").isNotNull(), 1).when(F.col("anywhere").isNotNull(), 2))
    return found.where("tier IS NOT NULL").select("edit_id", F.coalesce("here", "beside", "anywhere").alias("original_id"), "tier")


def bits_of(vector: Column) -> Column:
    """64 signs of a vector as an array of two longs of 32 bits; the reference's perceptual hashes have 64 bits."""
    half = lambda a: F.aggregate(F.slice(vector, a, 32), F.lit(0).cast("long"), lambda n, x: F.shiftleft(n, 1).bitwiseOR(F.when(x > 0, F.lit(1)).otherwise(0).cast("long")))
    return F.array(half(1), half(33))


def probing(most: int) -> tuple[int, int]:
    """Bands and the radius in a band for words of 64 bits that differ in at most so many: of two such words some band differs in at most
    radius bits. The choice is that with the fewest probes and candidates for some ten thousand words."""
    best = None
    for bands in range(1, most + 2):
        width, radius = 64 / bands, most // bands
        probes = bands * sum(comb(ceil(width), i) for i in range(radius + 1))
        cost = probes + 10_000 * probes / 2**width
        if best is None or cost < best[0]:
            best = cost, bands, radius
    return best[1:]


def band_rows(word: str, most: int, probe: bool) -> Column:
    """An array of (band, part) of a word of 64 bits: the value of each band, and, to probe, all within the radius of it."""
    bands, radius = probing(most)
    edges = [round(i * 64 / bands) for i in range(bands + 1)]
    whole = F.shiftleft(F.col(word)[0], 32).bitwiseOR(F.col(word)[1])
    turned = lambda i, part: lambda m: F.struct(F.lit(i).alias("band"), part.bitwiseXOR(m.cast("long")).alias("part"))
    rows = []
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        part = F.shiftrightunsigned(whole, 64 - b).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")) if b - a < 64 else whole
        masks = [sum(1 << k for k in ks) for n in range(radius + 1 if probe else 1) for ks in combinations(range(b - a), n)]
        masks = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
        rows.append(F.transform(F.array(*map(F.lit, masks)), turned(i, part)))
    return F.flatten(F.array(*rows))


def blocks(rows: DataFrame, by: list[str], key: str) -> DataFrame:
    """by, block, blocks and items: the rows of each by in so many blocks of about BLOCK, each an array of structs in order of key."""
    sizes = rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = rows.join(checked(sizes), by).withColumn("block", F.pmod(F.xxhash64(key, "w"), F.col("blocks")).cast("int"))
    first = [key] + [c for c in rows.columns if c not in (*by, key)]
    return dealt.groupBy(*by, "block", "blocks").agg(F.sort_array(F.collect_list(F.struct(*first))).alias("items"))


def grid(left: DataFrame, right: DataFrame, by: list[str], once: bool = False) -> DataFrame:
    """by, i, j, xs and ys: each block of left beside each of right with equal by; once: the blocks are the same ones, each two meet once.

    So many tasks as there are such pairs, and at most TASKS: none holds more than its pairs, one after the other.
    """
    if once:
        one = left.withColumn("j", F.explode(F.sequence("block", F.col("blocks") - 1)))
        two = right.withColumn("i", F.explode(F.sequence(F.lit(0), "block")))
    else:
        of = lambda b: b.select(*by, F.col("blocks").alias("others")).distinct()
        one = left.join(of(right), by).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
        two = right.join(of(left), by).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    one = one.select(*by, F.col("block").alias("i"), "j", F.col("items").alias("xs"))
    two = two.select(*by, "i", F.col("block").alias("j"), F.col("items").alias("ys"))
    tasks = max(1, min(one.count(), TASKS))
    keys = [*by, "i", "j"]
    return one.repartition(tasks, *keys).join(two.repartition(tasks, *keys), keys)


def columns_of(items: pa.Array) -> dict[str, np.ndarray]:
    """An array of structs by field; nulls are -1."""
    return {f.name: pc.fill_null(items.field(f.name), -1).to_numpy(zero_copy_only=False) for f in items.type}


def apart(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Of each few words of x the first place, and the number of bits in which each of them and each of y differ."""
    x, y = x.view(np.uint64), y.view(np.uint64)
    step = max(1, SCANNED // max(len(y), 1))
    for a in range(0, len(x), step):
        yield a, np.bitwise_count(x[a : a + step, None] ^ y[None, :])


def gathered(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """a, b and distance in batches of some size."""
    parts, n = [], 0
    for part in found:
        parts.append(part)
        n += len(part[0])
        if n >= SCANNED:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], ["a", "b", "distance"])
            parts, n = [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], ["a", "b", "distance"])


def scanned_pairs(most: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            for n in range(batch.num_rows):
                (i, j), (x, y) = (batch.column(c)[n].as_py() for c in ("i", "j")), (columns_of(batch.column(c)[n].values) for c in ("xs", "ys"))
                for at, d in apart(x["w"], y["w"]):
                    hits = np.flatnonzero(d <= most)
                    r, c = hits // len(y["w"]), hits % len(y["w"])
                    a, b, far = x["k"][at + r], y["k"][c], d.ravel()[hits].astype(np.int32)
                    own = a < b if i == j else slice(None)
                    yield np.minimum(a[own], b[own]), np.maximum(a[own], b[own]), far[own]

    return lambda batches: gathered(found(batches))


def scanned_nearest(most: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            for n in range(batch.num_rows):
                x, y = (columns_of(batch.column(c)[n].values) for c in ("xs", "ys"))
                has_next = ~batch.column("ys")[n].values.field("next").is_null().to_numpy(zero_copy_only=False)
                for at, d in apart(x["w"], y["w"]):
                    ids = x["k"][at : at + len(d)]
                    lo, hi = np.searchsorted(y["k"], ids), np.searchsorted(y["k"], ids, "right")
                    instead = []  # words whose least id is the row's own have the next one
                    for r in np.flatnonzero(hi > lo):
                        instead += [(r, int(d[r, p]), y["next"][p]) for p in range(lo[r], hi[r]) if has_next[p]]
                        d[r, lo[r] : hi[r]] = 255
                    best = d.argmin(axis=1)
                    far, other = d[np.arange(len(d)), best].astype(np.int32), y["k"][best]
                    for r, f, k in instead:
                        if (f, k) < (far[r], other[r]):
                            far[r], other[r] = f, k
                    ok = far <= most
                    yield ids[ok], other[ok], far[ok]

    return lambda batches: gathered(found(batches))


def word(bits: str) -> Column:
    """Two halves of 32 bits as one long."""
    return F.shiftleft(F.col(bits)[0], 32).bitwiseOR(F.col(bits)[1])


def hamming_pairs(hashes: DataFrame, key: str, bits: str, most: int) -> DataFrame:
    """JOIN-23. Pairs of hashes that differ in at most so many bits, a < b by key, with the distance. Keys are whole numbers.

    Equal hashes are one representative first, so that a word that many images share makes no pairs of its own; its members are in
    hash_classes(). The words are scanned in blocks, all against all: that is quadratic, a nanosecond or two a pair, where bands send
    far more through a shuffle and spare no time.
    """
    reps = hashes.groupBy(bits).agg(F.min(key).cast("long").alias("k")).select(F.lit(0).alias("all"), "k", word(bits).alias("w"))
    words = kept(blocks(kept(reps.dropna()), ["all"], "k"))
    return grid(words, words, ["all"], once=True).select("i", "j", "xs", "ys").mapInArrow(scanned_pairs(most), "a long, b long, distance int")


def hamming_keepers(hashes: DataFrame, key: str, bits: str, most: int = 8) -> DataFrame:
    """JOIN-23. Each image with its keeper: images come by id, and one within so many bits of an earlier keeper is a duplicate of the
    first such keeper; else it is a keeper, its own.

    In rounds: an image is a keeper once all its earlier neighbours are duplicates, and a duplicate once one of them is a keeper. A round
    is a join and an aggregate; there are as many as the longest chain of images that wait for each other.
    """
    classes = kept(hash_classes(hashes, key, bits))
    pairs = kept(hamming_pairs(hashes, key, bits, most).select(F.col("a").alias("early"), F.col("b").alias("late")))
    nodes = classes.select(F.col("rep").alias("id")).distinct()
    state = kept(nodes.withColumn("is_keeper", F.when(F.lit(False), True)))
    while True:
        seen = pairs.join(state.select(F.col("id").alias("early"), F.col("is_keeper").alias("early_keeper")), "early")
        seen = seen.groupBy(F.col("late").alias("id")).agg(F.max("early_keeper").alias("any_keeper"), F.count_if(F.col("early_keeper").isNull()).alias("open"))
        new = state.join(seen, "id", "left")
        decided = F.when(F.col("is_keeper").isNotNull(), F.col("is_keeper")).when(F.col("any_keeper"), False).when(F.coalesce("open", F.lit(0)) == 0, True)
        state = kept(new.select("id", decided.alias("is_keeper")))
        if state.where("is_keeper IS NULL").isEmpty():
            break
    keepers = state.where("is_keeper").select(F.col("id").alias("early"))
    first = pairs.join(keepers, "early").groupBy(F.col("late").alias("rep")).agg(F.min("early").alias("keeper"))
    own = state.where("is_keeper").select(F.col("id").alias("rep"), F.col("id").alias("keeper"))
    return classes.join(own.unionByName(first.join(own.select("rep"), "rep", "left_anti")), "rep").select(key, "keeper")


def burst_sizes(keepers: DataFrame, key: str) -> DataFrame:
    """STR-10. The bursts of hamming_keepers(): keepers that others are duplicates of, with the first and last id and the number of frames."""
    out = keepers.groupBy(F.col("keeper").alias("burst")).agg(F.min(key).alias("first_id"), F.max(key).alias("last_id"), F.count(F.lit(1)).alias("frames"))
    return out.where("frames > 1")


def hash_classes(hashes: DataFrame, key: str, bits: str) -> DataFrame:
    """Each image with the representative of its hash, the least id that has it."""
    reps = hashes.groupBy(bits).agg(F.min(key).alias("rep"))
    return hashes.join(reps, bits).select(key, "rep")


def nearest_in_section(left: DataFrame, right: DataFrame, section: str, most: int) -> DataFrame:
    """JOIN-24. Of each left row the nearest right row of the section within so many bits: least distance, then least id.

    left: id, bits and the section; right: other, bits and the section; ids are whole numbers. Equal words of a section are one on the
    right side, with their least id and the next, for the row that has the least one itself. Scanned in blocks as in hamming_pairs().
    """
    x = left.select(section, F.col("id").cast("long").alias("k"), word("bits").alias("w")).dropna()
    y = kept(right.select(section, F.col("other").cast("long").alias("k"), word("bits").alias("w")).dropna())
    least = y.groupBy(section, "w").agg(F.min("k").alias("least"))
    after = y.join(least, [section, "w"]).groupBy(section, "w").agg(F.min("k").alias("k"), F.min(F.when(F.col("k") > F.col("least"), F.col("k"))).alias("next"))
    xs, ys = kept(blocks(kept(x), [section], "k")), kept(blocks(kept(after.select(section, "k", "w", "next")), [section], "k"))
    near = grid(xs, ys, [section]).select("i", "j", "xs", "ys").mapInArrow(scanned_nearest(most), "a long, b long, distance int")
    return near.groupBy(F.col("a").alias("id")).agg(F.min(F.struct("distance", F.col("b").alias("other"))).alias("m")).select("id", "m.other", "m.distance")


def checked(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df, to be broadcast if it has so many rows at most, and joined as Spark sees fit else; reads no more than that of it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def kept(df: DataFrame) -> DataFrame:
    """df, computed once, in the session's checkpoint folder; where none is set and Spark runs in this process alone, in its memory."""
    if df.sparkSession.sparkContext.getCheckpointDir() or (folder := df.sparkSession.conf.get("spark.checkpoint.dir", None)):
        if not df.sparkSession.sparkContext.getCheckpointDir():
            df.sparkSession.sparkContext.setCheckpointDir(folder)
        return df.checkpoint()
    if not df.sparkSession.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return df.persist()
