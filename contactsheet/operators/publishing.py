"""Candidates for posts, calendars and prints, the month's plan, ratings, and what a publisher counts.

images: id, file_path, genre, mood, nima, quality, grid_fit, and flags; posts: image_id, status and days. Writers apply results by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactsheet.functions.scoring import combined, trust
from contactsheet.functions.text import extension
from contactsheet.operators.filters import blank
from contactsheet.operators.joins import checked, schedule_positions

#: Extensions of raw files, and genres that are never published.
RAW = [".arw", ".cr2", ".cr3", ".dng", ".nef", ".raf", ".orf", ".rw2", ".pef", ".srw", ".rwl", ".srf"]
PRIVATE = ["boudoir"]


def slot_score() -> Column:
    """PRJ-07. The grid fit, or else the combined score."""
    return F.coalesce(F.col("grid_fit"), combined(F.col("nima"), F.col("quality")))


def post_candidates(images: DataFrame, posts: DataFrame, where: Column) -> DataFrame:
    """FLT-02. The images that a condition takes, with is_raw, scheduled (a post that isn't out yet has it) and has_user_context."""
    open_ = posts.where((F.col("status") != "posted") & F.col("image_id").isNotNull()).select(F.col("image_id").alias("id"), F.lit(True).alias("scheduled")).distinct()
    out = images.where(where).join(open_, "id", "left")
    return out.withColumns({"is_raw": extension(F.col("file_path")).isin(RAW), "scheduled": F.coalesce("scheduled", F.lit(False)), "has_user_context": ~blank(F.col("user_context"))})


def candidate_order(mode: str, seed: int = 0) -> list[Column]:
    """SRT-04. Edits before raw files, then by grid_fit, nima, recent, or random: a hash of the id and a seed, the same at every run."""
    fit, nima = F.coalesce("grid_fit", F.lit(0.0)).desc(), F.coalesce("nima", F.lit(0.0)).desc()
    inner = {"nima": [nima, fit], "recent": [F.desc_nulls_last("captured_at"), F.desc("id")], "random": [F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")))]}
    return [F.col("is_raw"), *inner.get(mode, [fit, nima]), F.col("id")]


def calendar_candidates(images: DataFrame, posts: DataFrame, genres: list[str], mode: str) -> DataFrame:
    """FLT-03. Ready images of some genres that aren't posted, with their slot_score: ranked (of the queue), never_scheduled, or unposted."""
    out = images.where(F.col("content_ready") & F.col("posted_at").isNull() & F.col("genre").isin(genres))
    if mode == "ranked":
        out = out.where("social_queue")
    elif mode == "never_scheduled":
        out = out.join(posts.where("image_id IS NOT NULL").select(F.col("image_id").alias("id")), "id", "left_anti")
    return out.withColumn("slot_score", slot_score())


def print_candidates(images: DataFrame, prices: DataFrame, tier: str | None = None, genre: str | None = None, tag: str | None = None, unposted: bool = True) -> DataFrame:
    """FLT-04. Images worth a print with the prices and edition size of their tier. prices: tier, prices, edition_size; a tier that isn't there has those of standard."""
    where = F.col("print_worthy")
    for given, cond in ((tier, F.col("print_tier") == tier), (genre, F.col("genre") == genre), (tag, F.lower("tags").contains((tag or "").lower())), (unposted, blank(F.col("pixieset_url")))):
        where = where & cond if given else where
    of = F.when(F.col("print_tier") == "fine_art", "fine_art").otherwise("standard")
    return images.where(where).withColumn("tier", of).join(checked(prices), "tier", "left")


def listed_errors(log: DataFrame, severity: str | None = None, resolved: bool | None = None) -> DataFrame:
    """FLT-05. Errors of a severity and resolved or not, where these are given; latest first is the caller's order."""
    out = log if severity is None else log.where(F.col("severity") == severity)
    return out if resolved is None else out.where(F.col("resolved") == resolved)


def month_plan(wanted: DataFrame, images: DataFrame, posts: DataFrame, month: str, slot: str = "morning") -> DataFrame:
    """MUT-12, JOIN-29. Position n of an ordered list of paths becomes day n of the month: what a sync would do with each path.

    wanted: position (from 1), file_path. disposition: overflow, unresolved, private, protected (a posted or scheduled post has the day's
    slot) or created; a path that is skipped leaves its day empty. Planned posts of the month are dropped before.
    """
    placed = schedule_positions(wanted.select(F.col("position").alias("nth"), "file_path"), [F.col("nth")], month)
    known = images.select("file_path", F.col("id").alias("image_id"), "genre")
    fixed = posts.where(F.col("status").isin("posted", "scheduled") & (F.col("post_time") == slot)).select("post_date", F.lit(True).alias("taken")).distinct()
    out = placed.join(known, "file_path", "left").join(fixed, "post_date", "left")
    what = F.when(F.col("disposition") == "overflow", "overflow").when(F.col("image_id").isNull(), "unresolved").when(F.lower("genre").isin(PRIVATE), "private")
    return out.select(F.col("nth").alias("position"), "file_path", "post_date", "image_id", what.when(F.col("taken"), "protected").otherwise("created").alias("disposition"))


def synced_ratings(images: DataFrame, items: DataFrame) -> DataFrame:
    """MUT-06. images (file_path, nima, quality, portfolio, pass1_status, rating, pick, star_rating, pick_flag) after a batch of ratings.

    items: n (their order), file_path, rating, pick. The last item of a path counts. rating and pick are overwritten, even by null; their
    mirrors star_rating and pick_flag only by a value; four stars promote, a reject fails. A path that isn't there is added.
    """
    last = items.groupBy("file_path").agg(F.max_by(F.struct("rating", "pick"), "n").alias("new"))
    stars, pick = F.col("new.rating"), F.col("new.pick")
    both = images.join(last, "file_path", "full_outer")
    given = F.col("new").isNotNull()
    portfolio = F.coalesce("portfolio", F.lit(False))
    return both.select(
        "file_path",
        F.when(given, stars).otherwise(F.col("rating")).alias("rating"),
        F.when(given, pick).otherwise(F.col("pick")).alias("pick"),
        F.coalesce(stars, "star_rating").alias("star_rating"),
        F.coalesce(pick, "pick_flag").alias("pick_flag"),
        F.when(given, trust(stars, F.col("nima"), F.col("quality"))).alias("trust_score"),
        (portfolio | F.coalesce(stars >= 4, F.lit(False))).alias("portfolio"),
        F.when(pick == "reject", "fail").otherwise(F.col("pass1_status")).alias("pass1_status"),
        (given & ~portfolio & F.coalesce(stars >= 4, F.lit(False))).alias("promoted"),
    )


def client_totals(clients: DataFrame, key: str, bookings: DataFrame, client: str, amount: str, booked: Column) -> DataFrame:
    """MUT-08, AGG-34. Each client's bookings, revenue, first and last booking, and favourite genre, derived from the bookings.

    bookings has genre. Of genres that are booked as often the first by name is the favourite; bookings without a genre name none.
    """
    b = bookings.select(F.col(client).alias(key), F.col(amount).alias("amount"), booked.alias("booked"), "genre")
    totals = b.groupBy(key).agg(F.count(F.lit(1)).alias("bookings"), F.round(F.coalesce(F.sum("amount"), F.lit(0.0)), 2).alias("revenue"), F.min("booked").alias("first_booked"), F.max("booked").alias("last_booked"))
    genres = b.where("genre IS NOT NULL").groupBy(key, "genre").agg(F.count(F.lit(1)).alias("n"))
    favourite = genres.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("n"), "genre")).alias("f")).select(key, F.col("f.genre").alias("favorite_genre"))
    out = clients.select(key).join(totals, key, "left").join(favourite, key, "left")
    return out.withColumns({"bookings": F.coalesce("bookings", F.lit(0)).cast("long"), "revenue": F.coalesce("revenue", F.lit(0.0))})


def content_gaps(images: DataFrame, posts: DataFrame, genres: list[str], since: str) -> DataFrame:
    """AGG-35. kind and name: genres of a list that nothing was posted of since a day (missing_genre), moods of ready images likewise
    (unexplored_mood), and posted genres with under half the mean number of posts (underrepresented_genre); with the ready images."""
    day = F.lit(since).cast("date")
    ready = images.where("content_ready")
    recent = images.where(F.col("posted_at") >= day)
    posted = recent.select("genre").unionByName(posts.where((F.col("status") == "posted") & (F.col("post_date") >= day)).select("genre")).where("genre IS NOT NULL").distinct()
    listed = images.sparkSession.createDataFrame([(g,) for g in genres], "genre string")
    by_genre = ready.where("genre IS NOT NULL").groupBy("genre").agg(F.count(F.lit(1)).alias("ready"))
    counts = posts.where(F.col("post_date") >= day).where("genre IS NOT NULL").groupBy("genre").agg(F.count(F.lit(1)).alias("posts"))
    mean = counts.agg(F.avg("posts").alias("mean"))
    missing = listed.join(posted, "genre", "left_anti").join(by_genre, "genre", "left").select(F.lit("missing_genre").alias("kind"), F.col("genre").alias("name"), F.coalesce("ready", F.lit(0)).alias("ready"))
    few = listed.join(posted, "genre", "left_semi").join(counts, "genre", "left").crossJoin(F.broadcast(mean)).where(F.coalesce("posts", F.lit(0)) < F.coalesce("mean", F.lit(0.0)) * 0.5)
    few = few.join(by_genre, "genre", "left").select(F.lit("underrepresented_genre"), "genre", F.coalesce("ready", F.lit(0)))
    moods = ready.where("mood IS NOT NULL").groupBy("mood").agg(F.count(F.lit(1)).alias("ready"))
    moods = moods.join(recent.where("mood IS NOT NULL").select("mood").distinct(), "mood", "left_anti").select(F.lit("unexplored_mood"), "mood", "ready")
    return missing.union(few).union(moods)


def gallery_stats(galleries: DataFrame, images: DataFrame) -> DataFrame:
    """AGG-33. By shoot: galleries, views, downloads, last access, and the images of the newest gallery. images: gallery_id."""
    n = images.groupBy("gallery_id").agg(F.count(F.lit(1)).alias("image_count"))
    by = galleries.groupBy("shoot_id").agg(
        F.count(F.lit(1)).alias("gallery_count"), F.sum("views").alias("total_views"), F.sum("downloads").alias("total_downloads"), F.max("last_accessed").alias("last_accessed"), F.max_by("gallery_id", F.struct("created_at", "gallery_id")).alias("gallery_id")
    )
    return by.join(n, "gallery_id", "left").withColumn("image_count", F.coalesce("image_count", F.lit(0))).drop("gallery_id")


def license_totals(licenses: DataFrame, usage: str, amount: str, licensed: Column, as_of: str) -> DataFrame:
    """AGG-42. period, usage_type, licenses, revenue and mean: from the year's start on by usage type (null: unspecified) and all (null), and
    all of all time."""
    start = F.trunc(F.lit(as_of).cast("date"), "year")
    figures = [F.count(F.lit(1)).alias("licenses"), F.round(F.coalesce(F.sum(amount), F.lit(0.0)), 2).alias("revenue"), F.round(F.coalesce(F.avg(amount), F.lit(0.0)), 2).alias("mean")]
    year = licenses.where(licensed >= start).rollup(F.coalesce(F.col(usage), F.lit("unspecified")).alias("usage_type")).agg(*figures)
    ever = licenses.agg(*figures).select(F.lit("all_time").alias("period"), F.lit(None).cast("string").alias("usage_type"), "licenses", "revenue", "mean")
    return year.select(F.lit("year").alias("period"), *year.columns).unionByName(ever)


def retired(items: DataFrame, keys: DataFrame, section: str, index: str, key: str) -> DataFrame:
    """MUT-17. A soft delete: the items of some keys are retired and lose their place; the others of a section close up."""
    out = items.join(keys.select(key, F.lit(True).alias("gone")).distinct(), key, "left").withColumn("state", F.when(F.col("gone"), "retired").otherwise(F.col("state")))
    w = Window.partitionBy(section, "state").orderBy(index, key)
    return out.withColumn(index, F.when(F.col("state") != "retired", F.row_number().over(w) - 1)).drop("gone")
