"""The reference's joins of rows with their image, client or shoot, each with its own predicate and order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactsheet.operators.jobs import enqueue_plan, retagged


def days(as_of: str, c: str):
    return F.datediff(F.lit(as_of).cast("date"), F.col(c).cast("date"))


def licences(rows: DataFrame, clients: DataFrame, shoots: DataFrame, as_of: str, ahead: int | None) -> DataFrame:
    """JOIN-07. Licences that end within so many days from as_of on, first to end first; with ahead None those that have ended, the last first.

    rows: license_id, client_id, shoot_id, expires_at. A licence without its client is left out, one without a shoot stays. clients:
    client_id, client_name. shoots: shoot_id, shoot_genre.
    """
    past, today = days(as_of, "expires_at"), F.lit(as_of).cast("date")
    keep = past > 0 if ahead is None else F.col("expires_at").between(today, F.date_add(today, ahead))
    out = rows.where(F.col("expires_at").isNotNull() & keep).join(clients, "client_id").join(shoots, "shoot_id", "left")
    out = out.withColumn("days", past if ahead is None else -past)
    return out.orderBy(F.desc("expires_at") if ahead is None else F.asc("expires_at"), "license_id")


def posts_of(posts: DataFrame, images: DataFrame, start: str, end: str) -> DataFrame:
    """JOIN-09. The calendar's posts of some days with their image's path, genre and mood; posts without an image stay. By day, then id.

    images: image_id, file_path, image_genre, mood.
    """
    mine = posts.where(F.col("post_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return mine.join(images, "image_id", "left").orderBy("post_date", "post_id")


def posted_grid(posts: DataFrame, images: DataFrame, top: int = 9) -> DataFrame:
    """JOIN-10. The images of the last posts that are out, newest first; those without a time or an image don't count."""
    return posts.where("status = 'posted' AND posted_at IS NOT NULL").join(images, "image_id").orderBy(F.desc("posted_at"), F.desc("post_id")).limit(top)


def running_job(jobs: DataFrame, images: DataFrame, kinds: list[str]) -> DataFrame:
    """JOIN-12. The job of some kinds that started last among those that run, with its image's path; no row if none runs."""
    return jobs.where(F.col("job_type").isin(kinds) & (F.col("status") == "running")).join(images, "image_id").orderBy(F.desc("started_at"), F.desc("id")).limit(1)


def paths_with_job(jobs: DataFrame, images: DataFrame, paths: DataFrame, job_type: str = "pass1") -> DataFrame:
    """JOIN-12. Of paths (file_path) those whose image has a job of a kind in any state, once each."""
    known = jobs.where(F.col("job_type") == job_type).select("image_id").join(images.select("image_id", "file_path"), "image_id").select("file_path")
    return paths.select("file_path").distinct().join(known, "file_path", "left_semi")


def vip_clients(profiles: DataFrame, clients: DataFrame) -> DataFrame:
    """JOIN-14. Profiles that are worth it with their client, by revenue, nulls last."""
    return profiles.where("vip_worthy").join(clients, "client_id").orderBy(F.desc_nulls_last("total_revenue"), "client_id")


def rebooking(profiles: DataFrame, clients: DataFrame, as_of: str, least: int = 90) -> DataFrame:
    """JOIN-14. Likely clients whose last booking is so many days ago or who have none, the longest absent first, those without last."""
    since = days(as_of, "last_booked")
    likely = profiles.where("likelihood = 'high'").join(clients, "client_id").withColumn("days_since", since)
    return likely.where(F.col("days_since").isNull() | (F.col("days_since") >= least)).orderBy(F.desc_nulls_last("days_since"), "client_id")


def gallery_images(rows: DataFrame, images: DataFrame, gallery: int) -> DataFrame:
    """JOIN-16. The images of one gallery as they were added; an image that is gone leaves its row."""
    return rows.where(F.col("gallery_id") == gallery).join(images, "image_id", "left").orderBy("added_at", "image_id")


def pending_reminders(reminders: DataFrame, clients: DataFrame, as_of: str, hours: int) -> DataFrame:
    """JOIN-17. Pending reminders due until so many hours after as_of, overdue ones too, with the client's name if there is one."""
    until = F.lit(as_of).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(hours))
    return reminders.where((F.col("status") == "pending") & (F.col("due_at").cast("timestamp") <= until)).join(clients, "client_id", "left").orderBy("due_at", "reminder_id")


def merged_by_path(photos: DataFrame, results: DataFrame) -> DataFrame:
    """JOIN-31. A catalogue's photos with what is known of their path; of several results for a path the last counts. results: file_path, n, and values."""
    values = [c for c in results.columns if c not in ("file_path", "n")]
    last = results.groupBy("file_path").agg(F.max_by(F.struct(*values), "n").alias("r")).select("file_path", "r.*", F.lit(True).alias("found"))
    return photos.join(last, "file_path", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def push_status(images: DataFrame, as_of: str, days_back: int = 7) -> DataFrame:
    """AGG-40. One row: the last push, how many in the week before as_of, and how many wait."""
    since = F.date_sub(F.lit(as_of).cast("date"), days_back)
    return images.agg(
        F.max("pushed_at").alias("last_push"), F.count_if(F.col("pushed_at") >= since).alias("pushed_this_week"), F.count_if(F.col("print_worthy") & F.col("pushed_at").isNull()).alias("waiting")
    )


def retag_plan(images: DataFrame, jobs: DataFrame, model: str, least: float = 0.0, print_worthy: bool = False, limit: int = 10_000, priority: int = 3) -> DataFrame:
    """MUT-16. What a retag does with each image: pass3_at is cleared, and its pass3 job inserted, requeued, raised or reused (MUT-01)."""
    chosen = retagged(images, model, least, print_worthy, limit)
    asked = chosen.select(F.col("id").alias("image_id"), F.lit("pass3").alias("job_type"), F.lit(priority).alias("priority"))
    return chosen.select(F.col("id").alias("image_id"), "pass3_at").join(enqueue_plan(asked, jobs), "image_id")


def guarded(rows: DataFrame, changes: DataFrame, key: str, allowed) -> DataFrame:
    """CRUD-02. What becomes of each change: missing where its key isn't there, refused where the row's state doesn't allow it, else applied.

    allowed: a condition on rows' columns; null counts as not allowed. changes: key and values; a writer applies those that are applied.
    """
    there = rows.select(F.col(key).alias("row_key"), F.coalesce(allowed, F.lit(False)).alias("ok"))
    outcome = F.when(F.col("row_key").isNull(), "missing").when(F.col("ok"), "applied").otherwise("refused")
    return changes.join(there, F.col(key) == F.col("row_key"), "left").withColumn("outcome", outcome).drop("row_key", "ok")
