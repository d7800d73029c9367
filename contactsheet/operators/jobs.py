"""The job queue as pure functions of tables: what a batch of requests changes, what is stuck, what moves on.

jobs: id, job_type, image_id, status, priority, attempts, and times. Writers apply the result by key; gates are read from the table
as it was before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactsheet.operators.joins import checked
from contactsheet.operators.ranks import best

#: States of jobs that aren't done, and of images that no pass takes up again.
ACTIVE = ["queued", "running"]
TERMINAL_PASS1 = ["fail", "duplicate", "raw_review", "missing", "sidecar", "corrupt", "video"]


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """WIN-05. The newest job of each image and type."""
    return jobs.groupBy("image_id", "job_type").agg(F.max_by(F.struct("id", "status", "priority", "attempts"), "id").alias("job")).select("image_id", "job_type", "job.*")


def enqueue_plan(requests: DataFrame, jobs: DataFrame, max_attempts: int = 3, force: bool = False) -> DataFrame:
    """MUT-01. requests: image_id, job_type, priority. One row an image and type, repeats with their highest priority.

    action: reuse a complete or running job, or one that failed for good; raise the priority of a queued one; requeue a failed one
    that has attempts left; insert what has none. force inserts in place of a reuse of a complete job.
    """
    asked = requests.groupBy("image_id", "job_type").agg(F.max("priority").alias("asked"))
    both = asked.join(latest_jobs(jobs), ["image_id", "job_type"], "left")
    status, spent = F.col("status"), F.col("attempts") >= max_attempts
    action = F.when(status.isNull(), "insert").when((status == "complete") & F.lit(force), "insert").when(status.isin("complete", "running"), "reuse")
    action = action.when((status == "error") & spent, "reuse").when(status == "error", "requeue").when(F.col("asked") > F.col("priority"), "raise").otherwise("reuse")
    new = F.greatest(F.col("asked"), F.coalesce("priority", F.lit(0)))
    return both.select("image_id", "job_type", F.col("id").alias("job_id"), action.alias("action"), F.when(action == "reuse", F.col("priority")).otherwise(new).alias("new_priority"))


def bump_plan(requests: DataFrame, jobs: DataFrame, priority: int = 20) -> DataFrame:
    """MUT-02. requests: image_id, job_type. A running job is raised too, a failed one starts again, a complete one stays."""
    both = requests.select("image_id", "job_type").distinct().join(latest_jobs(jobs), ["image_id", "job_type"], "left")
    status = F.col("status")
    action = F.when(status.isNull(), "create").when(status == "complete", "noop").when(status == "error", "requeue")
    action = action.when(F.col("priority") >= priority, "noop").otherwise("bump")
    return both.select("image_id", "job_type", F.col("id").alias("job_id"), action.alias("action"))


def next_stage(pass1: Column, pass1_at: Column, pass2_at: Column, pass3_at: Column) -> Column:
    """PRJ-08. The stage that an image waits for; complete, culled or raw_review if it waits for none."""
    out = F.when(pass3_at.isNotNull(), "complete").when(pass1_at.isNull(), "pass1").when(pass1 == "fail", "culled").when(pass1 == "raw_review", "raw_review")
    return out.when(pass2_at.isNull(), "pass2").otherwise("pass3")


def fetch_batch(jobs: DataFrame, images: DataFrame, job_type: str, size: int, least_priority: int | None = None, max_attempts: int = 3) -> DataFrame:
    """SRT-02, JOIN-11. The queued jobs to run next: attempts left, image not terminal, highest priority, then oldest."""
    wanted = jobs.where((F.col("job_type") == job_type) & (F.col("status") == "queued") & (F.col("attempts") < max_attempts))
    wanted = wanted if least_priority is None else wanted.where(F.col("priority") >= least_priority)
    ok = images.where(F.coalesce(F.col("pass1_status"), F.lit("")).isin(TERMINAL_PASS1) == F.lit(False))
    return wanted.join(ok.select(F.col("id").alias("image_id")), "image_id", "left_semi").orderBy(F.desc("priority"), "queued_at", "id").limit(size)


def stuck(jobs: DataFrame, as_of: str, beat: int = 5, start: int = 15) -> DataFrame:
    """MUT-10. Running jobs whose heartbeat is older than beat minutes, or that have none and began over start minutes ago."""
    now = F.lit(as_of).cast("timestamp")
    age = lambda c: (F.unix_timestamp(now) - F.unix_timestamp(F.col(c).cast("timestamp"))) / 60
    late = F.when(F.col("heartbeat_at").isNotNull(), age("heartbeat_at") > beat).otherwise(age("started_at") > start)
    return jobs.where((F.col("status") == "running") & late)


def promotions(images: DataFrame, jobs: DataFrame, limit: int = 500) -> DataFrame:
    """MUT-09. What the waterfall queues next: pass2 once pass1 is drained, pass3 once both are, privacy at any time."""
    open_ = jobs.where(F.col("status").isin(ACTIVE)).agg(*(F.count_if(F.col("job_type") == p).alias(f"open_{p}") for p in ("pass1", "pass2")))
    has = jobs.where(F.col("status").isin(*ACTIVE, "error")).select("image_id", "job_type").distinct()
    inherited = jobs.where("job_type = 'pass1'").groupBy("image_id").agg(F.max("priority").alias("inherited"))
    rows = images.withColumnRenamed("id", "image_id").join(inherited, "image_id", "left").crossJoin(F.broadcast(open_))
    one = (F.col("open_pass1") == 0) & (F.col("pass1_status") == "pass") & F.col("pass2_at").isNull()
    two = (F.col("open_pass1") == 0) & (F.col("open_pass2") == 0) & F.col("pass2_at").isNotNull() & F.col("pass3_at").isNull() & (F.col("score") >= 6.0)
    three = F.col("pass3_at").isNotNull() & F.col("privacy_at").isNull() & F.coalesce((F.col("genre") == "boudoir") | F.col("faces_present"), F.lit(False))
    stage = F.when(one, "pass2").when(two, "pass3").when(three, "privacy")
    priority = F.when(one, F.when(F.col("inherited") > 5, F.col("inherited")).otherwise(5)).when(two, F.when(F.col("score") >= 6.5, 10).otherwise(3)).otherwise(3)
    out = rows.withColumns({"job_type": stage, "priority": priority}).where("job_type IS NOT NULL").join(has, ["image_id", "job_type"], "left_anti")
    order = [F.desc("priority"), F.desc_nulls_last("score"), F.col("image_id")]
    return best(out, ["job_type"], order, limit).select("image_id", "job_type", "priority")


def upsert(old: DataFrame, new: DataFrame, key: str, overwrite: list[str], keep: list[str]) -> DataFrame:
    """MUT-03 to MUT-06, CRUD-02. A merge by key: overwrite takes the new value, keep takes it only where the old is null; new keys are added.

    Several new rows of a key should have been made one before, by the order in which they came.
    """
    n = new.select(key, *(F.col(c).alias(f"new_{c}") for c in overwrite + keep), F.lit(True).alias("is_new"))
    both = old.withColumn("is_old", F.lit(True)).join(n, key, "full_outer")
    value = lambda c: F.when(F.col("is_new"), F.col(f"new_{c}")).otherwise(F.col(c)) if c in overwrite else F.coalesce(F.col(c), F.col(f"new_{c}")) if c in keep else F.col(c)
    return both.select(key, *(value(c).alias(c) for c in old.columns if c != key))


def sequence_steps(bookings: DataFrame, sent: DataFrame, rules: DataFrame, as_of: str) -> DataFrame:
    """MUT-15. The reminders to add: each rule that holds for a booking, once for a booking and sequence, with its steps' times.

    bookings: booking_id, status, shoot_date. rules: sequence, status, from_days, to_days (days until the shoot), offsets (hours, an array),
    anchor (now or shoot).
    """
    now = F.lit(as_of).cast("timestamp")
    b = bookings.withColumn("days_until", F.datediff(F.col("shoot_date"), now))
    hit = b.join(checked(rules.withColumnRenamed("status", "rule_status")), (F.col("status") == F.col("rule_status")) & F.col("days_until").between(F.col("from_days"), F.col("to_days")))
    hit = hit.join(sent.select("booking_id", "sequence").distinct(), ["booking_id", "sequence"], "left_anti")
    steps = hit.select("booking_id", "sequence", "anchor", "shoot_date", F.posexplode("offsets").alias("step_index", "hours"))
    base = F.when(F.col("anchor") == "shoot", F.col("shoot_date").cast("timestamp")).otherwise(now)
    due = F.timestamp_seconds(F.unix_timestamp(base) + F.col("hours") * 3600)
    return steps.select("booking_id", "sequence", "step_index", due.alias("due_at"))


def inherited_priority(images: DataFrame, jobs: DataFrame, job_type: str = "pass1") -> DataFrame:
    """JOIN-13. Images with the highest priority of their jobs of a type, null without one; the jobs are one row an image before the join."""
    top = jobs.where(F.col("job_type") == job_type).groupBy("image_id").agg(F.max("priority").alias("inherited"))
    return images.join(top, images["id"] == top["image_id"], "left").drop("image_id")


def insert_ignore(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """MUT-03. The rows to add: new keys alone, of several for a key the first by the other columns."""
    others = [c for c in new.columns if c != key]
    once = new.groupBy(key).agg(F.min(F.struct(*others)).alias("row")).select(key, "row.*") if others else new.distinct()
    return once.join(old.select(key), key, "left_anti")


def open_jobs(jobs: DataFrame, job_type: str, states: list[str]) -> DataFrame:
    """The images that have a job of a type in one of some states."""
    return jobs.where((F.col("job_type") == job_type) & F.col("status").isin(states) & F.col("image_id").isNotNull()).select(F.col("image_id").alias("id")).distinct()


def raised(jobs: DataFrame, images: DataFrame, priority: int = 10) -> DataFrame:
    """MUT-11, start. Queued jobs of some images (id) with their new priority; other jobs keep theirs."""
    mine = images.select(F.col("id").alias("image_id"), F.lit(True).alias("mine")).distinct()
    hit = (F.col("status") == "queued") & F.col("mine")
    return jobs.join(mine, "image_id", "left").withColumn("priority", F.when(hit, priority).otherwise(F.col("priority"))).drop("mine")


def lowered(jobs: DataFrame, priority: int = 10, to: int = 5) -> DataFrame:
    """MUT-11, cancel. Active jobs of that priority or more go back to normal."""
    return jobs.withColumn("priority", F.when((F.col("priority") >= priority) & F.col("status").isin(ACTIVE), to).otherwise(F.col("priority")))


def promoted_tier(images: DataFrame, jobs: DataFrame, low: float = 5.0, high: float = 6.0, priority: int = 10, limit: int = 5000) -> DataFrame:
    """MUT-14. The pass3 jobs to add for images of a range of scores (from low, below high) that pass2 has done and pass3 hasn't; best first."""
    ready = images.where(F.col("pass2_at").isNotNull() & F.col("pass3_at").isNull() & (F.col("nima") >= low) & (F.col("nima") < high))
    ready = ready.join(open_jobs(jobs, "pass3", ACTIVE), "id", "left_anti").orderBy(F.desc("nima"), "id").limit(limit)
    return ready.select(F.lit("pass3").alias("job_type"), F.col("id").alias("image_id"), F.lit("queued").alias("status"), F.lit(priority).alias("priority"))


def seeded(images: DataFrame, jobs: DataFrame, top: int = 500, least: float = 6.0) -> DataFrame:
    """MUT-18. The pass3 jobs that priority seeding adds, none while pass1 or pass2 have active jobs: the top by score at 10, then other picks at 8."""
    gate = jobs.agg(F.count_if(F.col("job_type").isin("pass1", "pass2") & F.col("status").isin(ACTIVE)).alias("active"))
    ready = images.where(F.col("pass2_at").isNotNull() & F.col("pass3_at").isNull()).join(open_jobs(jobs, "pass3", [*ACTIVE, "complete"]), "id", "left_anti")
    best = ready.where(F.col("nima") >= least).orderBy(F.desc("nima"), "id").limit(top).select("id")
    picks = ready.where("lr_pick = 'pick'").select("id").join(F.broadcast(best), "id", "left_anti")  # best has at most top rows
    rows = best.withColumn("priority", F.lit(10)).unionByName(picks.withColumn("priority", F.lit(8)))
    return rows.crossJoin(F.broadcast(gate)).where("active = 0").select(F.lit("pass3").alias("job_type"), F.col("id").alias("image_id"), F.lit("queued").alias("status"), "priority")


def retagged(images: DataFrame, model: str, least: float = 0.0, print_worthy: bool = False, limit: int = 10_000) -> DataFrame:
    """MUT-16. The images whose pass3 is to be done again: those that a model tagged, best first; a writer clears pass3_at and enqueues them."""
    where = (F.col("pass3_model") == model) & F.col("pass3_at").isNotNull()
    where = where & (F.col("nima") >= least) if least > 0 else where
    where = where & F.col("print_worthy") if print_worthy else where
    return images.where(where).orderBy(F.desc_nulls_last("nima"), "id").limit(limit).select("id", F.lit(None).cast("int").alias("pass3_at"))


def bumped_folder(images: DataFrame, jobs: DataFrame, folder: str, priority: int = 10, override: bool = False, least: float = 6.0) -> DataFrame:
    """AGG-45. The images of a folder by the stage that each waits for and what a bump does with it; a pass3 below the score, if overridden, is its own stage."""
    here = images.where(F.col("file_path").startswith(folder.rstrip("/") + "/"))
    stage = next_stage(F.col("pass1_status"), F.col("pass1_at"), F.col("pass2_at"), F.col("pass3_at"))
    rows = here.select(F.col("id").alias("image_id"), stage.alias("job_type"), F.coalesce("nima", F.lit(0.0)).alias("nima"))
    plan = bump_plan(rows.where(F.col("job_type").startswith("pass")), jobs, priority)
    below = (F.col("job_type") == "pass3") & (F.col("nima") < least) & F.lit(override)
    out = rows.join(plan.select("image_id", "action"), "image_id", "left")
    return out.groupBy(F.when(below, "pass3_below_threshold").otherwise(F.col("job_type")).alias("stage"), F.coalesce("action", F.lit("none")).alias("action")).agg(F.count(F.lit(1)).alias("n"))


def dispatchable(jobs: DataFrame) -> DataFrame:
    """STR-07. What a drain step may start: the first pass with active jobs, and its queued and running ones; later passes wait."""
    order = F.array_position(F.array(*map(F.lit, ["pass0", "pass1", "pass2", "pass3"])), F.col("job_type"))
    open_ = jobs.where(F.col("status").isin(ACTIVE)).groupBy("job_type").agg(F.count_if(F.col("status") == "queued").alias("queued"), F.count_if(F.col("status") == "running").alias("running"))
    first = open_.agg(F.min(order).alias("first"))
    return open_.crossJoin(F.broadcast(first)).select("job_type", "queued", "running", (order == F.col("first")).alias("may_start"))


def workers(idle: Column) -> Column:
    """STR-09. Workers by the seconds that the machine is idle: none, one from two minutes on, three from ten."""
    return F.when(idle >= 600, 3).when(idle >= 120, 1).otherwise(0)


def retried(attempts: Column, most: int = 3) -> Column:
    """STR-08. What a failed job becomes: queued while it has attempts left, else error for good."""
    return F.when(attempts < most, "queued").otherwise("error")
