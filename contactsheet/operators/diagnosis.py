"""PRJ-09. Where each image stands, what it waits for, and how long."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactsheet.operators.ranks import ranked

#: The score from which pass3 is promoted to by itself, and the modes in which it runs.
PROMOTED_FROM, VISION_MODES = 6.0, ["auto", "priority"]


def why_blocked(images: DataFrame, jobs: DataFrame, as_of: str, mode: str = "auto") -> DataFrame:
    """image_id, stage, reason and what goes with it, for each image.

    images: image_id, pass1_status, pass1_at, pass2_at, score, pass3_at. jobs: id, image_id, job_type, status, priority, attempts,
    queued_at, completed_at; the newest of an image and pass counts. A pass that has run isn't asked about again, and pass3 comes first.
    reason: complete; queued, running, error or no_job of the pass that is waited for; culled, raw_review; for pass3 without a job
    no_score, below_threshold, gated (pass1 or pass2 have active jobs) or eligible. paused and gated hold for an image that waits in
    pass3's queue or, gated by pass1 alone, in pass2's. position is 1 and the queued pass3 jobs strictly ahead by priority, then time;
    eta_minutes follows from it and the pass3 jobs that ended in the hour before as_of, null if there are none.
    """
    now = F.lit(as_of).cast("timestamp")
    newest = jobs.groupBy("image_id").agg(*(F.max(F.when(F.col("job_type") == p, F.struct("id", "status", "priority", "attempts"))).alias(p) for p in ("pass1", "pass2", "pass3")))
    active = F.col("status").isin("queued", "running")
    ended = F.col("completed_at").cast("timestamp")
    whole = jobs.agg(
        F.count_if((F.col("job_type") == "pass1") & active).alias("pass1_active"),
        F.count_if((F.col("job_type") == "pass2") & active).alias("pass2_active"),
        F.count_if((F.col("job_type") == "pass3") & (F.col("status") == "complete") & (ended >= now - F.expr("INTERVAL 1 HOUR"))).alias("per_hour"),
    )
    queue = ranked(jobs.where("job_type = 'pass3' AND status = 'queued'").select("id", "priority", "queued_at"), "position", [("priority", True), ("queued_at", False)])
    rows = images.join(newest, "image_id", "left").crossJoin(F.broadcast(whole))  # whole is one row
    rows = rows.join(queue.select(F.col("id").alias("queued_id"), "position"), F.col("pass3.id") == F.col("queued_id"), "left")

    one, two, three = F.col("pass1.status"), F.col("pass2.status"), F.col("pass3.status")
    job = lambda status: F.when(status.isin("queued", "running", "error"), status).otherwise("no_job")
    gated = (F.col("pass1_active") > 0) | (F.col("pass2_active") > 0)
    score = F.col("score")
    last = F.when(three.isin("queued", "running", "error"), three).when(score.isNull(), "no_score").when(score < PROMOTED_FROM, "below_threshold").when(gated, "gated").otherwise("eligible")
    culled, review = F.col("pass1_status") == "fail", F.col("pass1_status") == "raw_review"
    done, first, second = F.col("pass3_at").isNotNull(), F.col("pass1_at").isNull(), F.col("pass2_at").isNull()
    reason = F.when(done, "complete").when(first, job(one)).when(culled, "culled").when(review, "raw_review").when(second, job(two)).otherwise(last)
    stage = F.when(done, "complete").when(first, F.when(one == "error", "pass1_failed").otherwise("pass1_pending")).when(culled, "pass1_failed").when(review, "raw_review")
    stage = stage.when(second, "pass2_pending").when(last == "below_threshold", "below_threshold").otherwise("pass3_pending")
    waits = stage.isin("pass1_pending", "pass2_pending", "pass3_pending") & (reason == "queued")
    in_three = waits & (stage == "pass3_pending")
    of_job = lambda name: F.when(stage.isin("pass1_pending", "pass1_failed") & first, F.col(f"pass1.{name}")).when(stage == "pass2_pending", F.col(f"pass2.{name}")).when((stage == "pass3_pending"), F.col(f"pass3.{name}"))
    position = F.when(in_three, F.col("position"))
    return rows.select(
        "image_id",
        stage.alias("stage"),
        reason.alias("reason"),
        F.when(in_three, F.lit(mode not in VISION_MODES)).otherwise(False).alias("paused"),
        F.when(in_three, gated).when(waits & (stage == "pass2_pending"), F.col("pass1_active") > 0).otherwise(False).alias("gated"),
        F.when(reason.isin("queued", "running", "error"), of_job("priority")).alias("priority"),
        F.when(reason == "error", of_job("attempts")).alias("attempts"),
        position.alias("position"),
        F.when(F.col("per_hour") > 0, F.round(position / (F.col("per_hour") / 60.0), 1)).alias("eta_minutes"),
    )
