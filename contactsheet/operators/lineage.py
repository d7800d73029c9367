"""PRJ-15. Edits and what they were made from: the chain to the first original, and how scores changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactsheet.operators.joins import kept

#: The scores that are compared, the two flags last; for all of them more is better.
FIELDS = ["cull_score", "blur_score", "exposure_score", "nima_composite", "nima_aesthetic", "nima_technical", "score_composition", "quality_score", "print_score"]
FLAGS = ["portfolio_worthy", "print_worthy"]


def originals(images: DataFrame, key: str, parent: str, rounds: int = 40) -> DataFrame:
    """key, original, steps: the first of the chain of parents of each image, itself if it has none, and how many steps away it is.

    Each round an image takes over what its ancestor knows, so that a chain of n takes log2(n) rounds of one join. A parent that isn't
    there ends the chain before it. Images of a cycle, and those that lead into one, have no original: after as many rounds as a chain
    could need at most, their original is null.
    """
    links = images.select(F.col(key).alias("k"), F.col(parent).alias("up"))
    there = links.select(F.col("k").alias("there")).distinct()
    links = links.join(there, F.col("up") == F.col("there"), "left").select("k", F.col("there").alias("up"), F.when(F.col("there").isNull(), 0).otherwise(1).cast("long").alias("steps"))
    state = kept(links.dropDuplicates(["k"]))
    for _ in range(rounds):
        if state.where("up IS NOT NULL").isEmpty():
            break
        # Those whose chain goes on look up their ancestor: who is at its end hands on itself, the others where they have come to.
        ahead = state.select(F.col("k").alias("a"), F.col("up").alias("a_up"), F.col("steps").alias("a_steps"), *([F.col("original").alias("a_original")] if "original" in state.columns else [F.lit(None).cast(links.schema["k"].dataType).alias("a_original")]))
        known = F.col("original") if "original" in state.columns else F.lit(None).cast(links.schema["k"].dataType)
        both = state.withColumn("known", known).join(ahead, F.col("up") == F.col("a"), "left")
        ended = F.col("a").isNotNull() & F.col("a_up").isNull()
        state = kept(
            both.select(
                "k",
                F.when(F.col("up").isNull() | ended, None).otherwise(F.col("a_up")).alias("up"),
                (F.col("steps") + F.when(F.col("up").isNull(), 0).otherwise(F.col("a_steps"))).alias("steps"),
                F.when(F.col("up").isNull(), F.col("known")).when(ended, F.coalesce("a_original", "a")).alias("original"),
            )
        )
    found = state if "original" in state.columns else state.withColumn("original", F.lit(None).cast(links.schema["k"].dataType))
    open_ = F.col("up").isNotNull()
    return found.select(F.col("k").alias(key), F.when(~open_, F.coalesce("original", "k")).alias("original"), F.when(~open_, F.col("steps")).alias("steps"))


def lineage_deltas(images: DataFrame, key: str = "id", parent: str = "edited_from_id") -> DataFrame:
    """PRJ-15. One row for each edit and field that both it and what it was made from have: field, before, after, delta, improved.

    images: key, parent, and FIELDS and FLAGS; flags count as 0 and 1. Edits whose parent isn't there have no rows.
    """
    typed = images.select(key, parent, *(F.col(f).cast("double") for f in FIELDS), *(F.col(f).cast("int").cast("double").alias(f) for f in FLAGS))
    long = typed.unpivot([key, parent], [*FIELDS, *FLAGS], "field", "score").where("score IS NOT NULL")
    before = long.select(F.col(key).alias("of"), "field", F.col("score").alias("before"))
    both = long.where(F.col(parent).isNotNull()).join(before.withColumnRenamed("field", "of_field"), (F.col(parent) == F.col("of")) & (F.col("field") == F.col("of_field")))
    delta = F.round(F.col("score") - F.col("before"), 6)
    return both.select(key, parent, "field", "before", F.col("score").alias("after"), delta.alias("delta"), (delta > 0).alias("improved"))
