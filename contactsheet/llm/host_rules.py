"""Quality rules (10): failures by host, rates shrunk by an empirical beta prior, verdicts joined back.

DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactsheet.llm.common import SPACE, checkpointed, fresh, let, small, words

WINDOW = 8
#: A host fails a rule when its shrunk rate is above this; its documents then go.
MAX_RATE = 0.75
#: The prior's weight in documents, at least and at most.
PRIOR_DOCS = (2.0, 1000.0)
#: Verdicts of at most this many hosts are broadcast (under 10 MB); more are joined with the documents salted.
BROADCAST_HOSTS = 100_000
SALTS = 32
RULES = ("short", "repeats", "symbols", "lines", "lengths")


def _repeat_words(w: Column) -> Column:
    """Words in windows that are found twice or more. The windows' texts are compared only where two hashes are equal."""
    starts = F.sequence(F.lit(1), F.size(w) - (WINDOW - 1))

    def exact(_):
        windows = F.array_sort(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(w, i, WINDOW), " ").alias("w"), i.alias("i"))))

        def covered(a):
            same = lambda x, k: F.coalesce(F.get(a, k)["w"] == x["w"], F.lit(False))
            found = F.array_sort(F.transform(F.filter(a, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))
            first = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at"))
            more = lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["at"])).alias("n"), i.alias("at"))
            return F.aggregate(found, first, more, lambda s: s["n"])

        return let(windows, covered)

    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
    repeated = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(F.size(w) < WINDOW, 0).when(~repeated, 0).otherwise(exact(None))


def features(docs: DataFrame) -> DataFrame:
    """docs with a struct column rules_of: the counts and what they fail.

    Null and empty texts have no words and fail "short". Texts of any length are read whole; repeated rows are judged one by one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")

    def counts(w):
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            let(lines, F.size).cast("long").alias("n_lines"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
        )

    def judged(c):
        short, repeats = c["n_words"] < 20, 100 * c["n_repeat_words"] > 30 * c["n_words"]
        return F.struct(
            *(c[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
            (short | repeats).alias("base_failed"),
            short.alias("short"),
            repeats.alias("repeats"),
            (5 * c["n_symbols"] > c["n_words"]).alias("symbols"),
            (10 * c["n_dup_lines"] > 3 * c["n_lines"]).alias("lines"),
            ((c["word_chars"] < 2 * c["n_words"]) | (c["word_chars"] > 15 * c["n_words"])).alias("lengths"),
        )

    return docs.withColumn("rules_of", let(let(words(F.col("text")), counts), judged))


def host_verdicts(judged: DataFrame, host: Column, max_rate: float = MAX_RATE, mixed: bool = False) -> DataFrame:
    """One row a host: host (null: documents without one), docs, its shrunk rate by rule, host_ok.

    mixed: the rate of documents that fail any rule, rate_any, is held against max_rate too.

    The prior of a rule is the beta distribution with the mean and variance of the hosts' rates; where they don't vary, its weight is the most.
    """
    of = {r: F.col(f"rules_of.{r}") for r in RULES}
    if mixed:
        of["any"] = reduce(or_, of.values())
    by_host = judged.groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("docs"), *(F.count_if(c).alias(f"f_{r}") for r, c in of.items()))
    by_host = checkpointed(by_host)  # a row for each host
    moments = by_host.agg(
        *(F.avg(F.col(f"f_{r}") / F.col("docs")).alias(f"m_{r}") for r in of),
        *(F.coalesce(F.var_pop(F.col(f"f_{r}") / F.col("docs")), F.lit(0.0)).alias(f"v_{r}") for r in of),
    )
    out = by_host.crossJoin(F.broadcast(moments))  # moments is one row
    for r in of:
        m, v = F.col(f"m_{r}"), F.col(f"v_{r}")
        weight = F.when(v > 0, F.greatest(F.lit(PRIOR_DOCS[0]), F.least(F.lit(PRIOR_DOCS[1]), m * (1 - m) / v - 1))).otherwise(PRIOR_DOCS[1])
        out = out.withColumn(f"rate_{r}", (F.col(f"f_{r}") + weight * m) / (F.col("docs") + weight))
    ok = F.greatest(*(F.col(f"rate_{r}") for r in of)) <= max_rate
    return out.select("host", "docs", *(f"rate_{r}" for r in of), ok.alias("host_ok"))


def join_verdicts(judged: DataFrame, verdicts: DataFrame, host: Column) -> DataFrame:
    """judged with host_ok of its host. Few verdicts are broadcast; many are copied to each salt of the documents, so that a hot host is split."""
    of, salt, copy = (fresh(x, judged) for x in ("host_of_verdict", "salt_of_row", "salt_of_host"))
    ours = verdicts.select(F.col("host").alias(of), "host_ok")
    if small(ours, BROADCAST_HOSTS):
        return judged.join(F.broadcast(ours), host.eqNullSafe(F.col(of)), "left").drop(of)
    salted = judged.withColumn(salt, F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int"))
    copies = ours.withColumn(copy, F.explode(F.array(*map(F.lit, range(SALTS)))))
    return salted.join(copies, host.eqNullSafe(F.col(of)) & (F.col(salt) == F.col(copy)), "left").drop(of, salt, copy)


def host_rules(docs: DataFrame, host: Column | None = None, max_rate: float = MAX_RATE, mixed: bool = False) -> DataFrame:
    """docs with rules_of and kept: false if a document fails the base rules or its host fails a rule (mixed: or any of them, taken together).

    host: a column of docs, source by default. An empty table gives an empty table. Columns rules_of, kept and host_ok of docs are replaced.
    """
    host = F.col("source") if host is None else host
    docs = docs.drop("rules_of", "kept", "host_ok")
    judged = checkpointed(features(docs))  # else the texts are judged twice
    verdicts = host_verdicts(judged, host, max_rate, mixed)
    out = join_verdicts(judged, verdicts, host)
    return out.withColumn("kept", ~F.col("rules_of.base_failed") & F.coalesce(F.col("host_ok"), F.lit(True))).drop("host_ok")
