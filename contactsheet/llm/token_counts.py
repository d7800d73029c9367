"""Token counts (2): a map-side lookup in two tiers.

A text is cut where no piece of the vocabulary can reach across: before a run of spaces and before a line feed. The counts of
such pre-tokens add up to the count of the text. The first tier is a broadcast table of frequent pre-tokens and their token
counts, of a fixed size; the second is each worker's own cache, which encodes what it misses. No pre-token is shuffled for
the lookup; the table comes from a bounded summary of each task, over all texts, and only saves time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FREQUENT = 32_768
#: Pre-tokens that a task counts at once, and those it hands over.
TASK_COUNTS, TASK_FREQUENT = 100_000, 4_096
#: Entries of a worker's cache, and the longest pre-token that it keeps.
CACHED, LONGEST = 300_000, 64
_ODD = re.compile(r"\n[^ \n]*| +[^ \n]*|[^ \n]+")


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text. One of a line feed keeps it; else one leading space is understood, as the library puts it before a text."""
    text = text.replace("▁", " ")  # the library's own sign for a space
    if "  " in text or " \n" in text or text[-1:] == " " or text[:1] in (" ", "\n"):
        return [x[1:] if x[0] == " " else x for x in _ODD.findall(f" {text}")] if text else []
    return text.replace("\n", " \n").split(" ") if text else []


class Lengths(dict):
    """Token counts by pre-token: the frequent ones, then a cache that encodes what it misses and is emptied when full."""

    def __init__(self, model: str, frequent: dict[str, int] | None = None):
        import sentencepiece

        super().__init__(frequent or {})
        self.frequent, self.encode = frequent or {}, sentencepiece.SentencePieceProcessor(model_file=model).encode

    def __missing__(self, token: str) -> int:
        # The library puts a space before the text: a piece of its own before a line feed, and nothing at all for an empty text.
        n = len(self.encode(token)) - 1 if token[:1] == "\n" else len(self.encode(token)) if token else 1
        if len(token) <= LONGEST:
            if len(self) > CACHED + len(self.frequent):
                self.clear()
                self.update(self.frequent)
            self[token] = n
        return n

    def of(self, text: str | None) -> int:
        return sum(map(self.__getitem__, pretokens(text))) if text else 0


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                counts.update(pretokens(text))
            if len(counts) > 2 * TASK_COUNTS:
                counts = Counter(dict(counts.most_common(TASK_COUNTS)))
    top = [(t, n) for t, n in counts.most_common(TASK_FREQUENT) if len(t) <= LONGEST]
    yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["token", "n"])


def frequent_lengths(docs: DataFrame, model: str, text: str = "text", frequent: int = FREQUENT) -> dict[str, int]:
    """Token counts of at most so many frequent pre-tokens of all texts."""
    top = docs.select(text).mapInArrow(_summaries, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    lengths = Lengths(model)
    return {r.token: lengths[r.token] for r in top.orderBy(F.desc("n"), "token").limit(frequent).collect()}


def count_tokens(docs: DataFrame, model: str, text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """docs with n_tokens long, the tokens of each whole text.

    Null and empty texts have 0. Rows stay as they are, repeated ones too; a column n_tokens of docs is replaced.
    model: the file of the tokenizer, at the same place on every executor.
    """
    docs = docs.drop("n_tokens")
    shared = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, model, text, frequent))
    names, at = docs.columns, docs.columns.index(text)
    schema = docs.select("*", F.lit(0).cast("long").alias("n_tokens")).schema

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(model, shared.value)
        for batch in batches:
            n = pa.array([lengths.of(x) for x in batch.column(at).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, n], names=[*names, "n_tokens"])

    return docs.mapInArrow(counted, schema)
