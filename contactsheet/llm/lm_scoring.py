"""LM scoring (5): a smoothed n-gram model as a weighted automaton with failure arcs.

States are the root and the known histories of one to order - 1 tokens. A token goes on by its arc from the state if the n-gram is
known, and else by the failure arc to the state without the history's first token, down to the root, which has an arc for every token.
With Dirichlet smoothing of strength MU, and c for counts in the training texts: root arc: (c(w) + 1) / (N + V + 1); arc of history h
to w, with h' for h without its first token: (c(hw) + MU * arc of h' to w) / (c(h) + MU); failure arc of h: MU / (c(h) + MU). A
document starts in the state of the end and is read from left to right. Its stretches are read side by side: each enters by the
tokens before it, of which order - 1 determine the state.

No model is held in one place. Documents are dealt to blocks. A block's counts go, packed as arrays, to buckets of the keys; a bucket
adds up what all blocks have trained and answers each block with the totals of the keys that the block asked for. The block then has
just that part of the automaton which its own documents can reach, and traverses them with it.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactsheet.llm.common import shuffle_partitions, slices, tidy
from contactsheet.llm.packing import cuts, deflated, inflated, tally
from contactsheet.llm.words import LOWER, hashes, mix, spans, utf8

MU = 200.0
#: UTF-8 bytes of the texts of a block, and of those whose keys meet in a bucket.
BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 6 << 20
#: Blocks and buckets of small corpora.
LEAST_BLOCKS, LEAST_BUCKETS = 48, 24
#: Text of a task that is packed at once.
PACK_BYTES = 16 << 20
#: Bits of an n-gram's key: at least, and besides those that number the corpus's bytes; one n-gram in 2 ** SPARE_BITS is taken for another.
LEAST_BITS, SPARE_BITS = 48, 22
#: Tokens that are read one after another; the stretches of a block are read side by side.
STRETCH = 256
U = np.uint64
#: The key of the token that ends each document, and stands before the first word.
END = U(0x5851F42D4C957F2D)


def stream(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the tokens of some texts, each text as an end, its words in lower case and an end; and where each text's begin, and all end."""
    data = LOWER[data]
    begin, end, before = spans(data, bounds)
    starts = before + 2 * np.arange(len(bounds))
    out = np.full(starts[-1], END)
    out[np.arange(len(begin)) + np.repeat(2 * np.arange(len(bounds) - 1) + 1, np.diff(before))] = hashes(data, begin, end)
    return out, starts


def grams(tokens: np.ndarray, starts: np.ndarray, order: int, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """By n: the key of the n-gram that ends at each token, and whether there is one. The end before a text's first word is no gram by itself."""
    place = np.arange(len(tokens)) - np.repeat(starts[:-1], np.diff(starts))
    out, key = [(tokens, place >= 1)], tokens
    for n in range(2, order + 1):
        key = np.concatenate([key[:1], mix(mix(key[:-1]) + tokens[1:])])
        out.append((key >> U(64 - bits), place >= n - 1))
    return out


@tidy
def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns block, doc_id, held_out, text: a row for each block with its documents compressed."""
    for batch in batches:
        for part in slices(batch, 3, PACK_BYTES):
            part = part.take(pa.array(np.argsort(part.column(0).to_numpy(), kind="stable")))
            blocks = part.column(0).to_numpy()
            ends = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            ids, held = part.column(1).to_pylist(), part.column(2).to_pylist()
            rows = []
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                data, bounds = utf8(part.column(3).slice(a, b - a))
                rows.append(zstandard.compress(pickle.dumps((ids[a:b], held[a:b], bounds, data.tobytes())), 3))
            yield pa.RecordBatch.from_arrays([pa.array(blocks[ends[:-1]], pa.int32()), pa.array(rows, pa.binary())], names=["block", "texts"])


def _tokens(pdf: pd.DataFrame) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """doc_id and held_out of a block's documents, their tokens and where each one's begin, in an order that is the same each time."""
    ids, held, streams, lengths = [], [], [], []
    for x in sorted(pdf["texts"]):
        i, h, bounds, data = pickle.loads(zstandard.decompress(x))
        tokens, starts = stream(np.frombuffer(data, np.uint8), bounds)
        ids, held = ids + i, held + h
        streams.append(tokens)
        lengths.append(np.diff(starts))
    return ids, np.array(held, bool), np.concatenate(streams), np.concatenate([[0], np.cumsum(np.concatenate(lengths))])


class Automaton:
    """The part of the model that some documents reach. State 0 is the root; the others are histories, by length and number.

    index: by n, of each token of the documents the number of the n-gram that ends there (-1: none). counts: by n and number, the
    n-gram's count in the training texts. total, distinct: tokens of the training texts.
    """

    def __init__(self, index: list[np.ndarray], counts: list[np.ndarray], total: int, distinct: int, mu: float):
        order, sizes = len(counts), [len(c) for c in counts]
        base = np.cumsum([1, *sizes])
        weight = (counts[0] + 1) / (total + distinct + 1)
        self.words, self.known = sizes[0], counts[0] > 0
        self.root, self.root_next = np.log10(weight), np.where(self.known & (order > 1), base[0] + np.arange(sizes[0]), 0)
        histories = np.concatenate([[0], *counts[:-1]])
        self.fail, self.fail_weight = np.zeros(len(histories), np.int64), np.log10(mu / (histories + mu))
        codes, weights, nexts = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]
        for n in range(2, order + 1):
            gram, shorter = index[n - 1], index[n - 2]
            there, where = np.flatnonzero(gram >= 0), np.zeros(sizes[n - 1], np.int64)
            where[gram[there]] = there  # one place of each
            history, suffix = shorter[where - 1], shorter[where]
            weight = (counts[n - 1] + mu * weight[suffix]) / (counts[n - 2][history] + mu)
            to = base[n - 2] + suffix
            if n < order:
                self.fail[base[n - 1] : base[n]] = to
                to = base[n - 1] + np.arange(sizes[n - 1])
            known = counts[n - 1] > 0
            codes.append(((base[n - 2] + history) * self.words + index[0][where])[known])
            weights.append(np.log10(weight)[known])
            nexts.append(to[known])
        codes = np.concatenate(codes)
        by = np.argsort(codes)
        self.codes, self.weights, self.nexts = codes[by], np.concatenate(weights)[by], np.concatenate(nexts)[by]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From some states by a word each: the log10 weight of the arcs taken, failure arcs included, and the states reached."""
        out, to, todo = np.zeros(len(state)), state.copy(), np.arange(len(state))
        while len(todo):
            root = to[todo] == 0
            at = todo[root]
            out[at] += self.root[word[at]]
            to[at] = self.root_next[word[at]]
            todo = todo[~root]
            if not len(todo):
                break
            code = to[todo] * self.words + word[todo]
            arc = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            hit = self.codes[arc] == code if len(self.codes) else np.zeros(len(todo), bool)
            at, arc = todo[hit], arc[hit]
            out[at] += self.weights[arc]
            to[at] = self.nexts[arc]
            todo = todo[~hit]
            out[todo] += self.fail_weight[to[todo]]
            to[todo] = self.fail[to[todo]]
        return out, to

    def traverse(self, words: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
        """The log10 weight of each token (0 for the ends before the first words). words: numbers of the tokens. starts: of the documents."""
        out = np.zeros(len(words))
        pieces = -(-(np.diff(starts) - 1) // STRETCH)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.repeat(starts[:-1] + 1, pieces) + nth * STRETCH
        size = np.minimum(begin + STRETCH, np.repeat(starts[1:], pieces)) - begin
        by = np.argsort(-size, kind="stable")
        begin, size, nth = begin[by], size[by], nth[by]
        state = np.where(nth == 0, self.root_next[words[begin - 1]], 0)  # the end's state, or the root
        later = np.flatnonzero(nth > 0)
        for back in range(order - 1, 0, -1):
            _, state[later] = self.step(state[later], words[begin[later] - back])
        for k in range(int(size.max(initial=0))):
            n = int(np.searchsorted(-size, -k))  # stretches of more than k tokens
            out[begin[:n] + k], state[:n] = self.step(state[:n], words[begin[:n] + k])
        return out


def _ask(buckets: int, order: int, bits: int):
    """Of one block: its keys and their trained counts, dealt to the buckets; no rows for buckets without any."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, held, tokens, starts = _tokens(pdf)
        trained = np.repeat(~held, np.diff(starts))
        columns, some = {}, np.zeros(buckets, bool)
        for n, (keys, there) in enumerate(grams(tokens, starts, order, bits), 1):
            own, counts = tally(keys[there], trained[there])
            ends = cuts(own if n == 1 else own << U(64 - bits), buckets)
            some |= np.diff(np.concatenate([[0], ends, [len(own)]])) > 0
            columns[f"keys_{n}"] = [deflated(np.diff(x, prepend=U(0))) for x in np.split(own, ends)]
            columns[f"n_{n}"] = [deflated(x) for x in np.split(counts, ends)]
        return pd.DataFrame({"block": pdf["block"].iloc[0], "bucket": np.arange(buckets, dtype=np.int32), **columns})[some]

    return run


def _answer(order: int):
    """Of one bucket: each block gets the totals of its keys."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[["block", "bucket"]].copy()
        for k in range(1, order + 1):
            keys, own, total = _totals(pdf, k)
            out[f"n_{k}"] = [deflated(total[np.searchsorted(own, x)]) for x in keys]
        return out

    return run


def _totals(pdf: pd.DataFrame, n: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of one bucket: each block's keys of n-grams, the distinct ones, and their trained counts."""
    keys = [np.cumsum(inflated(x), dtype=U) for x in pdf[f"keys_{n}"]]
    return keys, *tally(np.concatenate(keys), np.concatenate([inflated(x) for x in pdf[f"n_{n}"]]))


def _known(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: its trained tokens, and how many are distinct."""
    _, _, total = _totals(pdf, 1)
    return pd.DataFrame({"tokens": [int(total.sum())], "distinct": [int((total > 0).sum())]})


def _score(mu: float, order: int, bits: int):
    """Of one block: its documents and the answers, which are in the order of the keys and have the training texts' tokens and distinct ones."""

    def run(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        ids, held, tokens, starts = _tokens(docs)
        answers, index, counts = answers.sort_values("bucket"), [], []
        for n, (keys, there) in enumerate(grams(tokens, starts, order, bits), 1):
            own, number = np.unique(keys[there], return_inverse=True)
            index.append(np.full(len(keys), np.searchsorted(own, END) if n == 1 else -1))  # the end before a text is an end
            index[-1][there] = number
            counts.append(np.concatenate([inflated(x) for x in answers[f"n_{n}"]]).astype(np.int64))
        total, distinct = int(answers["tokens"].iloc[0]), int(answers["distinct"].iloc[0])
        model = Automaton(index, counts, total, distinct, mu)
        taken = model.traverse(index[0], starts, order)
        base, known = model.root[index[0]], model.known[index[0]].astype(np.int64)
        base[starts[:-1]], known[starts[:-1]] = 0, 0
        added = [np.add.reduceat(x, starts[:-1]) for x in (known, base, taken)]
        return pd.DataFrame(
            {
                "doc_id": pd.array(ids, "Int64"),
                "held_out": held,
                "n_tokens": np.diff(starts) - 1,
                "n_known": added[0],
                "train_tokens": total,
                "base_score": added[1],
                "score": added[2],
            }
        )

    return run


def score_texts(docs: DataFrame, held_out: Column, text: str = "text", mu: float = MU, order: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (root alone) and score of each row of docs.

    The model is learnt from all rows that aren't held out (null counts as held out). Null and empty texts are the end token alone.
    Rows stay as they are, repeated ones too, and train as often. Without training rows every token has probability 1. An empty table
    gives an empty table. Words are told apart by 64-bit hashes and n-grams by shorter ones, whose length grows with the corpus. Logs
    are of base 10. order: the words of the longest n-grams, 1 at least.
    """
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first().n
    n = shuffle_partitions(docs.sparkSession)
    blocks, buckets = max(LEAST_BLOCKS, math.ceil(total / BLOCK_BYTES)), max(LEAST_BUCKETS, math.ceil(total / BUCKET_BYTES))
    bits = min(64, max(LEAST_BITS, SPARE_BITS + total.bit_length()))
    dealt = docs.select("doc_id", F.col(text).alias("text"), F.coalesce(held_out, F.lit(True)).alias("held_out"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("doc_id", F.octet_length("text"), "text"), F.lit(blocks)).cast("int"))
    dealt = dealt.select("block", "doc_id", "held_out", "text").mapInArrow(_pack_texts, "block int, texts binary").repartition(n, "block")
    orders = range(1, order + 1)
    asked = "block int, bucket int" + "".join(f", keys_{k} binary, n_{k} binary" for k in orders)
    asked = dealt.groupBy("block").applyInPandas(_ask(buckets, order, bits), asked)
    answers = asked.groupBy("bucket").applyInPandas(_answer(order), "block int, bucket int" + "".join(f", n_{k} binary" for k in orders))
    # The totals come from the same shuffle as the answers, in one query: it is read twice and made once.
    known = asked.groupBy("bucket").applyInPandas(_known, "tokens long, distinct long").agg(F.sum("tokens").alias("tokens"), F.sum("distinct").alias("distinct"))
    answers = answers.crossJoin(F.broadcast(known)).repartition(n, "block")  # known is one row
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_score(mu, order, bits), schema)
