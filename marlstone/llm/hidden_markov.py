"""A hidden Markov language model over words.

Training counts each word; the most frequent CLASSES words are classes of their own, all others share classes by their
ending. Latent states move by a transition matrix and emit classes; a class emits its words by their smoothed counts, with
one more for unknown words, so texts of equal length have probabilities that sum to one. Baum-Welch runs over all
training texts: each task adds up the expected counts of its texts, the shuffle sums them, and the driver normalises a matrix of
fixed size. A text's likelihood is exact, by the forward recursion with a scale taken out at each word.

Words' counts are joined by a broadcast for the most frequent HEAD words, and by a shuffle for all others.

A null text is one end. Repeated rows are scored each. A null id counts as the text '' for the split. Without training texts all
words are unknown. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Latent states, words that are classes of their own, classes that the others share, rounds of training.
STATES = 8
CLASSES = 1 << 12
SHARED = 256
ROUNDS = 4
#: Words whose counts are broadcast, at most: about 10 MB.
HEAD = 1 << 18
#: Distinct words that a task counts before it passes them on.
HELD = 500_000
#: Words of the texts whose recursion runs side by side, about; a longer text runs alone.
SIDE_BY_SIDE = 1 << 19


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def key_of(word: bytes) -> int:
    """A signed 64-bit hash that stands for the word."""
    h = xxhash.xxh3_64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def shared_class(word: bytes) -> int:
    return xxhash.xxh32_intdigest(word[-3:]) % SHARED


def counted(docs: DataFrame) -> DataFrame:
    """(key, shared, word, n) of the words of all texts, counted in each task before the shuffle. word: one of the key's."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = list(seen)
            arrays = [pa.array(list(map(key_of, words)), pa.int64()), pa.array(list(map(shared_class, words)), pa.int32()), pa.array(words, pa.binary()), pa.array(list(seen.values()), pa.int64())]
            seen.clear()
            return pa.RecordBatch.from_arrays(arrays, ["key", "shared", "word", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                seen.update(words_of(text))
            if len(seen) > HELD:
                yield out()
        yield out()

    found = docs.select("text").mapInArrow(count, "key long, shared int, word binary, n long")
    return found.groupBy("key").agg(F.first("shared").alias("shared"), F.first("word").alias("word"), F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What scoring must know of all words: the most frequent by rank, and sums over the classes that the others share."""

    rank: dict[bytes, int]
    counts: np.ndarray  # by rank
    own: int  # ranks below are classes of their own; this class is the end
    docs: int
    shared_tokens: np.ndarray  # training tokens of each shared class
    shared_words: np.ndarray  # its distinct words
    tokens: int
    distinct: int


#: Bins of a count's logarithm to the base 2; parts of a bin.
BINS, PARTS = 16, 1 << 20


def most_frequent(counts: DataFrame, head: int) -> DataFrame:
    """(word, n) of about the `head` most frequent words: those above a bin of counts, and of that bin a part chosen by hash.

    The bin follows from a histogram of fixed size, so no task sorts all words.
    """
    level = F.floor(F.log2("n") * BINS).cast("int")
    bins = sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True)  # BINS times 63 rows at most
    above = 0
    for at, n in bins:
        if above + n > head:
            part = PARTS * (head - above) // n
            return counts.where((level > at) | (level == at) & (F.pmod(F.xxhash64("key"), F.lit(PARTS)) < part)).select("word", "n")
        above += n
    return counts.select("word", "n")


def vocabulary(counts: DataFrame, n_docs: int, classes: int, head: int) -> Vocabulary:
    top = most_frequent(counts, head).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    words, n = top.column("word").to_pylist(), top.column("n").to_numpy().astype(float)
    sums = counts.groupBy("shared").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toArrow()  # SHARED rows
    tokens, distinct = np.zeros(SHARED), np.zeros(SHARED)
    at = sums.column("shared").to_numpy()
    tokens[at], distinct[at] = sums.column("n").to_numpy(), sums.column("v").to_numpy()
    all_tokens, all_words = int(tokens.sum()) + n_docs, int(distinct.sum()) + bool(n_docs)
    own = min(classes, len(words))
    for w, c in zip(words[:own], n, strict=False):
        tokens[shared_class(w)] -= c
        distinct[shared_class(w)] -= 1
    return Vocabulary({w: k for k, w in enumerate(words)}, n, own, n_docs, tokens, distinct, all_tokens, all_words)


ENCODED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, inside double, classes binary, rest array<long>"


def encoded(docs: DataFrame, held_out: Column, vocab: Vocabulary) -> DataFrame:
    """Each text as class numbers (16 bits each, the end last), the keys of its words beyond the head (rest), and what all else adds:
    known tokens, base score, and `inside`, the log10 probability of the words inside their shared classes."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)  # HEAD words at most

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, row = shared.value, TaskContext.get().partitionId() << 33
        logs, base = np.log10(v.counts + 1), -math.log10(v.tokens + v.distinct + 1)
        outside = -np.log10(v.shared_tokens + v.shared_words + 1)
        for b in batches:
            columns: list[list] = [[] for _ in range(6)]
            for text in b.column(2).to_pylist():
                words = words_of(text)
                rank = np.fromiter((v.rank.get(w, -1) for w in words), np.int64, len(words))
                others = np.flatnonzero((rank < 0) | (rank >= v.own))
                in_class = np.fromiter((shared_class(words[k]) for k in others), np.int64, len(others))
                classes = rank.copy()
                classes[others] = v.own + 1 + in_class
                known, far = rank[rank >= 0], rank[rank >= v.own]
                made = (
                    len(words) + 1,
                    len(known) + (v.docs > 0),
                    float(logs[known].sum() + math.log10(v.docs + 1) + (len(words) + 1) * base),
                    float(logs[far].sum() + outside[in_class].sum()),
                    np.append(classes, v.own).astype("<u2").tobytes(),
                    [key_of(words[k]) for k in np.flatnonzero(rank < 0)],
                )
                for c, x in zip(columns, made, strict=True):
                    c.append(x)
            rows = pa.array(np.arange(row, row + b.num_rows))
            row += b.num_rows
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([rows, b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [x.split()[0] for x in ENCODED.split(", ")])

    return docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(encode, ENCODED)


@dataclass
class Model:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # classes x states


def initial(vocab: Vocabulary, states: int) -> Model:
    """States that stay, each near the unigram distribution, apart by a fixed random factor."""
    counts = np.concatenate([vocab.counts[: vocab.own], [vocab.docs], vocab.shared_tokens]) + 1
    emit = counts[:, None] * np.random.default_rng(11).uniform(0.5, 1.5, (len(counts), states))
    move = np.full((states, states), 0.1 / max(states - 1, 1)) + np.eye(states) * (0.9 - 0.1 / max(states - 1, 1))
    return Model(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def blocks(texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(order, classes, starts): texts by falling length, a row of words per step; at step t the first starts[t + 1] - starts[t] texts go on."""
    order = np.argsort([-len(t) for t in texts], kind="stable")
    part = np.cumsum([len(texts[k]) for k in order]) // SIDE_BY_SIDE
    for some in np.split(order, np.flatnonzero(np.diff(part)) + 1) if len(order) else []:
        lengths = np.array([len(texts[k]) for k in some])
        live = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")  # texts longer than t
        starts = np.concatenate([[0], np.cumsum(live)])
        flat = np.concatenate([texts[k] for k in some]).astype(np.int64)
        step = np.concatenate([np.arange(n) for n in lengths])
        text = np.repeat(np.arange(len(some)), lengths)
        classes = np.empty(len(flat), np.int64)
        classes[starts[step] + text] = flat
        yield some, classes, starts


def forward(model: Model, classes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward variables, their scales and the emissions, in the layout of blocks()."""
    emit = model.emit[classes]
    alpha, scale = np.empty_like(emit), np.empty(len(classes))
    before = None
    for t in range(len(starts) - 1):
        lo, hi = starts[t], starts[t + 1]
        a = (model.start if before is None else before[: hi - lo] @ model.move) * emit[lo:hi]
        s = a.sum(axis=1)
        before = a / s[:, None]
        alpha[lo:hi], scale[lo:hi] = before, s
    return alpha, scale, emit


def log10_likelihoods(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Of each class sequence, exactly."""
    out = np.empty(len(texts))
    for order, classes, starts in blocks(texts):
        logs = np.log10(forward(model, classes, starts)[1])
        place = np.arange(len(classes)) - np.repeat(starts[:-1], np.diff(starts))
        out[order] = np.bincount(place, logs, minlength=len(order))
    return out


def expected(model: Model, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of starts, moves and emissions over the texts."""
    states = len(model.start)
    start, move, emitted = np.zeros(states), np.zeros((states, states)), np.zeros_like(model.emit)
    for _, classes, starts in blocks(texts):
        alpha, scale, emit = forward(model, classes, starts)
        gamma = np.empty_like(alpha)
        last = len(starts) - 2
        beta = np.ones((starts[last + 1] - starts[last], states))
        for t in range(last, -1, -1):
            lo, hi = starts[t], starts[t + 1]
            if len(beta) < hi - lo:  # texts that end here
                beta = np.concatenate([beta, np.ones((hi - lo - len(beta), states))])
            gamma[lo:hi] = alpha[lo:hi] * beta
            if t:
                onward = beta * emit[lo:hi] / scale[lo:hi, None]
                move += alpha[starts[t - 1] : starts[t - 1] + hi - lo].T @ onward
                beta = onward @ model.move.T
        start += gamma[: starts[1]].sum(axis=0)
        for k in range(states):
            emitted[:, k] += np.bincount(classes, gamma[:, k], minlength=len(emitted))
    return start, move * model.move, emitted


def train(rows: DataFrame, vocab: Vocabulary, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all rows that are not held out."""
    model, context = initial(vocab, states), rows.sparkSession.sparkContext
    for _ in range(rounds):
        known = context.broadcast(model)  # states x classes

        def add_up(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            total: np.ndarray | None = None
            for b in batches:
                parts = expected(known.value, [np.frombuffer(x, "<u2") for x in b.column(0).to_pylist()]) if b.num_rows else None
                if parts:
                    flat = np.concatenate([p.ravel() for p in parts])
                    total = flat if total is None else total + flat
            if total is not None:
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["at", "n"])

        sums = rows.where("NOT held_out").select("classes").mapInArrow(add_up, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        flat = np.zeros(states + states * states + model.emit.size)
        flat[sums.column("at").to_numpy()] = sums.column("n").to_numpy()
        start, move, emit = flat[:states] + 0.1, flat[states : states + states**2].reshape(states, states) + 0.1, flat[states + states**2 :].reshape(model.emit.shape)
        unigram = emit.sum(axis=1) + 1
        emit = emit + 10 * (unigram / unigram.sum())[:, None]  # each state knows each class a little
        model = Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
        known.unpersist()
    return model


def scored(docs: DataFrame, held_out: Column, store, classes: int = CLASSES, head: int = HEAD, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each text. `store` writes a DataFrame to the shared folder and reads it again.

    base_score is the sum of log10((c + 1) / (N + V + 1)) over a text's tokens, its end included.
    """
    learnt = docs.where(~held_out)
    counts = store(counted(learnt), "counts")
    vocab = vocabulary(counts, learnt.count(), classes, head)
    rows = store(encoded(docs, held_out, vocab), "encoded")
    model = docs.sparkSession.sparkContext.broadcast(train(rows, vocab, states, rounds))

    def likelihood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            logs = log10_likelihoods(model.value, [np.frombuffer(x, "<u2") for x in b.column("classes").to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(logs, pa.float64())], [*b.schema.names[:-1], "chain"])

    plain = ENCODED.split(", classes")[0]
    chains = rows.drop("rest").mapInArrow(likelihood, plain + ", chain double")
    others = rows.select("row", F.explode("rest").alias("key")).join(counts.select("key", F.log10(F.col("n") + 1).alias("log")), "key")
    others = others.groupBy("row").agg(F.count("*").alias("more"), F.sum("log").alias("log"))
    log = F.coalesce("log", F.lit(0.0))
    return chains.join(others, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0).cast("long"))).alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + log).alias("base_score"),
        (F.col("chain") + F.col("inside") + log).alias("score"),
    )
