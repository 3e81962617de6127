"""Language identification with error-correcting output codes.

Each language has a codeword. For each bit, a binary n-gram classifier tells the languages whose bit is 1 from the
others. Its weights are the log odds of hashed byte n-grams, from counts over all training texts. A text's margins
are decoded against each codeword by a logistic loss, weighted by how well each bit told the training texts apart;
the nearest codeword wins, and a text whose two nearest are about as near is flagged as ambiguous.

Null texts and texts without a letter are `und` with score 0. Repeated rows are predicted each. Columns besides those
named are ignored. Without a labelled row, every text is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import fresh

#: Hashed n-grams of one to four bytes; features in all.
ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 14
#: Bits of a codeword, at least; all useful bits are used while there are fewer.
BITS = 31
#: A text is ambiguous if its best codeword has less than this share against the next best.
CLEAR = 0.6
UND = "und"
LETTER = regex.compile(r"\p{L}")


def features(text: str) -> np.ndarray:
    """Counts of the hashed byte n-grams of a whole text, lower-cased, digits and punctuation left out of no n-gram."""
    b = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    out, h = np.zeros(BUCKETS, np.int64), np.zeros(len(b), np.uint32)
    for k in range(max(ORDERS)):
        h = (h[: len(b) - k] + b[k:] + np.uint32(1)) * np.uint32(0x9E3779B1)
        if k + 1 in ORDERS:
            out += np.bincount(h >> np.uint32(18), minlength=BUCKETS)
        h = h ^ (h >> np.uint32(15))
    return out


def codewords(n: int, bits: int = BITS) -> np.ndarray:
    """n x bits of 0 and 1. For few languages all two-way splits (each once), else splits drawn at random; none is constant."""
    if n <= 1:
        return np.zeros((n, 0), np.int8)
    if 2 ** (n - 1) - 1 <= bits:
        splits = np.arange(1, 2 ** (n - 1))
        return np.array([(splits >> k) & 1 for k in range(n)], np.int8)
    rng, columns = np.random.default_rng(7), {}
    bits = max(bits, int(np.ceil(10 * np.log2(n))))
    while len(columns) < bits:
        c = rng.permutation(n) < n // 2
        columns.setdefault((c if c[0] else ~c).tobytes(), c)
    return np.array(list(columns.values()), np.int8).T


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # BUCKETS x bits: log odds of each n-gram
    trust: np.ndarray  # of each bit


def counted(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all whole texts: summed in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if LETTER.search(text):
                    f = features(text)
                    sums[lang] = sums[lang] + f if lang in sums else f
        for lang, f in sums.items():
            at = np.flatnonzero(f)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(f[at])], ["lang", "bucket", "n"])

    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    return rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame) -> Model:
    """From text and lang of all rows given. What reaches the driver is a count per language and bucket."""
    rows = counted(docs).toPandas()
    languages = tuple(sorted(rows["lang"].unique()))
    counts = np.zeros((len(languages), BUCKETS))
    counts[[languages.index(x) for x in rows["lang"]], rows["bucket"].to_numpy(int)] = rows["n"]
    code = codewords(len(languages))
    shares = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True) if languages else counts
    side = lambda c: (c.T[:, :, None] * shares[None]).sum(axis=1) / np.maximum(c.sum(axis=0), 1)[:, None]  # noqa: E731  bits x BUCKETS
    ones, zeros = side(code.astype(float)), side(1.0 - code)
    weights = (np.log(ones) - np.log(zeros)).T if code.shape[1] else np.zeros((BUCKETS, 0))
    apart = np.abs(shares @ weights) if code.shape[1] else np.zeros((len(languages), 0))
    trust = apart.min(axis=0) / max(apart.min(axis=0).sum(), 1e-12) if code.shape[1] else np.zeros(0)
    return Model(languages, code, weights, trust)


def decoded(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of margins: the nearest codeword's index, and its share against the second nearest (0.5 to 1)."""
    signs = 2.0 * model.code - 1
    loss = np.logaddexp(0, -margins[:, None, :] * signs[None]) @ model.trust if signs.shape[1] else np.zeros((len(margins), len(signs)))
    order = np.argsort(loss, axis=1, kind="stable")
    rows = np.arange(len(loss))
    if loss.shape[1] < 2:
        return order[:, 0], np.ones(len(loss))
    gap = loss[rows, order[:, 1]] - loss[rows, order[:, 0]]
    return order[:, 0], 1 / (1 + np.exp(-gap))


#: N-grams that a margin is scaled to: a short text's margin counts for less.
SCALE = 50.0


def margin(model: Model, text: str) -> np.ndarray:
    """Of each bit: the mean log odds of the text's n-grams, scaled."""
    f = features(text)
    n = f.sum()
    return (f @ model.weights) / n * (SCALE * n / (n + SCALE))


def predict(docs: DataFrame, model: Model, keep: list[str | Column], names: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """The columns of `keep`, then under `names` the language, its score (0 to 1) and whether it is ambiguous. The text alone decides."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x a fixed number of buckets and bits
    kept = docs.select(*keep)
    own = fresh("text", kept.columns)
    rows = docs.select(*keep, F.col("text").alias(own))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            ok = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if m.languages else []
            lang, score, unclear = [UND] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            if ok:
                best, share = decoded(m, np.stack([margin(m, texts[i]) for i in ok]))
                for i, k, s in zip(ok, best, share, strict=True):
                    lang[i], score[i], unclear[i] = m.languages[k], s, s < CLEAR
            added = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unclear, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *added], [*b.schema.names[:-1], *names])

    schema = kept.schema.add(names[0], "string").add(names[1], "double").add(names[2], "boolean")
    return rows.mapInArrow(label, schema)
