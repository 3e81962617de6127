"""Phrase collocations from counts of all n-grams, by one sort of truncated suffixes (suffix-sigma).

Each position of a piece of text gives its suffix, truncated to max_n words. Words stand as 64-bit codes. Tasks count equal suffixes
first; then suffixes are dealt by language and first words, as ranges of their order, so that a frequent first word or pair of words spans
several tasks. Each task sorts its range in reverse order and counts all prefixes with one stack, many rows at a time: the stack
holds the prefixes that are open, one for each length, and a suffix that leaves a prefix closes it. Prefixes at the edges of a range may go on
in the next one, so their counts are joined afterwards. Of the others, only those with enough occurrences leave the task, as no part of a
candidate is rarer than it.

A candidate's cuts are then joined with the counts of their parts. Arithmetic is in integers and decimals without a fraction. The
words of the phrases in the result are found by their codes in a last scan; two words of one code are an error there, never a wrong count.

Texts are cut at . , ; : ! ? and line breaks (\\n to \\r) into pieces, these at spaces and tabs into words, A-Z lower-cased. Null
or empty texts have no words; a null lang is `und`, as is one of that name; a lang without words has no rows. Repeated rows
count each. Columns besides text and lang are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import bit_filter, passes

UND = "und"
#: Positions whose suffixes a task counts before it passes them on, and words whose codes it remembers.
HELD, KNOWN = 1 << 21, 1 << 20
#: Documents whose suffixes choose the ranges, about, every how many-th suffix of them is taken, and how many at most. They only decide which task counts what.
SAMPLE_DOCS, THINNED, SAMPLE_SUFFIXES = 4096, 32, 1 << 17

#: A-Z to a-z, tab to space, and what ends a piece to \n.
FOLDED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")
#: No word, and the end of a piece, among the codes of words.
NONE, BREAK = 0, 1


def code_of(word: bytes) -> int:
    code = xxhash.xxh3_64_intdigest(word, 13) - (1 << 63)
    return code if code not in (NONE, BREAK) else code + 2


class Codes(dict):
    """The code of each word, while it is remembered."""

    def __init__(self):
        self._begin()

    def _begin(self) -> None:
        self.clear()
        self.update({b"": NONE, b"\n": BREAK})

    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN:
            self._begin()
        self[word] = code = code_of(word)
        return code


def coded(text: bytes | None, codes: Codes) -> np.ndarray:
    """The codes of a text's words and piece ends, in order."""
    words = (text or b"").translate(FOLDED).replace(b"\n", b" \n ").split(b" ")
    found = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
    return found[found != NONE]


def suffixes(codes: np.ndarray, max_n: int) -> np.ndarray:
    """A column for each word: it and the words after it in its piece, max_n at most, then NONE."""
    breaks = codes == BREAK
    words, piece = codes[~breaks], np.cumsum(breaks)[~breaks]
    out = np.zeros((max_n, len(words)), np.int64)
    for k in range(min(max_n, len(words))):
        out[k, : len(words) - k] = np.where(piece[k:] == piece[: len(words) - k], words[k:], NONE)
    return out


def counted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct columns in ascending order, and how often each occurs."""
    rows = rows[:, np.lexsort(rows[::-1])]
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[:, 1:] != rows[:, :-1]).any(axis=0)
    starts = np.flatnonzero(new)
    return rows[:, starts], np.diff(starts, append=rows.shape[1])


def parts_of(rows: np.ndarray, bounds: list[tuple[int, ...]]) -> np.ndarray:
    """The range of each of the ascending columns: how many bounds are not after it."""
    begins = np.zeros(rows.shape[1] + 1, np.int64)
    for bound in bounds:
        lo, hi = 0, rows.shape[1]
        for column, x in zip(rows, bound, strict=True):
            lo, hi = lo + np.searchsorted(column[lo:hi], x), lo + np.searchsorted(column[lo:hi], x, "right")
        begins[lo] += 1
    return np.cumsum(begins)[:-1]


def key_names(max_n: int) -> list[str]:
    """The code of the lang, then of each word."""
    return [f"w{k}" for k in range(max_n + 1)]


def schema_of(first: str, max_n: int) -> str:
    return f"{first} int, " + ", ".join(f"{c} long" for c in key_names(max_n)) + ", n long"


def lang_code(lang: str | None) -> int:
    return code_of((UND if lang is None else lang).encode("utf-8", "surrogatepass"))


def texts_of(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def suffix_counts(docs: DataFrame, max_n: int, bounds: list[tuple[int, ...]]) -> DataFrame:
    """(part, w0 …, n): how often each suffix occurs, counted in each task; part is its range between the bounds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, held, size, end = Codes(), defaultdict(list), 0, np.array([BREAK])

        def out() -> Iterator[pa.RecordBatch]:
            tables = []
            for lang, texts in held.items():
                words = suffixes(np.concatenate(texts), max_n)
                tables.append(np.vstack([np.full(words.shape[1], lang_code(lang)), words]))
            rows, n = counted(np.hstack(tables))
            arrays = [pa.array(parts_of(rows, bounds).astype(np.int32)), *map(pa.array, rows), pa.array(n)]
            yield pa.RecordBatch.from_arrays(arrays, ["part", *key_names(max_n), "n"])
            held.clear()

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), texts_of(b), strict=True):
                found = coded(text, codes)
                held[lang] += [found, end]
                size += len(found)
                if size > HELD:
                    yield from out()
                    size = 0
        if held:
            yield from out()

    return docs.select("lang", "text").mapInArrow(count, schema_of("part", max_n))


def range_bounds(docs: DataFrame, max_n: int, parts: int) -> list[tuple[int, ...]]:
    """Suffixes that cut their order into about equal ranges, from a sample of bounded size."""
    total = docs.count()
    if not total or parts < 2:
        return []
    some = docs.sample(SAMPLE_DOCS / total, seed=1) if total > SAMPLE_DOCS else docs
    keys = suffix_counts(some, max_n, []).select(key_names(max_n)).where(F.pmod(F.xxhash64(*key_names(max_n)), F.lit(THINNED)) == 0)
    found = sorted(map(tuple, keys.limit(SAMPLE_SUFFIXES).toPandas().to_numpy().tolist()))
    return sorted({found[len(found) * k // parts] for k in range(1, parts)}) if found else []


class Stack:
    """The open prefixes of rows in order, by length: what begins each, its count so far, and whether it began with the range."""

    def __init__(self, max_n: int, min_count: int):
        self.depth, self.min_count = max_n + 1, min_count
        self.open: list[tuple[np.ndarray, int, bool] | None] = [None] * self.depth
        self.closed: list[tuple[int, np.ndarray, np.ndarray]] = []  # words, keys as columns, counts

    def _out(self, d: int, keys: np.ndarray, n: np.ndarray, edge: np.ndarray) -> None:
        """Prefixes that are closed. Those at an edge, and langs, leave whatever their count is."""
        there = keys[d] != NONE if d else np.ones(len(n), bool)
        left = there & ((n >= self.min_count) | edge | (d == 0))
        self.closed.append((d, keys[:, left], n[left]))

    def end(self) -> None:
        """The range ends: what is open may go on in the next one."""
        for d, top in enumerate(self.open):
            if top:
                self._out(d, top[0][:, None], np.array([top[1]]), np.array([True]))
        self.open = [None] * self.depth

    def push(self, rows: np.ndarray, n: np.ndarray, begins: bool) -> None:
        """Columns of one range, following those before; `begins`: they are its first."""
        changed = np.zeros(rows.shape[1] - 1, bool)
        for d in range(self.depth):
            changed = changed | (rows[d, 1:] != rows[d, :-1])
            starts = np.concatenate([[0], np.flatnonzero(changed) + 1])
            sums, edge = np.add.reduceat(n, starts), np.zeros(len(starts), bool)
            keys = np.zeros((self.depth, len(starts)), np.int64)
            keys[: d + 1] = rows[: d + 1, starts]
            edge[0] = begins
            if top := self.open[d]:
                if (top[0] == keys[:, 0]).all():
                    sums[0] += top[1]
                    edge[0] = top[2]
                else:
                    self._out(d, top[0][:, None], np.array([top[1]]), np.array([top[2]]))
            self._out(d, keys[:, :-1], sums[:-1], edge[:-1])
            self.open[d] = keys[:, -1], int(sums[-1]), bool(edge[-1])

    def taken(self) -> pa.RecordBatch:
        """The closed prefixes so far, as (words, w0 …, n)."""
        words = np.concatenate([np.full(len(n), d, np.int32) for d, _, n in self.closed] or [np.zeros(0, np.int32)])
        keys = np.hstack([k for _, k, _ in self.closed] or [np.zeros((self.depth, 0), np.int64)])
        n = np.concatenate([n for _, _, n in self.closed] or [np.zeros(0, np.int64)])
        self.closed = []
        return pa.RecordBatch.from_arrays([pa.array(words), *map(pa.array, keys), pa.array(n)], ["words", *key_names(self.depth - 1), "n"])


def grams(counts: DataFrame, parts: int, max_n: int, min_count: int) -> DataFrame:
    """(words, w0 …, n) of the prefixes of suffix_counts: how often each occurs, those with min_count or more; words is 0 for a lang itself, 1 for a word.

    A prefix at a range's edge is left with what the range has of it, so parts are summed.
    """

    def stacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, last = Stack(max_n, min_count), None
        for b in batches:
            if not b.num_rows:
                continue
            part, *rows = (c.to_numpy() for c in b.columns[:-1])
            rows, n = np.stack(rows), b.column("n").to_numpy()
            cuts = np.flatnonzero(part[1:] != part[:-1]) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)], strict=True):
                begins = part[lo] != last
                if begins:
                    stack.end()
                    last = part[lo]
                stack.push(rows[:, lo:hi], n[lo:hi], bool(begins))
            yield stack.taken()
        stack.end()
        yield stack.taken()

    keys = key_names(max_n)
    dealt = counts.repartitionById(parts, F.col("part")).sortWithinPartitions("part", *(F.desc(c) for c in keys))
    found = dealt.mapInArrow(stacked, schema_of("words", max_n)).groupBy("words", *keys).agg(F.sum("n").alias("n"))
    return found.where((F.col("n") >= min_count) | (F.col("words") == 0))


def scored(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """w0, w, words, a and b (score, k, l, r) of candidates (w0, w, words, a): b is the cut with the lowest score. counts (w0, part, n) holds all parts."""
    cut = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.select("*", F.slice("w", 1, F.col("k")).alias("first"), F.expr("slice(w, k + 1, words - k)").alias("rest"))
    cut = cut.join(counts.select("w0", F.col("part").alias("first"), F.col("n").alias("l")), ["w0", "first"])
    cut = cut.join(counts.select("w0", F.col("part").alias("rest"), F.col("n").alias("r")), ["w0", "rest"])
    wide = lambda c: F.col(c).cast("decimal(15,0)")  # noqa: E731  products below have 38 digits at most
    score = F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (wide("a") * wide("a")), wide("l") * wide("r"))
    return cut.groupBy("w0", "w", "words", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b"))


def spelled(docs: DataFrame, codes: DataFrame) -> DataFrame:
    """(code, word) of the words whose code is in codes (code), from a scan that a filter of bounded size thins."""
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(codes, "code"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            new: set[bytes] = set()
            for text in texts_of(b):
                new.update((text or b"").translate(FOLDED).split())
            new -= seen
            seen = seen | new if len(seen) < KNOWN else new
            words = list(new)
            found = np.array([code_of(w) for w in words], np.int64)
            at = np.flatnonzero(passes(bits.value, found))
            yield pa.RecordBatch.from_arrays([pa.array(found[at]), pa.array([words[k] for k in at.tolist()], pa.binary())], ["code", "word"])

    words = docs.select("text").mapInArrow(read, "code long, word binary").groupBy("code").agg(F.min("word").alias("word"), F.max("word").alias("last"))
    one = F.when(F.col("word") == F.col("last"), F.col("word").cast("string")).otherwise(F.raise_error(F.lit("two words have the same code")))
    return words.join(codes, "code").select("code", one.alias("word"))


def lang_names(docs: DataFrame) -> DataFrame:
    """(w0, lang) of all langs."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([lang_code(x) for x in langs], pa.int64()), pa.array(langs, pa.string())], ["w0", "lang"])

    return docs.select(F.coalesce("lang", F.lit(UND)).alias("lang")).distinct().mapInArrow(read, "w0 long, lang string")


def collocations(docs: DataFrame, store: Callable[[DataFrame, str], DataFrame], max_n: int = 3, min_count: int = 10, absorbed: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's first `top` phrases of 2 to max_n words that occur min_count times or more.

    a is the phrase's count, l and r those of its parts at the cut with the lowest score floor(1000000 * a * a / (l * r)), the first of such
    cuts; n the lang's words. Counts are below 10 ^ 15. Phrases inside a longer candidate that has `absorbed` percent of their count or
    more are left out. `store` writes a DataFrame to the shared folder and reads it again.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = range_bounds(docs, max_n, parts)
    found = store(grams(suffix_counts(docs, max_n, bounds), len(bounds) + 1, max_n, min_count), "grams")
    found = found.select("w0", F.slice(F.array(*key_names(max_n)[1:]), 1, F.col("words")).alias("w"), "words", "n")
    candidates = found.where("words > 1").select("w0", "w", "words", F.col("n").alias("a"))
    best = scored(candidates, found.where("words > 0").select("w0", F.col("w").alias("part"), "n"))

    # all shorter phrases inside the longer candidates
    starts = F.explode(F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), s -> slice(w, s, m))))"))
    inside = candidates.where("words > 2").select("w0", "a", starts.alias("w")).groupBy("w0", "w").agg(F.max("a").alias("longer"))
    kept = best.join(inside, ["w0", "w"], "left").where(F.coalesce(F.expr(f"100 * longer < {absorbed} * a"), F.lit(True)))

    # those that may be among the first, with all that are equal to the last of them, before words are looked up
    order = Window.partitionBy("w0").orderBy(F.desc("score"), F.desc("a"))
    kept = kept.select("w0", "w", "a", "b.l", "b.r", "b.score").withColumn("place", F.rank().over(order))
    kept = store(kept.where(F.col("place") <= top).drop("place"), "collocations")
    each = kept.select("w0", "w", F.posexplode("w").alias("at", "code"))
    words = each.join(spelled(docs, kept.select(F.explode("w").alias("code")).distinct()), "code")
    phrases = words.groupBy("w0", "w").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda s: s["word"]), " ").alias("phrase"))
    ranked = kept.join(phrases, ["w0", "w"]).withColumn("rank", F.row_number().over(order.orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    out = ranked.join(found.where("words = 0").select("w0", "n"), "w0").join(lang_names(docs), "w0")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
