"""Quality rules: a ledger of failure bits and measurements, policies over it, and ablations by bitwise aggregation.

Every rule is evaluated once per document. Its outcome is one bit of `fail_bits`; what it measured stays in columns.
A policy is a named, versioned mask of rules: applying another policy later reads the ledger, never the texts.
Only DataFrame functions are used.

Null or empty texts have no words and so fail the base rules. Repeated rows are each judged. Columns besides
doc_id and text are ignored, so they may have any names. An empty table gives an empty ledger.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import SPACES

#: A character that is part of a word.
WORD = r"[^\x20\x09-\x0D]"
#: Words in each window that is looked up for repeats.
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    #: Of the measurement columns; true means that the document fails.
    fails: Column


def rules() -> list[Rule]:
    """The rules by bit. A bit is never given to another rule: a changed rule gets a new bit, so old ledgers stay readable."""
    n, c = F.col("n_words"), F.col
    return [
        Rule(0, "few_words", n < 10),
        Rule(1, "repeated_windows", 100 * c("n_repeat_words") > 20 * n),
        Rule(2, "symbols", 10 * c("n_symbols") > n),
        Rule(3, "duplicate_lines", 10 * c("n_dup_lines") > 3 * c("n_lines")),
        Rule(4, "short_words", c("word_chars") < 2 * n),
        Rule(5, "long_words", c("word_chars") > 15 * n),
        Rule(6, "upper_case", 2 * c("n_upper") > c("word_chars")),
    ]


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    bits: tuple[int, ...]

    @property
    def mask(self) -> int:
        return sum(1 << b for b in self.bits)


BASE = Policy("base", 1, (0, 1))
STRICT = Policy("strict", 1, tuple(range(7)))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of each whole text.

    n_repeat_words counts words inside five-word windows that occur twice or more, the first occurrence included.
    A window is held as a 64-bit hash. Only documents in which two windows are equal go on to look for places:
    sorted by hash, equal neighbours are repeats; sorted by place, each adds the words that no later one covers.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    df = docs.select("doc_id", text.alias("text")).select("doc_id", "text", words.alias("words"), lines.alias("lines"))
    n = F.size("words")
    df = df.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda s, w: s + F.length(w)).alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.length(F.regexp_replace("text", r"\P{Lu}+", "")).cast("long").alias("n_upper"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    both = lambda a, b: F.xxhash64(a, b)  # noqa: E731  of two, then four, then five words; null where one reaches past the end
    n = F.size("h")
    df = df.withColumn("h2", F.zip_with("h", F.slice("h", 2, n), both))
    df = df.withColumn("h4", F.zip_with("h2", F.slice("h2", 3, n), both))
    df = df.withColumn("windows", F.slice(F.zip_with("h4", F.slice("h", WINDOW, n), both), F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(0))))
    df = df.drop("h", "h2", "h4")
    placed = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("placed", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed)).drop("windows")
    equal = lambda x, i: (x["h"] == F.get("placed", i - 1)["h"]) | (x["h"] == F.get("placed", i + 1)["h"])
    repeats = F.filter("placed", lambda x, i: F.coalesce(equal(x, i), F.lit(False)))
    df = df.withColumn("at", F.sort_array(F.transform(repeats, lambda x: x["i"]))).drop("placed")
    covered = F.aggregate(
        "at",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda s, i: F.struct((s["n"] + i + WINDOW - F.greatest(i, s["end"])).alias("n"), (i + WINDOW).alias("end")),
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered["n"], F.lit(0)).cast("long")).drop("at")


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements and `fail_bits`, one bit per rule."""
    bits = [F.when(r.fails, F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in rules()]
    return measured(docs).withColumn("fail_bits", reduce(lambda a, b: a.bitwiseOR(b), bits))


def passes(policy: Policy) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0


def ablation(entries: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: documents that fail it, and those that it alone rejects (kept if it were dropped).

    The ledger is first counted by bit pattern, of which there are at most 2 ^ rules, so the shuffle is tiny.
    """
    masked = F.col("fail_bits").bitwiseAND(F.lit(policy.mask))
    patterns = entries.groupBy(masked.alias("bits")).agg(F.count("*").alias("n"))
    named = [F.struct(F.lit(r.bit).alias("bit"), F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("m")) for r in rules() if r.bit in policy.bits]
    each = patterns.select("bits", "n", F.explode(F.array(*named)).alias("r"))
    hit = F.col("bits").bitwiseAND(F.col("r.m")) != 0
    return each.groupBy(F.lit(policy.name).alias("policy"), F.lit(policy.version).alias("version"), "r.bit", "r.rule").agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("r.m"), F.col("n"))), F.lit(0)).alias("n_only_this"),
    )


def judged(docs: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """doc_id, the measurements, fail_bits, base_failed and kept under the policy."""
    base_failed = ~passes(BASE)
    return ledger(docs).withColumn("base_failed", base_failed).withColumn("kept", ~base_failed & passes(policy))


def kept_rows(docs: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """The rows of docs, with all their columns, that the policy keeps. Rows pass through the ledger as one struct: no join.

    The observed count keeps the filter above the ledger: pushed below, it would evaluate the measurements once for each use.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    verdict = judged(docs.select(row.alias("doc_id"), "text"), policy).select("doc_id", "kept")
    counts = F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("kept"), 1)).alias("kept")
    return verdict.observe(f"{policy.name}-{uuid.uuid4().hex}", *counts).where("kept").select("doc_id.*")
