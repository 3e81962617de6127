"""Canonical exact digests.

A text is brought to a canonical form (Unicode NFKC, case folded, runs of white space as one space, ends trimmed) and
hashed to 128 bits by xxhash. Texts are the same if their canonical bytes are: digests only choose the buckets within
which bytes are compared. Likeness of two texts is thus 1 or 0.

Null texts are empty; all empty texts are the same. Repeated rows are copies of each other. Null ids come first
in the order of ids; equal ids are ordered by text. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import bit_filter, passes, spread_join


def canonical(text: str | None) -> bytes:
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digest(canon: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(canon)


def check(canon: bytes) -> int:
    """64 bits that tell rows of one bucket apart where it holds different bytes."""
    return xxhash.xxh3_64_intdigest(canon, seed=5) - (1 << 63)


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many, or all, of the following text."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


PAIRED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, body_check long"


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text and `bucket`, `borrowed`: partitions that hold runs of ascending ids, each followed by the first row of the next run.

    Runs begin at ids chosen as quantiles. The rows with such an id also go, as borrowed, to the run before, and those of the first run to the last.
    """
    runs = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fractions = [k / runs for k in range(runs)]
    found = docs.agg(F.min("doc_id").alias("least"), F.percentile_approx("doc_id", fractions, 100 * runs).alias("q"), F.max(F.col("doc_id").isNull()).alias("nulls")).first()
    bounds = np.array(sorted({found["least"], *found["q"]} if found["q"] else []), np.int64)
    n, nulls = max(len(bounds), 1), bool(found["nulls"])

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        x = ids.fillna(0).to_numpy(np.int64)
        run = np.where(known, np.maximum(np.searchsorted(bounds, x, "right") - 1, 0), 0)
        first = known & np.isin(x, bounds[0 if not nulls else 1 :]) | ~known
        return pd.Series([[r, -1 - (r - 1) % n] if f else [r] for r, f in zip(run.tolist(), first.tolist(), strict=True)])

    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.explode(places("doc_id")).alias("at"))
    df = df.select("doc_id", "text", F.when(F.col("at") < 0, -1 - F.col("at")).otherwise(F.col("at")).alias("bucket"), (F.col("at") < 0).alias("borrowed"))
    return df.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "borrowed", "doc_id", "text")


def paired(docs: DataFrame) -> DataFrame:
    """One row per document with the columns of PAIRED: its digest, that of its edited text, likeness to that and to the next document, and check()."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = zip(*(c.split() for c in PAIRED.split(", ")), strict=True)
        to = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
        held = None  # bucket, doc_id, text, canonical, digest
        for b in batches:
            rows = []
            for doc_id, text, bucket, borrowed in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                canon = canonical(text)
                mine = (bucket, doc_id, text, canon, digest(canon))
                if held and held[0] == bucket:
                    _, i, t, c, d = held
                    changed = edited(t, text)
                    ec = canonical(changed)
                    ed = digest(ec)
                    sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((i, len(t), sha, d, ed, float(d == ed and c == ec), float(d == mine[4] and c == canon), check(c)))
                held = None if borrowed else mine
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, to[k]) for c, k in zip(columns, kinds, strict=True)], list(names))

    return in_order(docs).mapInArrow(stream, PAIRED)


def key_of(fingerprint: str) -> int:
    return int(fingerprint[:15], 16)


SUSPECTS = "doc_id long, fingerprint string, body_check long, body binary"


def suspects(docs: DataFrame, digests: DataFrame) -> DataFrame:
    """The columns of SUSPECTS: the documents whose digest occurs twice or more, and by the filter's chance a few others, with their bytes
    compressed by a function of the bytes alone, so that equal means equal."""
    twice = digests.groupBy("fingerprint").count().where("count > 1")
    key = F.conv(F.substring("fingerprint", 1, 15), 16, 10).cast("long").alias("key")
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(twice.select(key), "key"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(3).compress
        for b in batches:
            ids = b.column(0).to_pylist()
            canon = [canonical(t) for t in b.column(1).to_pylist()]
            prints = [digest(c) for c in canon]
            at = np.flatnonzero(passes(bits.value, np.array([key_of(d) for d in prints], np.int64))).tolist()
            arrays = [pa.array([ids[k] for k in at], pa.int64()), pa.array([prints[k] for k in at], pa.string())]
            arrays += [pa.array([check(canon[k]) for k in at], pa.int64()), pa.array([pack(canon[k]) for k in at], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in SUSPECTS.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(read, SUSPECTS)


def buckets(found: DataFrame) -> DataFrame:
    """(fingerprint, class_id, n_copies, same) of the suspects' buckets with two documents or more; same: all have the same bytes.

    The least and the greatest bytes are found in each task first, so a bucket with a third of all documents sends one row a task.
    """
    ends = found.groupBy("fingerprint").agg(F.min("body").alias("x"), F.max("body").alias("y"), F.min("doc_id").alias("class_id"), F.count("*").alias("n_copies"))
    return ends.where("n_copies > 1").select("fingerprint", "class_id", "n_copies", (F.col("x") == F.col("y")).alias("same"))


def parted(found: DataFrame, mixed: DataFrame) -> DataFrame:
    """(fingerprint, body_check, class_id, n_copies) of buckets that hold different bytes: a class for each of them."""
    rows = found.join(mixed.select("fingerprint"), "fingerprint", "left_semi")
    return rows.groupBy("fingerprint", "body").agg(F.first("body_check").alias("body_check"), F.min("doc_id").alias("class_id"), F.count("*").alias("n_copies")).drop("body")


def classed(docs: DataFrame, rows: DataFrame, store) -> DataFrame:
    """Adds class_id (least id with the same canonical bytes) and n_copies to rows with doc_id, fingerprint and body_check of each document."""
    found = suspects(docs, rows)
    held = store(buckets(found), "buckets")
    classes, mixed = held.where("same"), held.where("NOT same")
    out = spread_join(rows, classes.drop("same"), "fingerprint", "doc_id")
    if not mixed.isEmpty():  # digests of different bytes met
        both = ["fingerprint", "body_check"]
        more = parted(found, mixed).withColumnsRenamed({"class_id": "c", "n_copies": "n"})
        out = out.join(more, both, "left").withColumns({"class_id": F.coalesce("c", "class_id"), "n_copies": F.coalesce("n", "n_copies")}).drop("c", "n")
    return out.withColumns({"class_id": F.coalesce("class_id", "doc_id"), "n_copies": F.coalesce("n_copies", F.lit(1).cast("long"))})


def fingerprinted(docs: DataFrame, store) -> DataFrame:
    """PAIRED without body_check, then class_id and n_copies. `store` writes a DataFrame to the shared folder and reads it again."""
    rows = store(paired(docs), "digests")
    out = classed(docs, rows, store)
    return out.select(*[c for c in rows.columns if c != "body_check"], "class_id", "n_copies")
