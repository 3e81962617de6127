"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.sources.tables import checkpoint_dir

#: White space between words: space and \t \n \v \f \r. bytes.split() and bytes.lower() use the same set and A-Z alone.
SPACES = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def released(spark: SparkSession) -> None:
    """Asks the JVM to collect finished plans: Spark drops their shuffle files then, which otherwise take disk until it happens."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts the lineage so that lost executors cost no recomputation."""
    spark, schema = df.sparkSession, df.schema
    path = f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    del df
    released(spark)
    return spark.read.schema(schema).parquet(path)


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def fresh(name: str, taken: list[str]) -> str:
    """A column name beginning with `name` that none of `taken` is, whatever the case."""
    low = {c.lower() for c in taken}
    while f"_{name}".lower() in low:
        name += "_"
    return f"_{name}"


#: Tasks over which the rows of one key are spread.
SPREAD = 16


def spread_join(rows: DataFrame, few: DataFrame, key: str, by: str) -> DataFrame:
    """rows LEFT JOIN few USING (key), few with a row for each key: the rows of a frequent key are dealt to SPREAD tasks by a hash of column `by`, and few's rows copied to each."""
    place = f"spread_{uuid.uuid4().hex}"
    dealt = rows.withColumn(place, F.pmod(F.xxhash64(by), F.lit(SPREAD)).cast("int"))
    copied = few.withColumn(place, F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return dealt.join(copied, [key, place], "left").drop(place)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bits of a filter at most: 16 MB. More keys only let more rows pass; what passes is always checked again.
FILTER_BITS = 1 << 27
#: Bits for each key, while there are few.
KEY_BITS = 16


def bit_filter(keys: DataFrame, column: str) -> bytes:
    """A bit for each long in `column`, by its lowest bits: a filter of a size that grows with their number up to FILTER_BITS.

    A row for each 64 bits at most reaches the driver.
    """
    bits = 1 << 16
    n = keys.count()
    while bits < min(n * KEY_BITS, FILTER_BITS):
        bits *= 2
    bit = keys.select(F.col(column).bitwiseAND(F.lit(bits - 1)).alias("bit"))
    words = bit.groupBy(F.shiftright("bit", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, int(bit & 63)))").alias("m"))
    out, rows = np.zeros(bits // 64, np.int64), words.toArrow()
    out[rows.column("w").to_numpy()] = rows.column("m").to_numpy()
    return out.astype("<i8").tobytes()


def passes(bits: bytes, keys: np.ndarray) -> np.ndarray:
    """Which of the longs a filter of bit_filter lets pass."""
    held = np.frombuffer(bits, np.uint8)
    at = keys & np.int64(8 * len(held) - 1)
    return (held[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Batches of rows sorted by a key without nulls, as tables of whole runs: each key's rows are in one table."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key)
        if held and k[0].as_py() != held[-1].column(key)[-1].as_py():
            yield pa.Table.from_batches(held)
            held = []
        values = k.to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(values, values[-1], "left"))
        if last:
            yield pa.Table.from_batches([*held, b.slice(0, last)])
            held = []
        held.append(b.slice(last))
    if held:
        yield pa.Table.from_batches(held)
