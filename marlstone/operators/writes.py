"""Writes as transforms: the table after a write, and the rows that RETURNING would give. Callers choose where to write the result."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inserted(target: DataFrame, rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """INSERT: columns that rows lack take their default, or null."""
    filled = [F.col(c) if c in rows.columns else defaults.get(c, F.lit(None)).cast(target.schema[c].dataType).alias(c) for c in target.columns]
    return target.unionByName(rows.select(*filled))


def _upsert(target: DataFrame, rows: DataFrame, keys: list[str], update: list[str] | None) -> DataFrame:
    """Old and new rows that an upsert brings together, as structs `o` and `n`."""
    whole = F.struct(*(F.col(f"`{c}`") for c in target.columns))
    null_key = F.when(F.greatest(*(F.col(f"`{k}`").isNull().cast("int") for k in keys)) == 1, F.monotonically_increasing_id()) if len(keys) > 1 else F.when(F.col(f"`{keys[0]}`").isNull(), F.monotonically_increasing_id())
    new = rows.select(whole.alias("n"), null_key.alias("apart"))
    once = new.groupBy(*(F.col(f"n.`{k}`").alias(f"k{i}") for i, k in enumerate(keys)), "apart").agg(F.min("n").alias("n"), F.count("*").alias("times"))
    if update is not None:
        once = once.withColumn("n", F.when(F.col("times") > 1, F.raise_error(F.lit("two new rows have the same key"))).otherwise(F.col("n")))
    return target.select(whole.alias("o")).join(once.select("n"), [F.col(f"o.`{k}`") == F.col(f"n.`{k}`") for k in keys], "full")


def _written(both: DataFrame, target: DataFrame, update: list[str] | None, where: Column | None) -> DataFrame:
    """The columns of target after the upsert, then `o`, and `written`: the row is new or updated."""
    meets = F.col("o").isNotNull() & F.col("n").isNotNull() & F.coalesce(F.lit(True) if where is None else where, F.lit(False)) & F.lit(update is not None)
    both = both.select("o", "n", (F.col("o").isNull() | meets).alias("written"), meets.alias("meets"))
    taken = lambda c: F.when(F.col("o").isNull() | (F.col("meets") & F.lit(c in (update or []))), F.col(f"n.`{c}`")).otherwise(F.col(f"o.`{c}`"))
    return both.select(F.struct(*(taken(c).alias(c) for c in target.columns)).alias("row"), "o", "written")


def upserted(target: DataFrame, rows: DataFrame, keys: list[str], update: list[str] | None, where: Column | None = None) -> DataFrame:
    """INSERT … ON CONFLICT (keys): DO UPDATE SET the columns `update` from the new row WHERE a condition on `o.x` and `n.x`, the old and the new row, or DO NOTHING if `update` is None.

    Of new rows with equal keys, DO NOTHING inserts the least one; DO UPDATE is an error, as a row would be affected twice. Null keys meet nothing.
    """
    return _written(_upsert(target, rows, keys, update), target, update, where).select("row.*")


def returning_upsert(target: DataFrame, rows: DataFrame, keys: list[str], update: list[str] | None, where: Column | None = None) -> DataFrame:
    """The rows that such an upsert writes, and `inserted`, false for those it updates. Rows that DO NOTHING or WHERE leaves alone are not returned."""
    found = _written(_upsert(target, rows, keys, update), target, update, where).where("written")
    return found.select("row.*", F.col("o").isNull().alias("inserted"))


def _met(target: DataFrame, source: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Both sides as structs `old` and `src`, of source one row for each key. Names that only one side has, and the keys, also stand on their own, so changes may use them."""
    row = lambda df: F.struct(*(F.col(f"`{c}`") for c in df.columns))
    a, b = target.select(row(target).alias("old")), source.dropDuplicates(keys).select(row(source).alias("src"))
    joined = a.join(b, [F.col(f"old.`{k}`") == F.col(f"src.`{k}`") for k in keys], how)
    low = lambda df: {c.lower() for c in df.columns}
    own = [F.col(f"old.`{c}`").alias(c) for c in target.columns if c.lower() not in low(source) - {k.lower() for k in keys} | {"old", "src"}]
    other = [F.col(f"src.`{c}`").alias(c) for c in source.columns if c.lower() not in low(target) | {"old", "src"}]
    return joined.select("old", "src", *own, *other)


def updated(target: DataFrame, source: DataFrame, keys: list[str], changes: dict[str, Column]) -> DataFrame:
    """UPDATE … FROM source: rows that meet a row of source by the keys get the changes, written over `old.x`, `src.x`, and plain names that only one side has; of several such rows, one counts."""
    joined = _met(target, source, keys, "left")
    return joined.select(*(F.when(F.col("src").isNotNull(), changes[c]).otherwise(F.col(f"old.`{c}`")).alias(c) if c in changes else F.col(f"old.`{c}`").alias(c) for c in target.columns))


def deleted(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """DELETE … USING source: rows that meet a row of source go."""
    return target.join(source, keys, "left_anti")


def returning(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that such a delete returns."""
    return target.join(source, keys, "left_semi")


def returning_update(target: DataFrame, source: DataFrame, keys: list[str], changes: dict[str, Column]) -> DataFrame:
    """UPDATE … FROM source RETURNING the keys, and old_ and new_ of each changed column; names and repeated keys as for updated()."""
    joined = _met(target, source, keys, "inner")
    return joined.select(*(F.col(f"old.`{k}`").alias(k) for k in keys), *(F.col(f"old.`{c}`").alias(f"old_{c}") for c in changes), *(to.alias(f"new_{c}") for c, to in changes.items()))


def returning_insert(target: DataFrame, rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """INSERT … RETURNING *: the rows as they are inserted."""
    return inserted(target.limit(0), rows, defaults)


def truncated(target: DataFrame) -> DataFrame:
    """TRUNCATE: no rows, the same columns."""
    return target.limit(0)
