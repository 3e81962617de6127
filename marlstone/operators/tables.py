"""What a table must hold beyond its schema: keys, references, enums, ranges; violations, differences."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: str
    nullable: bool = True
    allowed: tuple[str, ...] = ()
    low: float | str | None = None  # of dates and timestamps as ISO text
    high: float | str | None = None
    max_length: int | None = None
    pattern: str | None = None  # plain characters, \\d, \\w, [a-z] classes, with {n}, {m,n} or ?


@dataclass(frozen=True)
class TableSpec:
    name: str
    columns: tuple[ColumnSpec, ...]
    key: tuple[str, ...] = ()
    references: tuple[tuple[str, str, str], ...] = ()  # column, table, its column
    checks: dict[str, str] = field(default_factory=dict)  # rule, SQL condition
    unique: tuple[str, ...] = ()  # columns without repeated values, beside the key


def rules(spec: TableSpec) -> list[tuple[str, str, Column]]:
    """(column, rule, broken) of the rules that a row breaks on its own; null breaks only not_null."""
    out = []
    for c in spec.columns:
        x = F.col(c.name)
        out += [(c.name, "not_null", x.isNull())] * (not c.nullable)
        out += [(c.name, "enum", ~x.isin(*c.allowed))] if c.allowed else []
        out += [(c.name, "min", x < F.lit(c.low).cast(c.type))] if c.low is not None else []
        out += [(c.name, "max", x > F.lit(c.high).cast(c.type))] if c.high is not None else []
        out += [(c.name, "pattern", ~x.rlike(f"^(?:{c.pattern})$"))] if c.pattern else []
        out += [(c.name, "max_length", F.length(x) > c.max_length)] if c.max_length is not None else []
    return out + [("", rule, ~F.expr(condition)) for rule, condition in spec.checks.items()]


def violations(df: DataFrame, spec: TableSpec) -> DataFrame:
    """(key, column, rule, value), a row for each rule that a row breaks. One pass: all rules are columns of one scan."""
    key = F.to_json(F.struct(*(spec.key or [c.name for c in spec.columns])), {"ignoreNullFields": "false"})
    broken = [F.when(b, F.struct(F.lit(c).alias("column"), F.lit(r).alias("rule"), (F.col(c).cast("string") if c else F.lit(None).cast("string")).alias("value"))) for c, r, b in rules(spec)]
    return df.select(key.alias("key"), F.explode(F.array_compact(F.array(*broken))).alias("v")).select("key", "v.*")


def repeated_keys(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Keys that are on more than one row, and on how many. Counted in each task first, so a hot key is no burden."""
    return df.groupBy(*spec.key).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def orphans(df: DataFrame, spec: TableSpec, tables: dict[str, DataFrame]) -> DataFrame:
    """(column, value, n_rows) of references that no row answers."""
    parts = [df.sparkSession.createDataFrame([], "column string, value string, n_rows long")]
    for column, other, target in spec.references:
        known = tables[other].select(F.col(target).alias("value")).distinct()
        used = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n_rows"))
        parts.append(used.join(known, "value", "left_anti").select(F.lit(column).alias("column"), F.col("value").cast("string").alias("value"), "n_rows"))
    return reduce(DataFrame.unionByName, parts)


def described(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}{'' if f.nullable else ' not null'}" for f in df.schema.fields)


def differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """(column, change, before, after) between two catalogues of one table, as sources.tables.catalogue gives them."""
    a, b = before.select("column_name", F.col("type").alias("old")), after.select("column_name", F.col("type").alias("new"))
    both = a.join(b, "column_name", "full").where(~F.col("old").eqNullSafe(F.col("new")))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("type")
    return both.select(F.col("column_name").alias("column"), change.alias("change"), F.col("old").alias("before"), F.col("new").alias("after"))
