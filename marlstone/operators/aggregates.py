"""Aggregates and table functions that a user defines in Python.

An aggregate is a state that can be merged. Each task folds its rows into one state per key, in Arrow batches; states are dealt by key and
merged as a sorted stream. So a key with any number of rows sends one state for each task, and tasks hold a bounded number of keys at once.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

#: Keys whose states a task holds before it passes them on.
HELD_KEYS = 1 << 16


@dataclass(frozen=True)
class Aggregate:
    """empty() is a new state, add(state, rows) one with more rows (tuples of the arguments), merge(a, b) that of two, result(state) a value of the type `returns`.

    States are pickled between tasks. Nulls are handed over as None. `strict` leaves out rows with a null argument.
    """

    returns: str
    empty: Callable[[], Any]
    add: Callable[[Any, list[tuple]], Any]
    merge: Callable[[Any, Any], Any]
    result: Callable[[Any], Any]
    strict: bool = True


def aggregated(df: DataFrame, keys: list[str], **named: tuple[Aggregate, list[str]]) -> DataFrame:
    """keys, and a column for each name: its aggregate of the columns given. Null keys are a key like others; without keys there is one row, for an empty table too."""
    names = list(named)
    whole = F.struct(*(F.col(f"`{k}`") for k in keys)) if keys else F.struct(F.lit(True).alias("all"))
    columns = sorted({c for _, cs in named.values() for c in cs})
    rows = df.select(whole.alias("k"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)))
    at = {name: [columns.index(c) for c in cs] for name, (_, cs) in named.items()}
    kinds = {name: aggregate for name, (aggregate, _) in named.items()}
    key_type = rows.schema["k"].dataType

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[bytes, tuple[Any, list]] = {}

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([k for k, _ in states.values()], schema), pa.array([pickle.dumps(s) for _, s in states.values()], pa.binary())], ["k", "state"])
            states.clear()
            return made

        schema = None
        for b in batches:
            schema = b.schema.field("k").type
            values = [b.column(i + 1).to_pylist() for i in range(len(columns))]
            by_key: dict[bytes, list[int]] = {}
            keyed = b.column("k").to_pylist()
            for i, k in enumerate(keyed):
                by_key.setdefault(pickle.dumps(tuple(k.values())), []).append(i)
            for k, places in by_key.items():
                held = states.setdefault(k, (keyed[places[0]], [kinds[n].empty() for n in names]))[1]
                for j, n in enumerate(names):
                    some = [tuple(values[c][i] for c in at[n]) for i in places]
                    some = [r for r in some if None not in r] if kinds[n].strict else some
                    if some:
                        held[j] = kinds[n].add(held[j], some)
            if len(states) > HELD_KEYS:
                yield out()
        if states:
            yield out()

    partial = rows.mapInArrow(fold, StructType([StructField("k", key_type), StructField("state", _parse_datatype_string("binary"))]))
    if not keys:
        nothing = pickle.dumps([kinds[n].empty() for n in names])
        partial = partial.union(df.sparkSession.range(1).select(whole.alias("k"), F.lit(nothing).alias("state")))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_key, held, done = None, None, []
        kind = None

        def out() -> pa.RecordBatch:
            results = [pa.array([kinds[n].result(s[j]) for _, s in done], fields[j]) for j, n in enumerate(names)]
            made = pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], kind), *results], ["k", *(f"r{j}" for j in range(len(names)))])
            done.clear()
            return made

        for b in batches:
            kind = b.schema.field("k").type
            for k, state in zip(b.column("k").to_pylist(), b.column("state").to_pylist(), strict=True):
                new = pickle.loads(state)
                if held is not None and k == at_key:
                    held = [kinds[n].merge(x, y) for n, x, y in zip(names, held, new, strict=True)]
                    continue
                if held is not None:
                    done.append((at_key, held))
                at_key, held = k, new
            if len(done) > 1024:
                yield out()
        if held is not None:
            done.append((at_key, held))
            yield out()

    from pyspark.sql.pandas.types import to_arrow_type

    returned = [_parse_datatype_string(kinds[n].returns) for n in names]
    fields = [to_arrow_type(t) for t in returned]
    schema = StructType([StructField("k", key_type), *(StructField(f"r{j}", t) for j, t in enumerate(returned))])
    dealt = partial.withColumn("h", F.xxhash64("k")).repartition("h").sortWithinPartitions("h", "k").drop("h")
    found = dealt.mapInArrow(merge, schema)
    return found.select(*(F.col(f"k.`{k}`") for k in keys), *(F.col(f"r{j}").alias(n) for j, n in enumerate(names)))


def top_k(k: int, returns: str) -> Aggregate:
    """The k greatest tuples of the arguments, greatest first, as an array of structs of the type `returns`."""

    def add(state: list, rows: list[tuple]) -> list:
        return heapq.nlargest(k, [*state, *rows])

    return Aggregate(f"array<{returns}>", list, add, add, list)


def common_prefix() -> Aggregate:
    """The longest text that all texts begin with; null without texts."""

    def shared(a: str, b: str) -> str:
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        return a[:n]

    def add(state: str | None, rows: list[tuple]) -> str:
        low, high = min(rows)[0], max(rows)[0]
        both = shared(low, high)
        return both if state is None else shared(state, both)

    return Aggregate("string", lambda: None, add, lambda a, b: b if a is None else a if b is None else shared(a, b), lambda s: s)


def weighted_mean() -> Aggregate:
    """sum(value * weight) / sum(weight), from fractions of whole numbers, so that the order of rows does not matter; null if the weights' sum is 0."""
    from fractions import Fraction

    def add(state: tuple, rows: list[tuple]) -> tuple:
        return state[0] + sum(Fraction(v) * Fraction(w) for v, w in rows), state[1] + sum(Fraction(w) for _, w in rows)

    return Aggregate("double", lambda: (Fraction(0), Fraction(0)), add, lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: float(s[0] / s[1]) if s[1] else None)


def table_function(spark: SparkSession, name: str, returns: str, rows: Callable[..., Iterator[tuple]], strict: bool = True) -> None:
    """Registers a function for FROM and LATERAL in SQL: rows(*arguments) gives tuples of the schema `returns`. `strict`: none for a null argument."""

    class Handler:
        def eval(self, *arguments):
            if not (strict and None in arguments):
                yield from rows(*arguments)

    spark.udtf.register(name, F.udtf(Handler, returnType=returns))


def lateral(df: DataFrame, returns: str, rows: Callable[..., Iterator[tuple]], arguments: list[str], ordinality: str | None = None, outer: bool = False, strict: bool = True) -> DataFrame:
    """df, LATERAL rows(arguments): each row of df with each row that the function gives for it, numbered from 1 in a column named by `ordinality`; `outer` keeps rows without any.

    One pass in Arrow batches without a shuffle.
    """
    schema = _parse_datatype_string(returns)
    added = [*schema.fields, *([StructField(ordinality, _parse_datatype_string("bigint"))] if ordinality else [])]
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place, out = [], []
            for i, args in enumerate(zip(*(b.column(a).to_pylist() for a in arguments), strict=True) if arguments else [()] * b.num_rows):
                found = [] if strict and None in args else [tuple(r) for r in rows(*args)]
                found = [(*r, n) for n, r in enumerate(found, 1)] if ordinality else found
                found = found or ([(None,) * len(added)] if outer else [])
                place += [i] * len(found)
                out += found
            taken = b.take(pa.array(place, pa.int64()))
            columns = list(zip(*out, strict=True)) or [()] * len(added)
            yield pa.RecordBatch.from_arrays([*taken.columns, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [*b.schema.names, *(f.name for f in added)])

    return df.mapInArrow(run, StructType([*df.schema.fields, *added]))
