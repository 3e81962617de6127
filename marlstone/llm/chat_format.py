"""Chat formatting by schema fingerprint.

A record is a JSON object in any of several layouts: prompt and response, instruction with input and output, lists of
messages, or one row per turn. Its nested field paths (list items share one path) are hashed to a fingerprint. A
declarative mapping is registered for a set of required paths; the fingerprint of each distinct layout is matched to a
mapping once, and the mapping's paths say where roles and texts are. Records of no known layout are kept, with mapping
null and no turns, so nothing is lost silently.

Turns are written as <|im_start|>role, a line feed, the text, <|im_end|>, a line feed. A control string inside a role or text
gets a backslash after its first character, one more if there are backslashes there already; taking one away restores it.

A null text is empty, a null role is empty, a null conversation id is a conversation of its own. Turns with equal numbers follow by
role, then text; repeated rows are repeated turns. A conversation is one output row, so its turns meet in one task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = T.ArrayType(T.StructType().add("role", "string").add("text", "string"))
#: Strings that mark turns here or in other chat templates; a text must never show them unescaped.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
START, END = "<|im_start|>", "<|im_end|>\n"

_TAILS = "|".join(c[1:].replace("|", r"\|").replace("]", r"\]") for c in CONTROLS)
#: First character, backslashes, rest. Only a control string's own first character stands before its rest.
ESCAPABLE = "([<\\[])(\\\\*)(" + _TAILS + ")"
ESCAPED = "([<\\[])\\\\(\\\\*)(" + _TAILS + ")"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPABLE, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def escaped_role(role: Column) -> Column:
    """A role stands in one line, so its line feeds are escaped too."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescaped_role(role: Column) -> Column:
    parts = F.split(unescaped(role), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns. `turns`: a list field with role and text fields of its items; or `fields`: (role, path) in order."""

    name: str
    requires: frozenset[str]
    turns: str | None = None
    role: str | None = None
    text: str | None = None
    fields: tuple[tuple[str, str], ...] = ()


#: Common layouts of public instruction data. The first whose required paths are all there is taken.
MAPPINGS = (
    Mapping("messages", frozenset({"messages[].role", "messages[].content"}), "messages", "role", "content"),
    Mapping("conversations", frozenset({"conversations[].from", "conversations[].value"}), "conversations", "from", "value"),
    Mapping("instruction_input", frozenset({"instruction", "input", "output"}), fields=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("instruction", frozenset({"instruction", "output"}), fields=(("user", "instruction"), ("assistant", "output"))),
    Mapping("system_prompt", frozenset({"system", "prompt", "response"}), fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt", frozenset({"prompt", "response"}), fields=(("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt_completion", frozenset({"prompt", "completion"}), fields=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("question", frozenset({"question", "answer"}), fields=(("user", "question"), ("assistant", "answer"))),
    Mapping("turn_row", frozenset({"turn.role", "turn.text"}), "turn", "role", "text"),
)

#: Other names of roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "chatgpt": "assistant", "model": "assistant"}


def paths(value, at: str = "") -> Iterator[str]:
    """Nested field paths of a parsed record; items of a list share the path ending in []."""
    if isinstance(value, dict):
        for k, v in value.items():
            inner = f"{at}.{k}" if at else str(k)
            yield inner
            yield from paths(v, inner)
    elif isinstance(value, list):
        for v in value:
            yield from paths(v, at + "[]")


def fingerprint(found: frozenset[str]) -> int:
    """A signed 64-bit hash of the sorted distinct paths."""
    h = xxhash.xxh3_64_intdigest("\n".join(sorted(found)).encode())
    return h - (1 << 64) if h >> 63 else h


def turns_of(mapping: Mapping, record: dict) -> list[tuple[str, str]]:
    text = lambda v: "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    if mapping.turns is None:
        return [(role, text(record[f])) for role, f in mapping.fields if f != "input" or record[f]]
    items = record[mapping.turns]
    roles = [(text(x[mapping.role]), text(x[mapping.text])) for x in (items if isinstance(items, list) else [items])]
    return roles if isinstance(items, dict) else [(ROLES.get(r, r), t) for r, t in roles]


def canonical(records: DataFrame, json_column: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """All other columns, then fingerprint (null if the record is no JSON object), mapping and turns (role, text)."""
    kept = [c for c in records.columns if c != json_column]

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen: dict[int, Mapping | None] = {}  # of each layout, of which a data set has few
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for b in batches:
            prints, names, turns = [], [], []
            for raw in b.column(json_column).to_pylist():
                try:
                    record = json.loads(raw) if raw is not None else None
                except ValueError:
                    record = None
                if not isinstance(record, dict):
                    prints.append(None), names.append(None), turns.append([])
                    continue
                found = frozenset(paths(record))
                key = fingerprint(found)
                if key not in chosen:
                    chosen[key] = next((m for m in mappings if m.requires <= found), None)
                m = chosen[key]
                try:
                    made = turns_of(m, record) if m else []
                except (KeyError, TypeError):  # items of different layouts in one list
                    m, made = None, []
                prints.append(key), names.append(m.name if m else None), turns.append([{"role": r, "text": t} for r, t in made])
            arrays = [*(b.column(c) for c in kept), pa.array(prints, pa.int64()), pa.array(names, pa.string()), pa.array(turns, kind)]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, "fingerprint", "mapping", "turns"])

    schema = records.select(*kept).schema.add("fingerprint", "long").add("mapping", "string").add("turns", TURNS)
    return records.select(*kept, json_column).mapInArrow(convert, schema)


def turn_records(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A table with a row per turn as records: conversation, position and the turn as JSON."""
    options = {"ignoreNullFields": "false"}
    record = F.to_json(F.struct(F.struct(F.col(role).alias("role"), F.col(text).alias("text")).alias("turn")), options)
    return rows.select(F.col(conversation).alias("conv_id"), F.col(turn).alias("position"), record.alias("record"))


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id and the formatted text of (conv_id, position, turns), with the loss mask: where each assistant's text stands.

    Each turn is escaped where it lies; only the escaped turns of a conversation meet.
    """
    one = turns.select("conv_id", "position", F.posexplode("turns").alias("k", "t"))
    one = one.select("conv_id", F.struct("position", "k", F.col("t.role").alias("role"), F.col("t.text").alias("text")).alias("t"))
    whole = one.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    piece = lambda t: F.concat(F.lit(START), escaped_role(t["role"]), F.lit("\n"), escaped(t["text"]), F.lit(END))
    whole = whole.select("conv_id", "t", F.transform("t", piece).alias("pieces"))
    head = lambda t: F.length(escaped_role(t["role"])) + len(START) + 1
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    span = lambda s, t: F.struct((s["end"] + head(t)).alias("start"), F.length(escaped(t["text"])).alias("length"))
    spans = F.aggregate(
        F.arrays_zip("t", "pieces"),
        start,
        lambda s, x: F.struct(
            (s["end"] + F.length(x["pieces"])).alias("end"),
            F.when(x["t"]["role"] == "assistant", F.concat(s["spans"], F.array(span(s, x["t"])))).otherwise(s["spans"]).alias("spans"),
        ),
    )
    return whole.select("conv_id", F.array_join("pieces", "").alias("formatted"), spans["spans"].alias("loss_spans"))


def parsed(df: DataFrame) -> DataFrame:
    """Adds `turns` (role, text), read from `formatted` alone, and `loss_texts`, read from the spans of the mask."""
    parts = F.split("formatted", r"<\|im_end\|>\n", -1)
    body = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.substring(p, len(START) + 1, 2**31 - 1))
    turn = lambda b: F.struct(
        unescaped_role(F.substring_index(b, "\n", 1)).alias("role"),
        unescaped(b.substr(F.instr(b, "\n") + 1, F.lit(2**31 - 1))).alias("text"),
    )
    loss = F.transform("loss_spans", lambda s: unescaped(F.col("formatted").substr(s["start"] + 1, s["length"])))
    return df.withColumn("turns", F.transform(body, turn)).withColumn("loss_texts", loss)
