"""PostgreSQL's jsonb functions on variant columns: reading, editing, containment and paths, as Column expressions.

Paths and patterns are known when a plan is made: they compile to expressions that take a document apart along the path only, as a map or an array of
variants, and put it together again. A JSON null is a variant of its own; a column's null gives null. Objects are shown with their keys in byte order.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Step = str | int


def parsed(text: Column) -> Column:
    """text::jsonb."""
    return F.parse_json(text)


def shown(v: Column) -> Column:
    """jsonb::text, without white space."""
    return F.to_json(v)


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with the expression x once in the plan."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _with(f: Callable, more: object) -> Callable[[Column], Column]:
    """f with a second argument; Spark takes every parameter of a lambda, defaults too, for one of its own."""
    return lambda x: f(x, more)


def _object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _array(v: Column) -> Column:
    return F.when(~shown(v).startswith("["), F.lit(None)).otherwise(F.try_variant_get(v, "$", "array<variant>"))


def _made(x: Column) -> Column:
    """A variant of a map or an array of variants."""
    return F.call_function("to_variant_object", x)


def typeof(v: Column) -> Column:
    """jsonb_typeof: object, array, string, boolean, null or number."""
    kind = F.schema_of_variant(v)
    found = F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null")
    return F.when(v.isNotNull(), found.otherwise("number"))


def _steps(path: list[Step] | str) -> list[Step]:
    """A path as a list, or as PostgreSQL's text of one: {a,0,b}."""
    if isinstance(path, str):
        path = [m[0].strip('"') for m in re.finditer(r'"[^"]*"|[^{},]+', path)]
    return path


def _index(step: Step) -> int | None:
    return step if isinstance(step, int) else int(step) if re.fullmatch(r"-?\d+", step) else None


def _at(a: Column, n: int) -> Column:
    """An array's element by an index from 0, or from the end if negative; null if there is none."""
    return F.try_element_at(a, F.lit(n + 1 if n >= 0 else n))


def get(v: Column, step: Step) -> Column:
    """v -> step: a key of an object, or an index of an array."""
    if isinstance(step, int):
        return _at(_array(v), step)
    return F.try_element_at(_object(v), F.lit(step))


def get_path(v: Column, path: list[Step] | str) -> Column:
    """v #> path: a step is a key in an object and an index in an array."""

    def one(x: Column, step: Step) -> Column:
        n = _index(step)
        return F.coalesce(F.try_element_at(_object(x), F.lit(str(step))), *([_at(_array(x), n)] if n is not None else []))

    for step in _steps(path):
        v = _let(v, _with(one, step))
    return v


def as_text(v: Column) -> Column:
    """What ->> and #>> make of a value: a string as it is, null for JSON's null, all else shown."""
    return F.when(F.is_variant_null(v), F.lit(None)).when(typeof(v) == "string", F.try_variant_get(v, "$", "string")).otherwise(shown(v))


def get_text(v: Column, step: Step) -> Column:
    """v ->> step."""
    return _let(get(v, step), as_text)


def get_path_text(v: Column, path: list[Step] | str) -> Column:
    """v #>> path."""
    return _let(get_path(v, path), as_text)


def has_key(v: Column, key: str) -> Column:
    """v ? key: a key of an object, a string of an array, or the string itself."""
    same = lambda x: (typeof(x) == "string") & (F.try_variant_get(x, "$", "string") == key)
    found = lambda x: F.coalesce(F.map_contains_key(_object(x), key), F.exists(_array(x), same), same(x))
    return F.when(v.isNotNull(), _let(v, found))


def has_any(v: Column, keys: list[str]) -> Column:
    """v ?| keys."""
    found = F.lit(False)
    for k in keys:
        found = found | has_key(v, k)
    return F.when(v.isNotNull(), found)


def has_all(v: Column, keys: list[str]) -> Column:
    """v ?& keys."""
    found = F.lit(True)
    for k in keys:
        found = found & has_key(v, k)
    return F.when(v.isNotNull(), found)


def keys(v: Column) -> Column:
    """jsonb_object_keys as an array, in byte order."""
    return F.array_sort(F.map_keys(_object(v)))


def entries(v: Column) -> Column:
    """jsonb_each as an array of (key, value); explode it for rows."""
    return F.map_entries(_object(v))


def elements(v: Column) -> Column:
    """jsonb_array_elements as an array; explode it for rows."""
    return _array(v)


def array_length(v: Column) -> Column:
    return F.size(_array(v))


# Editing


def _with_key(m: Column, key: str, x: Column) -> Column:
    return _made(F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(F.lit(key), x)))


def _edited(v: Column, steps: list[Step], in_object: Callable[[Column, Column, str], Column], in_array: Callable[[Column, Column, int], Column]) -> Column:
    """v with the container of the path's last step changed: in_object(value, map, key) or in_array(value, array, index). Where the path leads nowhere, v stays."""
    key, n, last = str(steps[0]), _index(steps[0]), len(steps) == 1

    def inner(x: Column) -> Column:
        return _edited(x, steps[1:], in_object, in_array)

    def of_object(x: Column) -> Column:
        m = _object(x)
        return in_object(x, m, key) if last else F.when(F.map_contains_key(m, key), _with_key(m, key, inner(F.try_element_at(m, F.lit(key))))).otherwise(x)

    def of_array(x: Column) -> Column:
        if n is None:
            return F.raise_error(F.lit(f"path element {key!r} is not an integer")).cast("variant")
        a = _array(x)
        if last:
            return in_array(x, a, n)
        place = F.lit(n) if n >= 0 else F.size(a) + n
        return _made(F.transform(a, lambda e, i: F.when(i == place, inner(e)).otherwise(e)))

    return _let(v, lambda x: F.when(_object(x).isNotNull(), of_object(x)).when(_array(x).isNotNull(), of_array(x)).otherwise(x))


def _guarded(v: Column, new: Column | None, out: Column) -> Column:
    known = v.isNotNull() if new is None else v.isNotNull() & new.isNotNull()
    scalar = F.raise_error(F.lit("cannot set path in scalar")).cast("variant")
    return F.when(known, F.when(typeof(v).isin("object", "array"), out).otherwise(scalar))


def set_path(v: Column, path: list[Step] | str, new: Column, create: bool = True) -> Column:
    """jsonb_set(v, path, new, create): an index beyond an array's ends is put at that end. All steps but the last must exist."""
    place = lambda a, n: F.lit(n) if n >= 0 else F.size(a) + n

    def in_object(x: Column, m: Column, key: str) -> Column:
        return _with_key(m, key, new) if create else F.when(F.map_contains_key(m, key), _with_key(m, key, new)).otherwise(x)

    def in_array(x: Column, a: Column, n: int) -> Column:
        inside = (place(a, n) >= 0) & (place(a, n) < F.size(a))
        end = _made(F.concat(a, F.array(new)) if n >= 0 else F.concat(F.array(new), a))
        return F.when(inside, _made(F.transform(a, lambda e, i: F.when(i == place(a, n), new).otherwise(e)))).otherwise(end if create else x)

    steps = _steps(path)
    return _guarded(v, new, _edited(v, steps, in_object, in_array) if steps else v)


def insert_path(v: Column, path: list[Step] | str, new: Column, after: bool = False) -> Column:
    """jsonb_insert(v, path, new, after): before or after an array's element, or as a key that the object does not have yet."""

    def in_object(x: Column, m: Column, key: str) -> Column:
        there = F.raise_error(F.lit("cannot replace existing key")).cast("variant")
        return F.when(F.map_contains_key(m, key), there).otherwise(_with_key(m, key, new))

    def in_array(x: Column, a: Column, n: int) -> Column:
        at = (F.lit(n) if n >= 0 else F.size(a) + n) + (1 if after else 0)
        at = F.least(F.greatest(at, F.lit(0)), F.size(a))
        return _made(F.concat(F.slice(a, F.lit(1), at), F.array(new), F.slice(a, at + 1, F.size(a))))

    steps = _steps(path)
    return _guarded(v, new, _edited(v, steps, in_object, in_array) if steps else v)


def delete_path(v: Column, path: list[Step] | str) -> Column:
    """v #- path."""

    def in_array(x: Column, a: Column, n: int) -> Column:
        place = F.lit(n) if n >= 0 else F.size(a) + n
        return _made(F.filter(a, lambda e, i: i != place))

    steps = _steps(path)
    return _guarded(v, None, _edited(v, steps, lambda x, m, key: _made(F.map_filter(m, lambda k, _: k != key)), in_array) if steps else v)


def delete(v: Column, *what: Step) -> Column:
    """v - key, v - keys or v - index: keys of an object, strings or one element of an array."""
    if len(what) == 1 and isinstance(what[0], int):
        scalar = F.raise_error(F.lit("cannot delete from object using integer index")).cast("variant")
        return F.when(typeof(v) == "object", scalar).otherwise(delete_path(v, list(what)))
    names = [str(w) for w in what]
    strings = lambda a: F.filter(a, lambda e: ~F.coalesce((typeof(e) == "string") & F.try_variant_get(e, "$", "string").isin(names), F.lit(False)))
    return _guarded(v, None, _let(v, lambda x: F.when(_object(x).isNotNull(), _made(F.map_filter(_object(x), lambda k, _: ~k.isin(names)))).otherwise(_made(strings(_array(x))))))


def concat(a: Column, b: Column) -> Column:
    """a || b: objects are merged, the right one's keys counting; else both are arrays, or one element of one."""
    listed = lambda x: F.coalesce(_array(x), F.array(x))

    def merged(x: Column, y: Column) -> Column:
        kept = F.map_filter(_object(x), lambda k, _: ~F.map_contains_key(_object(y), k))
        return F.when(_object(x).isNotNull() & _object(y).isNotNull(), _made(F.map_concat(kept, _object(y)))).otherwise(_made(F.concat(listed(x), listed(y))))

    return F.when(a.isNotNull() & b.isNotNull(), _let(a, lambda x: _let(b, lambda y: merged(x, y))))


def build_object(**fields: Column) -> Column:
    """jsonb_build_object: a column's null becomes JSON's."""
    pairs = [x for k, c in fields.items() for x in (F.lit(k), F.coalesce(c.cast("variant"), F.parse_json(F.lit("null"))))]
    return _made(F.create_map(*pairs))


# Containment and paths


def _same(v: Column, value: object) -> Column:
    """v is this scalar; numbers are compared as numbers."""
    if value is None:
        return F.is_variant_null(v)
    if isinstance(value, bool):
        return (typeof(v) == "boolean") & (F.try_variant_get(v, "$", "boolean") == value)
    if isinstance(value, str):
        return (typeof(v) == "string") & (F.try_variant_get(v, "$", "string") == value)
    return (typeof(v) == "number") & _number_is(v, "==", value)


def _number_is(v: Column, op: str, value: float) -> Column:
    """Whole numbers are compared as decimals, others as doubles."""
    kind = "decimal(38,10)" if isinstance(value, int) else "double"
    return _compared(F.try_variant_get(v, "$", kind), op, F.lit(value).cast(kind))


def _compared(a: Column, op: str, b: Column) -> Column:
    return {"==": a == b, "!=": a != b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def contains(v: Column, pattern: object) -> Column:
    """v @> pattern, a Python value of dicts, lists and scalars: keys and elements may be more, in any order; an array also contains a scalar that is one of its elements."""

    def known(x: Column, p: object) -> Column:
        return F.when(x.isNotNull(), holds(x, p))

    def holds(x: Column, p: object, top: bool = False) -> Column:
        found = F.lit(True)
        if isinstance(p, dict):
            for k, q in p.items():
                found = found & F.coalesce(_let(F.try_element_at(_object(x), F.lit(k)), _with(known, q)), F.lit(False))
            return F.coalesce(_object(x).isNotNull() & found, F.lit(False))
        if isinstance(p, list):
            for q in p:
                found = found & F.exists(_array(x), _with(holds, q))
            return F.coalesce(_array(x).isNotNull() & found, F.lit(False))
        same = F.coalesce(_same(x, p), F.lit(False))
        return same | F.coalesce(F.exists(_array(x), lambda e: F.coalesce(_same(e, p), F.lit(False))), F.lit(False)) if top else same

    return F.when(v.isNotNull(), _let(v, lambda x: holds(x, pattern, True)))


PATH = re.compile(r'\s*(?:(\$|@)|\.\s*(\w+|"(?:[^"\\]|\\.)*"|\*)|\[\s*(\*|-?\d+|last)\s*\]|(\?)\s*\(|(\()|(\))|(&&|\|\|)|(==|!=|<>|<=|>=|<|>)|(!)|("(?:[^"\\]|\\.)*"|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)|(exists)\s*\()')


class _Path:
    """Reads a path in lax mode, and compiles it to what it does with an array of values."""

    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        text = text.strip().removeprefix("lax ")
        while text[at:].strip():
            m = PATH.match(text, at)
            if not m:
                raise ValueError(f"bad path at {text[at:]!r}")
            self.tokens.append((m.lastindex, m[m.lastindex]))
            at = m.end()
        self.k = 0

    def next(self, *kinds: int) -> str | None:
        """The next token if it is of one of these kinds."""
        if self.k < len(self.tokens) and self.tokens[self.k][0] in kinds:
            self.k += 1
            return self.tokens[self.k - 1][1]
        return None

    def must(self, *kinds: int) -> str:
        found = self.next(*kinds)
        if found is None:
            raise ValueError(f"bad path {self.text!r}")
        return found

    def whole(self) -> Callable[[Column], Column]:
        self.must(1)
        steps = self.steps()
        if self.k < len(self.tokens):
            raise ValueError(f"bad path {self.text!r}")
        return steps

    def steps(self) -> Callable[[Column], Column]:
        out: list[Callable[[Column], Column]] = []
        while True:
            if (name := self.next(2)) is not None:
                out.append(_member(None if name == "*" else json.loads(name) if name[0] == '"' else name))
            elif (n := self.next(3)) is not None:
                out.append(_element(n))
            elif self.next(4) is not None:
                test = self.either()
                self.must(6)
                out.append(_with(_kept, test))
            else:
                break

        def run(values: Column) -> Column:
            for step in out:
                values = step(values)
            return values

        return run

    def either(self) -> Callable[[Column], Column]:
        tests = [self.all()]
        while self.k < len(self.tokens) and self.tokens[self.k] == (7, "||"):
            self.k += 1
            tests.append(self.all())
        return lambda x: _folded([t(x) for t in tests], lambda a, b: a | b)

    def all(self) -> Callable[[Column], Column]:
        tests = [self.one()]
        while self.k < len(self.tokens) and self.tokens[self.k] == (7, "&&"):
            self.k += 1
            tests.append(self.one())
        return lambda x: _folded([t(x) for t in tests], lambda a, b: a & b)

    def one(self) -> Callable[[Column], Column]:
        if self.next(9) is not None:
            test = self.one()
            return lambda x: ~test(x)
        if self.next(5) is not None:
            test = self.either()
            self.must(6)
            return test
        if self.next(11) is not None:
            self.must(1)
            steps = self.steps()
            self.must(6)
            return lambda x: F.size(steps(F.array(x))) > 0
        self.must(1)
        steps, op, value = self.steps(), self.must(8), json.loads(self.must(10))
        return lambda x: F.exists(_unwrapped(steps(F.array(x))), lambda y: F.coalesce(_meets(y, op, value), F.lit(False)))


def _folded(tests: list[Column], f: Callable[[Column, Column], Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = f(out, t)
    return out


def _meets(v: Column, op: str, value: object) -> Column:
    if value is None or isinstance(value, bool):
        return {"==": _same(v, value), "!=": ~_same(v, value), "<>": ~_same(v, value)}.get(op, F.lit(None).cast("boolean"))
    if isinstance(value, str):
        return (typeof(v) == "string") & _compared(F.try_variant_get(v, "$", "string"), op, F.lit(value))
    return (typeof(v) == "number") & _number_is(v, op, value)


def _kept(values: Column, test: Callable[[Column], Column]) -> Column:
    return F.filter(_unwrapped(values), lambda x: F.coalesce(test(x), F.lit(False)))


def _unwrapped(values: Column) -> Column:
    """Arrays among the values give their elements."""
    return F.flatten(F.transform(values, lambda x: F.coalesce(_array(x), F.array(x))))


def _member(name: str | None) -> Callable[[Column], Column]:
    found = (lambda m: F.map_values(m)) if name is None else (lambda m: F.when(F.map_contains_key(m, name), F.array(F.try_element_at(m, F.lit(name)))))
    return lambda values: F.flatten(F.array_compact(F.transform(_unwrapped(values), lambda x: found(_object(x)))))


def _element(n: str) -> Callable[[Column], Column]:
    if n == "*":
        return _unwrapped
    place = F.lit(-1) if n == "last" else F.lit(int(n) + 1)
    outside = F.lit(int(n) < 0) if n != "last" else F.lit(False)
    return lambda values: F.filter(F.transform(values, lambda x: F.when(~outside, F.try_element_at(F.coalesce(_array(x), F.array(x)), place))), lambda x: x.isNotNull())


def path_query_array(v: Column, path: str) -> Column:
    """jsonb_path_query_array in lax mode, as an array of variants; explode it for jsonb_path_query.

    Paths have keys, .*, [n], [last], [*], and filters ?( … ) of comparisons with literals, exists( … ), &&, || and !.
    """
    run = _Path(path).whole()
    return F.when(v.isNotNull(), run(F.array(v)))


def path_query_first(v: Column, path: str) -> Column:
    return F.try_element_at(path_query_array(v, path), F.lit(1))


def path_exists(v: Column, path: str) -> Column:
    """v @? path."""
    return F.size(path_query_array(v, path)) > 0
