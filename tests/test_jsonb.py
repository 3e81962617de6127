"""jsonb functions, each case with what PostgreSQL's manual and its rules give."""

import json

import pytest
from pyspark.sql import functions as F

from marlstone.functions import jsonb as J

DOC = '{"a": {"b": [1, {"c": null}, "x"], "k": true}, "n": null, "s": "text", "f": 1.5}'


def read(text):
    """JSON as values; other texts as they are."""
    try:
        return json.loads(text)
    except ValueError:
        return text


@pytest.fixture(scope="module")
def ask(spark):
    """Values of expressions on a document, all in one plan."""

    def run(cases, doc=DOC):
        df = spark.createDataFrame([(doc,)], "d string").select(J.parsed(F.col("d")).alias("v"))
        got = df.select(*(f(F.col("v")).alias(f"c{i}") for i, f in enumerate(cases))).first()
        return [read(x) if isinstance(x, str) else x for x in got]

    return run


def lit(text):
    return J.parsed(F.lit(text))


def test_reading(ask):
    got = ask([
        lambda v: J.shown(J.get(v, "f")), lambda v: J.shown(J.get_path(v, "{a,b,1,c}")), lambda v: J.shown(J.get_path(v, ["a", "b", -1])), lambda v: J.get_path_text(v, "{a,b,-1}"),
        lambda v: J.get_text(v, "n"), lambda v: J.get_text(v, "none"), lambda v: J.shown(J.get_path(v, "{a,b,9}")), lambda v: J.shown(J.get_path(v, "{s,b}")), lambda v: J.get_text(v, "s"),
        lambda v: J.shown(J.get(J.get_path(v, "{a,b}"), 0)), lambda v: J.array_length(J.get_path(v, "{a,b}")), lambda v: J.array_length(v), lambda v: J.get_path_text(v, "{a,k}"), lambda v: J.shown(J.get(v, 0)),
    ])
    assert got == [1.5, None, "x", "x", None, None, None, None, "text", 1, 3, None, True, None]


def test_kinds_keys_and_entries(ask, spark):
    kinds = ask([lambda v, p=p: J.typeof(J.get_path(v, p)) for p in ("{a}", "{a,b}", "{n}", "{s}", "{f}", "{a,k}", "{none}")])
    assert kinds == ["object", "array", None, "string", "number", "boolean", None]  # the third is read as JSON's null
    got = ask([lambda v: J.has_key(v, "a"), lambda v: J.has_key(v, "b"), lambda v: J.has_key(J.get_path(v, "{a,b}"), "x"), lambda v: J.has_key(J.get(v, "s"), "text"), lambda v: J.has_key(v, "n"), lambda v: J.has_any(v, ["z", "s"]), lambda v: J.has_all(v, ["z", "s"]), lambda v: J.has_all(v, ["n", "s"])])
    assert got == [True, False, True, True, True, True, False, True]
    df = spark.createDataFrame([(DOC,), (None,)], "d string").select(J.parsed(F.col("d")).alias("v"))
    assert [r[0] for r in df.select(J.keys(F.col("v"))).collect()] == [["a", "f", "n", "s"], None]
    assert [(r["key"], r["t"]) for r in df.select(F.explode(J.entries(F.col("v"))).alias("e")).select("e.key", J.as_text(F.col("e.value")).alias("t")).where("key <> 'a'").orderBy("key").collect()] == [("f", "1.5"), ("n", None), ("s", "text")]


SMALL = '{"a": [1, 2, 3], "b": {"c": 4}, "d": null}'


def test_set(ask):
    new = lit('{"z": [null]}')
    cases = {
        ("{b,c}", True): {"b": {"c": {"z": [None]}}}, ("{b,x}", True): {"b": {"c": 4, "x": {"z": [None]}}}, ("{b,x}", False): {}, ("{a,0}", True): {"a": [{"z": [None]}, 2, 3]}, ("{a,-1}", False): {"a": [1, 2, {"z": [None]}]},
        ("{a,9}", True): {"a": [1, 2, 3, {"z": [None]}]}, ("{a,-9}", True): {"a": [{"z": [None]}, 1, 2, 3]}, ("{a,9}", False): {}, ("{x,y}", True): {}, ("{d,y}", True): {}, ("{e}", True): {"e": {"z": [None]}}, ("{d}", False): {"d": {"z": [None]}}, ("{}", True): {},
    }
    got = ask([lambda v, p=p, c=c: J.shown(J.set_path(v, p, new, c)) for p, c in cases], SMALL)
    assert got == [json.loads(SMALL) | x for x in cases.values()]
    assert ask([lambda v: J.shown(J.set_path(v, "{a}", F.lit(None).cast("variant"))), lambda v: J.shown(J.set_path(v, "{d}", lit("null")))], SMALL) == [None, json.loads(SMALL)]
    with pytest.raises(Exception, match="not an integer"):
        ask([lambda v: J.shown(J.set_path(v, "{a,x}", new))], SMALL)
    with pytest.raises(Exception, match="scalar"):
        ask([lambda v: J.shown(J.set_path(v, "{a}", new))], "5")


def test_deep_paths_keep_plans_small(ask):
    doc, path = 1, []
    for k in range(7):
        doc, path = ({f"k{k}": doc}, [f"k{k}", *path]) if k % 2 else ([0, doc], [1, *path])
    got = ask([lambda v: J.shown(J.set_path(v, path, lit("2"))), lambda v: J.shown(J.delete_path(v, path))], json.dumps(doc))
    for step in path[:-1]:
        doc, *got = (x[step] for x in (doc, *got))
    assert doc[path[-1]] == 1 and got[0] == ([0, 2] if path[-1] == 1 else {path[-1]: 2}) and got[1] == ([0] if path[-1] == 1 else {})


def test_insert(ask):
    new = lit('"i"')
    cases = {("{a,1}", False): {"a": [1, "i", 2, 3]}, ("{a,1}", True): {"a": [1, 2, "i", 3]}, ("{a,-1}", False): {"a": [1, 2, "i", 3]}, ("{a,-1}", True): {"a": [1, 2, 3, "i"]}, ("{a,8}", False): {"a": [1, 2, 3, "i"]}, ("{a,-8}", False): {"a": ["i", 1, 2, 3]}, ("{b,n}", False): {"b": {"c": 4, "n": "i"}}}
    assert ask([lambda v, p=p, a=a: J.shown(J.insert_path(v, p, new, a)) for p, a in cases], SMALL) == [json.loads(SMALL) | x for x in cases.values()]
    with pytest.raises(Exception, match="existing key"):
        ask([lambda v: J.shown(J.insert_path(v, "{b,c}", new))], SMALL)


def test_delete(ask):
    cases = {"{b,c}": {"b": {}}, "{a,0}": {"a": [2, 3]}, "{a,-1}": {"a": [1, 2]}, "{a,7}": {}, "{x}": {}, "{b,x,y}": {}}
    assert ask([lambda v, p=p: J.shown(J.delete_path(v, p)) for p in cases], SMALL) == [json.loads(SMALL) | x for x in cases.values()]
    assert ask([lambda v: J.shown(J.delete(v, "a")), lambda v: J.shown(J.delete(v, "a", "d", "x"))], SMALL) == [{"b": {"c": 4}, "d": None}, {"b": {"c": 4}}]
    assert ask([lambda v: J.shown(J.delete(v, "x")), lambda v: J.shown(J.delete(v, 1)), lambda v: J.shown(J.delete(v, -1)), lambda v: J.shown(J.delete(v, 5))], '["x", null, 1, "x"]') == [[None, 1], ["x", 1, "x"], ["x", None, 1], ["x", None, 1, "x"]]


def test_concat_and_build(ask, spark):
    got = ask([lambda v: J.shown(J.concat(v, lit('{"a": 0, "z": 1}'))), lambda v: J.shown(J.concat(J.get(v, "a"), lit("[9]"))), lambda v: J.shown(J.concat(v, lit("[9]"))), lambda v: J.shown(J.concat(lit("1"), lit("null"))), lambda v: J.shown(J.concat(v, F.lit(None).cast("variant")))], SMALL)
    assert got == [json.loads(SMALL) | {"a": 0, "z": 1}, [1, 2, 3, 9], [json.loads(SMALL), 9], [1, None], None]
    built = J.shown(J.build_object(a=F.lit(1), b=F.lit(None).cast("string"), c=lit("[1]"), d=F.lit("x")))
    assert json.loads(spark.range(1).select(built).first()[0]) == {"a": 1, "b": None, "c": [1], "d": "x"}


def test_containment(ask):
    yes = [{}, {"a": {}}, {"a": {"b": [1]}}, {"a": {"b": ["x", 1.0, 1]}}, {"a": {"b": [{}]}}, {"a": {"b": [{"c": None}]}}, {"n": None}, {"f": 1.5}]
    no = [[], {"x": None}, {"a": {"b": {}}}, {"a": {"b": [2]}}, {"a": {"b": [[1]]}}, {"s": ["text"]}, {"a": {"b": 1}}, {"a": {"k": 1}}, {"n": False}, 5]
    assert ask([lambda v, p=p: J.contains(v, p) for p in yes + no]) == [True] * len(yes) + [False] * len(no)
    assert ask([lambda v: J.contains(v, "x"), lambda v: J.contains(v, 2), lambda v: J.contains(v, [1, "x"]), lambda v: J.contains(v, [[1]])], '["x", 1, [1]]') == [True, False, True, True]


PATHS = {
    "$.a.b": [[1, {"c": None}, "x"]], "$.a.b[*]": [1, {"c": None}, "x"], "$.a.b[1].c": [None], "$.a.b.c": [None], "$.a.b[last]": ["x"], "$.a.b[7]": [], "$.none": [], '$."s"': ["text"], "$.f[0]": [1.5], "$.a.b[*] ? (@ == 1)": [1],
    "$.a.b ? (@ >= 1 || @ == \"x\")": [1, "x"], "$.a ? (@.k == true && @.b == 1).b[0]": [1], "$.a ? (!(@.k == true))": [], "$.* ? (@ == null)": [None], "$ ? (exists(@.a.b)).s": ["text"], "$.a ? (exists(@.q))": [], "$.f ? (@ > 1.2 && @ < 1.6)": [1.5], "lax $.s": ["text"],
}


def test_paths(ask):
    got = ask([lambda v, p=p: F.to_json(J.path_query_array(v, p)) for p in PATHS])
    assert dict(zip(PATHS, got, strict=True)) == PATHS
    assert ask([lambda v: J.path_exists(v, "$.a.b ? (@ == 5)"), lambda v: J.path_exists(v, "$.n"), lambda v: J.shown(J.path_query_first(v, "$.a.b[*]")), lambda v: J.shown(J.path_query_first(v, "$.z"))]) == [False, True, 1, None]
    for bad in ("$.", "a.b", "$.a ? (@ ==)", "$.a)", "$[x]"):
        with pytest.raises(ValueError, match="bad path"):
            J.path_query_array(F.col("v"), bad)


def test_nulls_give_null(ask, spark):
    v = F.lit(None).cast("variant")
    fs = [J.typeof, lambda v: J.has_key(v, "a"), lambda v: J.has_any(v, ["a"]), lambda v: J.contains(v, {}), lambda v: J.shown(J.set_path(v, "{a}", lit("1"))), lambda v: J.shown(J.delete(v, "a")), lambda v: J.shown(J.delete_path(v, "{a}")), lambda v: J.path_query_array(v, "$.a").isNull(), J.array_length]
    got = spark.range(1).select(*(f(v).alias(f"c{i}") for i, f in enumerate(fs))).first()
    assert [x for i, x in enumerate(got) if i != 7] == [None] * 8 and got[7] is True
