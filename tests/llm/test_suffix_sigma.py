"""Collocations against a count of all n-grams in Python, and the query's SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from marlstone.llm import queries, suffix_sigma
from marlstone.llm.common import stored


def expected(rows, max_n=3, min_count=10, absorbed=50, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for i in range(len(w)) for m in range(1, max_n + 1) if i + m <= len(w))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= min_count}
    gone = set()
    for (lang, w), a in candidates.items():
        shorter = ((lang, w[i : i + m]) for m in range(2, len(w)) for i in range(len(w) - m + 1))
        gone.update(k for k in shorter if 100 * a >= absorbed * candidates[k])
    out = defaultdict(list)
    for (lang, w), a in candidates.items():
        if (lang, w) not in gone:
            score, k = min((1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, rank, p.decode(), -a, x, y, n[lang], -score) for lang, v in out.items() for rank, (score, a, p, x, y) in enumerate(sorted(v)[:top], 1))


def made(spark, rows, columns="lang string, text string"):
    return spark.createDataFrame(rows, columns)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["the", "The", "of", "a", "a\x01b", "a\x00", "zé", "日本", "%20", "und", "\x1cx", "q"]
    parts = [" ", " ", " ", "\t", "  ", ", ", ". ", "\n", "\r\n", "\x0b", "!"]
    texts = ["".join(rng.choice(words) + rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    out = [(rng.choice(["en", "en", "fr", None, "und", "a b", "a%20b", "", "x\n"]), t) for t in texts]
    return [*out, ("en", None), (None, ""), ("zz", " ., "), out[0], out[0], ("en", "w " * 30_000), ("en", "".join(f"x y u{k}, " for k in range(500)))]


@pytest.mark.parametrize(("max_n", "top"), [(3, 2000), (4, 7), (2, 1)])
def test_counts(spark, rows, max_n, top):
    df = made(spark, rows).selectExpr("lang", "text", "1 AS n", "2 AS key", "3 AS part", "4 AS w")
    got = suffix_sigma.collocations(df, stored, max_n=max_n, min_count=4, top=top).collect()
    assert sorted(map(tuple, got)) == expected(rows, max_n, 4, top=top)


def keyed(df):
    return {tuple(r) for r in df.select("words", *suffix_sigma.key_names(3), "n").collect()}


def test_ranges_at_every_place(spark, rows):
    """A prefix that spans ranges is counted whole, wherever the ranges begin."""
    df = made(spark, rows)
    counts = suffix_sigma.suffix_counts(df, 3, [])
    keys = sorted({tuple(r) for r in counts.select(suffix_sigma.key_names(3)).collect()})
    want = keyed(suffix_sigma.grams(counts, 1, 3, 4))
    x = suffix_sigma.code_of(b"x")
    for bounds in (keys[::7], keys[3::40], [k for k in keys if k[1] == x]):
        assert keyed(suffix_sigma.grams(suffix_sigma.suffix_counts(df, 3, bounds), len(bounds) + 1, 3, 4)) == want


def test_stack_over_any_cut_of_the_rows(rows):
    """Batches may end anywhere inside a prefix."""
    codes = suffix_sigma.Codes()
    words = [np.vstack([np.full(s.shape[1], suffix_sigma.lang_code(lang)), s]) for lang, t in rows for s in [suffix_sigma.suffixes(suffix_sigma.coded((t or "").encode()[:400], codes), 3)]]
    keys, n = suffix_sigma.counted(np.hstack(words))
    keys, n = keys[:, ::-1], n[::-1]

    def counts(size):
        stack = suffix_sigma.Stack(3, 4)
        for start in range(0, len(n), size):
            stack.push(keys[:, start : start + size], n[start : start + size], start == 0)
        stack.end()
        return sorted(map(tuple, zip(*(c.to_pylist() for c in stack.taken().columns), strict=True)))

    want = Counter()
    for k, m in zip(keys.T.tolist(), n.tolist(), strict=True):
        for d in range(4):
            if d == 0 or k[d]:
                want[(d, *k[: d + 1], *[0] * (3 - d))] += m
    whole = counts(len(n))
    assert {k[:-1]: k[-1] for k in whole}.items() <= want.items() and {k for k, m in want.items() if m >= 4} <= {k[:-1] for k in whole}
    assert all(counts(size) == whole for size in (1, 2, 3, 50))


def test_counts_are_passed_on_in_parts(spark, rows, monkeypatch):
    monkeypatch.setattr(suffix_sigma, "HELD", 20)
    monkeypatch.setattr(suffix_sigma, "KNOWN", 5)
    counts = suffix_sigma.suffix_counts(made(spark, rows).coalesce(1), 3, [])
    assert counts.count() > counts.select(suffix_sigma.key_names(3)).distinct().count()
    assert sorted(map(tuple, suffix_sigma.collocations(made(spark, rows), stored, min_count=4).collect())) == expected(rows, min_count=4)


def test_products_beyond_64_bits(spark):
    """Counts of this size are put in where tasks would have counted them."""
    a, b = 3_000_000_019, 2_999_999_929
    rows = [(0, 7, 8, 9, b), (0, 7, 8, 0, a - b), (0, 7, 9, 0, 5)]
    counts = spark.createDataFrame(rows, suffix_sigma.schema_of("part", 2))
    assert {tuple(r) for r in suffix_sigma.grams(counts, 1, 2, 10).collect()} == {(0, 7, 0, 0, a + 5), (1, 7, 8, 0, a), (2, 7, 8, 9, b)}
    parts = spark.createDataFrame([(7, [8], a), (7, [9], b + 5)], "w0 long, part array<long>, n long")
    scored = suffix_sigma.scored(spark.createDataFrame([(7, [8, 9], 2, b)], "w0 long, w array<long>, words int, a long"), parts)
    assert scored.first()["b"]["score"] == 1000000 * b * b // (a * (b + 5))


def test_two_words_of_one_code_are_an_error(spark, monkeypatch):
    docs = made(spark, [("en", "a b a b c")])
    codes = spark.createDataFrame([(suffix_sigma.code_of(b"a"),)], "code long")
    assert [tuple(r) for r in suffix_sigma.spelled(docs, codes).collect()] == [(suffix_sigma.code_of(b"a"), "a")]
    spread = docs.union(docs)
    assert suffix_sigma.spelled(spread, codes).count() == 1
    monkeypatch.setattr(suffix_sigma, "code_of", lambda word: 5)
    with pytest.raises(Exception, match="two words have the same code"):
        suffix_sigma.spelled(docs, spark.createDataFrame([(5,)], "code long")).collect()


def test_codes_are_forgotten_and_found_again(monkeypatch):
    monkeypatch.setattr(suffix_sigma, "KNOWN", 4)
    codes = suffix_sigma.Codes()
    text = b"a b. c d\te  f\na b"
    want = [suffix_sigma.BREAK if w == "." else suffix_sigma.code_of(w.encode()) for w in "a b . c d e f . a b".split()]
    assert suffix_sigma.coded(text, codes).tolist() == want and len(codes) <= 6
    assert suffix_sigma.suffixes(np.array([5, 6, 1, 7]), 3).tolist() == [[5, 6, 7], [6, 0, 0], [0, 0, 0]]


def test_empty_table(spark):
    assert suffix_sigma.collocations(made(spark, []), stored).collect() == []
    assert suffix_sigma.collocations(made(spark, [(None, None), ("en", "one two")]), stored).collect() == []


def test_query_agrees_with_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    df = queries.op13_suffix_sigma(spark, sf)
    want = con.execute(queries.OP13_SQL).fetchall()
    assert [c[0] for c in con.description] == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(want)
    docs = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(want) == expected(docs)
