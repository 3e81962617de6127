"""Components against brute force over all pairs, on texts with many near copies, shared passages and odd rows."""

import random
import re

import numpy as np
import pytest

from marlstone.llm import jaccard_groups
from marlstone.llm.common import stored

SCHEMA = "doc_id long, text string"


def brute(rows, size=3, percent=90):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and 100 * len(a & b) >= percent * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), d if not sets[i] else least.get(find(i))) for i, (d, _) in enumerate(rows))


def near(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        k = rng.randrange(len(out))
        out[k] = f"x{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    pool = [f"w{k}" for k in range(60)]
    out = []
    for length in (12, 30, 31, 33, 90, 200, 400):
        base = [rng.choice(pool) if length < 100 else f"b{length}_{k}" for k in range(length)]
        for _ in range(25):
            out.append(near(rng, base, rng.randrange(0, max(2, length // 25))))
        for k in range(6):  # containments at the edge of the threshold
            out.append(" ".join(base[: length - k * length // 40]))
    passage = [f"p{k}" for k in range(60)]
    for k in range(40):
        out.append(" ".join([*passage, *(f"u{k}_{j}" for j in range(k % 9))]))
    out += ["a b", "a b", "A B", "b a", "one", "", " \n", "z" * 100_000, "p0 p1 p2"]
    rows = list(enumerate(out)) + [(700, None), (None, "a b"), (3, out[3])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("tokens, size, percent", [(1 << 17, 3, 90), (400, 3, 90), (400, 5, 80), (1 << 17, 1, 90)])
def test_components_match_brute_force(spark, rows, monkeypatch, tokens, size, percent):
    monkeypatch.setattr(jaccard_groups, "GROUP_TOKENS", tokens)
    monkeypatch.setattr(jaccard_groups, "ASKING_TOKENS", 2 * tokens)
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "1 AS n", "2 AS sid", "3 AS gid")
    got = sorted((tuple(r) for r in jaccard_groups.linked_components(docs, stored, size, percent).collect()), key=str)
    key = lambda r: str(r)
    assert got == sorted((r if r[0] is not None else (None, *r[1:]) for r in brute_with_null(rows, size, percent)), key=key)


def brute_with_null(rows, size, percent):
    named = [(10**9 if d is None else d, t) for d, t in rows]
    return [(None if d == 10**9 else d, n, c) for d, n, c in brute(named, size, percent)]


def test_empty_table(spark):
    assert jaccard_groups.linked_components(spark.createDataFrame([], SCHEMA), stored).collect() == []


@pytest.mark.parametrize("percent", [50, 80, 90, 97])
def test_linked_sets_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    up = lambda a, b: -(-a // b)
    tried = 0
    for n in [*range(1, 120), 337, 1000, 5000]:
        for m in {n, n + 1, 100 * n // percent, 100 * n // percent - 1}:
            o = up(percent * (n + m), 100 + percent)  # the least overlap of linked sets
            if m < n or o > n or n == m == o:
                continue
            both = rng.permutation(np.unique(rng.integers(0, 1 << 63, n + m, np.uint64)))
            x, y = np.sort(both[:n]), np.sort(np.concatenate([both[:o], both[n : n + m - o]]))
            assert 100 * o >= percent * (n + m - o) and len(x) == n and len(y) == m
            s, of, least = jaccard_groups.signatures([x, y], percent)
            shared = set(s[of == 0]) & set(s[of == 1])
            assert shared and len(shared) >= max(least), (n, m)
            tried += 1
    assert tried > 100


def test_links_at_the_threshold(spark):
    """Sets of 100 and 109 words with 99 in common are linked exactly; a third of 110 words is there to mislead bounds by group."""
    common = [f"c{k}" for k in range(99)]
    x, y = [*common, "x0"], [*common, *(f"y{k}" for k in range(10))]
    z = [*common[:89], *(f"z{k}" for k in range(21))]
    w = [*common[1:], "x0", "w0"]
    texts = [" ".join(t) for t in (x, y, z, w)] + [" ".join([f"f{k}", *common[:9]]) for k in range(30)]
    rows = list(enumerate(texts, 1))
    for percent in (90, 80):
        got = sorted(map(tuple, jaccard_groups.linked_components(spark.createDataFrame(rows, SCHEMA), stored, 1, percent).collect()))
        assert got == brute(rows, 1, percent)
    assert got[0][2] == got[1][2] == 1
    for m in (109, 110, 111):
        rows = [(1, " ".join(x)), (2, " ".join([*common, *(f"y{k}" for k in range(m - 99))]))]
        got = sorted(map(tuple, jaccard_groups.linked_components(spark.createDataFrame(rows, SCHEMA), stored, 1).collect()))
        assert got == brute(rows, 1, 90) and (got[1][2] == 1) == (m == 109)
