"""The trained models against plain counting, enumeration and decoding, and the ledger's ablation against its SQL."""

import itertools
import json
import math
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import chat_format, hidden_markov, language_id, quality_rules, queries
from marlstone.llm.common import crc_mod, stored

# Language ID


def grams(text):
    """Hashed byte n-grams of one to four bytes, one at a time."""
    data, out = (" " + text.lower() + " ").encode("utf-8", "surrogatepass"), Counter()
    for size in range(1, 5):
        for i in range(len(data) - size + 1):
            h = 0
            for k, byte in enumerate(data[i : i + size]):
                if k:
                    h ^= h >> 15
                h = (h + byte + 1) * 0x9E3779B1 & 0xFFFFFFFF
            out[h >> 18] += 1
    return out


TEXTS = [("en", "the cat sat on the mat"), ("de", "die Katze saß auf der Matte"), ("fr", "le chat était sur le tapis"), ("en", "a dog and a cat"), ("es", "el gato está en la alfombra"), ("de", "ein Hund"), ("fr", "日本 le chien"), ("en", "12 34"), (None, "no language"), ("en", None), ("es", "")]


def test_language_counts_are_those_of_all_texts(spark):
    df = spark.createDataFrame(TEXTS, "lang string, text string").selectExpr("*", "1 AS bucket", "2 AS n").repartition(3)
    want = defaultdict(Counter)
    for lang, text in TEXTS:
        if lang and text and any(c.isalpha() for c in text):
            want[lang].update(grams(text))
    assert {(r["lang"], r["bucket"]): r["n"] for r in language_id.counted(df).collect()} == {(x, b): n for x, c in want.items() for b, n in c.items()}


def test_language_decoding_by_hand(spark):
    """Weights, margins, losses and shares computed one at a time."""
    df = spark.createDataFrame(TEXTS, "lang string, text string")
    model = language_id.train(df)
    assert model.languages == ("de", "en", "es", "fr")
    words = {tuple(row) for row in model.code.tolist()}
    assert len(words) == 4 and all(0 < sum(c) < 4 for c in model.code.T.tolist())  # different words, no constant bit
    counts = {x: Counter() for x in model.languages}
    for lang, text in TEXTS:
        if lang and text and any(c.isalpha() for c in text):
            counts[lang].update(grams(text))
    size = language_id.BUCKETS
    share = {x: [(c[b] + 0.5) / (sum(c.values()) + 0.5 * size) for b in range(size)] for x, c in counts.items()}

    def weight(bit, bucket):
        sides = [[share[x][bucket] for x, code in zip(model.languages, model.code, strict=True) if code[bit] == side] for side in (1, 0)]
        return math.log(sum(sides[0]) / len(sides[0])) - math.log(sum(sides[1]) / len(sides[1]))

    bits = range(model.code.shape[1])
    assert all(weight(b, k) == pytest.approx(model.weights[k, b]) for b in bits for k in range(0, size, 997))
    asked = [(1, "the cat"), (2, "die Hund"), (3, "日本"), (4, "x " * 4000), (5, None), (6, "12 !"), (7, "")]
    rows = spark.createDataFrame(asked, "lang_pred int, text string").selectExpr("lang_pred AS score", "text", "text AS features", "1 AS ambiguous_", "2 AS _text")
    got = {r["score"]: r for r in language_id.predict(rows, model, ["score", "features", "_text"], ("found", "share", "unclear")).collect()}
    for i, text in asked[:4]:
        f = grams(text)
        n = sum(f.values())
        margins = [sum(c * model.weights[k, b] for k, c in f.items()) / n * (50 * n / (n + 50)) for b in bits]
        loss = {x: sum(model.trust[b] * math.log1p(math.exp(-margins[b] * (2 * int(code[b]) - 1))) for b in bits) for x, code in zip(model.languages, model.code, strict=True)}
        best, second = sorted(loss, key=lambda x: (loss[x], x))[:2]
        assert got[i]["found"] == best and got[i]["share"] == pytest.approx(1 / (1 + math.exp(loss[best] - loss[second])))
        assert got[i]["unclear"] == (got[i]["share"] < language_id.CLEAR)
    assert all((got[i]["found"], got[i]["share"]) == ("und", 0.0) for i in (5, 6, 7))
    assert language_id.predict(rows.limit(0), model, ["score"]).collect() == []


# Hidden Markov model

LINES = ["a b a", "b a", "c", "", None, "a x y", "z", "B q a", "a b", "unseen a"]


def test_scores_by_all_paths_of_states(spark):
    """The score column against the sum over every sequence of states, with the words of shared classes spelled out."""
    df = spark.createDataFrame(list(enumerate(LINES)), "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS classes", "3 AS score").repartition(2)
    held, kinds = crc_mod("doc_id", 7) == 2, dict(classes=2, head=3, states=2, rounds=2)
    got = {r["doc_id"]: r for r in hidden_markov.scored(df, held, stored, **kinds).collect()}
    counts = hidden_markov.counted(df.where(~held))
    vocab = hidden_markov.vocabulary(counts, df.where(~held).count(), kinds["classes"], kinds["head"])
    model = hidden_markov.train(stored(hidden_markov.encoded(df, held, vocab), "encoded"), vocab, kinds["states"], kinds["rounds"])
    seen = Counter(w for i, t in enumerate(LINES) if not got[i]["held_out"] for w in (t or "").lower().encode().split())
    own = sorted(seen, key=lambda w: (-seen[w], w))[:2]
    shared = defaultdict(list)
    for w in seen:
        if w not in own:
            shared[hidden_markov.shared_class(w)].append(w)

    def emission(word, state):
        if word is None:
            return model.emit[len(own), state]
        if word in own:
            return model.emit[own.index(word), state]
        k = hidden_markov.shared_class(word)
        return model.emit[len(own) + 1 + k, state] * (seen[word] + 1) / (sum(seen[w] for w in shared[k]) + len(shared[k]) + 1)

    for i, text in enumerate(LINES):
        words = [*(text or "").lower().encode().split(), None]
        total = 0.0
        for path in itertools.product(range(2), repeat=len(words)):
            p = model.start[path[0]]
            for a, b in itertools.pairwise(path):
                p *= model.move[a, b]
            for word, state in zip(words, path, strict=True):
                p *= emission(word, state)
            total += p
        assert got[i]["score"] == pytest.approx(math.log10(total), rel=1e-9)
    assert {i for i in got if got[i]["held_out"]} and any(w not in seen for w in (b"unseen", b"z", b"q"))


def test_emissions_of_a_state_add_up_to_one(spark):
    df = spark.createDataFrame(list(enumerate(LINES)), "doc_id long, text string")
    vocab = hidden_markov.vocabulary(hidden_markov.counted(df), df.count(), 2, 3)
    model = hidden_markov.train(stored(hidden_markov.encoded(df, F.lit(False), vocab), "encoded"), vocab, 2, 1)
    assert np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.move.sum(axis=1), 1) and math.isclose(model.start.sum(), 1)


# Chat layouts, from records to a loss mask and back


def test_layouts_become_one_format(spark):
    records = [
        {"messages": [{"role": "system", "content": "be [INST] kind"}, {"role": "human", "content": "q\n1"}, {"role": "assistant", "content": "</s> a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a<|im_end|>"}, {"from": "human", "value": ""}, {"from": "gpt", "value": "b"}]},
        {"instruction": "do", "input": "this", "output": "done"},
        {"prompt": "p", "completion": "c"},
        {"question": "q?", "answer": "x" * 50_000},
    ]
    df = spark.createDataFrame([(k, json.dumps(r), "t") for k, r in enumerate(records)], "conv_id int, record string, t string").selectExpr("conv_id", "0 AS position", "record", "t AS role")
    read = {r["conv_id"]: r for r in chat_format.parsed(chat_format.formatted(chat_format.canonical(df))).collect()}
    want = {
        0: [("system", "be [INST] kind"), ("user", "q\n1"), ("assistant", "</s> a")],
        1: [("user", "q"), ("assistant", "a<|im_end|>"), ("user", ""), ("assistant", "b")],
        2: [("user", "do"), ("user", "this"), ("assistant", "done")],
        3: [("user", "p"), ("assistant", "c")],
        4: [("user", "q?"), ("assistant", "x" * 50_000)],
    }
    for k, turns in want.items():
        assert [tuple(t)[:2] for t in read[k]["turns"]] == turns
        assert list(read[k]["loss_texts"]) == [t for role, t in turns if role == "assistant"]


def test_empty_chat_tables(spark):
    none = spark.createDataFrame([], "conv_id int, position int, record string")
    assert chat_format.canonical(none).collect() == [] and chat_format.formatted(chat_format.canonical(none)).collect() == []
    rows = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert chat_format.parsed(chat_format.formatted(chat_format.canonical(chat_format.turn_records(rows)))).collect() == []


# Ledger


def test_ablation_agrees_with_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = con.execute(queries.ABLATION_SQL).fetchall()
    df = queries.quality_ablation(spark, sf)
    assert sorted(c[0] for c in con.description) == sorted(df.columns)
    assert sorted(map(tuple, df.select([c[0] for c in con.description]).collect())) == sorted(want)


def test_a_second_version_of_a_policy_on_a_stored_ledger(spark):
    docs = spark.createDataFrame([(1, "word " * 20), (2, "# " * 30 + "w"), (3, "few"), (4, None)], "doc_id long, text string")
    entries = stored(quality_rules.ledger(docs), "ledger")
    first, second = quality_rules.Policy("p", 1, (0,)), quality_rules.Policy("p", 2, (0, 2))
    kept = {v: {r["doc_id"] for r in entries.where(quality_rules.passes(policy)).collect()} for v, policy in ((1, first), (2, second))}
    assert kept == {1: {1, 2}, 2: {1}}
    rows = {(r["version"], r["bit"]): (r["n_failed"], r["n_only_this"]) for p in (first, second) for r in quality_rules.ablation(entries, p).collect()}
    assert rows == {(1, 0): (2, 2), (2, 0): (2, 2), (2, 2): (1, 1)}
