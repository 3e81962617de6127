"""The operators on small tables with nulls, empty and long texts, ties, repeated rows, clashing column names; brute force or round trips."""

import collections
import hashlib
import html
import itertools
import json
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import bpe_words, chat_format, exact_digest, hidden_markov, language_id, packing, quality_rules, site_style, token_files, tokens
from marlstone.llm.common import crc_mod, stored

TEXTS = ["one two three four five six seven eight nine ten eleven.", "", None, " \n\t ", "a" * 50_000, "x y z\n" * 30, "Ünïcode  TEXT here", "don't 12 <|endoftext|> end", "dup dup", "dup dup", "日本 語"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, " \n\t "), (4, "same id")]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS lang", "1 AS n", "2 AS words", "3 AS row", "4 AS file")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def encoder():
    return tokens.codec(**tokens.public_codec())


def texts_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def by_text(rows):
    return sorted(rows, key=str)


def test_separator_scan_blocks(spark, docs, empty, encoder):
    blocks = token_files.document_blocks(docs, end_id=50256, block=64, **tokens.public_codec())
    got = [(r["doc_id"], r["n_tokens"]) for r in token_files.documents_of(blocks, 50256).collect()]
    assert by_text(got) == by_text([(d, len(encoder.encode_ordinary(t))) for d, t in texts_of(docs)])
    assert token_files.documents_of(token_files.document_blocks(empty, end_id=50256, **tokens.public_codec()), 50256).collect() == []


@pytest.mark.parametrize("width", [2, 4])
def test_separator_scan_files(spark, tmp_path, width):
    runs = {"a.bin": [5, 6, 0, 0, 7, 8, 9, 10, 11, 12, 13, 0, 4], "b.bin": [1, 0], "c.bin": [], "d.bin": [3, 3]}
    for name, ids in runs.items():
        (tmp_path / name).write_bytes(np.array(ids, f"<u{width}").tobytes())
    blocks = token_files.file_blocks(spark, str(tmp_path), width=width, block=3)
    got = sorted((r["file"][-5:], r["ordinal"], r["start"], r["n_tokens"]) for r in token_files.documents_of(blocks, 0, width).collect())
    assert got == [("a.bin", 0, 0, 2), ("a.bin", 1, 3, 0), ("a.bin", 2, 4, 7), ("b.bin", 0, 0, 1)]
    assert sorted((r["file"][-5:], r["start"], r["n_tokens"]) for r in token_files.unended(blocks, 0, width).collect()) == [("a.bin", 12, 1), ("d.bin", 0, 2)]


PAGE = """<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Head {0} &amp; line</h1><p><b>First   para {0}<br><p>Second para {0} &lt;x&gt;</p><ul><li>one<li>two {0}</ul><div class="share">Share</div></article>
<div id="comments"><p>Nice {0}</p></div><aside>Side</aside><form>Name <input></form><script>var t="</p>";</script><footer>&copy; me</footer></body></html>"""


def test_pages(spark):
    rows = [(k, f"http://h.org/{k}", PAGE.format(f"u{k}")) for k in range(12)]
    rows += [(50, None, None), (51, "http://b.org", ""), (52, "http://b.org", "plain <b>text</b> &eacute;"), (53, "bad url", "<div><p>open"), (0, "http://h.org/0", PAGE.format("u0"))]
    got = site_style.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS path"), stored).collect()
    assert len(got) == len(rows)
    found = {r["page_id"]: r["text"] for r in got}
    assert found[3] == "Head u3 & line\nFirst para u3\nSecond para u3 <x>\none\ntwo u3"
    assert (found[50], found[51], found[52], found[53]) == ("", "", "plain text é", "open")
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_style_tree_removes_what_a_host_repeats(spark):
    page = "<body><div class=x><p>Same words on all pages</p></div><div class=y><p>Own words {0}</p></div></body>"
    rows = [(k, "http://h.org", page.format(k)) for k in range(20)]
    got = site_style.extracted(spark.createDataFrame(rows, "page_id long, url string, html string"), stored)
    assert {r["text"] for r in got.collect()} == {f"Own words {k}" for k in range(20)}


def test_layouts_that_small_hosts_share(spark):
    page = "<body><div class=x><p>Same words on all pages</p></div><div class=y><p>Own words {0}</p></div></body>"
    rows = [(k, f"http://h{k // 2}.org", page.format(k)) for k in range(20)]
    got = site_style.extracted(spark.createDataFrame(rows, "page_id long, url string, html string"), stored)
    assert {r["text"] for r in got.collect()} == {f"Own words {k}" for k in range(20)}


def test_tree_decides_where_names_tell_nothing(spark):
    """The pages of the test data with their article and adverts as divs of names without meaning: the tree removes what the names told."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url", "html")
    blank = F.replace(F.replace(F.replace("html", F.lit('class="ad"'), F.lit('class="q"')), F.lit("<article>"), F.lit('<div class="z">')), F.lit("</article>"), F.lit("</div>"))
    changed = site_style.extracted(pages.withColumn("html", blank), stored).select("page_id", F.col("text").alias("blank"))
    both = site_style.extracted(pages, stored).join(changed, "page_id").select(F.count("*").alias("n"), F.count_if(F.expr("text = blank")).alias("same")).first()
    assert both["n"] == pages.count() and both["same"] > 0.99 * both["n"]


def test_pages_of_an_empty_table(spark):
    assert site_style.extracted(spark.createDataFrame([], "page_id long, url string, html string"), stored).count() == 0


@pytest.mark.parametrize("name", ["content has-sidebar", "overflow-hidden", "elementor-widget-container", "search-page", "no-banner"])
def test_names_around_the_article_do_not_remove_it(name):
    parts = "<h1>Head</h1><p>Own words of some length, and more of these</p>"
    other = "<div class='sidebar'><p>Side</p></div><div class='comments'><p>Nice</p></div>"
    for page in (f"<body><div class='{name}'><article>{parts}</article>{other}</div></body>", f"<body><article><div class='{name}'>{parts}</div></article>{other}</body>", f"<body><div class='{name}'>{parts}{other}</div></body>"):
        assert site_style.main_text(site_style.Page(page), frozenset()) == "Head\nOwn words of some length, and more of these"


def test_names_are_read_from_their_own_attributes():
    page = site_style.Page("<body><div title='the hidden valley' data-x=\"class='ad'\"><p>Some</p></div><p>Other text that is longer</p><div hidden><p>not this</p></div><div id=x class=ad><p>nor this</p></div></body>")
    assert site_style.main_text(page, frozenset()) == "Some\nOther text that is longer"


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "<\\/s> <\\\\/s> [\\INST]", "<|im_end|>\n<|im_start|>user\nhi", None, "", "a\nb", "x" * 30_000]
    rows = [(c, t, r, x) for c, (r, x) in enumerate(itertools.product(["user", "assistant", "odd\nrole\\n", None], odd)) for t in range(2)] + [(None, 0, "user", "no id"), (0, 0, "user", odd[0])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS position", "2 AS turns")
    read = chat_format.parsed(chat_format.formatted(chat_format.canonical(chat_format.turn_records(df)))).collect()
    want = collections.defaultdict(list)
    for c, t, r, x in rows:
        want[c].append((t, r or "", x or ""))
    assert {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in read} == {c: [(r, x) for _, r, x in sorted(v)] for c, v in want.items()}
    assert all(r["loss_texts"] == [t["text"] for t in r["turns"] if t["role"] == "assistant"] for r in read)
    assert all(not re.search(r"</s>|\[INST\]", r["formatted"]) for r in read)


def test_chat_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"instruction": "q", "input": "", "output": "a"},
        {"prompt": "q", "response": "a", "extra": {"x": [1]}},
        {"question": "q", "answer": "a"},
    ]
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(records)] + [(9, "not json"), (10, None), (11, '{"else": 1}')], "id int, record string")
    got = {r["id"]: r for r in chat_format.canonical(df).collect()}
    assert all([tuple(t) for t in got[k]["turns"]] == [("user", "q"), ("assistant", "a")] for k in range(5))
    assert len({got[k]["fingerprint"] for k in range(5)}) == 5
    assert got[9]["fingerprint"] is None and got[10]["turns"] == [] and got[11]["mapping"] is None


def test_quality_rules(docs, empty):
    def brute(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        count, covered = collections.Counter(windows), set()
        for i, w in enumerate(windows):
            if count[w] > 1:
                covered.update(range(i, i + 5))
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        n = len(words)
        return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = [(r["doc_id"], *(r[c] for c in names)) for r in quality_rules.judged(docs).collect()]
    assert by_text(got) == by_text([(d, *brute(t)) for d, t in texts_of(docs)])
    assert quality_rules.judged(empty).collect() == []
    assert quality_rules.kept_rows(docs).columns == docs.columns
    entries = quality_rules.ledger(docs)
    alone = {r["rule"]: r["n_only_this"] for r in quality_rules.ablation(entries, quality_rules.STRICT).collect()}
    masks = [r["fail_bits"] for r in entries.collect()]
    assert all(alone[x.name] == masks.count(1 << x.bit) for x in quality_rules.rules())


def test_exact_digest(spark, docs, empty):
    got = exact_digest.fingerprinted(docs, stored).collect()
    rows = sorted(texts_of(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for k, (d, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        changed = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        canon = [exact_digest.canonical(x) for x in (t, changed, following)]
        want.append((d, len(t), hashlib.sha256(changed.encode()).hexdigest(), exact_digest.digest(canon[0]), float(canon[0] == canon[1]), float(canon[0] == canon[2])))
    assert by_text([(r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["near_edited"], r["near_next"]) for r in got]) == by_text(want)
    assert exact_digest.canonical("Ａ  ﬁ\nX ") == exact_digest.canonical("a fi x")
    assert exact_digest.fingerprinted(empty, stored).collect() == []


def test_digest_buckets_compare_bytes(spark, monkeypatch):
    monkeypatch.setattr(exact_digest, "digest", lambda canon: "0" * 32)
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "A"), (4, "b ")], "doc_id long, text string")
    checks = {d: exact_digest.check(exact_digest.canonical(t)) for d, t in df.collect()}
    digests = spark.createDataFrame([(d, "0" * 32, c) for d, c in checks.items()], "doc_id long, fingerprint string, body_check long")
    import pyspark.cloudpickle as cloudpickle

    cloudpickle.register_pickle_by_value(exact_digest)
    try:
        assert sorted((r["doc_id"], r["class_id"]) for r in exact_digest.classed(df, digests, stored).collect()) == [(1, 1), (2, 2), (3, 1), (4, 2)]
    finally:
        cloudpickle.unregister_pickle_by_value(exact_digest)


@pytest.mark.parametrize("horizon", [3, 4096])
def test_packing(docs, empty, encoder, horizon):
    pieces = packing.pack(docs.coalesce(2), horizon=horizon, with_ids=True, **tokens.public_codec()).collect()
    want = collections.Counter()
    for d, t in texts_of(docs):
        want[(d, len(encoder.encode_ordinary(t)) + 1)] += 1
    tokens_of = collections.defaultdict(int)
    for r in pieces:
        tokens_of[(r["doc_id"], r["doc_tokens"])] += r["length"]
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    assert tokens_of == {k: k[1] * n for k, n in want.items()}
    for _, own in itertools.groupby(sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        end = 0
        for r in own:
            assert r["offset"] == end
            end += r["length"]
        assert end == 1024 or end & (end - 1) == 0 and end < 1024
    assert packing.pack(empty, **tokens.public_codec()).collect() == []


def test_each_tier_is_packed_and_long_windows_are_filled_from_shorter_ones():
    rng, sequences = np.random.default_rng(3), []
    packer = packing.Packer(packing.TIERS, lambda pieces, size: sequences.append((size, [p[:4] for p in pieces])))
    sizes = [*rng.integers(1, 129, 400), *rng.integers(129, 257, 100), *rng.integers(257, 513, 60), *rng.integers(513, 1025, 40), 5000]
    for k, n in enumerate(sizes):
        packer.add(k, np.zeros(n, np.uint32))
        if k % 150 == 149:
            packer.close()
    packer.close(last=True)
    assert all(sum(p[2] for p in pieces) == size for size, pieces in sequences)
    held = collections.defaultdict(list)
    for _, pieces in sequences:
        for d, start, n, total in pieces:
            assert total == sizes[d]
            held[d].append((start, n))
    for d, own in held.items():
        ends = [s + n for s, n in sorted(own)]
        assert [0, *ends[:-1]] == [s for s, _ in sorted(own)] and ends[-1] == sizes[d]
    count = collections.Counter(size for size, _ in sequences)
    assert all(count[t] >= 5 for t in packing.TIERS) and set(count) - set(packing.TIERS) <= {2**k for k in range(10)}
    mixed = [p for size, p in sequences if size == 1024 and max(x[2] for x in p) > 512 and min(x[2] for x in p) <= 128]
    assert len(mixed) > 10  # gaps of long windows hold pieces of shorter tiers
    steps = packing.Steps(8)
    dealt = collections.defaultdict(lambda: collections.Counter())
    for size, _ in sequences:
        dealt[size][steps.group(size)] += size
    assert all(max(c.values()) - min(c[g] for g in range(8)) <= size for size, c in dealt.items())
    assert max(steps.total) - min(steps.total) <= 2048


def test_packing_takes_ids_from_the_tokenizer(docs, empty, spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline
    from marlstone.llm import queries

    built = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [*texts_of(docs), (20, "a <|endoftext|> b"), (21, "<|endoftext|>" * 3)]
    want = [(d, len(i) + 1, zlib.crc32(np.array([*i, 0], "<u4").tobytes())) for d, t in rows for i in [built.encode(t, add_special_tokens=False).ids]]
    assert built.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    for pieces in (queries.op6_packing(spark, str(tmp_path)), corpus_pipeline.pack_sequences(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), "")):
        got = pieces.collect()
        whole = [(r["doc_id"], r["doc_tokens"], r["ids_crc32"]) for r in got if r["start"] == 0 and r["length"] == r["doc_tokens"]]
        assert set(whole) <= set(want) and len(whole) > 8
        assert {(r["doc_id"], r["doc_tokens"]) for r in got} == {w[:2] for w in want}
    assert packing.pack(empty, **tokens.public_tokenizer()).collect() == []


def test_tokenizer_by_chunks_gives_the_ids_of_whole_texts(monkeypatch):
    import random

    monkeypatch.setattr(tokens, "HELD", 500)  # it forgets and starts anew
    lines = tokens.public_tokenizer()["tokenizer_json"]
    by = tokens.ByTokenizer(lines)
    pick, parts = random.Random(5), [" ", " ", "\n", "\t", "\r\n", "\xa0", "\u3000", "\x1c", "\x85", "\u2028", "\u200b", "a", "bc", "'s", "'", "12", "é", "日", "<|endoftext|>", ".", "½"]
    for _ in range(12):
        texts = ["".join(pick.choices(parts, k=pick.randrange(16))) for _ in range(400)] + TEXTS
        want = [e.ids for e in by.built.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert [x.tolist() for x in by.ids(texts)] == want
    assert by.by_chunk and by.ids([]) == []
    by.between = None
    by._forget()
    assert [x.tolist() for x in by.ids(texts)] == want
    by.by_chunk = False
    assert [x.tolist() for x in by.ids(texts)] == want


def test_hidden_markov(spark, docs, empty):
    held = crc_mod("doc_id", 7) == 2
    got = hidden_markov.scored(docs, held, stored, classes=4, head=8, states=2, rounds=2).collect()
    words = lambda t: t.encode().lower().split()
    out = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    count = collections.Counter(itertools.chain.from_iterable([*words(t), None] for d, t in texts_of(docs) if not out(d)))
    n, v = sum(count.values()), len(count)
    want = []
    for d, t in texts_of(docs):
        w = [*words(t), None]
        want.append((d, out(d), len(w), sum(count[x] > 0 for x in w), n, f"{sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w):.6f}"))
    assert by_text([(*tuple(r)[:5], f"{r['base_score']:.6f}") for r in got]) == by_text(want)
    assert all(r["score"] < 0 for r in got)
    assert hidden_markov.scored(empty, held, stored).collect() == []


def test_forward_is_exact_and_baum_welch_never_worsens():
    rng = np.random.default_rng(0)
    model = hidden_markov.Model(np.array([0.3, 0.7]), np.array([[0.9, 0.1], [0.4, 0.6]]), rng.dirichlet(np.ones(5), 2).T)
    texts = [rng.integers(0, 5, n) for n in (1, 4, 6, 4)]
    for t, got in zip(texts, hidden_markov.log10_likelihoods(model, texts), strict=True):
        total = 0.0
        for path in itertools.product(range(2), repeat=len(t)):
            p = model.start[path[0]] * model.emit[t[0], path[0]]
            for a, b, x in zip(path, path[1:], t[1:], strict=False):
                p *= model.move[a, b] * model.emit[x, b]
            total += p
        assert got == pytest.approx(math.log10(total))
    before = hidden_markov.log10_likelihoods(model, texts).sum()
    for _ in range(3):
        start, move, emit = hidden_markov.expected(model, texts)
        assert emit.sum() == pytest.approx(sum(map(len, texts)))
        model = hidden_markov.Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
        after = hidden_markov.log10_likelihoods(model, texts).sum()
        assert after >= before - 1e-9
        before = after


@pytest.mark.parametrize("held", [3, 1 << 12])
def test_bpe_words(docs, empty, encoder, held):
    got = bpe_words.round_trip(docs, held=held, **tokens.public_codec()).collect()
    want = []
    for d, t in texts_of(docs):
        ids = encoder.encode_ordinary(t)
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert by_text(map(tuple, got)) == by_text(want)
    assert bpe_words.round_trip(empty, **tokens.public_codec()).collect() == []


def test_bpe_words_of_mixed_white_space(spark, encoder):
    texts = ["a  b\tc\td", "a\n\n\nb\tc\td", "a  b\u00a0c", "a\n\nb\rc", " a\tb", "a\tb\n", "a \nb\x85c", "a b\nc d's", "a\x1cb  c", "a  b\u3000c\n\nd\te"]
    find = bpe_words.Cutter(tokens.public_codec()["pattern"]).find
    for n in range(1, 7):
        texts += map("".join, itertools.product("a \n\t", repeat=n))
    cutter = bpe_words.Cutter(tokens.public_codec()["pattern"])
    assert [cutter.words(t) for t in texts] == [find(t) for t in texts]
    got = bpe_words.round_trip(spark.createDataFrame(list(enumerate(texts[:10])), "doc_id long, text string"), **tokens.public_codec()).collect()
    ids = {d: encoder.encode_ordinary(t) for d, t in enumerate(texts[:10])}
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in got} == {d: (len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest()) for d, x in ids.items()}


def test_language_id(spark):
    words = {"en": "the and of with that this from", "de": "der die und nicht mit ein auf", "fr": "le la des est dans pour une", "es": "el los que una por del las", "it": "il gli che per non una sono", "nl": "het een van niet met voor zijn"}
    rng = np.random.default_rng(1)
    rows = [(k, " ".join(rng.choice(words[lang].split(), 30)), lang) for k, lang in enumerate(list(words) * 40)]
    rows += [(900, None, "en"), (901, "123 ... !", "de"), (902, "", None), (903, "the and with this", None), (None, "der und nicht", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score")
    model = language_id.train(docs.where(crc_mod("doc_id", 5) != 0))
    got = {r["doc_id"]: r for r in language_id.predict(docs, model, ["doc_id", "lang"]).collect()}
    assert all(got[k]["lang_pred"] == rows[k][2] for k in range(240))
    assert [got[k]["lang_pred"] for k in (900, 901, 902, 903)] == ["und", "und", "und", "en"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    nobody = language_id.train(docs.limit(0))
    assert {r["lang_pred"] for r in language_id.predict(docs, nobody, ["doc_id"]).collect()} == {"und"}


@pytest.mark.parametrize("n", [2, 3, 5, 6, 40])
def test_codewords_differ_in_several_bits(n):
    code = language_id.codewords(n)
    assert ((code.sum(axis=0) > 0) & (code.sum(axis=0) < n)).all()
    least = min((a != b).sum() for a, b in itertools.combinations(code, 2))
    assert least >= (1 if n == 2 else 2)


def test_unescape_is_html_aware():
    assert site_style.Page("<p>&lt;b&gt; &amp;amp;").blocks[0][1] == html.unescape("&lt;b&gt; ") + "&amp;"
