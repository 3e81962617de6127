"""The pipeline's stages, each against brute force on its own input."""

import collections
import re

import corpus_pipeline
from marlstone.llm import tokens
from marlstone.llm.common import read_table, stored

SF = "/root/testdata/sf0.001"


def passes_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, chars = len(words), sum(map(len, words))
    count = collections.Counter(tuple(words[i : i + 5]) for i in range(n - 4))
    covered = {j for i in range(n - 4) if count[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    upper = sum(c.isupper() and c.istitle() is not None and c.lower() != c for c in text)
    fails = [n < 10, 100 * len(covered) > 20 * n, 10 * len(re.findall(r"[#*$%&|<>]", text)) > n, 10 * (len(lines) - len(set(lines))) > 3 * len(lines), chars < 2 * n, chars > 15 * n, 2 * upper > chars]
    return not any(fails)


def least_of_components(rows):
    sets = {}
    for d, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower())
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {d for d in sets if find(d) == d}


def test_stages(spark):
    docs = read_table(spark, SF, "documents")
    columns = docs.columns
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        seen.append(docs)
    assert [d.columns for d in seen[1:4]] == [columns] * 3
    rows = [{r["doc_id"]: r["text"] for r in d.select("doc_id", "text").collect()} for d in seen[:4]]
    assert set(rows[1]) == {d for d, t in rows[0].items() if re.search(r"[^\W\d_]", t)}
    assert set(rows[2]) == {d for d, t in rows[1].items() if passes_rules(t)}
    assert set(rows[3]) == least_of_components(sorted(rows[2].items()))
    encoder, packed = tokens.codec(**tokens.public_codec()), collections.Counter()
    for r in seen[4].collect():
        packed[r["doc_id"]] += r["length"]
    assert packed == {d: len(encoder.encode_ordinary(t)) + 1 for d, t in rows[3].items()}


def test_run_on_an_empty_table(spark, tmp_path):
    read_table(spark, SF, "documents").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_one_of_each_group_by_row(spark):
    words = lambda k, n=40: " ".join(f"{k}{j}" for j in range(n))
    rows = [(None, words("a")), (None, words("b")), (1, words("c")), (None, words("c")), (2, words("c", 41)), (2, words("d")), (3, words("e")), (3, words("e")), (3, words("f"))]
    rows += [(None, words("g")), (None, words("g", 41)), (4, ""), (4, None), (None, " ")]
    docs = spark.createDataFrame([(t, d, "en") for d, t in rows], "text string, doc_id long, lang string")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect()]
    either = [r for r in got if r[1] in (words("g"), words("g", 41))]
    assert len(either) == 1 and either[0][0] is None
    want = [(None, words("a")), (None, words("b")), (1, words("c")), (2, words("d")), (3, words("e")), (3, words("f")), (4, ""), (4, None), (None, " ")]
    assert sorted((r for r in got if r not in either), key=str) == sorted(want, key=str)
