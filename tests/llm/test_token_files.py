"""Token counts from files that are written and read again, against the encoder itself."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import queries, token_files, tokens

END = 50256
ROWS = [(1, "one two three"), (2, ""), (None, "no id"), (3, None), (3, "same id"), (3, "same id"), (4, "long " * 9000), (5, "end <|endoftext|> inside\r\nP\xc4 \n"), (6, "日本 語")]


@pytest.mark.parametrize(("width", "block", "partitions"), [(2, 1 << 18, 1), (2, 7, 3), (4, 5, 4)])
def test_counts_through_files(spark, tmp_path, width, block, partitions):
    path = str(tmp_path / "in")
    spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 AS part", "2 AS ordinal", "3 AS file").repartition(partitions).write.parquet(path)
    docs = spark.read.parquet(path)
    codec = tokens.public_codec()
    got = token_files.counted(docs, str(tmp_path / "out"), end_id=END, width=width, block=block, **codec).collect()
    encoder = tokens.codec(**codec)
    want = [(d, len(encoder.encode_ordinary(t or ""))) for d, t in ROWS]
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in got), key=str) == sorted(want, key=str)
    files = [np.frombuffer(r["content"], f"<u{width}") for r in token_files.binary_files(spark, str(tmp_path / "out")).collect()]
    assert sum(int((f == END).sum()) for f in files) == len(ROWS) and all(f[-1] == END for f in files)
    assert sum(map(len, files)) == sum(n for _, n in want) + len(ROWS)
    for part in {r["part"] for r in got}:
        own = sorted((r["ordinal"], r["start"], r["n_tokens"]) for r in got if r["part"] == part)
        assert [o for o, _, _ in own] == list(range(len(own))) and [s for _, s, _ in own] == [sum(n + 1 for _, _, n in own[:k]) for k in range(len(own))]
    blocks = token_files.file_blocks(spark, str(tmp_path / "out"), width, block)
    assert sorted((r["file"], r["ordinal"], r["start"], r["n_tokens"]) for r in token_files.documents_of(blocks, END, width).collect())[0][3] >= 0
    assert token_files.documents_of(blocks, END, width).count() == len(ROWS) and token_files.unended(blocks, END, width).count() == 0


def test_an_end_id_between_two_ids_is_none(spark, tmp_path):
    """Bytes of the end id across the edge of two other ids are no end."""
    a, b = 0x5001, 0x02C4  # the bytes 01 50 c4 02
    (tmp_path / "x.bin").write_bytes(np.array([a, b, END, a], "<u2").tobytes())
    rows = token_files.located(token_files.stitched(token_files.scanned_files(spark, str(tmp_path), END, 2, 2))).collect()
    assert [(r["ordinal"], r["start"], r["n_tokens"]) for r in rows] == [(0, 0, 2)]


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.counted(docs, str(tmp_path / "out"), end_id=END, width=2, **tokens.public_codec()).collect() == []


def test_partitions_that_change_are_an_error(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    codec = tokens.public_codec()
    token_files.written(docs, str(tmp_path / "out"), end_id=END, width=2, **codec)
    real, token_files.written = token_files.written, lambda *a, **k: None
    try:
        with pytest.raises(Exception, match="partitions have changed"):
            token_files.counted(docs.coalesce(1), str(tmp_path / "out"), end_id=END, width=2, **codec).collect()
    finally:
        token_files.written = real


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    encoder = tokens.codec(**tokens.public_codec())
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    got = queries.op1_separator_scan(spark, sf).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == sorted((r["doc_id"], len(encoder.encode_ordinary(r["text"]))) for r in docs)
