"""Byte-level BPE by a global shuffle of distinct words.

Texts are cut into pre-tokens. Each task explodes its texts into distinct words and positions: a block of documents numbers
its words, and a document is the sequence of its words' numbers. The words, once per block, are dealt by hash to buckets, so that all
blocks' copies of a word meet in one task, which encodes it once while it remembers it (2,000,000 words; a bucket with more begins anew). The ids then return to the blocks, where texts are put together by
position. Decoding is a lookup in the token-byte table, a fixed vocabulary of 50,257 rows that each task holds as a dict, in place of a join.

Words are pre-aggregated by block before the shuffle, so a frequent word is no hot key: a block sends it once. A block ends with its
input partition, at HELD distinct words or at HELD_CHARS characters, so what one task holds is bounded. Documents are shuffled once, as numbers.

Null or empty texts have no ids. Repeated rows are encoded each. Columns besides doc_id and text are ignored; an empty table gives no rows.
The input's partitions must be the same when a task is run again, as those of a file scan are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import tokens

#: Distinct words of a block, about; cut chunks that a task remembers.
HELD = 300_000
#: Characters of a block's texts, about.
HELD_CHARS = 1 << 24
#: Buckets of words for each shuffle partition, and at most.
BUCKETS, MOST_BUCKETS = 4, 1 << 14
#: Encoded words that a task remembers before it starts anew.
REMEMBERED = 2_000_000


class Cutter(dict):
    """Pre-tokens of a chunk of text, remembered. A text whose white space is single spaces and line feeds between words
    is cut at these, as every match starts or ends there; any other text is one chunk."""

    def __init__(self, pattern: str):
        self.find = regex.compile(pattern).findall

    def __missing__(self, chunk: str) -> list[str]:
        out = self.find(chunk)
        if len(self) < HELD:
            self[chunk] = out
        return out

    def words(self, text: str) -> list[str]:
        if text.split() != text.replace("\n", " ").split(" "):  # other white space, two side by side, or one at an end
            return self.find(text)
        out = []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append("\n")
            first, *later = line.split(" ")
            out += self[first]
            for w in later:
                out += self[" " + w]
        return out


class Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n


#: Rows of two kinds, by key: documents of a block (key: the block) and words of a block in a bucket (key: -1 - bucket).
PLACED = "key long, block long, doc_ids array<long>, lengths array<int>, body binary"


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit integers with like bytes together."""
    return numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view("<i4").ravel()


def _lists(numbers: np.ndarray, lengths: np.ndarray, data: bytes) -> bytes:
    """Numbered byte strings as one body."""
    return b"".join([len(numbers).to_bytes(4, "little"), numbers.astype("<i4").tobytes(), lengths.astype("<i4").tobytes(), data])


def _listed(body: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    n = int.from_bytes(body[:4], "little")
    return np.frombuffer(body, "<i4", n, 4), np.frombuffer(body, "<i4", n, 4 + 4 * n), body[4 + 8 * n :]


def placed(docs: DataFrame, pattern: str, buckets: int, held: int = HELD) -> DataFrame:
    """The blocks' documents, as numbers of words, and their words by bucket: the columns of PLACED."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, pack = Cutter(pattern), zstandard.ZstdCompressor(3).compress
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
        names = [c.split()[0] for c in PLACED.split(", ")]
        block, number, ids, codes, chars = TaskContext.get().partitionId() << 32, Numbers(), [], [], 0

        def closed() -> pa.RecordBatch:
            rows = [(block, block, ids, list(map(len, codes)), pack(_planes(np.concatenate([*codes, np.empty(0, np.int32)]))))]
            words = [w.encode("utf-8", "surrogatepass") for w in number]
            if words:
                bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                edges = np.flatnonzero(np.diff(bucket[order])) + 1
                for some in np.split(order, edges):
                    part = [words[k] for k in some.tolist()]
                    body = _lists(some, np.fromiter(map(len, part), np.int64, len(part)), b"".join(part))
                    rows.append((-1 - int(bucket[some[0]]), block, None, None, pack(body)))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = cutter.words(text) if text else []
                ids.append(doc_id)
                codes.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                chars += len(text or "")
                if len(number) > held or chars > HELD_CHARS:
                    yield closed()
                    block, number, ids, codes, chars = block + 1, Numbers(), [], [], 0
        if ids:
            yield closed()

    return docs.select("doc_id", "text").mapInArrow(place, PLACED)


def encoded_words(dealt: DataFrame, rank_lines: bytes, pattern: str) -> DataFrame:
    """(of, body): the ids of each block's words by bucket. All rows of a bucket are in one partition, so each distinct word is encoded once while it is remembered."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, known = tokens.codec(rank_lines, pattern), {}
        pack, open_up = zstandard.ZstdCompressor(3).compress, zstandard.ZstdDecompressor().decompress
        for b in batches:
            b = b.filter(pa.compute.less(b.column("key"), 0))
            bodies = []
            for body in b.column("body").to_pylist():
                number, lengths, data = _listed(open_up(body))
                ends = np.cumsum(lengths)
                words = [data[lo:hi] for lo, hi in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                if len(known) > REMEMBERED:
                    known.clear()
                for w in set(words) - known.keys():
                    known[w] = tokens.ids_of(encoder, w.decode("utf-8", "surrogatepass")).astype("<u4").tobytes()
                ids = list(map(known.__getitem__, words))
                bodies.append(pack(_lists(number, np.fromiter(map(len, ids), np.int64, len(ids)), b"".join(ids))))
            yield pa.RecordBatch.from_arrays([b.column("block"), pa.array(bodies, pa.binary())], ["of", "ids"])

    return dealt.mapInArrow(encode, "of long, ids binary")


def round_trip(docs: DataFrame, rank_lines: bytes, pattern: str, held: int = HELD) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # One exchange for both uses: each takes all its columns, and no filter that would be pushed below it.
    dealt = placed(docs, pattern, min(BUCKETS * parts, MOST_BUCKETS), held).repartition(parts, "key")
    back = encoded_words(dealt, rank_lines, pattern).groupBy("of").agg(F.collect_list("ids").alias("ids"))
    whole = dealt.join(back, F.col("key") == F.col("of"), "left")
    line_of = lambda ids: " ".join(map(str, ids)).encode()

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = tokens.ranks_of(rank_lines)
        table = dict(zip(ranks.values(), ranks.keys(), strict=True))  # the token-byte table
        open_up = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for k, key in enumerate(b.column("key").to_pylist()):
                if key < 0:
                    continue
                codes = _numbers(open_up(b.column("body")[k].as_py()))
                parts = [_listed(open_up(x)) for x in b.column("ids")[k].as_py() or []]
                n_words = sum(len(p[0]) for p in parts)
                lines, pieces, sizes = [b""] * n_words, [b""] * n_words, np.zeros(n_words, np.int64)
                for number, lengths, data in parts:
                    sizes[number] = lengths // 4
                    ids, at = np.frombuffer(data, "<u4").tolist(), 0
                    for word, n in zip(number.tolist(), (lengths // 4).tolist(), strict=True):
                        own = ids[at : at + n]
                        at += n
                        lines[word], pieces[word] = line_of(own), b"".join(map(table.__getitem__, own))
                doc_ids, lengths = b.column("doc_ids")[k].as_py(), b.column("lengths")[k].as_py()
                n, ids_sha, text_sha, at = [], [], [], 0
                for length in lengths:
                    own = codes[at : at + length]
                    at += length
                    n.append(int(sizes[own].sum()))
                    own = own.tolist()
                    ids_sha.append(hashlib.sha256(b" ".join(map(lines.__getitem__, own))).hexdigest())
                    text_sha.append(hashlib.sha256(b"".join(map(pieces.__getitem__, own))).hexdigest())
                arrays = [pa.array(doc_ids, pa.int64()), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return whole.mapInArrow(put_together, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
