"""Token counts of flat token files without an index, by a scan for the end-of-document id.

A file is a run of fixed-width ids, each document ending in the end id. It is read as blocks of equal size that know nothing
of documents. A first pass searches each block for the end id with one vectorised comparison. A prefix scan over the
blocks' sizes and last ends then gives each block its offset and the start of the document that it continues, so a
document across any number of blocks is counted whole. Only ends and sizes are shuffled, never the ids.

Documents are written as such files to the shared folder by Spark's own text writer: a row is a document's ids as bytes, and what
ends a line there is the end id. A file is what one task reads of the input, so a split of the input bounds it, and it is read again as a
whole by one task, as Spark cuts no binary files; files from elsewhere must stay below 2 GB. The files hold no document ids. A manifest of
each input split's document ids in order names them again; the input must be cut into the same partitions whenever it is read,
as those of a file scan are, which the counts of documents per file are compared for.

A document without tokens is an end id alone and counts 0. Ids after a file's last end are a document without an end:
`unended` rows. An empty file has no rows, nor has an empty table. Null texts are empty; repeated rows and ids are documents each; a null id
stays null. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm import tokens

#: Ids of a block.
BLOCK = 1 << 18


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of all files with a content at a path that Spark can read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.col("length") > 0).select(F.col("path").alias("file"), "content")


def file_blocks(spark: SparkSession, path: str, width: int = 4, block: int = BLOCK) -> DataFrame:
    """(file, block, data) of all binary files at a path that Spark can read, each cut by the task that reads it."""
    step = block * width

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column("file").to_pylist(), b.column("content"), strict=True):
                whole = memoryview(content.as_buffer())
                for k, start in enumerate(range(0, len(whole), step)):
                    data = pa.array([whole[start : start + step].tobytes()], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([k]), data], ["file", "block", "data"])

    return binary_files(spark, path).mapInArrow(cut, "file string, block long, data binary")


def separator(end_id: int, width: int) -> str:
    """The end id's bytes as Latin-1."""
    return end_id.to_bytes(width, "little").decode("latin-1")


def written(docs: DataFrame, path: str, rank_lines: bytes, pattern: str, end_id: int, width: int = 4) -> None:
    """Writes each partition's documents as one flat file of ids of `width` bytes, an end id after each document."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.codec(rank_lines, pattern)
        for b in batches:
            ids = [tokens.ids_of(encoder, t).astype(f"<u{width}").tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], ["ids"])

    ids = docs.select("text").mapInArrow(encode, "ids binary").select(F.col("ids").cast("string"))
    ids.write.option("lineSep", separator(end_id, width)).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 0).text(path)


def manifest(docs: DataFrame) -> DataFrame:
    """(part, ordinal, doc_id): the partition in which each document stands, and where."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return docs.select(F.spark_partition_id().cast("long").alias("part"), place.alias("ordinal"), "doc_id")


def scanned_files(spark: SparkSession, path: str, end_id: int, width: int = 4, block: int = BLOCK) -> DataFrame:
    """As scanned(file_blocks(...)): (file, block, n, ends); the ids stay in the task that reads them."""
    step = block * width

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column("file").to_pylist(), b.column("content"), strict=True):
                whole = memoryview(content.as_buffer())
                runs = [np.frombuffer(whole[k : k + step], f"<u{width}") for k in range(0, len(whole), step)]
                ends = pa.array([np.flatnonzero(r == end_id) for r in runs], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(runs)), pa.array(np.arange(len(runs))), pa.array([len(r) for r in runs]), ends], ["file", "block", "n", "ends"])

    return binary_files(spark, path).mapInArrow(scan, "file string, block long, n long, ends array<long>")


def counted(docs: DataFrame, path: str, rank_lines: bytes, pattern: str, end_id: int, width: int = 4, block: int = BLOCK) -> DataFrame:
    """doc_id, part, ordinal, start and n_tokens of each document, from the token files of docs that it writes to a new folder at `path`."""
    written(docs, path, rank_lines, pattern, end_id, width)
    found = located(stitched(scanned_files(docs.sparkSession, path, end_id, width, block)))
    part = F.regexp_extract("file", r"part-(\d+)-[^/]*$", 1).cast("long")
    found = found.select(part.alias("part"), "ordinal", "start", "n_tokens")
    named = manifest(docs).withColumn("known", F.lit(True)).join(found, ["part", "ordinal"], "full")
    sure = F.when(F.col("known").isNull() | F.col("start").isNull(), F.raise_error(F.lit("documents and token files differ: the input's partitions have changed"))).otherwise(F.col("start"))
    return named.select("doc_id", "part", "ordinal", sure.alias("start"), "n_tokens")


def document_blocks(docs: DataFrame, rank_lines: bytes, pattern: str, end_id: int, block: int = BLOCK) -> DataFrame:
    """(file, block, data, doc_ids): each input partition as one flat run of ids, cut without regard to documents.
    doc_ids are the documents whose ends were written to the block, in order: the writer's manifest."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, file, made = tokens.codec(rank_lines, pattern), TaskContext.get().partitionId(), 0
        run, size, ended = [], 0, []  # ended: (document, place of its end in the run)

        def cut(n: int) -> pa.RecordBatch:
            nonlocal run, size, ended, made
            whole = np.concatenate(run)
            data, rest = whole[:n], whole[n:]
            here = [d for d, at in ended if at < n]
            row = [pa.array([file], pa.int64()), pa.array([made], pa.int64()), pa.array([data.astype("<u4").tobytes()], pa.binary()), pa.array([here], pa.list_(pa.int64()))]
            run, size, made, ended = [rest], len(rest), made + 1, [(d, at - n) for d, at in ended if at >= n]
            return pa.RecordBatch.from_arrays(row, ["file", "block", "data", "doc_ids"])

        end = np.array([end_id], np.uint32)
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = tokens.ids_of(encoder, text)
                run += [ids, end]
                size += len(ids) + 1
                ended.append((doc_id, size - 1))
                while size >= block:
                    yield cut(block)
        if size:
            yield cut(size)

    return docs.select("doc_id", "text").mapInArrow(write, "file long, block long, data binary, doc_ids array<long>")


def scanned(blocks: DataFrame, end_id: int, width: int = 4) -> DataFrame:
    """Each block without its data, with n (its ids) and ends (places of the end id in it)."""
    kept = [c for c in blocks.columns if c != "data"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = [np.frombuffer(x, f"<u{width}") for x in b.column("data").to_pylist()]
            ends = [np.flatnonzero(r == end_id) for r in runs]
            arrays = [*(b.column(c) for c in kept), pa.array([len(r) for r in runs], pa.int64()), pa.array([e.tolist() for e in ends], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, "n", "ends"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.drop("data").schema.fields) + ", n long, ends array<long>"
    return blocks.select(*kept, "data").mapInArrow(scan, schema)


def stitched(scan: DataFrame) -> DataFrame:
    """The blocks with `offset` (ids of the file before the block), `open_at` (start of the document that is open there) and `ordinal` (ends before)."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    df = scan.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    df = df.withColumn("ordinal", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)))
    last = F.when(F.size("ends") > 0, F.col("offset") + F.array_max("ends") + 1)
    return df.withColumn("last", last).withColumn("open_at", F.coalesce(F.max("last").over(before), F.lit(0).cast("long"))).drop("last")


def located(df: DataFrame) -> DataFrame:
    """One row per end of stitched blocks: file, ordinal, start (place of the first id), n_tokens (ids before the end), and doc_id if blocks have doc_ids."""
    named = "doc_ids" in df.columns
    df = df.withColumn("ends", F.transform("ends", lambda e: e + F.col("offset")))
    starts = F.when(F.size("ends") > 0, F.concat(F.array("open_at"), F.transform(F.slice("ends", 1, F.size("ends") - 1), lambda e: e + 1))).otherwise(F.array().cast("array<bigint>"))
    zipped = F.arrays_zip(starts.alias("start"), F.col("ends").alias("stop"), *([F.col("doc_ids").alias("doc_id")] if named else []))
    each = df.select("file", "ordinal", F.posexplode(zipped).alias("k", "d"))
    return each.select(*(["d.doc_id"] if named else []), "file", (F.col("ordinal") + F.col("k")).alias("ordinal"), "d.start", (F.col("d.stop") - F.col("d.start")).alias("n_tokens"))


def documents_of(blocks: DataFrame, end_id: int, width: int = 4) -> DataFrame:
    """located() of unscanned blocks."""
    return located(stitched(scanned(blocks, end_id, width)))


def unended(blocks: DataFrame, end_id: int, width: int = 4) -> DataFrame:
    """file, start and n_tokens of what follows each file's last end, where there is any."""
    df = stitched(scanned(blocks, end_id, width))
    tail = df.groupBy("file").agg(
        F.max(F.col("offset") + F.col("n")).alias("stop"), F.max(F.greatest("open_at", F.coalesce(F.col("offset") + F.array_max("ends") + 1, F.lit(0)))).alias("start")
    )
    return tail.where("stop > start").select("file", "start", (F.col("stop") - F.col("start")).alias("n_tokens"))
