"""Hierarchical multi-length packing.

Documents become token ids with an end id. Each is routed to the smallest context tier that holds it, or, if longer
than the largest, first cut into full windows and a rest. Each tier is packed into windows of its own size, longest tier first;
what its pieces leave open in a window is filled from shorter tiers, the last gap with a part of a piece. What short tiers have left
then fills windows of their own size, and what remains at the end is cut at powers of two, so no sequence needs padding.
Sequences are dealt to step groups so that each group of a partition gets as many tokens of each window size; nothing is balanced over partitions.

Partitions are packed apart, in one pass without a shuffle: a sequence holds documents of one partition only. Only the
open pieces of a partition are held, at most `horizon` documents at a time, so memory does not grow with the input.
Sequence ids hold the partition's number in their upper bits. The input's partitions must be the same when a task is
run again, as those of a file scan are.

Null or empty texts are one end id. Repeated rows are packed each. Columns besides doc_id and text are ignored.
An empty table gives an empty result; a null doc_id stays null.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from marlstone.llm import tokens

#: Context sizes, each a power of two, ascending. The last is the window that all sequences are padded to.
TIERS = (128, 256, 512, 1024)
#: Documents that a task holds before it closes what it can.
HORIZON = 4096
#: Texts that a tokenizer encodes at once.
AT_ONCE = 256
#: Step groups that sequences of a partition are dealt to.
STEP_GROUPS = 8

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group int"


class Packer:
    """Packs the documents of one partition. A piece is [doc_id, start, length, doc_tokens, ids]."""

    def __init__(self, tiers: tuple[int, ...], emit: Callable[[list, int], None]):
        self.tiers, self.top, self.emit = tiers, tiers[-1], emit
        self.waiting: list[list[list]] = [[] for _ in tiers]

    def add(self, doc_id, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at >= self.top:
            self.emit([[doc_id, at, self.top, n, ids[at : at + self.top]]], self.top)
            at += self.top
        if at < n:
            self._route([doc_id, at, n - at, n, ids[at:]])

    def _tier(self, n: int) -> int:
        return bisect_left(self.tiers, n)

    def _route(self, piece: list) -> None:
        self.waiting[self._tier(piece[2])].append(piece)

    def close(self, last: bool = False) -> None:
        """Packs each tier, from the longest down, into windows of its size until what waits in it and below fills no further one; at the end, all."""
        for pieces in self.waiting:
            pieces.sort(key=lambda p: p[2])
        left = [sum(p[2] for p in pieces) for pieces in self.waiting]
        for tier in range(len(self.tiers) - 1, -1, -1):
            while self.waiting[tier] and sum(left[: tier + 1]) >= self.tiers[tier]:
                self._window(self.tiers[tier], tier, left)
        while last and any(left):
            self._window(1 << (sum(left).bit_length() - 1), len(self.tiers) - 1, left)

    def _window(self, size: int, tier: int, left: list[int]) -> None:
        """One sequence of exactly `size` tokens, of which as many wait in the tier and below at least: the tier's longest piece, then what fits of its
        tier, then of shorter ones; a gap that nothing fits is closed with a part of one of the shortest pieces."""
        got, gap = [], size
        for k in range(tier, -1, -1):
            pieces = self.waiting[k]
            while pieces and gap:
                at = bisect_right(pieces, gap, key=lambda p: p[2])  # the longest that fits is before it
                if not at:
                    break
                got.append(pieces.pop(at - 1))
                left[k] -= got[-1][2]
                gap -= got[-1][2]
        if gap:
            k = next(k for k, pieces in enumerate(self.waiting) if pieces)
            doc_id, start, n, total, ids = self.waiting[k].pop(0)
            got.append([doc_id, start, gap, total, ids[:gap]])
            left[k] -= n
            rest = [doc_id, start + gap, n - gap, total, ids[gap:]]
            k = self._tier(rest[2])
            insort_left(self.waiting[k], rest, key=lambda p: p[2])
            left[k] += rest[2]
        self.emit(got, size)


class Steps:
    """Deals sequences to step groups such that each has as many tokens of each window size, and then in all."""

    def __init__(self, groups: int):
        self.total, self.by_size = [0] * groups, {}

    def group(self, size: int) -> int:
        own = self.by_size.setdefault(size, [0] * len(self.total))
        at = min(range(len(own)), key=lambda k: (own[k], self.total[k]))
        own[at] += size
        self.total[at] += size
        return at


def pack(docs: DataFrame, rank_lines: bytes = b"", pattern: str = "", end_id: int = 0, tiers: tuple[int, ...] = TIERS, horizon: int = HORIZON, step_groups: int = STEP_GROUPS, with_ids: bool = False, tokenizer_json: bytes | None = None) -> DataFrame:
    """One row per piece: the columns of PIECES, and with_ids its ids as little-endian unsigned 32-bit integers.

    Ids are those of tokenizer_json where it is given, else of rank_lines and pattern, to which strings of special tokens are ordinary text.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.tokenizer(tokenizer_json) if tokenizer_json else tokens.codec(rank_lines, pattern)
        base, made, rows = TaskContext.get().partitionId() << 33, 0, []
        steps = Steps(step_groups)

        def emit(pieces: list, size: int) -> None:
            nonlocal made
            group, offset = steps.group(size), 0
            for doc_id, start, n, total, ids in pieces:
                raw = ids.astype("<u4").tobytes()
                rows.append((doc_id, start, n, zlib.crc32(raw), total, base + made, offset, size, group, raw if with_ids else None))
                offset += n
            made += 1

        def taken() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            kinds = [pa.int64()] * 7 + [pa.int32()] * 2 + [pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays if with_ids else arrays[:-1], names if with_ids else names[:-1])

        def encoded(batch: pa.RecordBatch) -> Iterator[tuple]:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                texts = part.column(1).to_pylist()
                ids = encoder.ids(texts) if tokenizer_json else [tokens.ids_of(encoder, t) for t in texts]
                yield from zip(part.column(0).to_pylist(), ids, strict=True)

        packer, held, end = Packer(tiers, emit), 0, np.array([end_id], np.uint32)
        for batch in batches:
            for doc_id, ids in encoded(batch):
                packer.add(doc_id, np.concatenate([ids, end]))
                held += 1
                if held >= horizon:
                    packer.close()
                    held = 0
                if len(rows) >= 8192:
                    yield taken()
        packer.close(last=True)
        if rows:
            yield taken()

    schema = PIECES + ", ids binary"
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select("doc_id", "text").mapInArrow(packed, schema if with_ids else PIECES)
