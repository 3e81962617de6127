"""Nearest neighbours by inner product: low-dimensional stable projections, indexed by kd-trees, with a chi-square stopping test.

One more entry, sqrt(M * M - |x| * |x|), makes all vectors of a band of lengths as long as M, its longest; a query has 0 there. Largest
inner products then are least distances. Few projections on normal vectors are stable: the square of a projected distance over that
of the true one is chi-square distributed. So the leaves of a kd-tree of projected vectors are visited by their distance from the projected query,
and what they hold is verified on the original vectors, until a vector as near as the worst one kept would have been
seen already with the probability asked for.

A kd-tree over a bounded sample cuts each band into cells, and each cell's rows have a tree of their own in the task that reads them;
a large cell is split by hash. All vectors are indexed. Each query first asks the cell that it lies in; with what it finds as a bound, it
then asks all other cells that the same test leaves, at any number of them.

Equal vectors are one unit and searched once, as query and as candidate; a unit keeps its least ids, as many as an answer can show.
Vectors that are null, of another length than most, zero, or with null or non-finite components take no part, nor do those whose squared length
is no finite positive double, nor rows with a null id. Repeated rows count once; rows of one id with different vectors each count, and of
each other. Ties go to the least id. Other columns are ignored. An empty table gives no rows. Two vectors are equal if 128-bit hashes of them are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.vectors import as_bytes, dimension, from_bytes, matrices

Store = Callable[[DataFrame, str], DataFrame]

#: Projections; an even number, for which the chi-square distribution has a closed form.
PROJECTIONS = 8
#: Probability with which a neighbour is seen before its query stops.
SEEN = 0.95
#: Vectors of a cell, about, and of a leaf at most.
CELL, LEAF = 4096, 64
#: Vectors that the cells are fitted on, and cells, at most. Larger cells are split by hash.
SAMPLE, CELLS = 1 << 14, 1 << 12
#: Queries that ask one copy of a cell, about, and that a task handles at once.
ASKING, AT_ONCE = 1 << 14, 1 << 11


def chi_square_quantile(p: float, degrees: int) -> float:
    """x with P(chi-square <= x) = p, for even degrees of freedom: 1 - P is a Poisson sum."""
    low, high = 0.0, 1e4
    for _ in range(200):
        x = (low + high) / 2
        terms = np.cumprod([1.0, *(x / 2 / k for k in range(1, degrees // 2))])
        low, high = (x, high) if 1 - np.exp(-x / 2) * terms.sum() < p else (low, x)
    return high


def bands_of(squares: np.ndarray) -> np.ndarray:
    """Lengths within a factor of 2 ** 0.25 of each other; 1 is in the middle of a band."""
    return np.floor(2 * np.log2(squares) + 0.5).astype(np.int32)


def checked(df: DataFrame, vec_id: str, column: str, d: int) -> DataFrame:
    """(vec_id, uid, band, square, v): the rows that take part, with a hash of their vector and its squared length."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = matrices(b, column, d)
            x = x + 0.0  # no negative zeros
            squares = (x * x).sum(axis=1)
            fine = np.isfinite(squares) & (squares > 0)
            at, x, squares = at[fine], x[fine], squares[fine]
            uid = pa.array([xxhash.xxh3_128_digest(row.tobytes()) for row in x], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)).cast(pa.int64()), uid, pa.array(bands_of(squares)), pa.array(squares), as_bytes(x)], ["vec_id", "uid", "band", "square", "v"])

    return df.where(F.col(vec_id).isNotNull()).select(vec_id, column).mapInArrow(read, "vec_id long, uid binary, band int, square double, v binary")


@dataclass(frozen=True)
class Cells:
    """The cells of one band: a kd-tree as rows (dimension, place, left, right), where a negative child -c - 1 is cell c, and each cell's box."""

    nodes: list[tuple[int, float, int, int]]
    first: int
    low: np.ndarray
    high: np.ndarray

    def cell_of(self, p: np.ndarray) -> np.ndarray:
        out, open_nodes = np.full(len(p), self.first), [(0, np.arange(len(p)))] if self.nodes else []
        while open_nodes:
            node, rows = open_nodes.pop()
            dim, place, left, right = self.nodes[node]
            under = p[rows, dim] < place
            for child, some in ((left, rows[under]), (right, rows[~under])):
                if child < 0:
                    out[some] = self.first - child - 1
                else:
                    open_nodes.append((child, some))
        return out


def fitted_cells(points: np.ndarray, count: int, first: int) -> Cells:
    """About `count` cells, numbered from `first`, by halving the sample again and again at the median of its widest dimension."""
    m = points.shape[1]
    nodes, low, high = [], [], []

    def grow(rows: np.ndarray, parts: int, lo: np.ndarray, hi: np.ndarray) -> int:
        some = points[rows]
        dim = int(np.argmax(np.ptp(some, axis=0))) if len(rows) > 1 else 0
        place = float(np.median(some[:, dim])) if len(rows) > 1 else 0.0
        under = some[:, dim] < place
        if parts < 2 or not under.any():
            low.append(lo), high.append(hi)
            return -len(low)
        node = len(nodes)
        nodes.append(None)
        upper, lower = lo.copy(), hi.copy()
        upper[dim] = lower[dim] = place
        nodes[node] = (dim, place, grow(rows[under], parts // 2, lo, lower), grow(rows[~under], parts - parts // 2, upper, hi))
        return node

    grow(np.arange(len(points)), count, np.full(m, -np.inf), np.full(m, np.inf))
    return Cells(nodes, first, np.array(low), np.array(high))


@dataclass(frozen=True)
class Index:
    """What all tasks know: the projection, and by band its longest squared length, its cells and into how many parts each of these is split. Bounded by CELLS."""

    d: int
    normal: np.ndarray
    quantile: float
    longest: dict[int, float]
    cells: dict[int, Cells]
    parts: dict[int, int]
    main: int

    def projected(self, x: np.ndarray, squares: np.ndarray, longest) -> np.ndarray:
        """Vectors of one band, or with 0 for `longest` queries."""
        return x @ self.normal[:-1] + np.sqrt(np.maximum(longest - squares, 0))[:, None] * self.normal[-1]

    def reach(self, squares: np.ndarray, longest: float, least: np.ndarray) -> np.ndarray:
        """Squared projected distances from which on the test holds: a query stops there. `least` is the inner product to reach; where no vector of the band can reach it, nothing is asked."""
        true = squares + longest - 2 * least
        return np.where(least > np.sqrt(squares * longest) * (1 + 1e-12), -1.0, self.quantile * np.maximum(true, 0) + 1e-12 * (squares + longest))


def box_distances(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances between each point and each box."""
    out = np.zeros((len(q), len(low)))
    for k in range(q.shape[1]):
        x = q[:, k, None]
        out += np.maximum(np.maximum(low[:, k] - x, x - high[:, k]), 0) ** 2
    return out


class Tree:
    """The kd-tree of one group of vectors of a band."""

    def __init__(self, index: Index, longest: float, x: np.ndarray, squares: np.ndarray, ids: list, uids: list):
        p = index.projected(x, squares, longest)
        order, open_runs, starts = np.arange(len(x)), [(0, len(x))], []
        while open_runs:
            lo, hi = open_runs.pop()
            if hi - lo <= LEAF:
                starts.append(lo)
                continue
            rows = order[lo:hi]
            dim = int(np.argmax(np.ptp(p[rows], axis=0)))
            half = (hi - lo) // 2
            order[lo:hi] = rows[np.argpartition(p[rows, dim], half)]
            open_runs += [(lo, lo + half), (lo + half, hi)]
        self.starts = np.sort(np.array(starts))
        self.stops = np.append(self.starts[1:], len(x))
        self.index, self.longest, self.x, self.ids = index, longest, x[order], [ids[k] for k in order.tolist()]
        self.uids = [uids[k] for k in order.tolist()]
        self.first = np.array([i[0] for i in self.ids])
        self.low, self.high = np.minimum.reduceat(p[order], self.starts), np.maximum.reduceat(p[order], self.starts)

    def nearest(self, q: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, inner product) of the k nearest units found of each query, those of `least` or more.

        Leaves are taken in the order of their distance, more of them at each turn. A query stops at the first leaf at which the test holds.
        """
        squares, rows = (q * q).sum(axis=1), np.arange(len(q))
        away = box_distances(self.index.projected(q, squares, 0), self.low, self.high)
        order = np.argsort(away, axis=1, kind="stable")
        least, found, at, turn = least.copy(), (np.empty(0, int), np.empty(0, int), np.empty(0)), 0, 1
        while at < len(self.starts):
            leaves = order[:, at : at + turn]
            go = away[rows[:, None], leaves] < self.index.reach(squares, self.longest, least)[:, None]
            if not go.any():
                break
            ask, column = np.nonzero(go)
            leaf = leaves[ask, column]
            by_leaf = np.argsort(leaf, kind="stable")
            cuts = np.flatnonzero(np.diff(leaf[by_leaf], prepend=-1))
            seen = [found]
            for some in np.split(by_leaf, cuts[1:]):
                asking, lo, hi = ask[some], self.starts[leaf[some[0]]], self.stops[leaf[some[0]]]
                s = q[asking] @ self.x[lo:hi].T
                i, j = np.nonzero(s >= least[asking, None])
                seen.append((asking[i], lo + j, s[i, j]))
            query, row, score = (np.concatenate(c) for c in zip(*seen, strict=True))
            best = np.lexsort((self.first[row], -score, query))
            query = query[best]
            place = np.arange(len(query)) - np.searchsorted(query, query)
            best, query = best[place < k], query[place < k]
            found = (query, row[best], score[best])
            full = place[place < k] == k - 1
            least[query[full]] = found[2][full]
            at, turn = at + turn, 2 * turn
        query, row, _ = found
        return query, row, (q[query] * self.x[row]).sum(axis=1)


def fitted(units: DataFrame, d: int, seed: int = 0) -> Index:
    """The index's cells, from a sample of SAMPLE units about; each band's size and longest length, from all of them."""
    bands = units.groupBy("band").agg(F.count("*").alias("n"), F.max("square").alias("longest")).collect()
    total = sum(r["n"] for r in bands)
    some = units.select("band", "square", "v")
    some = (some.sample(SAMPLE / total, seed=seed) if total > SAMPLE else some).toArrow()
    band, square = some.column("band").to_numpy(), some.column("square").to_numpy()
    x = from_bytes(some.column("v"), d)
    normal = np.random.default_rng(seed).normal(size=(d + 1, PROJECTIONS))
    index = Index(d, normal, chi_square_quantile(SEEN, PROJECTIONS), {r["band"]: r["longest"] for r in bands}, {}, {}, max((r["n"], r["band"]) for r in bands)[1])
    first = 0
    for r in sorted(bands, key=lambda r: r["band"]):
        own = band == r["band"]
        points = index.projected(x[own], square[own], r["longest"])
        cells = fitted_cells(points, max(1, min(r["n"] // CELL, CELLS * r["n"] // total)), first)
        index.cells[r["band"]] = cells
        first += len(cells.low)
    return index


def placed(units: DataFrame, index: Index) -> DataFrame:
    """The units with the cell that holds each."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, band, squares = from_bytes(b.column("v"), index.d), b.column("band").to_numpy(), b.column("square").to_numpy()
            cell = np.zeros(len(x), np.int64)
            for k in np.unique(band).tolist():
                own = band == k
                cell[own] = index.cells[k].cell_of(index.projected(x[own], squares[own], index.longest[k]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32))], [*b.schema.names, "cell"])

    return units.mapInArrow(place, "uid binary, band int, square double, v binary, ids array<long>, asks boolean, cell int")


ASKED = "uid binary, square double, v binary, least double, band int, cell int, part int"


def asking(queries: DataFrame, index: Index, first: bool) -> DataFrame:
    """The columns of ASKED: each query (uid, square, v, least) with the cell and part where it lies, or with all others that the test leaves."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                b = batch.slice(start, AT_ONCE)
                x, squares, least = from_bytes(b.column("v"), index.d), b.column("square").to_numpy(), b.column("least").to_numpy()
                p = index.projected(x, squares, 0)
                own = np.array([u[0] for u in b.column("uid").to_pylist()])
                home = index.cells[index.main].cell_of(p)
                home_part = own % np.array([index.parts.get(c, 1) for c in home.tolist()])
                if first:
                    yield out(b, np.arange(len(x)), np.full(len(x), index.main), home, home_part)
                    continue
                for band, cells in index.cells.items():
                    go = box_distances(p, cells.low, cells.high) < index.reach(squares, index.longest[band], least)[:, None]
                    row, cell = np.nonzero(go)
                    cell += cells.first
                    times = np.array([index.parts.get(c, 1) for c in cell.tolist()], np.int64)
                    row, cell = np.repeat(row, times), np.repeat(cell, times)
                    part = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                    other = (cell != home[row]) | (part != home_part[row])
                    yield out(b, row[other], np.full(other.sum(), band), cell[other], part[other])

    def out(b: pa.RecordBatch, row, band, cell, part) -> pa.RecordBatch:
        taken = [b.column(c).take(pa.array(row, pa.int64())) for c in ("uid", "square", "v", "least")]
        return pa.RecordBatch.from_arrays([*taken, *(pa.array(c, pa.int32()) for c in (band, cell, part))], [c.split()[0] for c in ASKED.split(", ")])

    return queries.select("uid", "square", "v", "least").mapInArrow(spread, ASKED)


def answers(points: DataFrame, asked: DataFrame, index: Index, k: int) -> DataFrame:
    """(uid, score, ids, own): what each query finds in the groups (cell, part) that it asks. A group that many ask is copied, so that each copy is asked by about ASKING.

    own: the unit found is the query itself."""
    copies = asked.groupBy("cell", "part").agg(F.ceil(F.count("*") / ASKING).cast("int").alias("copies"))
    ask = asked.join(copies, ["cell", "part"]).select("cell", "part", F.pmod(F.xxhash64("uid"), "copies").cast("int").alias("copy"), F.lit(1).alias("kind"), "band", "uid", "square", "v", "least", F.lit(None).cast("array<long>").alias("ids"))
    held = points.join(copies, ["cell", "part"]).select("*", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    held = held.select("cell", "part", "copy", F.lit(0).alias("kind"), "band", "uid", "square", "v", F.lit(0.0).alias("least"), "ids")
    keys = ["cell", "part", "copy", "kind"]
    dealt = held.unionByName(ask).repartition("cell", "part", "copy").sortWithinPartitions(*keys)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, tree = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in keys], axis=1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
                b, (*group, kind) = batch.slice(lo, hi - lo), key[lo].tolist()
                if not kind:
                    rows = [*rows, b] if group == at else [b]
                    at, tree = group, None
                elif group == at:
                    if tree is None:
                        t = pa.Table.from_batches(rows)
                        tree = Tree(index, index.longest[b.column("band")[0].as_py()], from_bytes(t.column("v"), index.d), t.column("square").to_numpy(), t.column("ids").to_pylist(), t.column("uid").to_pylist())
                    for start in range(0, hi - lo, AT_ONCE):
                        some = b.slice(start, AT_ONCE)
                        query, row, score = tree.nearest(from_bytes(some.column("v"), index.d), some.column("least").to_numpy(), k)
                        uid, ids = some.column("uid").take(pa.array(query)), pa.array([tree.ids[r] for r in row.tolist()], pa.list_(pa.int64()))
                        own = pa.array([u == tree.uids[r] for u, r in zip(uid.to_pylist(), row.tolist(), strict=True)], pa.bool_())
                        yield pa.RecordBatch.from_arrays([uid, pa.array(score), ids, own], ["uid", "score", "ids", "own"])

    return dealt.mapInArrow(search, "uid binary, score double, ids array<long>, own boolean")


def nearest(df: DataFrame, store: Store, asks: Column, k: int = 20, vec_id: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of each row for which `asks`, a condition on vec_id, holds.
    `store` writes a DataFrame to the shared folder and reads it again."""
    spark = df.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = dimension(df.where(F.size(column) > 0), column)
    if not d:
        return empty
    rows = checked(df, vec_id, column, d)
    pairs = store(rows.select("vec_id", "uid").distinct(), "ids")
    first = Window.partitionBy("uid").orderBy("vec_id")
    ids = pairs.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1).groupBy("uid").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked_for = pairs.where(asks).select(F.col("vec_id").alias("query_id"), "uid")
    ids = ids.join(asked_for.select("uid").distinct().withColumn("asks", F.lit(True)), "uid", "left")
    units = rows.groupBy("uid").agg(F.first("band").alias("band"), F.first("square").alias("square"), F.first("v").alias("v"))
    units = store(units.join(ids, "uid").select("uid", "band", "square", "v", "ids", F.coalesce("asks", F.lit(False)).alias("asks")), "units")
    if units.isEmpty():
        return empty
    index = fitted(units, d)
    points = store(placed(units, index), "points")
    for r in points.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > 2 * CELL).collect():
        index.parts[r["cell"]] = -(-r["n"] // CELL)
    sizes = spark.createDataFrame([(c, n) for c, n in index.parts.items()], "cell int, parts int")
    by_hash = F.conv(F.hex(F.substring("uid", 2, 2)), 16, 10).cast("int") % F.coalesce("parts", F.lit(1))
    points = points.join(F.broadcast(sizes), "cell", "left").withColumn("part", by_hash).drop("parts", "asks")  # CELLS rows at most

    queries = units.where("asks").select("uid", "square", "v", F.lit(float("-inf")).alias("least"))
    near = store(answers(points, asking(queries, index, True), index, k + 1), "near")
    bound = near.groupBy("uid").agg(F.when(F.count("*") > k, F.min("score")).alias("bound"))
    queries = queries.join(bound, "uid", "left").withColumn("least", F.coalesce("bound", "least"))
    found = near.unionByName(answers(points, store(asking(queries, index, False), "asking"), index, k + 1))

    each = found.select("uid", "score", "own", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id")
    top = each.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    top = top.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score", "own"))).alias("top"))
    own = asked_for.join(top, "uid").select("query_id", F.expr(f"slice(filter(top, t -> not (t.own and t.vec_id = query_id)), 1, {k})").alias("top"))
    return own.select("query_id", F.posexplode("top").alias("at", "t")).select("query_id", (F.col("at") + 1).alias("rank"), "t.vec_id", "t.score")
