"""Exact Jaccard self-join over word shingles by a token-group matrix, and the components of its links.

Equal sets are one unit. Units that may be linked are partitioned into groups of similar units, and each group's row of the
matrix is stored: the union of its tokens, and of each member the places of its tokens in the union. A unit that is
asked for its links in a group is first bounded by its overlap with the union alone; the group is opened, and its members counted one
by one, only if the bound reaches what the smallest partner that fits would need. All arithmetic is in integers.

Which unit asks which group: sets x and y with 100 * |x & y| >= percent * |x | y| differ in few tokens, k at most, which follows from their
sizes. Tokens are dealt by hash to more than k parts, so at least one part is the same in both sets. A part's
signature is a hash of its tokens, and only units that share as many as that leaves are ever compared (see Plan for small parts). Sizes are cut into
bands such that linked sets are in one band or in neighbours; each unit has the signatures of its own band and of the one below.

What is asked for is connection, so pairs that are already connected need no look. In a first round, the units of a signature
ask the group of one of them, its lead. Signatures whose units are then all of one component are settled; in a second round, the
units of each other signature ask all groups that hold units of it. Nothing is capped, and no pairs of units are made before a group is opened.

Texts without a word have an empty set and are linked with nothing. Repeated rows and copies are one unit. Columns besides doc_id
and text are ignored. A null id is kept and takes the component of its links, null if none has an id. An empty table gives no rows.
Tokens and signatures are 64-bit hashes, set ids 128-bit ones: sets are the same if their hashes are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from math import exp, factorial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, StructField, StructType

from marlstone.llm.common import bit_filter, fresh, mixed, passes, runs, spread_join
from marlstone.llm.components import Roots, components

Store = Callable[[DataFrame, str], DataFrame]

#: Tokens of a group's members, about: more are split to further groups.
GROUP_TOKENS = 1 << 17
#: Tokens of the units that ask one copy of a group, about: more go to further copies.
ASKING_TOKENS = 1 << 20
#: Tokens whose signatures are made at once; a larger set stands alone.
AT_ONCE = 1 << 18
#: Parts beyond k, as shares of k: the least is taken with which few units have too many small parts.
SLACK = (0.0, 0.125, 0.25)
#: Sizes that plans reach.
LARGEST = 1 << 40
#: Sizes of a group are within this factor.
SIZES = 1.5


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a whole text's word shingles, A-Z lower-cased; of its whole sequence if it has fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(size, len(words))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = mixed(out + h[k : len(h) - width + 1 + k])
    return np.unique(out)


def set_id(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def unit_of(sid: bytes) -> int:
    """The number of a unit in candidates: 64 bits of its set id. Should two units share one, both are looked at."""
    return int.from_bytes(sid[:8], "little", signed=True)


@dataclass(frozen=True)
class Plan:
    """By band: its least size, the most tokens in which linked sets differ whose smaller one is there, the parts, and the tokens of a part that is not small.

    At least parts - differ parts are the same in linked sets. A unit with fewer small parts than that thus shares a part that is not small with
    each partner, and leaves its small ones out; a unit with more has the signatures of all.
    """

    least: np.ndarray
    differ: np.ndarray
    parts: np.ndarray
    large: np.ndarray


@cache
def plan_of(percent: int) -> Plan:
    least = [1]
    while least[-1] < LARGEST:
        least.append(least[-1] * 100 // percent + 1)
    differ, parts, large = [], [], []
    for low, after in zip(least[:-1], least[1:], strict=True):
        most = after - 1
        k = (most + 100 * most // percent) * (100 - percent) // (100 + percent)
        for slack in SLACK:
            p = k + 1 + int(k * slack)
            mean = low / p
            few = [sum(exp(-mean) * mean**j / factorial(j) for j in range(c)) * p <= (p - k) / 2 for c in range(1, 5)]
            if few[0]:
                break
        differ.append(k), parts.append(p), large.append(sum(few))
    return Plan(*(np.array(x, np.int64) for x in (least[:-1], differ, parts, large)))


def signatures(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The signatures of the sets, none of them empty, as signed integers, and the set of each; of each set, how many it shares at least with a linked one.

    Of the parts - differ parts that are the same, those that are small in this set may have no signature.
    """
    plan = plan_of(percent)
    sizes = np.array([len(s) for s in sets], np.int64)
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    value, place = mixed(tokens + np.uint64(0x9E3779B97F4A7C15)), mixed(tokens ^ np.uint64(0x5851F42D4C957F2D))
    low, high = (value & np.uint64(0xFFFFFFFF)).astype(float), (value >> np.uint64(32)).astype(float)
    own_band = np.searchsorted(plan.least, sizes, "right") - 1
    out, of, least = [], [], np.full(len(sets), LARGEST)
    for band in (own_band, own_band - 1):
        differ = np.where(band >= 0, plan.differ[band], 0)
        parts = np.where(differ > 0, plan.parts[band], 0)  # sets that may differ in no token are linked only if they are the same
        first = np.cumsum(parts) - parts
        some = parts[owner] > 0
        at = owner[some]
        slot = first[at] + (place[some] % parts[at].astype(np.uint64)).astype(np.int64)
        n = int(parts.sum())
        held = np.bincount(slot, minlength=n)
        sums = [np.bincount(slot, x[some], minlength=n).astype(np.uint64) for x in (low, high)]
        unit = np.repeat(np.arange(len(sets)), parts)
        small = held < plan.large[band][unit]
        left = parts - differ - np.bincount(unit[small], minlength=len(sets))
        kept = ~small | (left < 1)[unit]
        least = np.minimum(least, np.where(parts > 0, np.maximum(left, 1), LARGEST))
        number = (np.arange(n) - first[unit] + (band[unit] << 40)).astype(np.uint64)
        out.append(mixed(sums[0] + (sums[1] << np.uint64(32)) + mixed(number))[kept]), of.append(unit[kept])
    return np.concatenate(out).view(np.int64), np.concatenate(of), least


def signed(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, sid, u) of each document: set size, set id and unit; the last two null if the set is empty."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, size) for t in b.column(1).to_pylist()]
            sid = [set_id(s) if len(s) else None for s in sets]
            arrays = [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sid, pa.binary()), pa.array([x and unit_of(x) for x in sid], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "sid", "u"])

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n long, sid binary, u long")


def signature_rows(docs: DataFrame, size: int, percent: int, bits: bytes | None = None) -> DataFrame:
    """(s, u, least): the signatures of each document's set, and how many of them a linked set shares at least; those only that pass the filter, where there is one."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)  # FILTER_BITS at most

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(sets: list[np.ndarray]) -> pa.RecordBatch:
            s, of, least = signatures(sets, percent)
            if shared.value is not None:
                at = passes(shared.value, s)
                s, of = s[at], of[at]
            u = np.array([unit_of(set_id(x)) for x in sets], np.int64)[of]
            return pa.RecordBatch.from_arrays([pa.array(s), pa.array(u), pa.array(least[of])], ["s", "u", "least"])

        sets, total = [], 0
        for b in batches:
            for text in b.column(0).to_pylist():
                s = shingles(text, size)
                if len(s):
                    if total and total + len(s) > AT_ONCE:
                        yield made(sets)
                        sets, total = [], 0
                    sets.append(s)
                    total += len(s)
        if sets:
            yield made(sets)

    return docs.select("text").mapInArrow(sign, "s long, u long, least long")


def met_twice(rows: DataFrame) -> DataFrame:
    """(s, lead): the signatures that two units share at least, counted in each task first; the lead is the least of them."""
    return rows.groupBy("s").agg(F.min("u").alias("lead"), F.max("u").alias("last")).where("lead < last").select("s", "lead")


def shared_signatures(docs: DataFrame, store: Store, size: int, percent: int) -> DataFrame:
    """(s, u, least, lead): the units of each signature that two units share at least, without units that share too few for any link.

    A first scan finds these signatures; a second one their units. A filter of bounded size thins the second: whatever passes is joined exactly.
    """
    shared = store(met_twice(signature_rows(docs, size, percent)), "shared")
    rows = signature_rows(docs, size, percent, bit_filter(shared, "s"))
    rows = store(rows.join(shared.select("s"), "s").groupBy("s", "u").agg(F.max("least").alias("least")), "signatures")
    enough = rows.groupBy("u").agg(F.count("*").alias("held"), F.max("least").alias("least")).where("held >= least").select("u")
    rows = store(rows.join(enough, "u"), "signatures")
    return store(rows.join(met_twice(rows), "s").select("s", "u", "least", "lead"), "signatures")


def token_table(docs: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """(u, sid, n, tokens) of the members (u, sid, rep): their sets again, from a scan in which a filter of bounded size chooses the documents."""
    hashed = F.xxhash64("rep").alias("h")
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(members.select(hashed), "h"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.flatnonzero(passes(bits.value, b.column(1).to_numpy()))
            sets = [s for t in b.column(0).take(pa.array(at)).to_pylist() if len(s := shingles(t, size))]
            arrays = [pa.array([set_id(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["sid", "n", "tokens"])

    rows = docs.select("text", F.xxhash64("doc_id").alias("h")).mapInArrow(read, "sid binary, n long, tokens binary")
    return rows.join(members.select("u", "sid"), "sid").dropDuplicates(["sid"]).select("u", "sid", "n", "tokens")


def homes(units: DataFrame) -> DataFrame:
    """(u, n, gid) of (u, n, home): the units of a home and of sizes close together are a group; if it has many tokens, it is split by unit to groups of about GROUP_TOKENS."""
    sized = units.withColumn("sizes", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(SIZES))))
    total = sized.groupBy("home", "sizes").agg(F.sum("n").alias("total"))
    split = sized.join(total, ["home", "sizes"]).withColumn("part", F.pmod(F.xxhash64("u"), F.ceil(F.col("total") / GROUP_TOKENS)))
    return split.select("u", "n", F.xxhash64("home", "sizes", "part").alias("gid"))


def needed(n: np.ndarray, least: np.ndarray, percent: int) -> np.ndarray:
    """Tokens that sets of size n share at least with a linked set, whose size is `least` or more."""
    m = np.maximum(least, -(-percent * n // 100))
    return -(-percent * (n + m) // (100 + percent))


class Group:
    """A row of the matrix: the union of the members' tokens, and the places of each member's tokens there."""

    def __init__(self, union: np.ndarray, sizes: np.ndarray, places: Callable[[], np.ndarray]):
        self.union, self.sizes, self.read = union, sizes, places
        self.places: np.ndarray | None = None
        self.starts = np.cumsum(sizes) - sizes

    def bound(self, tokens: np.ndarray) -> np.ndarray:
        """Which tokens of the union a set has: no member shares more with it."""
        at = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        have = np.zeros(len(self.union), bool)
        have[at[self.union[at] == tokens]] = True
        return have

    def linked(self, have: np.ndarray, n: int, percent: int) -> np.ndarray:
        """The members linked with a set of size n that has these tokens: the group is opened."""
        if self.places is None:
            self.places = self.read()
        common = np.add.reduceat(have[self.places].astype(np.int32), self.starts).astype(np.int64)
        return np.flatnonzero(100 * common >= percent * (n + self.sizes - common))

    def inside(self, percent: int) -> list[tuple[int, int]]:
        """Links between members, enough to connect all that are linked. Those whose overlap with the union of the others is too small go first, again and again."""
        if self.places is None:
            self.places = self.read()
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        alive, left = np.ones(len(self.sizes), bool), -1
        while alive.sum() != left:
            left = alive.sum()
            held = np.bincount(self.places[alive[owner]], minlength=len(self.union))
            common = np.add.reduceat((held[self.places] > 1).astype(np.int32), self.starts)
            alive &= common >= needed(self.sizes, np.zeros_like(self.sizes), percent)
        at = np.flatnonzero(alive)
        if len(at) < 2:
            return []
        among = self.places[alive[owner]]
        some, roots, out = Group(self.union, self.sizes[at], lambda: among), Roots(), []
        for k, start in enumerate(some.starts.tolist()):
            have = np.zeros(len(self.union), bool)
            have[among[start : start + int(some.sizes[k])]] = True
            for j in some.linked(have, int(some.sizes[k]), percent).tolist():
                if j != k and roots.merge(k, j):
                    out.append((int(at[k]), int(at[j])))
        return out


MATRIX = "gid long, union binary, low long, sids array<binary>, sizes array<long>, places binary, a array<binary>, b array<binary>"


def matrix(members: DataFrame, table: DataFrame, percent: int) -> DataFrame:
    """A row per group of the members (u, gid): its union, least size, members and their places, and the links (a, b) inside it."""
    rows = members.select("u", "gid").join(table, "u").select("gid", "sid", "tokens")
    dealt = rows.repartition("gid").sortWithinPartitions("gid", "sid")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [c.split(" ") for c in MATRIX.split(", ")]
        kinds = {"long": pa.int64(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary()), "array<long>": pa.list_(pa.int64())}
        for run in runs(batches, "gid"):
            g = run.column("gid").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]])
            sid, tokens = run.column("sid").to_pylist(), run.column("tokens").to_pylist()
            out = []
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                sets = [np.frombuffer(x, np.uint64) for x in tokens[lo:hi]]
                union, places = np.unique(np.concatenate(sets), return_inverse=True)
                sizes = np.array([len(s) for s in sets])
                links = Group(union, sizes, lambda places=places: places).inside(percent) if hi - lo > 1 else []
                out.append((g[lo], union.tobytes(), sizes.min(), sid[lo:hi], sizes, places.astype("<u4").tobytes(), [sid[lo + i] for i, _ in links], [sid[lo + j] for _, j in links]))
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*out, strict=True), fields, strict=True)], [c for c, _ in fields])

    return dealt.mapInArrow(build, MATRIX)


def asked(rows: DataFrame, asking: DataFrame, table: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between the units that ask (u, n, gid) and the members of the groups, enough to connect all that are linked.

    A group that many units ask is copied, so that each copy is asked by about ASKING_TOKENS.
    """
    copies = asking.groupBy("gid").agg(F.ceil(F.sum("n") / ASKING_TOKENS).alias("copies"))
    ask = asking.select("u", "gid").join(copies, "gid").join(table, "u").select("gid", F.pmod(F.xxhash64("u"), "copies").alias("copy"), F.lit(1).alias("kind"), "sid", F.col("tokens").alias("body"))
    groups = rows.join(copies, "gid").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    groups = groups.select("gid", "copy", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("sid"), F.col("union").alias("body"), "low", "sids", "sizes", "places")
    dealt = groups.unionByName(ask, allowMissingColumns=True).repartition("gid", "copy").sortWithinPartitions("gid", "copy", "kind", "sid")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, at, sids, low, roots = None, None, [], 0, Roots()
        for b in batches:
            a, c = [], []
            keys = zip(*(b.column(x).to_pylist() for x in ("gid", "copy", "kind")), strict=True)
            for k, (gid, copy, kind) in enumerate(keys):
                body = np.frombuffer(b.column("body")[k].as_py(), np.uint64)
                if not kind:
                    places, sids, low = b.column("places")[k], b.column("sids")[k].as_py(), b.column("low")[k].as_py()
                    group = Group(body, np.array(b.column("sizes")[k].as_py()), lambda x=places: np.frombuffer(x.as_py(), "<u4").astype(np.int64))
                    at, roots = (gid, copy), Roots()
                elif at == (gid, copy):
                    have, n = group.bound(body), len(body)
                    if have.sum() >= needed(np.int64(n), np.int64(low), percent):
                        sid = b.column("sid")[k].as_py()
                        for j in group.linked(have, n, percent).tolist():
                            if sids[j] != sid and roots.merge(sid, sids[j]):
                                a.append(sid), c.append(sids[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(c, pa.binary())], ["a", "b"])

    across = dealt.mapInArrow(check, "a binary, b binary")
    inside = rows.select(F.explode(F.arrays_zip("a", "b")).alias("l")).select("l.a", "l.b")
    return across.union(inside)


def led(entries: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """For round one, of (s, u, n, lead): the leads in groups (u, n, gid), and the units that ask the groups of their leads (u, n, gid)."""
    home = entries.groupBy("u").agg(F.min("lead").alias("home"), F.max("n").alias("n"), F.max(F.col("u") == F.col("lead")).alias("leads"))
    groups = homes(home.where("leads").drop("leads"))
    pairs = entries.where("u <> lead").groupBy("u", "n", "lead").agg(F.count("*").alias("held"), F.max("least").alias("least"))
    pairs = pairs.where("2 * held >= least").drop("held", "least")  # the likely ones: round two meets all that are still apart
    other = groups.select(F.col("u").alias("lead"), F.col("n").alias("m"), "gid")
    fits = (percent * F.col("n") <= 100 * F.col("m")) & (percent * F.col("m") <= 100 * F.col("n"))
    return groups, pairs.join(other, "lead").where(fits).select("u", "n", "gid").distinct()


def unsettled(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """(s, u, n, least, lead, c): the entries of the signatures whose units are not all of one component c, without units that have too few for a link."""
    rows = entries.join(labels, "u")
    apart = rows.groupBy("s").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("s")
    rows = rows.join(apart, "s")
    enough = rows.groupBy("u").agg(F.count("*").alias("held"), F.max("least").alias("least")).where("held >= least").select("u")
    return rows.join(enough, "u")


def apart(entries: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """For round two, of unsettled entries: the units in groups (u, n, gid), and the units that ask other groups (u, n, gid) which hold a unit of
    another component with one of their signatures and a size that fits. Of two groups, the units of the one with fewer units ask the other."""
    groups = homes(entries.groupBy("u").agg(F.min("lead").alias("home"), F.max("n").alias("n")))
    units = groups.groupBy("gid").agg(F.count("*").alias("units"))
    rows = entries.select("s", "u", "least", "c").join(groups.join(units, "gid"), "u")
    held = rows.groupBy("s", F.col("gid").alias("other"), F.col("units").alias("others")).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("c").alias("x"), F.max("c").alias("y"))
    fits = (percent * F.col("n") <= 100 * F.col("high")) & (percent * F.col("low") <= 100 * F.col("n"))
    differ = (F.col("x") != F.col("c")) | (F.col("y") != F.col("c"))
    asking = rows.join(held, "s").where((F.struct("others", "other") > F.struct("units", "gid")) & fits & differ)
    asking = asking.groupBy("u", "n", F.col("other").alias("gid")).agg(F.count("*").alias("held"), F.max("least").alias("least"))
    return groups, asking.where("held >= least").select("u", "n", "gid")


def labelled(docs: DataFrame, store: Store, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and (sid, rep, component) of their sets: component is null where a set is linked with no other.

    Tables are stored between steps, so that plans stay small and lost executors cost little.
    """
    docs = docs.select("doc_id", "text")
    rows = store(signed(docs, size), "signed")
    units = rows.where("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.max("u").alias("u"), F.max("n").alias("n"))
    units = store(units, "units")
    entries = shared_signatures(docs, store, size, percent)
    members = store(units.join(entries.select("u").distinct(), "u"), "members")
    table = store(token_table(docs, members, size), "tokens")
    entries = store(entries.join(members.select("u", "n"), "u"), "entries")

    def met(groups: DataFrame, asking: DataFrame) -> DataFrame:
        groups, asking = store(groups, "groups"), store(asking, "asking")
        return store(asked(store(matrix(groups, table, percent), "matrix"), asking, table, percent), "links")

    edges = met(*led(entries, percent))
    named = table.select("sid", "u").join(components(edges, store), F.col("sid") == F.col("node"), "left")
    left = store(unsettled(entries, named.select("u", F.coalesce("component", "sid").alias("c"))), "unsettled")
    found = components(edges.union(met(*apart(left, percent))), store)
    return rows, units.select("sid", "rep").join(found, F.col("sid") == F.col("node"), "left").select("sid", "rep", "component")


def first_of_each_component(docs: DataFrame, store: Store, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all columns, that come first in their component: by doc_id, nulls last, then set id, then text and the
    other columns. Rows with an empty set are linked with nothing and are all kept; of rows that are the same throughout, one.

    Rows whose set is linked with none and is no other row's are kept as they are read. Only the others are shuffled.
    """
    rows, reps = labelled(docs, store, size, percent)
    order = F.struct(F.col("rep").isNull().alias("none"), F.coalesce("rep", F.lit(0)).alias("id"), "sid")
    first = reps.groupBy(F.coalesce("component", "sid")).agg(F.min(order).alias("first")).select("first.*", F.lit(True).alias("leads"))
    several = rows.where("sid IS NOT NULL").groupBy("sid").agg(F.first("u").alias("u"), F.count("*").alias("rows"))
    several = several.join(reps.where("component IS NOT NULL").select("sid", F.lit(True).alias("linked")), "sid", "left")
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(several.where("linked OR rows > 1"), "u"))
    sid_name, open_name = fresh("sid", docs.columns), fresh("open", docs.columns)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, size) for t in b.column("text").to_pylist()]
            sid = [set_id(s) if len(s) else None for s in sets]
            maybe = passes(bits.value, np.array([unit_of(x) if x else 0 for x in sid], np.int64)) & np.array([bool(x) for x in sid], bool)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sid, pa.binary()), pa.array(maybe)], [*b.schema.names, sid_name, open_name])

    schema = StructType([*docs.schema.fields, StructField(sid_name, BinaryType()), StructField(open_name, BooleanType())])
    signed_rows = docs.mapInArrow(sign, schema)
    keys = [F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col(sid_name).alias("sid")]
    row = F.struct("text", *(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    judged = signed_rows.where(F.col(open_name)).groupBy(*keys).agg(F.min(row).alias("row"))
    chosen = judged.join(first, ["none", "id", "sid"]).where("leads").select("row.*")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return signed_rows.where(~F.col(open_name)).select(columns).union(chosen.select(columns))


def linked_components(docs: DataFrame, store: Store, size: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id of each document. Two are linked when 100 * intersection >= percent * union.
    `store` writes a DataFrame to the shared folder and reads it again."""
    rows, reps = labelled(docs, store, size, percent)
    least = reps.where("component IS NOT NULL").groupBy("component").agg(F.min("rep").alias("least"))
    named = spread_join(reps, least, "component", "sid").select(F.col("sid").alias("of"), F.coalesce("least", "rep").alias("component_id"))
    out = rows.select("doc_id", "n", "sid").join(named, F.col("sid") == F.col("of"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
