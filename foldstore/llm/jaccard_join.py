"""Exact Jaccard join of documents as a metric-space join.

The distance of two documents is 1 minus the Jaccard similarity of their sets of 5-word shingles, a metric. Documents
link at a distance of at most 1/4.

Regions. Unrelated documents share no shingle and are all at distance 1 from each other, so document pivots would tell
nothing apart at the top level. The pivots there are single shingles: a document lies at 1 - 1/size from the shingles
that it holds, at 1 from all others. Of its equally near pivots a document belongs to the first in one global order,
rare before frequent (counts of hashed shingles over all documents decide, then the hash).

Windows. By the triangle inequality two linked documents of sizes m and n differ in at most (m + n)/7 shingles, so a
document of size n can meet a partner only at one of its first n - ceil(3n/4) + 1 pivots, and it is replicated to just
these. The same bound says how many of them two linked documents share at least, see ``least_common``.

Within regions documents are the pivots. Every document is measured from the leader that seems nearest to it, and those
within 1/4 of each other are one class from then on. Large regions that still hold several classes are divided again,
``ROUNDS`` times: some of their documents, drawn by hash, are pivots, every other document goes to the Voronoi region of
the one that seems nearest, is measured from it, and joins its class if it lies within 1/4. What is left are pairs of
different classes. They are narrowed by the windows of the pivots that both were measured from (distances that differ by
over 1/4 exclude a link), by sizes, by the number of shared pivots and by sketches, and what remains is compared,
exactly, on whole sets. Regions with the same least node are joined as one, so that a pair is a row for each such node
and not for each pivot that it shares. Regions of frequent shingles are dealt into parts first.

Sketches. A sketch is the parity of the shingles that fall to each of ``SKETCH`` places. The places where two sketches
differ never outnumber the symmetric difference of the sets, a metric too, so that more than (m + n)/7 of them exclude a
link: exactly, and before a pair becomes a row. "Seems nearest" above is by the same number.

Copies with equal sets are one node throughout, however many there are, so no group of copies is ever expanded into
pairs; members of one class are never paired either. A node goes by 64 bits of its content's 128-bit digest; the few
that share them (one pair in 6 billion nodes is to be expected) go by the other 64.

Shared state has a bound: 2^20 frequent shingles for the order, and 2^24 bits that tell which documents' texts are read
again. Neither decides a result.

Defined cases: null and empty texts, and texts without words, have size 0 and link with nothing; a text of fewer than 5
words is one shingle; repeated rows are copies; documents with a null id are measured and form no class id of their
own (the class id is the smallest id that isn't null, null if there is none); very long texts are one set, held by one
task at a time; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldstore.llm import hashing
from foldstore.llm.runtime import clearing, cut, give_back, passing, small_batches, tidy

WORDS = 5
#: Links at 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Shingles are counted by so many bits of their hashes, and pivots are known by so many.
COUNT_BITS, PIVOT_BITS = 40, 56
#: A task reports shingles that it counted so often; in all, those that reach the second number are frequent, and so many of them are told apart.
REPORTED, FREQUENT, MOST_FREQUENT = 2, 8, 1 << 20
#: Shingles that a task counts, and replicas that it gathers, before it hands them on.
COUNTED_AT_ONCE, REPLICAS_AT_ONCE = 1_000_000, 500_000
#: Replicas of one bucket of regions, about.
BUCKET = 300_000
#: Leaders, of those that share most pivots with it, among which a document looks for the nearest.
LEADERS = 3
#: Documents of a region that is divided again, how often that is done, and into how many.
LARGE, ROUNDS, PIVOTS = 8, 2, 16
#: Documents of one part of a frequent shingle's region, about.
PART = 4096
#: 64-bit words of a sketch.
SKETCH_WORDS = 8
SKETCH = 64 * SKETCH_WORDS
#: Sketches of unrelated sets differ in half of their places; up to so many say that two documents seem near.
TELLING = SKETCH * 35 // 100
#: Shingles that are measured from one copy of a pivot.
TURN = 200_000
SALTS = 16
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD)]


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text the sorted array of its distinct shingles, as 64-bit hashes."""
    data, offsets = hashing.buffers(texts)
    for i, j in hashing.chunks(offsets):
        (word,), first = hashing.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], hashing.BLANK_PARTED)
        n = len(word) - WORDS + 1
        runs = hashing.mix(sum(word[k : k + n] * f for k, f in enumerate(_FACTORS))) if n > 0 else word[:0]
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= WORDS:
                s = np.sort(runs[a : b - WORDS + 1])
                yield s[np.concatenate([[True], s[1:] != s[:-1]])]
            elif b > a:
                whole = sum(word[k : k + 1] * f for k, f in zip(range(a, b), _FACTORS)) + np.uint64(b - a)
                yield hashing.mix(hashing.mix(whole))
            else:
                yield word[:0]


def content_hash(shingles: np.ndarray) -> tuple[int, int]:
    """A set's 128-bit name, as two signed 64-bit numbers."""
    import xxhash

    d = xxhash.xxh3_128_digest(shingles.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


@dataclass(frozen=True)
class Names:
    """What a set goes by: the lower half of its digest, or the upper one where sets share the lower."""

    digest: Callable[[np.ndarray], tuple[int, int]]
    clashes: frozenset[int] = frozenset()

    def __call__(self, shingles: np.ndarray) -> int:
        high, low = self.digest(shingles)
        return high if low in self.clashes else low

    def column(self) -> Column:
        return F.when(F.col("low").isin(list(self.clashes)), F.col("high")).otherwise(F.col("low")) if self.clashes else F.col("low")


def window(n: int) -> int:
    """How many of its first pivots a document of n shingles is replicated to."""
    return n - (PERCENT * n + 99) // 100 + 1


def _overlap(m, n):
    """Least common shingles of linked documents of sizes m and n."""
    return F.ceil(F.lit(PERCENT) * (m + n) / F.lit(100 + PERCENT))


def least_common(m, n):
    """Least number of pivots that linked documents of sizes m and n share within both windows.

    With an overlap of o, the k-th common shingle in the global order is at most the (k + m - o)-th of the first
    document and the (k + n - o)-th of the second; both lie in the windows for k up to this number.
    """
    reach = lambda s: s - F.ceil(F.lit(PERCENT) * s / 100) + 1 - s + _overlap(m, n)
    return F.greatest(F.lit(1), F.least(reach(m), reach(n)))


def _sizes_allow(m, n):
    return F.lit(100) * F.least(m, n) >= F.lit(PERCENT) * F.greatest(m, n)


def _linked(common: Column, m: Column, n: Column) -> Column:
    return F.lit(100) * common >= F.lit(PERCENT) * (m + n - common)


def sketch(s: np.ndarray) -> np.ndarray:
    """The parities of a set's shingles by place, as signed 64-bit words."""
    odd = np.bincount((s & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


SKETCHES = [f"k{i}" for i in range(SKETCH_WORDS)]


def _differing(x: str, y: str) -> Column:
    """Places where two sketches differ, of columns with these prefixes."""
    return sum((F.bit_count(F.col(f"{x}{k}").bitwiseXOR(F.col(f"{y}{k}"))) for k in SKETCHES[1:]), F.bit_count(F.col(f"{x}k0").bitwiseXOR(F.col(f"{y}k0"))))


def _sketches_allow(differing: Column, m: Column, n: Column) -> Column:
    """Linked documents differ in m + n - 2 * overlap shingles at most."""
    return differing <= m + n - 2 * _overlap(m, n)


MEASURED = "doc_id long, n long, high long, low long, " + ", ".join(f"{k} long" for k in SKETCHES) + ", shingle long, count long"


def _measure(docs: DataFrame, digest: Callable[[np.ndarray], tuple[int, int]]) -> DataFrame:
    """A row for each document (doc_id, n, high, low, its sketch), and rows (shingle, count) for the order of shingles."""
    names = [x.split()[0] for x in MEASURED.split(", ")]

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        at, n = np.unique(np.concatenate(held) >> np.uint64(64 - COUNT_BITS), return_counts=True)
        some = n >= REPORTED
        return pa.RecordBatch.from_arrays([*[pa.nulls(int(some.sum()), pa.int64())] * (len(names) - 2), pa.array(at[some].view(np.int64)), pa.array(n[some])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for b in batches:
            rows, sketches = [], []
            for s in shingle_sets(b.column(1)):
                held.append(s)
                size += len(s)
                rows.append((len(s), *digest(s)))
                sketches.append(sketch(s))
                if size >= COUNTED_AT_ONCE:
                    yield counted(held)
                    held, size = [], 0
            cols = list(np.array(rows, np.int64).T) + list(np.array(sketches, np.int64).T) if rows else [np.zeros(0, np.int64)] * (3 + SKETCH_WORDS)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols), *[pa.nulls(len(rows), pa.int64())] * 2], names)
        if held:
            yield counted(held)

    return docs.mapInArrow(tidy(run), MEASURED)


def _order(measured: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(frequent shingles, sorted; the logarithms of their counts)."""
    sums = measured.where("shingle is not null").groupBy("shingle").agg(F.sum("count").alias("count")).where(F.col("count") >= FREQUENT)
    rows = sums.orderBy(F.desc("count"), "shingle").limit(MOST_FREQUENT).toArrow()
    at = rows["shingle"].to_numpy().view(np.uint64)
    k = np.argsort(at)
    return at[k], np.log2(rows["count"].to_numpy()[k]).astype(np.uint8)


def in_order(s: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The window of a set: its first pivots in the global order, and their classes, 0 for rare ones."""
    at, classes = frequent
    c = np.zeros(len(s), np.uint8)
    if len(at):
        b = s >> np.uint64(64 - COUNT_BITS)
        k = np.minimum(np.searchsorted(at, b), len(at) - 1)
        c = np.where(at[k] == b, classes[k], 0)
    k = np.argsort(c, kind="stable")[: window(len(s))]  # s is sorted, so ties follow the hash
    return s[k], c[k]


# Replicas travel in blocks, one for each bucket of regions: sorted by region, each column as planes of bytes, compressed.
REPLICA = np.dtype([("pivot", np.uint64), ("part", np.int32), ("node", np.int64), ("n", np.int32), ("pos", np.int32)])


def to_block(rows: np.ndarray) -> bytes:
    """Replicas sorted by pivot; nodes are numbered within the block."""
    nodes, first, which = np.unique(rows["node"], return_index=True, return_inverse=True)
    columns = [np.diff(rows["pivot"], prepend=np.uint64(0)), which.astype(np.uint32), (rows["part"] + 1).astype(np.uint32), rows["pos"].astype(np.uint32)]
    planes = [c.view(np.uint8).reshape(len(rows), -1).T.tobytes() for c in columns]
    head = np.array([len(rows), len(nodes)], np.int64).tobytes() + nodes.tobytes() + rows["n"][first].tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes))


def from_block(data: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, k = np.frombuffer(raw, np.int64, 2).tolist()
    nodes, sizes, at = np.frombuffer(raw, np.int64, k, 16), np.frombuffer(raw, np.int32, k, 16 + 8 * k), 16 + 12 * k
    rows = np.empty(n, REPLICA)

    def column(kind) -> np.ndarray:
        nonlocal at
        width = np.dtype(kind).itemsize
        got = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(kind).ravel()
        at += n * width
        return got

    rows["pivot"] = np.cumsum(column(np.uint64), dtype=np.uint64)
    which = column(np.uint32)
    rows["node"], rows["n"] = nodes[which], sizes[which]
    rows["part"] = column(np.uint32).astype(np.int32) - 1
    rows["pos"] = column(np.uint32)
    return rows


def _replicate(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], names: Names, buckets: int) -> DataFrame:
    """(bucket, block): replicas of every document for the pivots in its window; part is -1 where a region is whole."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def blocks(held: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(held)
        bucket = (hashing.mix(rows["pivot"] ^ hashing.mix(rows["part"].astype(np.uint64))) % np.uint64(buckets)).astype(np.int64)
        k = np.lexsort((rows["pivot"], bucket))
        rows, bucket = rows[k], bucket[k]
        kinds, first = np.unique(bucket, return_index=True)
        return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array([to_block(x) for x in np.split(rows, first[1:])], pa.binary())], ["bucket", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        done: set[int] = set()
        held, size = [], 0
        for b in batches:
            for s in shingle_sets(b.column(1)):
                if not len(s):
                    continue
                node = names(s)
                if node in done:  # a copy within the task
                    continue
                if len(done) < 300_000:
                    done.add(node)
                p, c = in_order(s, order)
                share = np.maximum(1, (1 << c.astype(np.int64)) // PART)
                rows = np.empty(len(p), REPLICA)
                rows["pivot"], rows["node"], rows["n"], rows["pos"] = p >> np.uint64(64 - PIVOT_BITS), node, len(s), np.arange(1, len(p) + 1)
                rows["part"] = np.where(share > 1, (node & 0x7FFFFFFF) % share, -1)
                held.append(rows)
                size += len(rows)
                if size >= REPLICAS_AT_ONCE:
                    yield blocks(held)
                    held, size = [], 0
        if held:
            yield blocks(held)

    return docs.mapInArrow(tidy(run), "bucket long, block binary")


REGIONS = "pivot long, part int, node long, n long, pos int, leader long, nl long, drawn int"


def _meet(rows: np.ndarray, region: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (first, second) of rows in regions of fewer than LARGE documents that sizes and positions allow."""
    first, second = [], []
    for step in range(1, LARGE - 1):
        k = np.flatnonzero(region[step:] == region[:-step])
        m, n = rows["n"][k].astype(np.int64), rows["n"][k + step].astype(np.int64)
        overlap = -(-PERCENT * (m + n) // (100 + PERCENT))
        reach = [overlap - -(-PERCENT * x // 100) + 1 for x in (m, n)]
        half = (np.maximum(1, np.minimum(*reach)) + 1) // 2
        ok = (100 * np.minimum(m, n) >= PERCENT * np.maximum(m, n)) & (rows["pos"][k] <= m - overlap + half) & (rows["pos"][k + step] <= n - overlap + half)
        first.append(k[ok])
        second.append(k[ok] + step)
    return np.concatenate(first), np.concatenate(second)


def _gather(table: pa.Table) -> pa.Table:
    """Of small regions the pairs of documents (leader, node) that may link, without a pivot; of large ones, and of parts,
    the documents, each with the region's leader, and with bit k of ``drawn`` set for the pivots of round k."""
    rows = np.concatenate([from_block(x.as_py()) for x in table["block"]])
    rows = rows[np.lexsort((rows["node"], rows["part"], rows["pivot"]))]
    same = np.concatenate([[False], (rows[1:]["pivot"] == rows[:-1]["pivot"]) & (rows[1:]["part"] == rows[:-1]["part"])])
    once = ~(same & np.concatenate([[False], rows[1:]["node"] == rows[:-1]["node"]]))  # copies of different tasks
    rows, same = rows[once], same[once]
    region = np.cumsum(~same) - 1
    first = np.flatnonzero(~same)
    members = np.bincount(region)[region]
    large = (members >= LARGE) | (rows["part"] >= 0)
    few = np.flatnonzero(~large & (members > 1))
    x, y = (few[i] for i in _meet(rows[few], region[few]))
    k = np.flatnonzero(large)
    head = first[region[k]]
    drawn = np.zeros(len(k), np.int32)
    for turn in range(ROUNDS):
        by = np.lexsort((hashing.mix(rows["node"][k].view(np.uint64) + np.uint64(turn + 1)), region[k]))
        place = np.arange(len(k)) - np.searchsorted(region[k], region[k])[by] if len(k) else np.zeros(0, np.int64)
        drawn[by[place < PIVOTS]] |= 1 << turn
    none = lambda kind: pa.nulls(len(y), kind)
    joined = lambda a, b: pa.chunked_array([a, b])
    column = lambda c, at: pa.array(np.ascontiguousarray(rows[c][at]).astype(np.int64))
    columns = [
        joined(none(pa.int64()), column("pivot", k)), joined(none(pa.int32()), pa.array(np.ascontiguousarray(rows["part"][k]))),
        joined(column("node", y), column("node", k)), joined(column("n", y), column("n", k)), joined(none(pa.int32()), pa.array(np.ascontiguousarray(rows["pos"][k]))),
        joined(column("node", x), column("node", head)), joined(column("n", x), column("n", head)), joined(none(pa.int32()), pa.array(drawn)),
    ]
    give_back()
    return pa.table(columns, [c.split()[0] for c in REGIONS.split(", ")])


def _measured_pairs(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, names: Names, what: str) -> DataFrame:
    """pairs (a, b, na, nb) with the size of their intersection, from the whole sets.

    Only texts of documents in pairs are read again; a bit set of bounded size, tested where the texts lie, passes these
    and a few others. A text travels to the turns of the documents a that it is measured from; within a turn, sorted,
    the text of a comes first, so that a task holds two sets at a time.
    """
    turns = pairs.groupBy("a").agg(F.ceil(F.sum("nb") / TURN).alias("turns"))
    dealt = cut(pairs.join(turns, "a").withColumn("turn", F.pmod(F.xxhash64("b"), F.col("turns"))).drop("turns"), f"{what}-turns")
    wants = dealt.select(F.col("b").alias("node"), F.col("a").alias("host"), "turn", F.lit(1).alias("role"), "na", "nb")
    hosts = dealt.select(F.col("a").alias("node"), F.col("a").alias("host"), "turn", F.lit(0).alias("role"), "na", F.lit(0).cast("long").alias("nb")).distinct()
    wants = wants.union(hosts)
    involved = cut(wants.select("node").distinct().join(nodes, "node").select(F.col("rep").alias("set_id")), f"{what}-involved")
    some = passing(docs, "doc_id", involved).select("text")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for b in batches:
            # A repeated id may come with other texts: the content's own name tells which row is meant.
            own = [names(s) for s in shingle_sets(b.column(0))]
            new = [k for k, x in enumerate(own) if not (x in done or done.add(x))]
            if len(done) > 300_000:
                done.clear()
            yield pa.RecordBatch.from_arrays([pa.array([own[k] for k in new], pa.int64()), b.column(0).take(pa.array(new, pa.int64()))], ["node", "text"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, turn, base = None, None, None
        for b in batches:
            out = []
            for s, h, t, role, node, na, nb in zip(shingle_sets(b.column(6)), *(b.column(k).to_pylist() for k in range(6)), strict=True):
                if role == 0:
                    host, turn, base = h, t, s
                    continue
                if (h, t) != (host, turn):
                    raise RuntimeError("the text of a pivot is missing")
                at = np.minimum(np.searchsorted(base, s), len(base) - 1)
                out.append((h, node, na, nb, int((base[at] == s).sum())))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "na", "nb", "common"])

    texts = some.mapInArrow(tidy(named), "node long, text string")
    rows = texts.join(wants, "node").select("host", "turn", "role", "node", "na", "nb", "text")
    rows = rows.repartition("host", "turn").sortWithinPartitions("host", "turn", "role")
    return cut(rows.mapInArrow(tidy(compared), "a long, b long, na long, nb long, common long").distinct(), f"{what}-measured")


def components(links: DataFrame) -> DataFrame:
    """(node, label) with the least id of each connected component, for every id of links (a, b).

    Rounds of contraction: every class takes the least class that it touches and what that one takes, and links within
    a class go. A class is named after its least id, so the last name is the component's least id. What is left halves
    with every round at least; each round is written to the shared folder, so that the lineage stays short.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b"), F.col("a")))
    left = cut(links.where("a <> b").select("a", "b").distinct(), "cc-links")
    names = cut(both(links).select(F.col("a").alias("node"), F.col("a").alias("label")).distinct(), "cc-names")
    while left.limit(1).count():
        near = cut(both(left).groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")), "cc-near")
        far = near.select(F.col("a").alias("to"), F.col("to").alias("on"))
        step = cut(near.join(far, "to", "left").select(F.col("a").alias("old"), F.coalesce("on", "to").alias("new")), "cc-step")
        to = lambda c, name: step.select(F.col("old").alias(c), F.col("new").alias(name))
        left = cut(left.join(to("a", "x"), "a").join(to("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct(), "cc-links")
        names = cut(names.join(to("label", "new"), "label", "left").select("node", F.coalesce("new", "label").alias("label")), "cc-names")
    return names


def _relabel(spark: SparkSession, label: DataFrame, links: DataFrame) -> DataFrame:
    """label (node, label, ...) after links (a, b) of nodes have joined their classes."""
    of = lambda c, name: label.select(F.col("node").alias(c), F.col("label").alias(name))
    classes = links.join(of("a", "x"), "a").join(of("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    found = components(classes).select(F.col("node").alias("label"), F.col("label").alias("new"))
    return cut(label.join(found, "label", "left").withColumn("label", F.coalesce("new", "label")).drop("new"), "join-labels")


def _several(regions: DataFrame, label: DataFrame, what: str) -> DataFrame:
    """Regions of several classes, with the class of every document and, as head and main, the least node and its class."""
    classed = cut(regions.join(label.select("node", "label"), "node"), what)
    mixed = classed.groupBy("pivot").agg(F.min("node").alias("head"), F.min_by("label", "node").alias("main"), F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 < l1").select("pivot", "head", "main")
    return classed.join(mixed, "pivot")


@clearing
def join(docs: DataFrame, digest: Callable[[np.ndarray], tuple[int, int]] = content_hash) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs`` (doc_id, text)."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark, 500)
    c = F.col
    docs = docs.select(c("doc_id").cast("long").alias("doc_id"), "text")
    measured = cut(_measure(docs, digest), "join-measured")
    members = measured.where("shingle is null")
    sums = [F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("size"), *[F.max(k).alias(k) for k in SKETCHES]]
    sets = cut(members.where("n > 0").groupBy("low", "high").agg(*sums), "join-sets")
    # Of N sets about N * N / 2^65 share a name: few enough for a list.
    names = Names(digest, frozenset(r.low for r in sets.groupBy("low").count().where("count > 1").select("low").toLocalIterator()))
    nodes = sets.select(names.column().alias("node"), "rep", "copies", "size", *SKETCHES)

    replicas = members.agg(F.sum(c("n") - F.ceil(F.lit(PERCENT) * c("n") / 100) + 1).alias("n")).first()["n"] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-replicas // BUCKET))
    blocks = _replicate(docs, _order(measured), names, buckets)
    regions = cut(blocks.groupBy("bucket").applyInArrow(_gather, REGIONS), "join-regions")

    star = regions.where("pivot is not null and node <> leader").select(c("leader").alias("a"), c("node").alias("b"), c("nl").alias("na"), c("n").alias("nb"))
    # The leader of a part stands for it in the region of its shingle, even if it is alone.
    heads = regions.where("pivot is not null and part >= 0").select("pivot", c("leader").alias("node"), c("nl").alias("n")).distinct()
    top = Window.partitionBy("pivot")
    heads = heads.withColumn("a", F.min("node").over(top)).withColumn("na", F.min_by("n", "node").over(top)).where("node <> a").select("a", c("node").alias("b"), "na", c("n").alias("nb"))
    # Stars only make classes early; what they leave out waits for the exact pass below.
    counted = lambda pairs: pairs.groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.sum("shared").alias("shared"))
    one = F.lit(1).cast("long").alias("shared")
    few = cut(counted(regions.where("pivot is null").select(c("leader").alias("a"), c("node").alias("b"), c("nl").alias("na"), c("n").alias("nb"), one)), "join-few")
    star = counted(star.union(heads).select("*", one).union(few))
    star = star.where(_sizes_allow(c("na"), c("nb")) & (c("shared") * 4 >= least_common(c("na"), c("nb"))))
    best = Window.partitionBy("b").orderBy(F.desc("shared"), "a")
    star = star.withColumn("nth", F.row_number().over(best)).where(c("nth") <= LEADERS)
    side = lambda name: nodes.select(c("node").alias(name), *[c(k).alias(f"{name}_{k}") for k in SKETCHES])

    def sketched(pairs: DataFrame) -> DataFrame:
        """pairs whose sketches allow a link, with the places where these differ."""
        both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("differ", _differing("a_", "b_"))
        return both.where(_sketches_allow(c("differ"), c("na"), c("nb"))).select("a", "b", "na", "nb", "differ")

    nearest = lambda pairs: pairs.groupBy("b").agg(F.min(F.struct("differ", "a", "na", "nb")).alias("x")).select("x.a", "b", "x.na", "x.nb")
    star = _measured_pairs(cut(nearest(sketched(star)), "join-star"), docs, nodes, names, "star")
    # A node whose rows all have a null id goes by its own number until the end.
    label = nodes.select("node", "copies", "size", "rep", F.coalesce("rep", "node").alias("label"))
    known, links = star, star.where(_linked(c("common"), c("na"), c("nb"))).select("a", "b")
    label = _relabel(spark, label, links)

    large = regions.where("pivot is not null").select("pivot", "part", "node", "n", "pos", "drawn").join(nodes.select("node", *SKETCHES), "node")
    for k in range(ROUNDS):
        rows = cut(_several(large, label, "join-large"), "join-round")
        drawn = rows.where(c("drawn").bitwiseAND(1 << k) > 0).select("pivot", "part", c("node").alias("a"), c("n").alias("na"), c("label").alias("a_label"), *[c(x).alias(f"a_{x}") for x in SKETCHES])
        both = rows.select("pivot", "part", c("node").alias("b"), c("n").alias("nb"), "label", *[c(x).alias(f"b_{x}") for x in SKETCHES]).join(drawn, ["pivot", "part"])
        seems = _sketches_allow(_differing("a_", "b_"), c("na"), c("nb")) & (_differing("a_", "b_") <= TELLING)
        both = both.where((c("label") != c("a_label")) & _sizes_allow(c("na"), c("nb")) & seems)
        pairs = cut(nearest(both.withColumn("differ", _differing("a_", "b_"))).join(known.select("a", "b"), ["a", "b"], "left_anti"), "join-voronoi")
        if pairs.isEmpty():
            break
        found = _measured_pairs(pairs, docs, nodes, names, "voronoi")
        links = found.where(_linked(c("common"), c("na"), c("nb"))).select("a", "b")
        known, label = known.union(found), _relabel(spark, label, links)

    # Pairs of different classes that some region holds.
    away = 1 - c("common") / (c("na") + c("nb") - c("common"))
    middle = star.select(c("b").alias("node"), c("a").alias("centre"), away.alias("away"))
    # Regions with one head are joined as one, so that a pair is a row for each head and not for each pivot that it shares.
    apart = ["node", "n", "label", "held"]
    held = F.sort_array(F.collect_list(F.struct("pos", "pivot"))).alias("held")
    by_head = _several(large, label, "join-large").groupBy("head", "node").agg(*[F.max(k).alias(k) for k in ("n", "label", "main")], held)
    many = by_head.join(middle, "node", "left").join(nodes.select("node", *SKETCHES), "node")
    many = cut(many.select("head", *apart, (c("label") != c("main")).alias("stray"), "centre", "away", *SKETCHES), "join-many")
    x = many.where("stray").select("head", *[c(k).alias(f"x_{k}") for k in [*apart, "centre", "away", *SKETCHES]])
    y = many.select("head", *[c(k).alias(f"y_{k}") for k in [*apart, "stray", "centre", "away", *SKETCHES]])
    allowed = (c("x_label") != c("y_label")) & (~c("y_stray") | (c("x_node") < c("y_node"))) & _sizes_allow(c("x_n"), c("y_n"))

    limit = 1 - PERCENT / 100 + 1e-9
    near = F.coalesce((c("x_centre") != c("y_centre")) | (F.abs(c("x_away") - c("y_away")) <= limit), F.lit(True)) & _sketches_allow(_differing("x_", "y_"), c("x_n"), c("y_n"))
    low = c("x_node") < c("y_node")
    pick = lambda f, g, name: F.when(low, c(f)).otherwise(c(g)).alias(name)
    # Of least_common pivots half are asked for, within windows that are shorter by the other half.
    half = F.ceil(least_common(c("x_n"), c("y_n")) / 2)
    within = lambda k: F.slice(f"{k}_held.pivot", 1, F.size(F.filter(f"{k}_held.pos", lambda pos: pos <= c(f"{k}_n") - _overlap(c("x_n"), c("y_n")) + half)))
    shared = F.size(F.array_intersect(within("x"), within("y"))).cast("long").alias("shared")
    met = x.join(y, "head").where(allowed & near).select(pick("x_node", "y_node", "a"), pick("y_node", "x_node", "b"), pick("x_n", "y_n", "na"), pick("y_n", "x_n", "nb"), shared).where("shared > 0")
    pairs = counted(met.union(few)).where(c("shared") >= F.ceil(least_common(c("na"), c("nb")) / 2))
    of = lambda name: label.select(c("node").alias(name), c("label").alias(f"{name}_label"))
    pairs = pairs.join(of("a"), "a").join(of("b"), "b").where("a_label <> b_label")
    asked = known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = cut(sketched(pairs).drop("differ").join(asked, ["a", "b"], "left_anti"), "join-rest")
    rest = _measured_pairs(pairs, docs, nodes, names, "rest")
    label = _relabel(spark, label, rest.where(_linked(c("common"), c("na"), c("nb"))).select("a", "b"))

    unnamed = label.where("rep is null").select("label").distinct()
    least = label.join(unnamed, "label").groupBy("label").agg(F.min("rep").alias("least"), F.lit(True).alias("renamed"))
    named = label.join(least, "label", "left").withColumn("component", F.when(c("renamed"), c("least")).otherwise(c("label")))
    named = named.where("copies > 1 or rep is null or component <> rep").select("node", "component")
    named = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    every = members.select("doc_id", "n", names.column().alias("node")).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return every.join(named, ["node", "salt"], "left").select("doc_id", c("n").alias("n_shingles"), F.when(c("n") == 0, c("doc_id")).otherwise(F.coalesce("component", "doc_id")).alias("component_id"))
