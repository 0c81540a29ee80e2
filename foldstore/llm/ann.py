"""Approximate nearest neighbours by a hierarchical k-means tree.

A tree of k-means splits is grown on a bounded sample (``SAMPLE`` vectors and ``SAMPLE_BYTES``, those with the smallest
hash); every vector is then sent down to its nearest leaf, so the index holds all rows. Leaves grow in number with the
rows, one for each ``ROWS_PER_LEAF``, as long as the sample has ``LEAF`` vectors for each; beyond that they grow in size,
and a second tree within each leaf would be the next step. A query walks the tree best bin first: a priority
queue holds the branches seen so far by their distance from the query, and the nearest is always opened next. How
many leaves are visited is calibrated: for ``CALIBRATION`` vectors the true neighbours are found among all rows, in
blocks, and the number of visits is widened until the leaves visited hold the wanted share of them.

Candidates in visited leaves are compared by their exact distance. A leaf of many rows, or one that many queries visit,
is dealt into blocks of bounded size. Equal vectors are one entry with their smallest ids, as many as any answer can
name, so that a vector that a third of all rows share costs no more than another.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components neither ask nor answer; vectors
of several lengths are searched apart, each among those of its own; rows with a null id take no part; ties go to the smaller id; repeated rows count once; an id with
several vectors asks and answers with the nearest of them; with fewer candidates than neighbours all are returned.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldstore.llm.runtime import clearing, cut, small_batches

SAMPLE, SAMPLE_BYTES = 131_072, 64 << 20
#: Rows of a leaf, about, and its sample vectors at least; a split has so many branches.
ROWS_PER_LEAF, LEAF, BRANCHES, ROUNDS = 256, 16, 16, 8
CALIBRATION, RECALL = 256, 0.95
#: Rows and queries of one block of a leaf.
ROWS, QUERIES = 4096, 8192
#: A query goes on until its leaves hold so many entries at least.
ENOUGH = 64


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows, up to rounding."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None, :], 0)


@dataclass(frozen=True)
class Tree:
    """centres of all nodes, the root first; the children of node k are first[k] to first[k] + fan[k] - 1, none for a leaf; leaf[k] numbers leaves."""

    centres: np.ndarray
    first: np.ndarray
    fan: np.ndarray
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def locate(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector, down the nearest centres."""
        at = np.zeros(len(x), np.int64)
        while True:
            inner = np.unique(at[self.fan[at] > 0])
            if not len(inner):
                return self.leaf[at]
            for node in inner:
                mine = np.flatnonzero(at == node)
                at[mine] = self.first[node] + squared(x[mine], self.centres[self.first[node] : self.first[node] + self.fan[node]]).argmin(1)

    def best_bins(self, q: np.ndarray) -> Iterator[int]:
        """Leaves in the order of a best-bin-first walk."""
        queue, n = [(0.0, 0)], 0
        while queue:
            _, node = heapq.heappop(queue)
            if not self.fan[node]:
                n += 1
                yield int(self.leaf[node])
                continue
            a = int(self.first[node])
            away = ((self.centres[a : a + self.fan[node]] - q) ** 2).sum(1)
            for k, d in enumerate(away.tolist()):
                heapq.heappush(queue, (d, a + k))


def k_means(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Cluster of each row; starts from rows spread evenly over the given order."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)]
    part = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        part = squared(x, centres).argmin(1)
        count = np.bincount(part, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, part, x)
        centres = sums[count > 0] / count[count > 0, None]
    return squared(x, centres).argmin(1)


def grow(sample: np.ndarray, leaf_size: int = ROWS_PER_LEAF, branches: int = BRANCHES) -> Tree:
    """A tree whose leaves hold ``leaf_size`` sample vectors at most, unless these are equal."""
    centres, first, fan, leaf = [sample.mean(0)], [0], [0], [-1]
    work = [(0, np.arange(len(sample)))]
    leaves = 0
    while work:
        node, rows = work.pop()
        part = k_means(sample[rows], min(branches, max(2, -(-len(rows) // leaf_size)))) if len(rows) > leaf_size else np.zeros(len(rows), np.int64)
        kinds = np.unique(part)
        if len(kinds) < 2:
            leaf[node] = leaves
            leaves += 1
            continue
        first[node], fan[node] = len(centres), len(kinds)
        for k in kinds:
            mine = rows[part == k]
            centres.append(sample[mine].mean(0))
            first.append(0)
            fan.append(0)
            leaf.append(-1)
            work.append((len(centres) - 1, mine))
    return Tree(np.array(centres), np.array(first), np.array(fan), np.array(leaf))


def matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of equal length, without nulls, as doubles."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 0)


def valid(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, vector, hash) of the rows that take part."""
    v = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector")).where(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    )
    return v.withColumn("hash", F.xxhash64("vector"))


def _nearest(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, id, distance) of the k nearest rows of each query, exactly, ties to smaller ids."""
    places, found, away = [], [], []
    most = min(len(x), k + 2)
    for a in range(0, len(q) if most else 0, 256):
        block, mine = q[a : a + 256], own[a : a + 256]
        rough = squared(block, x)
        some = np.argpartition(rough, most - 1, axis=1)[:, :most] if most < len(x) else np.tile(np.arange(most), (len(block), 1))
        bound = np.take_along_axis(rough, some, 1).max(1)
        # Rounding can hide a row behind the bound; queries with rows that close to it get them all.
        close = (rough <= (bound + 1e-9 * (1 + bound))[:, None]).sum(1) > most
        exact = np.sqrt(((x[some] - block[:, None, :]) ** 2).sum(2))
        exact[ids[some] == mine[:, None]] = np.inf
        order = np.lexsort((ids[some], exact), axis=1)[:, :k]
        some, exact = np.take_along_axis(some, order, 1), np.take_along_axis(exact, order, 1)
        keep = np.isfinite(exact) & ~close[:, None]
        places.append(np.broadcast_to(np.arange(a, a + len(block))[:, None], keep.shape)[keep])
        found.append(ids[some][keep])
        away.append(exact[keep])
        for j in np.flatnonzero(close):
            near = np.flatnonzero((rough[j] <= bound[j] + 1e-9 * (1 + bound[j])) & (ids != mine[j]))
            d = np.sqrt(((x[near] - block[j]) ** 2).sum(1))
            best = np.lexsort((ids[near], d))[:k]
            places.append(np.full(len(best), a + j))
            found.append(ids[near][best])
            away.append(d[best])
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return join(places, np.int64), join(found, np.int64), join(away, np.float64)


def visits(tree: Tree, index: DataFrame, k: int, recall: float = RECALL) -> tuple[int, float]:
    """Leaves to visit so that the calibration vectors find the wanted share of their true neighbours, and the share found."""
    spark = index.sparkSession
    some = index.orderBy(F.xxhash64("vec_id", "hash"), "vec_id").limit(CALIBRATION).select("vec_id", "vector").toArrow()
    if not some.num_rows:
        return 1, 1.0
    q, own = matrix(some["vector"].combine_chunks()), some["vec_id"].to_numpy()
    shared = spark.sparkContext.broadcast((q, own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, own = shared.value
        for b in batches:
            x, ids, leaf = matrix(b.column(1)), b.column(0).to_numpy(), b.column(2).to_numpy()
            if not len(x):
                continue
            where = pd.Series(leaf, ids)
            where = where[~where.index.duplicated()]
            place, i, d = _nearest(x, ids, q, own, k)
            cols = [place.astype(np.int32), i, d, where.loc[i].to_numpy().astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query", "vec_id", "score", "leaf"])

    near = index.select("vec_id", "vector", "leaf").mapInArrow(run, "query int, vec_id long, score double, leaf int")
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))).where(F.col("rank") <= k).select("query", "leaf").toArrow()
    query, leaf = best["query"].to_numpy(), best["leaf"].to_numpy()
    place = np.zeros(len(query))
    for j in np.unique(query):
        order = {f: n for n, f in enumerate(tree.best_bins(q[j]))}
        mine = query == j
        place[mine] = [order[f] for f in leaf[mine]]
    n = 1
    while n < tree.leaves and (place < n).mean() < recall:
        n = min(tree.leaves, max(n + 1, n * 5 // 4))
    return n, float((place < n).mean()) if len(place) else 1.0


def _with_leaf(df: DataFrame) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField("leaf", T.IntegerType())])


@clearing
def search(rows: DataFrame, is_query, *, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row for whose vec_id the column ``is_query`` holds;
    and recall, the share of true neighbours that the calibration vectors found."""
    spark = rows.sparkSession
    small_batches(spark, 4096)
    every = valid(rows, vec_id, vector)
    # A row for each length of vectors; nearly always there is one.
    lengths = [r["n"] for r in every.select(F.size("vector").alias("n")).distinct().orderBy("n").toLocalIterator()]
    found = [_search(every.where(F.size("vector") == n) if len(lengths) > 1 else every, is_query, k, recall, n) for n in lengths]
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], RESULT)


RESULT = "query_id long, rank int, vec_id long, score double, recall double"


def _search(every: DataFrame, is_query, k: int, recall: float, length: int) -> DataFrame:
    """The search among valid vectors (vec_id, vector, hash) of one length."""
    spark = every.sparkSession
    same = Window.partitionBy("hash", "vector").orderBy("vec_id")
    entries = cut(every.withColumn("nth", F.dense_rank().over(same)).where(F.col("nth") <= k + 1).select("vec_id", "vector", "hash").dropDuplicates(["hash", "vector", "vec_id"]), "ann-entries")
    n = entries.count()
    sample = entries.orderBy("hash", "vec_id").limit(min(SAMPLE, SAMPLE_BYTES // (8 * length))).select("vector").toArrow()
    tree = grow(matrix(sample["vector"].combine_chunks()), max(LEAF, sample.num_rows * ROWS_PER_LEAF // n))
    shared = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = shared.value.locate(matrix(b.column(1))) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf.astype(np.int32))], [*b.schema.names, "leaf"])

    index = cut(entries.mapInArrow(place, _with_leaf(entries)), "ann-index")
    count = np.zeros(tree.leaves, np.int64)
    for leaf, n in index.groupBy("leaf").count().collect():  # one row for each leaf of the bounded tree
        count[leaf] = n
    width, reached = visits(tree, index, k, recall)
    held = spark.sparkContext.broadcast((count, width))
    enough = max(ENOUGH, 2 * k)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, (count, width) = shared.value, held.value
        for b in batches:
            x, at, leaves = matrix(b.column(1)), [], []
            for j in range(len(x)):
                seen = 0
                for n, leaf in enumerate(tree.best_bins(x[j])):
                    if n >= width and seen >= enough:
                        break
                    seen += count[leaf]
                    at.append(j)
                    leaves.append(leaf)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), b.column(1).take(pa.array(at, pa.int64())), pa.array(leaves, pa.int32())], ["query_id", "query", "leaf"])

    asks = every.where(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query")).dropDuplicates()
    asks = cut(asks.mapInArrow(walk, _with_leaf(asks)), "ann-asks")
    asked = np.zeros(tree.leaves, np.int64)
    for leaf, n in asks.groupBy("leaf").count().collect():
        asked[leaf] = n
    blocks = np.maximum(1, -(-count // ROWS)), np.maximum(1, -(-asked // QUERIES))
    table = spark.createDataFrame(pd.DataFrame({"leaf": np.arange(tree.leaves, dtype=np.int32), "row_blocks": blocks[0], "ask_blocks": blocks[1]}))
    mine = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).alias
    each = lambda n, name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias(name)
    left = index.join(F.broadcast(table), "leaf").select("leaf", mine("vec_id", "row_blocks")("r"), each("ask_blocks", "a"), "vec_id", "vector")
    right = asks.join(F.broadcast(table), "leaf").select("leaf", mine("query_id", "ask_blocks")("a"), each("row_blocks", "r"), "query_id", "query")

    def compare(rows: pa.Table, asks: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not rows.num_rows or not asks.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)
        q = asks["query_id"].to_numpy()
        place, ids, d = _nearest(matrix(rows["vector"].combine_chunks()), rows["vec_id"].to_numpy(), matrix(asks["query"].combine_chunks()), q, k)
        return pa.table([q[place], ids, d], names)

    found = left.groupBy("leaf", "r", "a").cogroup(right.groupBy("leaf", "r", "a")).applyInArrow(compare, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", F.lit(reached).alias("recall"))
