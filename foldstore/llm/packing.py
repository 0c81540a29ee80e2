"""Packing of tokenised documents into sequences of bounded length by best fit and swap-based local search.

1. Texts are tokenised where they lie; a document is its ids and a closing 0. Only documents longer than a sequence are
   cut, into full pieces and a rest. What goes on is one narrow row for each piece.
2. Full pieces are sequences by themselves. The others are dealt at random into blocks of some thousand pieces.
3. A block is packed by best fit, longest piece first; then pieces are moved and exchanged (one for one, two for one, one
   for two) between any two of its underfull sequences, found by an index of lengths, as long as the sum of squared fills
   rises, which empties the least filled.
4. Sequences that stay underfull give their pieces back; these are dealt into blocks of all leftovers and packed again,
   so that what is lost doesn't grow with the number of blocks.

Tokenising works by words: pieces of the tokenizer never cross white space, so the ids of a blank-parted word are looked
up once. That holds for texts of the characters in ``PLAIN``; any other text goes through the tokenizer itself.

Defined cases: a null or empty text is the single id 0; repeated rows are packed each, in whichever blocks their row
numbers fall to; of pieces of equal length the one with the smaller doc_id, null first, and piece is packed first; very
long texts are cut one at a time; an empty table gives no rows; other columns of ``docs`` aren't read.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldstore.llm.runtime import clearing, cut, scratch, small_batches, tidy

CAPACITY = 2048
BLOCK = 8192
#: The fill below which a sequence is packed again.
AGAIN = 0.97
#: Words in each generation of the table of known words.
CACHE = 200_000
#: Letters, digits and signs of Latin scripts and common punctuation: the tokenizer's normalisation only lower-cases these, and its classes are those of Python.
PLAIN = re.compile("[\t\n\r -~¡-¬®-ɏ–—‘’“”…]*")


class WordTokenizer:
    """Ids of texts as little-endian unsigned 32-bit numbers.

    Ids of words are kept in two generations: when the younger is full it becomes the elder, and what the elder had is
    forgotten unless it is met again.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        bare = json.loads(self.whole.to_str())
        bare["normalizer"] = None  # new words come lower-cased, in characters that normalisation doesn't change
        # Bytes of each token: byte-level names have a character for each, and a mark at a word's end.
        vocabulary = bare["model"]["vocab"]
        mark = bare["model"].get("end_of_word_suffix") or ""
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for name, k in vocabulary.items():
            self.bytes[k] = len(name.removesuffix(mark))
        self.bare = Tokenizer.from_str(json.dumps(bare))
        self.young: dict[str, bytes] = {}
        self.elder: dict[str, bytes] = {}

    def _learn(self, new: list[str]) -> None:
        """Tokenise words in one go; no token crosses words and none leaves a byte out, so that bytes tell whose it is."""
        ids = np.asarray(self.bare.encode(" ".join(new), add_special_tokens=False).ids, dtype="<u4")
        ends = np.cumsum(np.fromiter(map(len, map(str.encode, new)), np.int64, len(new)))
        last = np.searchsorted(np.cumsum(self.bytes.take(ids)), ends) + 1
        data, first = ids.tobytes(), 0
        for w, end in zip(new, (4 * last).tolist(), strict=True):
            self.young[w] = data[first:end]
            first = end

    def _direct(self, text: str) -> bytes:
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not PLAIN.fullmatch(text) or "<|" in text:
            return self._direct(text)
        words = text.lower().split()
        young = self.young
        new = [w for w in set(words) if w not in young]
        if new:
            if len(new) > CACHE:
                return self._direct(text)
            if len(young) + len(new) > CACHE:
                self.young, self.elder = young, _ = {}, young
                new = list(set(words))
            elder = self.elder
            fresh = [w for w in new if w not in elder]
            if len(fresh) < len(new):
                young.update((w, elder[w]) for w in new if w in elder)
            if fresh:
                self._learn(fresh)
        return b"".join(map(young.__getitem__, words))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordTokenizer(path)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, and a number of its own."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = tokenizer(path)
        row = TaskContext.get().partitionId() << 36
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = ids_of(text.as_py()) + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), row))
                    row += 1
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "row"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), PIECES)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes: longest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r: some bin has room r
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[k].append(i)
        else:
            k, room = len(bins), capacity
            bins.append([i])
        by_room.setdefault(room - n, []).append(k)
        rooms |= 1 << (room - n)
    return bins


class Underfull:
    """The underfull bins of a block, with the lengths that each holds, and where to find a length or a sum of two.

    Pieces of one length are alike, so a bin is known by its distinct lengths: at most 63 of them fit 2,048 tokens,
    however many pieces it holds, which bounds the sums of two.
    """

    def __init__(self, bins: list[list[int]], size: list[int], capacity: int):
        self.bins, self.size, self.capacity = bins, size, capacity
        self.fill = [sum(size[i] for i in b) for b in bins]
        self.held: list[dict[int, list[int]]] = [{} for _ in bins]
        self.where: tuple[dict[int, dict[int, None]], dict[int, dict[int, None]]] = ({}, {})
        #: Bit n: some bin holds the length n; some bin holds two lengths of this sum.
        self.some = [0, 0]
        for k, b in enumerate(bins):
            for i in b:
                self.held[k].setdefault(size[i], []).append(i)
            self.enter(k)

    def pairs(self, k: int) -> dict[int, tuple[int, int]]:
        """Sums of two lengths of a bin."""
        lengths = sorted(self.held[k])
        return {m + n: (m, n) for x, m in enumerate(lengths) for n in lengths[x:] if m != n or len(self.held[k][m]) > 1}

    def enter(self, k: int) -> None:
        if 0 < self.fill[k] < self.capacity:
            for kind, found in enumerate((self.held[k], self.pairs(k))):
                for n in found:
                    if n not in self.where[kind]:
                        self.where[kind][n] = {}
                        self.some[kind] |= 1 << n
                    self.where[kind][n][k] = None

    def leave(self, k: int) -> None:
        if 0 < self.fill[k] < self.capacity:
            for kind, found in enumerate((self.held[k], self.pairs(k))):
                for n in found:
                    del self.where[kind][n][k]
                    if not self.where[kind][n]:
                        del self.where[kind][n]
                        self.some[kind] &= ~(1 << n)

    def giver(self, kind: int, k: int, back: int, least: int) -> tuple[int, int] | None:
        """(gain, bin) of the greatest length or sum that another bin can give bin k for ``back`` tokens, if it gains over ``least``."""
        found = self.some[kind] & ((1 << (back + self.capacity - self.fill[k] + 1)) - 1)
        while (n := found.bit_length() - 1) > back + least:
            for a in self.where[kind][n]:
                # A shift of so many tokens raises the sum of squared fills if it ends beyond what a has now.
                if a != k and self.fill[a] < self.fill[k] + n - back:
                    return n - back, a
            found &= ~(1 << n)
        return None

    def best(self, k: int) -> tuple[int, int, tuple[int, ...], tuple[int, ...]] | None:
        """(gain, bin a, lengths that a gives, lengths that k gives for them): a move of one or two, or an exchange of
        one for one, two for one or one for two, that fills bin k most."""
        best = None
        for back, taken in [(0, ()), *((m, (m,)) for m in self.held[k]), *self.pairs(k).items()]:
            for kind in (0, 1) if len(taken) < 2 else (0,):
                if found := self.giver(kind, k, back, best[0] if best else 0):
                    gain, a = found
                    best = gain, a, (back + gain,) if kind == 0 else self.pairs(a)[back + gain], taken
                    if gain == self.capacity - self.fill[k]:
                        return best
        return best

    def shift(self, a: int, k: int, give: tuple[int, ...], back: tuple[int, ...]) -> None:
        self.leave(a)
        self.leave(k)
        for source, target, lengths in ((a, k, give), (k, a, back)):
            moved = [self.held[source][n].pop() for n in lengths]
            for n in lengths:
                if n in self.held[source] and not self.held[source][n]:
                    del self.held[source][n]
            for n, i in zip(lengths, moved, strict=True):
                self.held[target].setdefault(n, []).append(i)
                self.fill[source] -= n
                self.fill[target] += n
        self.enter(a)
        self.enter(k)


def local_search(bins: list[list[int]], size: list[int], capacity: int) -> list[list[int]]:
    """Raise the sum of squared fills by moves and exchanges between all underfull bins until none does; empty bins go.

    The fullest bins are filled first, from whichever bin has the fitting piece. Each step raises the sum of squares, an
    integer with a bound, so this ends.
    """
    u = Underfull(bins, size, capacity)
    waiting = [(-u.fill[k], k) for k in range(len(bins)) if 0 < u.fill[k] < capacity]
    heapq.heapify(waiting)
    while waiting:
        at, k = heapq.heappop(waiting)
        if u.fill[k] != -at or not 0 < u.fill[k] < capacity:
            continue
        if step := u.best(k):
            gain, a, give, back = step
            u.shift(a, k, give, back)
            for x in (a, k):
                if 0 < u.fill[x] < capacity:
                    heapq.heappush(waiting, (-u.fill[x], x))
    return [[i for own in held.values() for i in own] for held in u.held if held]


def pack_block(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Adds bin, offset and fill to the pieces of one block."""
    rows = rows.sort_values(["length", "doc_id", "piece", "row"], ascending=[False, True, True, True], na_position="first", kind="stable").reset_index(drop=True)
    size = rows["length"].astype(int).tolist()
    bins = local_search(best_fit(size, capacity), size, capacity)
    where, offset, fill = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    for k, b in enumerate(bins):
        at = 0
        for i in b:
            where[i], offset[i] = k, at
            at += size[i]
        fill[b] = at
    return rows.assign(bin=where, offset=offset, fill=fill)


def _packed(rows: DataFrame, blocks: int, capacity: int, seed: int) -> DataFrame:
    block = F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(blocks)).cast("long")
    return rows.withColumn("block", block).groupBy("block").applyInPandas(lambda df: pack_block(df, capacity), PIECES + ", block long, bin long, offset long, fill long")


@clearing
def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    cutting = cut(pieces(docs, path, capacity), "pack-pieces")
    rest = cutting.where(F.col("length") < capacity)
    base = scratch(spark, "pack-first")
    first = cut(_packed(rest, max(1, -(-rest.count() // block)), capacity, 1), "pack-first", base)
    done = F.col("fill") >= int(AGAIN * capacity)
    left = first.where(~done).drop("block", "bin", "offset", "fill")
    second = _packed(left, max(1, -(-left.count() // block)), capacity, 2)
    number = lambda kind: (F.lit(kind << 60) + F.col("block") * F.lit(1 << 32) + F.col("bin")).alias("sequence_id")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = cutting.where(F.col("length") >= capacity).select(*names, (F.lit(2 << 60) + F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.union(first.where(done).select(*names, number(0), "offset")).union(second.select(*names, number(1), "offset"))
