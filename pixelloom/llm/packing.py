"""Packing by first-fit decreasing over a tournament tree, in randomised groups of documents.

Documents are dealt to groups by a hash of doc_id, text and the number of the part of the table that they are read in,
about GROUP documents each; the number of groups follows the table. A document longer than a sequence is cut at
multiples of its length. Pieces go, longest first, into the leftmost sequence with room, found in a tree of which each
inner node holds the larger of its sons' free places. Spark sorts a group's pieces (and spills), so they are placed as
they come: a task holds the tree, one number for a sequence, and no piece. One shuffle does it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, pick, small_batches
from .tokens import encoder

#: Documents for each group, on average.
GROUP = 4096
#: Groups for each partition, and partitions at most.
TOGETHER, PARTITIONS = 4, 100_000


class Tournament:
    """Free places of bins of one capacity; first(size) is the leftmost bin with room. It grows as bins are wanted."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.leaves, self.tree = capacity, 1, [capacity, capacity]

    def first(self, size: int) -> int:
        while self.tree[1] < size:
            self.grow()
        tree, i = self.tree, 1
        while i < self.leaves:
            i *= 2
            if tree[i] < size:
                i += 1
        return i - self.leaves

    def grow(self) -> None:
        """Twice as many bins: each level of the tree gets as many free ones to its right."""
        tree, width = [self.capacity, self.capacity], 1
        while width <= self.leaves:
            tree += self.tree[width : 2 * width] + [self.capacity] * width
            width *= 2
        self.leaves, self.tree = 2 * self.leaves, tree

    def take(self, i: int, size: int) -> int:
        """Put size into bin i; the places taken there before."""
        tree, i = self.tree, i + self.leaves
        free = tree[i]
        tree[i] = free - size
        while i > 1:
            i //= 2
            most = max(tree[2 * i], tree[2 * i + 1])
            if tree[i] == most:
                break
            tree[i] = most
        return self.capacity - free


class FirstFit:
    """Places of pieces that come longest first: full ones have a bin of their own, before all others."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.full, self.tree = capacity, 0, Tournament(capacity)

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset in it)."""
        if not 0 < size <= self.capacity:
            raise ValueError("a piece must have from 1 to capacity tokens")
        if size == self.capacity:
            self.full += 1
            return self.full - 1, 0
        b = self.tree.first(size)
        return self.full + b, self.tree.take(b, size)


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset in it) of each size; equal sizes in their order."""
    out: list = [None] * len(sizes)
    fit = FirstFit(capacity)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        out[i] = fit.place(sizes[i])
    return out


_PIECES = pa.schema([("grp", pa.int64()), ("draw", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
_PACKED = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack(docs: DataFrame, length: int = 2048, vocabulary: str = "byte_bpe_50k.json", end_id: int | None = 1, group: int = GROUP, seed: int = 7) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, doc_tokens, ids (little-endian 32-bit), sequence_id, offset.

    Null and empty texts are end_id alone. Repeated rows are each packed, those of different parts of the table in
    different groups. Rows that draw alike and have equal pieces are exchangeable, so reruns over the same parts agree.
    An empty table gives no rows. Other columns of docs don't matter.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = pick(docs, "doc_id", "text")
    groups = max(1, -(-rows.count() // group))
    drawn = rows.withColumn("draw", F.xxhash64(F.lit(seed), "doc_id", F.coalesce("text", F.lit("")), F.spark_partition_id())).withColumn("grp", F.pmod("draw", F.lit(groups)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail = encoder(vocabulary), [] if end_id is None else [end_id]
        for batch in batches:
            for part in batches_of(zip(*(batch.column(c).to_pylist() for c in ("grp", "draw", "doc_id", "text")), strict=True), 200):
                out = []
                for (grp, draw, doc_id, _), own in zip(part, enc.batch([x[3] for x in part]), strict=True):
                    ids = np.concatenate([own, np.array(tail, dtype=np.uint32)]).astype("<u2" if enc.narrow else "<u4")
                    out += [(grp, draw, doc_id, a, len(ids[a : a + length]), len(ids), ids[a : a + length].tobytes()) for a in range(0, len(ids), length)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _PIECES.types, strict=True)], schema=_PIECES)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fit = None, None
        for batch in batches:
            for some in batches_of(zip(*(batch.column(c).to_pylist() for c in ("grp", "doc_id", "start", "length", "doc_tokens", "ids")), strict=True), 500):
                out = []
                for grp, d, s, n, t, ids in some:
                    if grp != now:
                        now, fit = grp, FirstFit(length)
                    b, o = fit.place(n)
                    out.append((d, s, n, t, np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4").tobytes(), (now << 32) + b, o))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _PACKED.types, strict=True)], schema=_PACKED)

    pieces = drawn.mapInArrow(encode, "grp bigint, draw bigint, doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary")
    partitions = min(PARTITIONS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-groups // TOGETHER)))
    dealt = pieces.repartition(partitions, "grp").sortWithinPartitions("grp", F.desc("length"), "draw", "doc_id", "start")
    return dealt.mapInArrow(fill, "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary, sequence_id bigint, offset bigint")
