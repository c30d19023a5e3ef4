"""Sharding by a Feistel permutation of global row numbers, with cycle walking; DataFrame functions only.

Rows get numbers 0..n-1 in the order of doc_id. A Feistel network permutes a grid of a x b cells, the smallest near a
square that holds n: a number r is (r div b, r mod b), and each round adds a keyed hash of one half to the other. Where
a cell beyond n comes out, the network is applied again until one below n does, which makes a permutation of 0..n-1.
The shard of place p is p mod shards, its slot p div shards: both can be computed from the row number alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import pick, saved

ROUNDS = 6
#: Walks at most. Fewer than a <= sqrt(n) + 1 cells lie beyond n, so this suffices always up to n = 4096, and later a
#: walk this long has a chance below n ** -32 a row; should one occur, the query fails and doesn't go on wrongly.
WALKS = 64


def _round(half: Column, k: int, seed: int, modulus: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed * ROUNDS + k), half), F.lit(modulus))


def feistel(x: Column, n: int, seed: int) -> Column:
    """One pass of the network over the grid of n: a permutation of 0..a*b-1."""
    a, b = grid(n)
    def step(k: int):
        def halves(p: Column) -> Column:
            left, right = p["l"], p["r"]
            if k % 2:
                return F.struct(left.alias("l"), ((right + _round(left, k, seed, b)) % b).alias("r"))
            return F.struct(((left + _round(right, k, seed, a)) % a).alias("l"), right.alias("r"))

        return halves

    pair = F.struct(F.floor(x / b).cast("bigint").alias("l"), (x % b).alias("r"))
    for k in range(ROUNDS):
        # Bound by a one-element array, so that each round's halves are computed once.
        pair = F.transform(F.array(pair), step(k))[0]
    return F.transform(F.array(pair), lambda p: p["l"] * b + p["r"])[0]


def grid(n: int) -> tuple[int, int]:
    a = max(1, int(n**0.5))
    while a * a < n:
        a += 1
    return a, max(1, -(-n // a))


def permuted(x: Column, n: int, seed: int = 5) -> Column:
    """The place of row number x in the shuffled order of n rows."""
    once = feistel(x, n, seed)
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), once, lambda y, _: F.when(y < n, y).otherwise(feistel(y, n, seed)))
    walked = F.transform(F.array(walk), lambda y: F.when(y < n, y).otherwise(F.raise_error(F.lit("cycle walking didn't end")).cast("bigint")))[0]
    first = F.transform(F.array(once), lambda y: F.when(y < n, y))[0]
    return F.coalesce(first, walked)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with `row_number`, from 0 without gaps in the given order, and without a global sort in one task.

    Range partitions are sorted; a row's number is its place there after the rows of the partitions before.
    The rows are written to the shared folder once, so that a task that runs again can't number them anew.
    """
    placed = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "shard-rows")
    part = F.shiftright("at", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    bases = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    # Two numbers for each range partition: bounded by the number of partitions, so it is broadcast.
    joined = placed.join(F.broadcast(bases), part == F.col("part"))
    return joined.withColumn("row_number", F.col("base") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at", "part", "base")


def shard(docs: DataFrame, shards: int = 8, seed: int = 5) -> DataFrame:
    """doc_id, size, text_crc32, row_number, place, shard, slot of every row.

    Law `rows`: counts of shards are at most one apart. size is the text's bytes plus 1; a null text has none and the
    crc32 of the empty one. Null doc_ids come first; equal ones are ordered by size and crc32, and rows equal in all
    three are exchangeable. An empty table gives no rows. Other columns of docs don't matter.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = pick(docs, "doc_id", "text").select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = numbered(rows, "doc_id", "size", "text_crc32")
    n = rows.count()
    placed = rows.withColumn("place", permuted(F.col("row_number"), n, seed) if n else F.lit(None).cast("bigint"))
    return placed.withColumn("shard", (F.col("place") % shards).cast("int")).withColumn("slot", F.floor(F.col("place") / shards).cast("bigint"))
