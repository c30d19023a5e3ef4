"""Mixing sources to target weights with hash-threshold histograms.

Every document has a hash. A source that shall give r times its size gives each document floor(r) times, and the rest
by a threshold: once more where the hash is below it. Words are summed by source and hash bucket; running sums find the
bucket in which the budget ends; only the documents of that bucket are summed again, by the next bits of the hash,
until its hash values are single ones. Nothing is sorted and no document leaves its partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, pick, saved

#: Bits of the hash for each level of histograms; the levels cover the 60 bits used.
BITS, LEVELS = 12, 5
WEIGHTS = (1, 2, 3)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("bigint")


def running(rows: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """rows with columns of the sums over all rows before each in the order, without a sort in one task.

    Range partitions are sorted by themselves; what stands before a partition is a row of numbers for each.
    """
    placed = saved(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()).withColumns({f"{k}_of": c for k, c in sums.items()}), "mix-running")
    totals = placed.groupBy("part").agg(*[F.sum(f"{k}_of").alias(k) for k in sums])
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"{k}_base") for k in sums])
    own = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # As many rows as partitions, so they are broadcast.
    met = placed.join(F.broadcast(bases), "part").withColumns({k: F.col(f"{k}_base") + F.coalesce(F.sum(f"{k}_of").over(own), F.lit(0)) for k in sums})
    return met.select(*rows.columns, *sums)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """source, source_size, target from source, source_size: a row for each source.

    Sources in the order of their code points, null last, weigh as weights say, repeating, and share all sizes; none
    gets over `most` times its own. What stands above is shared anew by weight: in the end target = min(most * size,
    level * weight) with one level for all, found from running sums over the sources by size / weight.
    """
    by_name = F.col("source").asc_nulls_last()
    ranked = running(sources, [by_name], rank=F.lit(1))
    cap = F.col("source_size") * F.lit(float(most))
    priced = ranked.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))).withColumn("ratio", cap / F.col("w"))
    held = saved(running(priced, [F.col("ratio").asc(), by_name], capped=cap, weight=F.col("w")), "mix-held")
    total, weight = held.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.sum("w")).first()
    # The level is that of the first source whose cap isn't below it.
    level = (F.lit(float(total)) - F.col("capped")) / (F.lit(weight) - F.col("weight"))
    found = held.where(level * F.col("w") <= cap).agg(F.min(F.struct("ratio", by_name_key(), level.alias("level"))).alias("least")).first()["least"]
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least(cap, F.lit(found["level"] if found else 0.0) * F.col("w")))
    return held.select("source", "source_size", target.alias("target"))


def by_name_key() -> Column:
    """What puts null sources last in a comparison of structs."""
    return F.struct(F.col("source").isNull(), F.col("source")).alias("name")


def _bucket(level: int) -> Column:
    return F.shiftrightunsigned(F.col("h"), 64 - BITS * (level + 1)).bitwiseAND(F.lit((1 << BITS) - 1))


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id", F.coalesce("source", F.lit("")), F.coalesce("text", F.lit("")))


def _limits(rows: DataFrame, weights: tuple[int, ...], most: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, source, size, h of every row; and s, source_size, target, whole, limit of every source."""
    sized = saved(rows.select("doc_id", "source", n_words(F.col("text")).alias("size"), _hash(seed).alias("h")), "mix-sizes")
    ratio = F.col("target") / F.greatest(F.col("source_size"), F.lit(1))
    budgets = saved(
        targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
        .withColumn("whole", F.least(F.floor(ratio + F.lit(1e-12)), F.lit(int(most))).cast("bigint"))
        .withColumn("budget", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))),
        "mix-budgets",
    )
    # prefix: the bits of the boundary bucket so far; budget: what is left inside it.
    state = budgets.select("source", F.lit(0).cast("bigint").alias("prefix"), "budget", F.lit(None).cast("bigint").alias("limit"))
    for level in range(LEVELS):
        state = saved(_refined(sized, state, level), f"mix-level-{level}")
    limits = budgets.drop("budget").withColumnRenamed("source", "s").join(state.select("source", "limit"), F.col("source").eqNullSafe(F.col("s"))).drop("source")
    # A row for each source, written, so that its size is known: Spark broadcasts it if it is small, and texts stay where they are.
    return sized, saved(limits, "mix-limits")


def _copies(has_words: Column) -> Column:
    used = F.shiftrightunsigned(F.col("h"), 64 - BITS * LEVELS)
    return F.when(has_words, F.col("whole") + (used < F.col("limit")).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = 3.0, seed: int = 11) -> DataFrame:
    """doc_id, source, size, source_size, target, copies: how often the mix takes each row of docs.

    size is the number of words; null and empty texts have none and are never taken. A null source is a source of its
    own. Rows that are equal in doc_id, source and text have one hash and are taken alike; the last hash value goes in
    if that brings the source nearer to its target (even: it stays out), so a source misses its target by half
    the words of one hash value at most. An empty table gives no rows. Other columns of docs don't matter.
    """
    sized, limits = _limits(pick(docs, "doc_id", "text", "source"), weights, most, seed)
    out = sized.join(limits, F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "source", "size", "source_size", "target", _copies(F.col("size") > 0).alias("copies"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = 3.0, seed: int = 11) -> DataFrame:
    """The rows of documents that the mix takes, each as often as it takes them. Texts aren't shuffled.

    Null, empty and blank texts are never taken. Null ids and sources are values like others; rows equal in id, source
    and text are taken alike. An empty table gives no rows. Other columns of docs don't matter.
    """
    rows = pick(docs, "doc_id", "text", "lang", "source", "n_chars")
    _, limits = _limits(rows, weights, most, seed)
    taken = rows.withColumn("h", _hash(seed)).join(limits, F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", _copies(F.col("text").rlike(f"[^{SPACE}]")))
    return taken.where("copies > 0").select("doc_id", "text", "lang", "source", "n_chars", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy")).drop("copy")


def _refined(sized: DataFrame, state: DataFrame, level: int) -> DataFrame:
    """The state one level on: sums by source and bucket, of documents in the boundary bucket only."""
    last = level == LEVELS - 1
    open_ = state.withColumnRenamed("source", "s")
    inside = sized.join(open_, F.col("source").eqNullSafe(F.col("s")))
    if level:
        inside = inside.where(F.shiftrightunsigned(F.col("h"), 64 - BITS * level) == F.col("prefix"))
    sums = inside.groupBy("source", "prefix", "budget", _bucket(level).alias("b")).agg(F.sum("size").alias("n"))
    running = Window.partitionBy("source").orderBy("b")
    cum = sums.withColumn("upto", F.sum("n").over(running)).withColumn("before", F.col("upto") - F.col("n"))
    # The boundary: the first bucket at whose end the budget is reached; else what follows the last bucket.
    reached = F.min(F.when(F.col("upto") >= F.col("budget"), F.struct("b", "before", "n")))
    at = cum.groupBy("source", "prefix", "budget").agg(reached.alias("at"), F.max("b").alias("most"), F.max("upto").alias("all"))
    b = F.coalesce(F.col("at.b"), F.col("most"))
    before = F.coalesce(F.col("at.before"), F.lit(0)).cast("double")
    here = F.shiftleft(F.col("prefix"), BITS) + b
    if not last:
        return at.select("source", here.alias("prefix"), F.when(F.col("at").isNull(), F.lit(float("inf"))).otherwise(F.col("budget") - before).alias("budget"), F.lit(None).cast("bigint").alias("limit"))
    nearer = F.col("at").isNull() | (2 * (F.col("budget") - before) > F.col("at.n"))
    return at.select("source", here.alias("prefix"), "budget", (here + nearer.cast("bigint")).alias("limit"))
