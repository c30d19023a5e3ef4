"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints have 64 bits. Their bits are grouped into partitions, correlated ones together. If partition i gets the
threshold t_i >= -1 and the sum of all t_i + 1 is one more than the radius, two fingerprints within the radius agree
in some partition up to t_i bits: a search looks only at those (-1: never). How many partitions, and the thresholds,
come from dynamic programming on candidate counts estimated from all fingerprints. Candidates are verified.

Work is done on distinct fingerprints; copies only count. Buckets of over BUCKET fingerprints aren't paired: what
touches one is linked exactly by another way. Each such fingerprint names itself and its 64 neighbours at one bit;
two fingerprints within two bits name a common one, and at most 65 fingerprints name the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import DOCUMENT_TYPES, as_bytes, bitmap, bits_of, in_bitmap, pick, saved, small_batches
from .similar_links import similar_links

BUCKET = 64
#: Parts that the rows of one node, fingerprint or component are dealt to when they meet what is known of it.
SALTS = 8
#: Links that the driver joins to components itself (4 MB of them); more go through rounds of joins.
LOCAL = 1 << 18
#: What a row of a signature costs, in candidate pairs.
SIGNATURE_COST = 3.0
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash, as a signed 64-bit integer.

    Words are lower-cased in A-Z and parted by ASCII white space; shingles count with repeats. Fewer words than a
    shingle has make one of them all; no word (null, empty) makes 0.
    """
    words = as_bytes(text).lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *[e + 1 for e in ends[:-1]]]
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(flat[a:b], seed) for a, b in zip(starts, ends[k - 1 :], strict=False)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), BLOCK):
        ones += np.unpackbits(hashes[i : i + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, *others: str) -> DataFrame:
    """doc_id, other columns of documents, and fp of every row.

    Null, empty and blank texts have the fingerprint 0. Null ids stay; repeated rows come out as often. An empty table
    gives no rows. Columns of docs that aren't named don't matter.
    """
    small_batches(docs.sparkSession)
    rows = pick(docs, *dict.fromkeys(["doc_id", *others, "text"]))
    carried = [c for c in rows.columns if c in ("doc_id", *others)]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t, shingle, seed) for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], fps], names=[*carried, "fp"])

    return rows.mapInArrow(hashed, ", ".join(f"{c} {DOCUMENT_TYPES[c]}" for c in carried) + ", fp bigint")


# ---- the plan: partitions and thresholds


@dataclass(frozen=True)
class Partition:
    bits: tuple[int, ...]
    threshold: int


def bit_counts(distinct: DataFrame) -> np.ndarray:
    """How many fingerprints have bits i and j both, over all of them: 64 x 64."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((64, 64), dtype=np.int64)
        for batch in batches:
            x = np.unpackbits(batch.column("fp").to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += np.rint(x.T @ x).astype(np.int64)  # exact: a batch has far fewer than 2 ** 24 rows
        i, j = np.nonzero(both)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "n": pa.array(both[i, j], pa.int64())})

    both = np.zeros((64, 64), dtype=np.int64)
    for i, j, n in distinct.select("fp").mapInArrow(count, "i int, j int, n bigint").groupBy("i", "j").agg(F.sum("n")).collect():  # 4096 rows at most
        both[i, j] = n
    return both


def correlated_groups(both: np.ndarray, n: int, m: int) -> list[tuple[int, ...]]:
    """64 bits in m groups of nearly one size: each grows from its lowest free bit by what correlates most with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    r = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    free, groups = set(range(64)), []
    for k in range(m):
        group = [min(free)]
        free.remove(group[0])
        for _ in range(-(-(64 - k) // m) - 1):
            best = max(sorted(free), key=lambda b: sum(r[b, g] for g in group))
            group.append(best)
            free.remove(best)
        groups.append(tuple(sorted(group)))
    return groups


def estimates(bits: tuple[int, ...], both: np.ndarray, n: int, radius: int) -> list[float]:
    """Cost of each threshold from -1 to radius: signatures, and pairs that agree up to so many bits of the partition.

    Bits differ with the chance 2p(1-p) each; the chances of 0, 1, .. differing bits follow by convolution.
    """
    p = np.diag(both)[list(bits)] / max(n, 1)
    chance = np.array([1.0])
    for q in 2 * p * (1 - p):
        chance = np.convolve(chance, [1 - q, q])
    cost, signatures = [0.0], 0.0
    for t in range(radius + 1):
        signatures += float(len(list(combinations(range(len(bits)), t)))) if t <= len(bits) else 0.0
        cost.append(SIGNATURE_COST * n * signatures + n * n / 2 * float(chance[: t + 1].sum()))
    return cost


def allocate(costs: list[list[float]], radius: int) -> tuple[float, list[int]]:
    """Thresholds of least total cost whose t + 1 sum to radius + 1, by dynamic programming over the partitions."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, ts) in best.items():
            for t in range(-1, radius + 1):
                total = used + t + 1
                if total <= radius + 1 and (total not in new or cost + own[t + 1] < new[total][0]):
                    new[total] = (cost + own[t + 1], [*ts, t])
        best = new
    return best[radius + 1]


def plan(distinct: DataFrame, radius: int) -> list[Partition]:
    n = distinct.count()
    both = bit_counts(distinct)
    found = []
    for m in range(1, radius + 3):
        groups = correlated_groups(both, n, m)
        cost, ts = allocate([estimates(g, both, n, radius) for g in groups], radius)
        found.append((cost, [Partition(g, t) for g, t in zip(groups, ts, strict=True) if t >= 0]))
    return min(found, key=lambda x: x[0])[1]


# ---- probing


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _masks(bits: tuple[int, ...], threshold: int) -> list[int]:
    return [_signed(sum(1 << b for b in c)) for t in range(threshold + 1) for c in combinations(bits, t)]


def _flips(fp: Column, masks: list[int]) -> Column:
    return F.explode(F.transform(F.array(*[F.lit(m) for m in masks]), lambda m: fp.bitwiseXOR(m)))


def links(distinct: DataFrame, radius: int = 2, partitions: list[Partition] | None = None) -> DataFrame:
    """a, b: links between different fingerprints within radius <= 2 that leave no component apart.

    distinct: fp, each once. All links of ordinary buckets are returned; in large ones, a chain or star of links.
    """
    if not 0 <= radius <= 2:
        raise ValueError("the radius must be from 0 to 2")
    partitions = plan(distinct, radius) if partitions is None else partitions
    fp = F.col("fp")
    index = probe = None
    for i, p in enumerate(partitions):
        own = F.lit(_signed(sum(1 << b for b in p.bits)))
        a = distinct.select("fp", F.lit(i).alias("part"), fp.bitwiseAND(own).alias("key"))
        b = distinct.select("fp", F.lit(i).alias("part"), _flips(fp.bitwiseAND(own), _masks(p.bits, p.threshold)).alias("key"))
        index, probe = (a, b) if index is None else (index.unionAll(a), probe.unionAll(b))
    large = saved(index.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET).select("part", "key"), "simhash-large")
    some_large = bool(large.take(1))
    ordinary = index
    if some_large:
        ordinary = index.join(large, ["part", "key"], "left_anti")
    pairs = probe.withColumnRenamed("fp", "a").join(ordinary.withColumnRenamed("fp", "b"), ["part", "key"]).where("a < b")
    # A probe's partition gives a pair from either side, so a < b loses none; thresholds are symmetric.
    found = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b")
    if some_large:
        touching = probe.join(large, ["part", "key"], "left_semi").select("fp").distinct()
        named = touching.select("fp", _flips(fp, [0, *[_signed(1 << b) for b in range(64)]]).alias("name")) if radius == 2 else None
        if radius == 2:
            first = named.withColumn("a", F.min("fp").over(Window.partitionBy("name")))  # 65 fingerprints at most
            found = found.unionAll(first.where("a < fp").select("a", F.col("fp").alias("b")))
        else:
            masks = [0, *[_signed(1 << b) for b in range(64)]][: 1 + 64 * radius]
            near = touching.select(F.col("fp").alias("a"), _flips(fp, masks).alias("b")).join(distinct.select(F.col("fp").alias("b")), "b", "left_semi")
            found = found.unionAll(near.where("a < b").select("a", "b"))
    return found.distinct()


# ---- components


def salted_join(rows: DataFrame, known: DataFrame, key: str, *spread: str) -> DataFrame:
    """Rows beside what is known of their key: by key and salt, which follows from the columns spread.

    So the rows of one key, be they most of all, go to SALTS tasks, each of which adaptive joins may split further.
    """
    copies = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")).join(copies, [key, "salt"]).drop("salt")


def _joined(edges: pa.Table) -> pa.Table:
    """node, root of all nodes of the edges (a, b)."""
    to: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := to.setdefault(x, x)) != x:
            to[x] = to[y]
            x = to[x]
        return x

    for a, b in zip(edges.column("a").to_pylist(), edges.column("b").to_pylist(), strict=True):
        a, b = root(a), root(b)
        to[max(a, b)] = min(a, b)
    nodes = list(to)
    return pa.table({"node": pa.array(nodes, pa.int64()), "root": pa.array([root(x) for x in nodes], pa.int64())})


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node that an edge (a, b) names; root is the smallest node of its component.

    Up to LOCAL edges are joined on the driver, as each round has many tasks that hold next to nothing. More go through
    alternating large-star and small-star steps; each round is written to the shared folder, which cuts the lineage.
    A node's edges meet in min(), which sums them up before they are shuffled, and in a salted join with it.
    """
    edges = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "components")
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.col("b") % 1_000_003).alias("s")).first()
        if now["n"] == 0 or now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(edges.select("b", "b").distinct())
        if now["n"] <= LOCAL:
            return saved(edges.sparkSession.createDataFrame(_joined(edges.toArrow())), "components")
        before = now
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = salted_join(both, least, "a", "b").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = salted_join(large, least, "a", "b")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").unionAll(least.select("a", F.col("m").alias("b")))
        edges = saved(small.distinct(), "components")


def groups(docs: DataFrame, shingle: int = 3, radius: int = 2, seed: int = 42, similarity: float | None = None) -> DataFrame:
    """doc_id, fp, component_id of every row: the smallest doc_id among all documents reachable over links.

    Fingerprints link within the radius; with a similarity, texts whose five-word shingles are so similar link as well.

    Null and empty texts have the fingerprint 0 and link like others. Null doc_ids are in a group but don't name it,
    unless it has no other: then component_id is null. Repeated rows come out as often. An empty table gives no rows.
    Other columns of docs don't matter.
    """
    marked, label = _labels(docs, shingle, radius, seed, similarity)
    return marked.join(label, "fp").select("doc_id", "fp", "component_id")


def _labels(docs: DataFrame, shingle: int, radius: int, seed: int, similarity: float | None) -> tuple[DataFrame, DataFrame]:
    """doc_id, fp of every row; and fp, root, component_id, alone of every fingerprint.

    root is the same in all of its group; alone: one row has the fingerprint, and it has no link.
    """
    marked = saved(fingerprints(docs, shingle, seed), "simhash")
    distinct = saved(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    of = components(links(distinct.select("fp"), radius))
    if similarity is not None:
        of = saved(of, "simhash-components")
        similar = similar_links(docs, of, partial(fingerprint, shingle=shingle, seed=seed), similarity=similarity)
        of = components(of.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(similar))
    # Fingerprints without a link are groups of their own; the others get the least doc_id of their component.
    linked = of.join(distinct, F.col("node") == F.col("fp")).select("node", "root", "least")
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    named = saved(salted_join(linked, least, "root", "node").select(F.col("node").alias("fp"), "root", "component"), "simhash-groups")
    return marked, distinct.join(named, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component", "least").alias("component_id"), (F.col("root").isNull() & (F.col("n") == 1)).alias("alone"))


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _grouped_rows(docs: DataFrame, ids, grouped: bool, names: list[str], shingle: int, seed: int) -> DataFrame:
    """The rows with a doc_id that the bitmap ids holds, with fp; or those with one that it doesn't."""
    small_batches(docs.sparkSession)

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bits_of(ids.value)
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(bits, batch.column("doc_id").to_numpy()) == grouped))
            fps = [pa.array([fingerprint(t, shingle, seed) for t in batch.column("text").to_pylist()], pa.int64())] if grouped else []
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *fps], names=[*names, "fp"][: len(names) + len(fps)])

    return pick(docs, *names).where("doc_id IS NOT NULL").mapInArrow(parted, ", ".join([*[f"{c} {DOCUMENT_TYPES[c]}" for c in names], "fp bigint"][: len(names) + grouped]))


def one_of_each(docs: DataFrame, shingle: int = 3, radius: int = 2, seed: int = 42, similarity: float | None = None) -> DataFrame:
    """The columns of documents: of each group the row with the smallest doc_id; of a group without any, the least row.

    Of rows with equal doc_id and fingerprint one stays, the least by its columns; with equal ids but different
    fingerprints each stays. Rows without a doc_id go if their group has a document with one; else one stays, the least
    by its columns. The fingerprints of texts are computed again here, which is cheaper than to keep texts beside them.
    Documents that are a group of their own stay where they are: a bitmap tells most of them, and the others' texts alone
    are shuffled.
    """
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    marked, label = _labels(docs, shingle, radius, seed, similarity)
    found = marked.join(label, "fp").where(F.col("doc_id") == F.col("component_id"))
    stay = saved(found.groupBy("doc_id", "fp").agg(F.count(F.lit(1)).alias("n")), "simhash-stay")
    ids = bitmap(marked.where("doc_id IS NOT NULL").join(label.where(~F.col("alone")).select("fp"), "fp").select("doc_id"), "doc_id")
    kept = _grouped_rows(docs, ids, True, names, shingle, seed).join(stay, ["doc_id", "fp"])
    single = kept.where("n = 1").select(*names)
    if not stay.where("n > 1").take(1):
        several = single.limit(0)
    else:
        least = kept.where("n > 1").groupBy("doc_id", "fp").agg(F.min(F.struct(*names)).alias("row"))
        several = least.select("row.*")
    nameless = label.where("component_id IS NULL").select("fp", "root")
    least = fingerprints(pick(docs, *names).where("doc_id IS NULL"), shingle, seed, *names).groupBy("fp").agg(F.min(F.struct(*names)).alias("row"))
    unnamed = least.join(nameless, "fp").groupBy("root").agg(F.min("row").alias("row"))
    alone = _grouped_rows(docs, ids, False, names, shingle, seed)
    return alone.unionAll(single).unionAll(several).unionAll(unnamed.select("row.*"))
