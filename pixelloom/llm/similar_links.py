"""Links between texts whose word shingles have a Jaccard similarity of 0.8 or more, beside those of SimHash.

Five-word fingerprints of such texts differ in up to 14 of 64 bits (measured), and a search to that radius takes a
fixed share of all pairs. So these links come from min-hash bands: BANDS keys of ROWS minima each, which two texts of
similarity 0.8 fail to share once in 10 ** 7. In a bucket, all pairs of different groups are compared on the whole sets
of shingles; only pairs whose minima put them far below go before that.

A large group of near copies has much the same bucket in each band. Large buckets that share texts become one, where that
makes no more pairs, so its pairs meet once and not once a band.

Large buckets are dealt to cells, and blocks of two cells meet: each cell of texts outside the bucket's largest group
with each cell of the bucket. Before that their texts meet the bucket's most typical ones, which links most of a group
that one text holds together; what is linked then no longer counts as outside. That only saves work, since what stays
outside meets the whole bucket. A block holds the sets of its outside texts and reads the others' past them, so there are
few cells: a bucket of n texts with r outside has n + CELLS * r rows of blocks at most while r is up to 2048 and n up to
131072, beyond that about nr / 2048 + nr / 16384. The pairs compared inside blocks stay nr.

Whole sets are what is wide here, so they are sent as seldom as can be: blocks of the same texts, as the bands of a group
make them, are one; and a part of the blocks goes first, since what that links leaves most others with one group only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, batches_of, bitmap, bits_of, in_bitmap, pick, saved, small_batches

BANDS, ROWS = 32, 4
#: Texts of a bucket that is one block; of larger ones a cell has half of that, or more where there would be over CELLS.
MOST = 1024
CELLS = 8
#: Texts outside the largest group that a block holds, and texts that it reads past them, in MOST.
LEFT, RIGHT = 2, 16
#: Typical texts that a cell of a large bucket names.
NAMED = 4
#: How far an estimate may be below the similarity: of pairs at 0.8, one in 3 * 10 ** 7 is estimated lower by 128 minima.
MARGIN = 0.21
#: Parts that the rows of one key are dealt to when they meet what is known of the key.
SALTS = 16
#: One of so many blocks goes first.
FIRST = 8
#: Columns of shingles that are multiplied at once.
COLUMNS = 1024
#: Rows of a text in blocks that meet one copy of its set.
SPREAD = 256
#: Left texts that are multiplied at once.
HELD = 512
BLOCK = 2048
SEED = 42

_draw = np.random.default_rng(SEED)
_FACTORS = _draw.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _draw.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return as_bytes(text).lower().split()


def class_of(words: list[bytes]) -> int:
    """One number for texts of the same words, signed."""
    n = xxhash.xxh64_intdigest(b" ".join(words), SEED)
    return n - (1 << 64) if n >> 63 else n


def shingle_set(words: list[bytes], shingle: int) -> np.ndarray:
    """Hashes of the shingles, each once; fewer words than a shingle has make one of them all, no word none."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    flat = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *[e + 1 for e in ends[:-1]]]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(flat[a:b], SEED) for a, b in zip(starts, ends[min(shingle, len(words)) - 1 :], strict=False)], dtype=np.uint64))


def minima(shingles: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), BLOCK):
        least = np.minimum(least, (shingles[i : i + BLOCK, None] * _FACTORS + _TERMS).min(axis=0))
    return least


def sketches(docs: DataFrame, shingle: int, fingerprint) -> DataFrame:
    """fp, class, keys of the bands, and one byte of each minimum, for every text with a word."""
    small_batches(docs.sparkSession)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, classes, keys, bytes_of = [], [], [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                if words:
                    least = minima(shingle_set(words, shingle))
                    fps.append(fingerprint(text))
                    classes.append(class_of(words))
                    keys.append([xxhash.xxh64_intdigest(part.tobytes(), i) >> 1 for i, part in enumerate(least.reshape(BANDS, ROWS))])
                    bytes_of.append((least >> np.uint64(56 - 16)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(classes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(bytes_of, pa.binary())], names=["fp", "class", "keys", "minima"])

    return pick(docs, "text").mapInArrow(found, "fp bigint, class bigint, keys array<bigint>, minima binary")


def _blocks(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Parts of the blocks in turn, each with the block's columns of these names: rows of a block that one batch has."""
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [table.column(c).to_numpy() for c in names]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for i, j in zip([0, *cuts], [*cuts, table.num_rows], strict=True):
            yield tuple(c[i] for c in columns), table.slice(i, j - i)


def _by_block(dealt: DataFrame, names: list[str], found: Callable[[Iterator[pa.Table]], Iterable[list[np.ndarray]]], ddl: str, *order: Column | str) -> DataFrame:
    """The columns that found() makes of the rows of each block, which have equal columns of these names.

    found() gets the parts of a block in turn, by order and class.
    """
    fields = [x.split() for x in ddl.split(", ")]
    kinds = {"bigint": np.int64, "int": np.int32}

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for _, parts in groupby(_blocks(batches, names), key=lambda x: x[0]):
            yield from found(part for _, part in parts)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches_of(results(batches), 256):
            columns = [np.concatenate(c).astype(kinds[k]) for c, (_, k) in zip(zip(*some, strict=True), fields, strict=True)]
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[n for n, _ in fields])

    small_batches(dealt.sparkSession)
    return dealt.repartition(*names).sortWithinPartitions(*names, *order, "class").mapInArrow(blocks, ddl)


def _meet(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows beside what is known of their key: by key and salt, so that one bucket's rows have many tasks."""
    copies = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("class"), F.lit(SALTS)).cast("int")).join(copies, ["key", "salt"]).drop("salt")


def _cells(n: Column) -> Column:
    return F.greatest(F.ceil(n / (MOST // 2)), F.lit(1)).cast("int")


def _merged(rows: DataFrame) -> DataFrame:
    """key, class, grp, n: large buckets that share texts are one, if it has no more pairs than they have together.

    rows: the same columns; n is the number of a key's texts.
    """
    from .near_dup import components

    large = rows.where(F.col("n") > MOST // 2)
    if not large.take(1):
        return rows
    low = large.groupBy("class").agg(F.min("key").alias("low"))
    edges = large.join(low, "class").select(F.col("key").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
    of = components(edges).select(F.col("node").alias("key"), F.col("root").alias("one"))
    apart = of.join(large.select("key", "n").distinct(), "key").groupBy("one").agg(F.sum(F.col("n") * F.col("n")).alias("pairs"))
    named = saved(_meet(large, of).select("one", "class", "grp").distinct(), "similar-merged")
    whole = named.groupBy("one").agg(F.count(F.lit(1)).alias("n")).join(apart, "one").where(F.col("n") * F.col("n") <= F.col("pairs")).select("one", "n")
    one = _meet(named.withColumnRenamed("one", "key"), whole.withColumnRenamed("one", "key")).select("key", "class", "grp", "n")
    others = rows.join(F.broadcast(of.join(whole, "one").select("key")), "key", "left_anti").select("key", "class", "grp", "n")
    return saved(others.unionAll(one), "similar-rows")


def _dealt(rows: DataFrame) -> DataFrame:
    """key, p, q, side, class, grp: each left text of p's cell and each text of q's meet in the block (key, p, q).

    rows: key, class, grp, left, and the numbers of cells ps (of left texts) and qs (of all). Bits of side: 1 left,
    2 right.
    """
    own_p, own_q = F.pmod(F.xxhash64("class", "key"), F.col("ps")).cast("int"), F.pmod(F.xxhash64("key", "class"), F.col("qs")).cast("int")
    rows = rows.withColumn("own_p", own_p).withColumn("own_q", own_q)
    right = F.transform(F.sequence(F.lit(0), F.col("ps") - 1), lambda p: F.struct(p.alias("p"), F.col("own_q").alias("q"), F.when(F.col("left") & (p == F.col("own_p")), 3).otherwise(2).alias("side")))
    others = F.filter(F.sequence(F.lit(0), F.col("qs") - 1), lambda q: F.col("left") & (q != F.col("own_q")))
    left = F.transform(others, lambda q: F.struct(F.col("own_p").alias("p"), q.alias("q"), F.lit(1).alias("side")))
    return rows.select("key", "class", "grp", F.explode(F.concat(right, left)).alias("at")).select("key", "at.p", "at.q", "at.side", "class", "grp")


def typical(rows: DataFrame, minima_of: DataFrame) -> DataFrame:
    """key, class: of each bucket the texts whose minima agree most with the most frequent ones of their cell."""

    def named(parts: Iterator[pa.Table]) -> Iterator[list[np.ndarray]]:
        table = pa.concat_tables(parts)
        flat = _flat(table)
        counts = np.bincount((flat + 256 * np.arange(BANDS * ROWS)).ravel(), minlength=256 * BANDS * ROWS).reshape(-1, 256)
        agree = (flat == counts.argmax(axis=1)).sum(axis=1)
        best = np.argsort(-agree, kind="stable")[:NAMED]
        yield [table.column("key").to_numpy()[best], table.column("class").to_numpy()[best], agree[best]]

    cells = rows.withColumn("cell", F.pmod(F.xxhash64("class", "key"), F.col("qs")).cast("int")).select("key", "cell", "class").join(minima_of, "class")
    best = _by_block(cells, ["key", "cell"], named, "key bigint, class bigint, agree int").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("agree", "class")), False).alias("best"))
    return best.select("key", F.explode(F.slice("best", 1, MOST // 2)).alias("b")).select("key", "b.class")


def _flat(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("minima").to_pylist()), dtype=np.uint8).reshape(-1, BANDS * ROWS)


def in_reach(dealt: DataFrame, minima_of: DataFrame, least: float) -> DataFrame:
    """The rows of blocks that have a text of another group at the other side with so large a share of equal minima.

    same: a number of the texts left in the block and their sides. Of blocks with one number, one stays.
    """

    def near(parts: Iterator[pa.Table]) -> Iterator[list[np.ndarray]]:
        table = pa.concat_tables(parts)
        flat, grp, side = _flat(table), table.column("grp").to_numpy(), table.column("side").to_numpy()
        right, live = np.flatnonzero(side & 2), np.zeros(len(grp), dtype=bool)
        for i in np.flatnonzero(side & 1):
            other = right[grp[right] != grp[i]]
            close = other[(flat[other] == flat[i]).sum(axis=1) >= least * BANDS * ROWS]
            live[close] = True
            live[i] |= len(close) > 0
        own = [table.column(c).to_numpy()[live] for c in ("key", "p", "q", "side", "class", "grp")]
        order = np.lexsort((own[3], own[4]))
        same = xxhash.xxh64_intdigest(own[4][order].tobytes() + own[3][order].astype(np.int32).tobytes()) >> 1
        yield [*own, np.full(int(live.sum()), same, dtype=np.int64)]

    wide = dealt.join(minima_of, "class").select("key", "p", "q", "side", "class", "grp", "minima")
    found = saved(_by_block(wide, ["key", "p", "q"], near, "key bigint, p int, q int, side int, class bigint, grp bigint, same bigint"), "similar-reach")
    one = found.groupBy("same").agg(F.min(F.struct("key", "p", "q")).alias("one"))
    return found.join(one, "same").where(F.struct("key", "p", "q") == F.col("one")).drop("same", "one")


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each left set shares with each right one: a product of 0-1 matrices, exact in 32-bit floats."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    names, ids = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    sizes = [len(x) for x in [*left, *right]]
    row, n = np.repeat(np.arange(len(sizes)), sizes), len(left)
    both = (np.bincount(ids[row < n], minlength=len(names)) > 0) & (np.bincount(ids[row >= n], minlength=len(names)) > 0)
    ids = np.where(both, np.cumsum(both) - 1, -1)[ids]
    row, ids = row[ids >= 0], ids[ids >= 0]
    order = np.argsort(ids, kind="stable")
    row, ids = row[order], ids[order]
    for at in range(0, int(both.sum()), COLUMNS):
        i, j = np.searchsorted(ids, [at, at + COLUMNS])
        has = np.zeros((len(sizes), min(COLUMNS, int(both.sum()) - at)), dtype=np.float32)
        has[row[i:j], ids[i:j] - at] = 1.0
        out += has[:n] @ has[n:].T
    return out


def _forest(alike: Iterable[np.ndarray], left: np.ndarray, right: np.ndarray) -> list[np.ndarray]:
    """Links (a, b) between groups that hold together what all true places of alike do: one row of it at a time.

    left, right: the groups of rows and columns.
    """
    names, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    of, at = np.arange(len(names)), at.reshape(-1)
    a, b = [], []
    for i, row in enumerate(alike):
        own = of[at[i]]
        met = np.unique(of[at[len(left) + np.flatnonzero(row)]])
        met = met[met != own]
        if len(met):
            a.append(np.full(len(met), names[own]))
            b.append(names[met])
            of[np.isin(of, met)] = own
    none = np.zeros(0, dtype=np.int64)
    return [np.concatenate([none, *a]), np.concatenate([none, *b])]


def _linked(left: list[np.ndarray], own: np.ndarray, right: list[np.ndarray], other: np.ndarray, similarity: float) -> list[np.ndarray]:
    """Links (a, b) between the groups own of left sets and the groups other of right sets."""
    shared = common(left, right)
    size, sizes = [len(x) for x in left], np.array([len(x) for x in right])
    alike = (n >= similarity * (k + sizes - n) - 1e-9 for k, n in zip(size, (row.astype(np.float64) for row in shared), strict=True))
    return _forest(alike, own, other)


def _renamed(grp: np.ndarray, to: dict[int, int]) -> np.ndarray:
    """The groups, each by the name at the end of its links."""
    names = grp.tolist()
    for i, name in enumerate(names):
        while name in to:
            name = to[name]
        names[i] = name
    return np.array(names, dtype=np.int64)


def verified(met: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """a, b: links between groups, by all pairs of different groups in the blocks, on their whole sets."""

    def linked(parts: Iterator[pa.Table]) -> Iterator[list[np.ndarray]]:
        left, grp, to = [], np.zeros(0, dtype=np.int64), {}
        for part in parts:
            own, side = _renamed(part.column("grp").to_numpy(), to), part.column("side").to_numpy()
            flat = part.column("set").combine_chunks()
            ends, values = flat.offsets.to_numpy(), flat.values.to_numpy()
            of = [values[ends[i] : ends[i + 1]] for i in range(len(own))]
            # Texts of the left side alone come first, then those of both: so each left text meets all that are right.
            left += [of[i].copy() for i in np.flatnonzero(side & 1)]
            grp = np.concatenate([grp, own[(side & 1) > 0]])
            right = np.flatnonzero(side & 2)
            sets, other = [of[i] for i in right], own[right]
            for at in range(0, len(left), HELD):
                some = slice(at, at + HELD)
                if (grp[some, None] != other).any():
                    a, b = _linked(left[some], grp[some], sets, other, similarity)
                    if len(a):
                        to.update(zip(b.tolist(), a.tolist(), strict=True))
                        grp, other = _renamed(grp, to), _renamed(other, to)
                        yield [a, b]

    # A text in many blocks has copies of its set, one for SPREAD rows.
    degree = met.groupBy("class").agg(F.ceil(F.count(F.lit(1)) / SPREAD).cast("int").alias("copies"))
    copied = sets.join(degree, "class").select("class", "set", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    salted = met.join(degree, "class").withColumn("copy", F.pmod(F.xxhash64("key", "p", "q"), F.col("copies")).cast("int")).drop("copies")
    wide = salted.join(copied, ["class", "copy"]).select("key", "p", "q", "side", "class", "grp", "set")
    return _by_block(wide, ["key", "p", "q"], linked, "a bigint, b bigint", F.col("side").bitwiseAND(1).desc(), "side").distinct()


def sets_of(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """class, set of the wanted classes. A bitmap of fixed size tells most other texts before any text is shuffled."""
    sent = bitmap(wanted, "class")

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bits_of(sent.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            own = np.array([class_of(words_of(t)) for t in texts], dtype=np.int64)
            live = in_bitmap(bits, own)
            yield pa.RecordBatch.from_arrays([pa.array(own[live]), batch.column("text").filter(pa.array(live))], names=["class", "text"])

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(words_of(t), shingle).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array(found, pa.list_(pa.int64()))], names=["class", "set"])

    small_batches(docs.sparkSession)
    # Of copies one text goes on; they are told apart from others by the class, before the shuffle and after.
    texts = pick(docs, "text").mapInArrow(classes, "class bigint, text string").groupBy("class").agg(F.first("text").alias("text"))
    return texts.join(wanted, "class", "left_semi").mapInArrow(shingled, "class bigint, set array<bigint>")


def similar_links(docs: DataFrame, grouped: DataFrame, fingerprint, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """a, b: fingerprints of groups that hold texts of so high a similarity. grouped: node, root of linked fingerprints.

    Null texts and those without a word have no such link. Repeated rows and copies count once.
    """
    from .near_dup import components

    each = sketches(docs, shingle, fingerprint).groupBy("class").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("minima").alias("minima"))
    roots = grouped.select(F.col("node").alias("fp"), F.col("root"))
    each = saved(each.join(roots, "fp", "left").select("class", F.coalesce("root", "fp").alias("grp"), "keys", "minima"), "similar-sketches")
    minima_of = each.select("class", "minima")
    rows = each.select("class", "grp", F.explode("keys").alias("key"))
    # Buckets of one group have nothing to link.
    several = rows.groupBy("key").agg(F.min("grp").alias("low"), F.max("grp").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").select("key", "n")
    rows = _merged(saved(_meet(rows, several).select("key", "class", "grp", "n"), "similar-rows"))

    def links(dealt: DataFrame) -> DataFrame:
        met = saved(in_reach(dealt, minima_of, similarity - MARGIN), "similar-met")
        sets = saved(sets_of(docs, met.select("class").distinct(), shingle), "similar-sets")
        early = F.pmod(F.xxhash64("key", "p", "q"), F.lit(FIRST)) == 0
        first = saved(verified(met.where(early), sets, similarity), "similar-links")
        roots = components(first).withColumnRenamed("node", "grp")
        rest = met.where(~early).join(roots, "grp", "left").withColumn("grp", F.coalesce("root", "grp")).drop("root")
        several = rest.groupBy("key", "p", "q").agg(F.min("grp").alias("low"), F.max("grp").alias("high")).where("low < high").select("key", "p", "q")
        return first.unionAll(saved(verified(rest.join(several, ["key", "p", "q"]), sets, similarity), "similar-links"))

    large = rows.where(F.col("n") > MOST).withColumn("qs", _cells(F.col("n")))
    first = None
    if large.take(1):
        named = typical(large, minima_of).withColumn("named", F.lit(True))
        left = large.join(named, ["key", "class"], "left").withColumn("left", F.coalesce("named", F.lit(False))).withColumn("ps", F.lit(1))
        first = links(_dealt(left))
        roots = components(first).withColumnRenamed("node", "grp")
        rows = saved(rows.join(roots, "grp", "left").select("key", "class", F.coalesce("root", "grp").alias("grp"), "n"), "similar-rows")
    own = rows.groupBy("key", "grp").agg(F.count(F.lit(1)).alias("size"))
    sizes = own.groupBy("key").agg(F.max(F.struct("size", "grp")).alias("most"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    met = _meet(rows, sizes.select("key", F.col("most.size").alias("size"), F.col("most.grp").alias("major")))
    whole = F.col("n") <= MOST
    met = met.withColumn("left", F.col("grp") != F.col("major"))
    ps = F.greatest(F.ceil((F.col("n") - F.col("size")) / (LEFT * MOST)), F.lit(1))
    qs = F.greatest(F.least(_cells(F.col("n")), F.lit(CELLS)), F.ceil(F.col("n") / (RIGHT * MOST)))
    met = met.withColumn("ps", F.when(whole, 1).otherwise(ps).cast("int")).withColumn("qs", F.when(whole, 1).otherwise(qs).cast("int"))
    found = links(_dealt(met))
    return found if first is None else found.unionAll(first)
