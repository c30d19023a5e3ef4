"""Quality rules: fixed base rules, then robust multivariate outliers by language and source.

Each document has a vector of transformed statistics. For every (lang, source), every language and all documents a
minimum-covariance-determinant estimate is found over all their rows: from several deterministic starts (medians with
deviations about them, covariances of squashed and of unit vectors, plain covariances) concentration steps take mean and
covariance of the part of the rows that is nearest so far. After some steps the start of the least determinant goes on,
until no step lessens it. A group's estimate is drawn towards its parent's by one rule for every size, and a document
goes if its Mahalanobis distance is beyond a fixed limit.

Medians and the distance that parts the nearest rows come from histograms with fixed bounds, summed by group and bucket;
so sums of a group are never gathered in one task, and reruns agree. The estimates are a few numbers for each group:
up to a fixed number of groups they stay on the driver between steps, more are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import DOCUMENT_TYPES, as_bytes, pick, saved, small_batches

# The characters that count as symbols, and white space.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"

MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
#: The part of the rows that the estimate is for; steps of every start, and of the best one at most.
PART, FIRST_STEPS, MOST_STEPS = 0.75, 2, 20
#: A determinant that a step lessens by a smaller factor stands still.
STILL = 1e-3
#: Rows that a parent's estimate counts as beside a group's own.
PARENT = 50
#: Parts that rows of one group are dealt to when they meet the group's numbers, which have a copy for each part.
SALTS = 64
#: Pairs of language and source at most whose groups' numbers (some 62 for each start) stay on the driver.
#: A table of theirs in the shared folder is a file for each shuffle partition, however few rows there are, and each file
#: costs its executor three child processes where the folder is a local one (Hadoop calls chmod).
FEW = 1 << 10
#: Buckets of statistics (for one unit) and of distances (for a doubling of 1 + d).
FINE, OCTAVE = 512, 32
#: Documents beyond this squared distance go. It is far out (chi-square of 5 dimensions: 1 in 10**11), since clean
#: statistics have longer tails than a normal distribution.
LIMIT = 60.0
#: Least standard deviation of each statistic: most documents have no symbol, so the estimates alone could be zero.
#: Each is small enough that an extreme value of that statistic alone is beyond the limit.
STATISTICS = {"symbols": 0.25, "length": 0.12, "repeats": 0.08, "lines": 0.12, "upper": 0.1}
D = len(STATISTICS)
FLOORS = np.array(list(STATISTICS.values()))
UPPER = np.triu_indices(D)


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of three that occur twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
    if len(seen) < 1 << 21:
        keys = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:  # pairs get numbers of their own first
        _, pairs = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)
        keys = pairs[:-1] * len(seen) + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(n - 2, dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : k + n - 2] |= again
    return int(covered.sum())


def base_statistics(text: str | None) -> dict[str, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_upper (words without small letters)."""
    if not text:
        return dict.fromkeys(("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper"), 0)
    words = as_bytes(text).split()
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return {
        "n_words": len(words),
        "word_chars": len(text) - sum(text.count(c) for c in BLANKS),
        "n_symbols": sum(text.count(c) for c in SYMBOLS),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated_words(words),
        "n_upper": sum(map(bytes.isupper, words)),
    }


NAMES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")


def statistics(docs: DataFrame, *others: str) -> DataFrame:
    """Other columns of documents, the base statistics and base_failed of every row."""
    small_batches(docs.sparkSession)
    rows = pick(docs, *dict.fromkeys(["doc_id", "lang", "source", *others, "text"]))
    carried = [c for c in rows.columns if c != "text" or "text" in others]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [base_statistics(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], *[pa.array([f[k] for f in found], pa.int64()) for k in NAMES]], names=[*carried, *NAMES])

    found = rows.mapInArrow(count, ", ".join([*[f"{c} {DOCUMENT_TYPES[c]}" for c in carried], *[f"{k} bigint" for k in NAMES]]))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return found.withColumn("base_failed", failed)


def transformed() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "symbols": F.log1p(100 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        "length": F.log1p(F.col("word_chars") / words),
        "repeats": F.sqrt(F.col("n_repeat_words") / words),
        "lines": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        "upper": F.sqrt(F.col("n_upper") / words),
    }


def _x(i: int) -> Column:
    return F.col(f"x{i}")


def _distance(mean: Column, inverse: Column) -> Column:
    """The squared Mahalanobis distance, as one expression of the rows' columns and the group's."""
    total = F.lit(0.0)
    for i in range(D):
        for j in range(i, D):
            product = (_x(i) - mean[i]) * (_x(j) - mean[j]) * inverse[i * D + j]
            total = total + (product if i == j else 2 * product)
    return total


def _square(upper: np.ndarray) -> np.ndarray:
    out = np.zeros((D, D))
    out[UPPER] = upper
    return out + np.triu(out, 1).T


def floored(cov: np.ndarray) -> np.ndarray:
    """A covariance of the nearest part, scaled to that of all rows, with the least deviations."""
    return cov * CONSISTENCY + np.diag(FLOORS**2)


def _consistency() -> float:
    """What makes the covariance of the nearest PART of normal rows that of all: by a fixed quadrature of chi-square."""
    from math import gamma

    x = np.linspace(0, 200, 400_001)[1:]
    cdf = lambda k: np.cumsum(x ** (k / 2 - 1) * np.exp(-x / 2) / (2 ** (k / 2) * gamma(k / 2))) * (x[1] - x[0])
    at = np.searchsorted(cdf(D), PART)
    return float(PART / cdf(D + 2)[at])


CONSISTENCY = _consistency()


def _keys() -> Column:
    """A row's groups from the finest to all documents; null languages and sources are groups as well."""
    return F.array(
        F.to_json(F.struct(F.lit(2).alias("k"), "lang", "source")),
        F.to_json(F.struct(F.lit(1).alias("k"), "lang")),
        F.lit('{"k":0}'),
    )


def _meet(long: DataFrame, groups: DataFrame, few: bool) -> DataFrame:
    """Rows of long beside the numbers of their group: by key and salt, so that a group of all rows has many tasks.

    few: the groups' numbers are few (see FEW) and go to all tasks.
    """
    if few:
        return long.join(F.broadcast(groups), "key")
    copies = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return long.join(copies, ["key", "salt"])


def _kept(name: str, few: bool) -> Callable[[DataFrame], DataFrame]:
    """What cuts the lineage of groups' numbers: few ones come to the driver, others are written to the shared folder."""
    return (lambda df: df.sparkSession.createDataFrame(df.toArrow(), df.schema)) if few else partial(saved, name=name)


def _mapped(groups: DataFrame, f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, few: bool) -> DataFrame:
    """f of groups' numbers: on the driver if there are few."""
    if not few:
        return groups.mapInPandas(f, schema)
    made = pd.concat(f(iter([groups.toArrow().to_pandas()])))
    return groups.sparkSession.createDataFrame(pa.Table.from_pandas(made, preserve_index=False), schema)


def medians(long: DataFrame) -> DataFrame:
    """key, n, m, dev: medians of the statistics by group and deviations about them, to 1 / FINE."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.round(_x(i) * FINE).cast("int").alias("b")) for i in range(D)]))
    counts = long.select("key", each.alias("v")).groupBy("key", "v.i", "v.b").agg(F.count(F.lit(1)).alias("c"))
    # Windows go over the buckets of one statistic of one group: some thousands, whatever the number of rows.
    own = Window.partitionBy("key", "i")
    upto = counts.withColumn("n", F.sum("c").over(own)).withColumn("upto", F.sum("c").over(own.orderBy("b")))
    mid = upto.withColumn("m", F.min(F.when(2 * F.col("upto") >= F.col("n"), F.col("b"))).over(own)).withColumn("off", F.abs(F.col("b") - F.col("m")))
    off = mid.withColumn("upto", F.sum("c").over(own.orderBy("off")))
    dev = off.groupBy("key", "i").agg(F.first("n").alias("n"), F.first("m").alias("m"), F.min(F.when(2 * F.col("upto") >= F.col("n"), F.col("off"))).alias("dev"))
    by_place = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("i", c))), lambda s: s[c] / float(FINE))
    return dev.groupBy("key").agg(F.first("n").alias("n"), by_place("m").alias("m"), by_place("dev").alias("dev"))


def _starts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """key, n, m, scale and sums of z, tanh(z) and z / |z| -> key, n, m and the starts: (start, mean, inverse, logdet)."""
    for part in parts:
        out = []
        for n, m, scale, z, zz, t, tt, uu in zip(*(part[c] for c in ("n", "m", "scale", "z", "zz", "t", "tt", "uu")), strict=True):
            m, scale, z, t = np.array(m), np.array(scale), np.array(z) / n, np.array(t) / n
            scaled = np.diag(scale)
            plain, squashed, unit = _square(np.array(zz) / n) - np.outer(z, z), _square(np.array(tt) / n) - np.outer(t, t), _square(np.array(uu) / n) * D
            for start, (mean, cov) in enumerate(((m, np.eye(D)), (m, squashed), (m, unit), (m + scale * z, plain))):
                inverse = np.linalg.inv(scaled @ cov @ scaled + np.diag(FLOORS**2))
                out.append((start, mean.tolist(), inverse.ravel().tolist()))
        keys = part.loc[part.index.repeat(4), ["key", "n", "m"]].reset_index(drop=True)
        yield keys.assign(start=[o[0] for o in out], mean=[o[1] for o in out], inverse=[o[2] for o in out], cov=[[0.0] * D * D for _ in out], logdet=float("inf"))


_STATE = "key string, n bigint, m array<double>, start int, mean array<double>, inverse array<double>, cov array<double>, logdet double"


def _stepped(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums about m of the nearest rows -> mean, covariance, its inverse and the logarithm of its determinant."""
    for part in parts:
        means, inverses, covs, dets = [], [], [], []
        for h, m, s, ss in zip(part["h"], part["m"], part["s"], part["ss"], strict=True):
            s = np.array(s) / h
            cov = _square(np.array(ss) / h) - np.outer(s, s)
            full = floored(cov)
            means.append((np.array(m) + s).tolist())
            covs.append(cov.ravel().tolist())
            inverses.append(np.linalg.inv(full).ravel().tolist())
            dets.append(float(np.linalg.slogdet(full)[1]))
        yield part[["key", "n", "m", "start"]].assign(mean=means, inverse=inverses, cov=covs, logdet=dets)


def concentrated(long: DataFrame, state: DataFrame, few: bool) -> DataFrame:
    """The state after one step: of the PART of a group's rows that is nearest, mean and covariance.

    Rows are summed by bucket of their distance; the nearest ones are those up to the bucket in which PART is reached.
    """
    packed = state.groupBy("key").agg(F.first("m").alias("m"), F.collect_list(F.struct("start", "mean", "inverse")).alias("of"))
    met = _meet(long, packed, few).select("key", "m", *[_x(i) for i in range(D)], F.explode("of").alias("o"))
    far = F.least(F.floor(OCTAVE * F.log2(1 + F.greatest(_distance(F.col("o.mean"), F.col("o.inverse")), F.lit(0.0)))), F.lit(20 * OCTAVE)).cast("int")
    near = met.select("key", "o.start", far.alias("b"), *[(_x(i) - F.col("m")[i]).alias(f"x{i}") for i in range(D)])
    sums = near.groupBy("key", "start", "b").agg(F.count(F.lit(1)).alias("h"), *[F.sum(_x(i)).alias(f"s{i}") for i in range(D)], *[F.sum(_x(i) * _x(j)).alias(f"s{i}_{j}") for i, j in zip(*UPPER, strict=True)])
    own = Window.partitionBy("key", "start")
    upto = sums.withColumn("n", F.sum("h").over(own)).withColumn("before", F.sum("h").over(own.orderBy("b")) - F.col("h"))
    inside = upto.where(F.col("before") < PART * F.col("n")).groupBy("key", "start").agg(
        F.sum("h").alias("h"), F.array(*[F.sum(f"s{i}") for i in range(D)]).alias("s"), F.array(*[F.sum(f"s{i}_{j}") for i, j in zip(*UPPER, strict=True)]).alias("ss")
    )
    return _mapped(inside.join(state.select("key", "start", "n", "m"), ["key", "start"]), _stepped, _STATE, few)


def estimates(rows: DataFrame, few: bool) -> DataFrame:
    """key, n, mean, cov of each group of rows (lang, source, salt, x0..): of all its starts the least determinant."""
    kept = _kept("mcd", few)
    long = rows.select(F.explode(_keys()).alias("key"), "salt", *[_x(i) for i in range(D)])
    mid = kept(medians(long).withColumn("scale", F.transform(F.arrays_zip("dev", F.array(*[F.lit(float(f)) for f in FLOORS]).alias("f")), lambda s: F.greatest(1.4826 * s["dev"], s["f"]))))
    z = _meet(long, mid.select("key", "m", "scale"), few).select("key", *[((_x(i) - F.col("m")[i]) / F.col("scale")[i]).alias(f"x{i}") for i in range(D)])
    z = z.withColumn("r", F.greatest(sum((_x(i) * _x(i) for i in range(1, D)), _x(0) * _x(0)), F.lit(1e-12)))
    t = [(1 - 2 / (F.exp(2 * F.least(F.greatest(_x(i), F.lit(-20.0)), F.lit(20.0))) + 1)) for i in range(D)]
    pairs = list(zip(*UPPER, strict=True))
    sums = z.groupBy("key").agg(
        F.array(*[F.sum(_x(i)) for i in range(D)]).alias("z"), F.array(*[F.sum(_x(i) * _x(j)) for i, j in pairs]).alias("zz"), F.array(*[F.sum(t[i]) for i in range(D)]).alias("t"),
        F.array(*[F.sum(t[i] * t[j]) for i, j in pairs]).alias("tt"), F.array(*[F.sum(_x(i) * _x(j) / F.col("r")) for i, j in pairs]).alias("uu"),
    )
    state = kept(_mapped(sums.join(mid, "key"), _starts, _STATE, few))
    for _ in range(FIRST_STEPS):
        state = kept(concentrated(long, state, few))
    least = lambda s: s.groupBy("key").agg(F.min_by(F.struct(*s.columns), F.struct("logdet", "start")).alias("s")).select("s.*")
    active, done = kept(least(state)), None
    for _ in range(MOST_STEPS):
        new = concentrated(long, active, few)
        both = new.join(active.select("key", F.struct(*active.columns).alias("old")), "key")
        # A step counts if it lessens the determinant; a group for which it doesn't is done.
        step = kept(both.withColumn("better", F.col("logdet") < F.col("old.logdet") - STILL))
        still = step.where(~F.col("better")).select("old.*")
        done = still if done is None else done.unionByName(still)
        active = step.where("better").select(*active.columns)
        if not active.take(1):
            break
    return done.unionByName(active).select("key", "n", "mean", "cov")


def _drawn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A group's estimate and its parents' -> mean and inverse: each drawn towards the one above by PARENT rows."""
    for part in parts:
        means, inverses = [], []
        for of in part["of"]:
            mean = cov = None
            for e in sorted(of, key=lambda e: e["key"]):
                m, c, n = np.array(e["mean"]), np.array(e["cov"]).reshape(D, D), e["n"]
                w = 1.0 if mean is None else n / (n + PARENT)
                # What a small group's mean is away from its parent's adds to the spread of the two together.
                cov = c if cov is None else w * c + (1 - w) * cov + w * (1 - w) * np.outer(m - mean, m - mean)
                mean = m if mean is None else w * m + (1 - w) * mean
            means.append(mean.tolist())
            inverses.append(np.linalg.inv(floored(cov)).ravel().tolist())
        yield part[["l", "s"]].assign(mean=means, inverse=inverses)


def judge(docs: DataFrame, limit: float = LIMIT, *others: str) -> DataFrame:
    """Other columns of documents, base statistics, base_failed, distance (squared) and kept of every row.

    Rows that fail the base rules (null, empty and short texts do) have no distance and aren't part of estimates.
    Null languages and sources are groups as well. Repeated rows are judged alike. An empty table gives no rows.
    Columns of docs beside documents' own don't matter.
    """
    # Beside texts the statistics are counted again, so that no copy of the corpus lies in the shared folder.
    texts = "text" in others
    found = statistics(docs, *others) if texts else saved(statistics(docs, *others), "quality-statistics")
    measured = statistics(docs) if texts else found
    vectors = measured.where(~F.col("base_failed")).select("lang", "source", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt"), *[c.alias(f"x{i}") for i, c in enumerate(transformed().values())])
    if texts:  # else they come from the statistics that are written
        vectors = saved(vectors, "quality-vectors")
    distinct = vectors.select("lang", "source").distinct()
    few = 0 < distinct.count() <= FEW
    of = estimates(vectors, few)
    # Each pair of lang and source that there is, with its own numbers and those of its parents: three rows a pair.
    pairs = distinct.select(F.col("lang").alias("l"), F.col("source").alias("s"), F.explode(_keys()).alias("key"))
    together = pairs.join(of, "key").groupBy("l", "s").agg(F.collect_list(F.struct("key", "n", "mean", "cov")).alias("of"))
    finest = _mapped(together, _drawn, "l string, s string, mean array<double>, inverse array<double>", few)
    finest = F.broadcast(finest) if few else saved(finest, "mcd-finest")
    with_x = found.select("*", *[c.alias(f"x{i}") for i, c in enumerate(transformed().values())])
    judged = with_x.join(finest, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")
    distance = F.when(~F.col("base_failed"), _distance(F.col("mean"), F.col("inverse")))
    return judged.withColumn("distance", distance).withColumn("kept", F.coalesce(F.col("distance") <= limit, F.lit(False))).drop("mean", "inverse", "l", "s", *[f"x{i}" for i in range(D)])


def kept_documents(docs: DataFrame, limit: float = LIMIT) -> DataFrame:
    """The columns of documents of the rows that the rules keep.

    Null, empty and short texts fail the base rules and go; repeated rows stay or go together. Null ids, languages and
    sources are values like others. An empty table gives no rows. Other columns of docs don't matter.
    """
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    return judge(docs, limit, *names).where("kept").select(*names)
