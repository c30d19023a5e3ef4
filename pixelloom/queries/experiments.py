"""Experiments: rankings, sweeps, folds, paired comparisons, percentiles, lifecycles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import query


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("SELECT p_brand, round(avg(p_retailprice), 4) AS mean FROM part GROUP BY p_brand ORDER BY round(avg(p_retailprice), 4) DESC, p_brand LIMIT 3")
def stage_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The three best candidates by mean, ties by id."""
    return _table(spark, sf, "part").groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 4).alias("mean")).orderBy(F.desc("mean"), "p_brand").limit(3)


_STRENGTHS = (0.25, 0.5, 0.75)


@query(
    "SELECT p_brand, s AS strength, round(avg(greatest(0.0, least(1.0, 1 - abs(p_size / 50.0 - s)))), 6) AS agreement FROM part CROSS JOIN (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) AS v(s) GROUP BY ALL"
)
def strength_sweep(spark: SparkSession, sf: str) -> DataFrame:
    rows = _table(spark, sf, "part").select("p_brand", "p_size", F.explode(F.array(*[F.lit(s) for s in _STRENGTHS])).alias("strength"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(F.col("p_size") / 50.0 - F.col("strength"))))
    return rows.groupBy("p_brand", "strength").agg(F.round(F.avg(score), 6).alias("agreement"))


@query("SELECT h.n_nationkey AS held_out, count(*) AS tuned_on, CAST(sum(o.n_nationkey) AS BIGINT) AS checksum FROM nation h JOIN nation o ON h.n_nationkey <> o.n_nationkey GROUP BY 1")
def loo_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Leave-one-out folds of a small id set: what is left is the whole less the one, without a join."""
    ids = _table(spark, sf, "nation").select("n_nationkey")
    every = Window.partitionBy()
    return ids.select(F.col("n_nationkey").alias("held_out"), (F.count(F.lit(1)).over(every) - 1).alias("tuned_on"), (F.sum("n_nationkey").over(every) - F.col("n_nationkey")).cast("bigint").alias("checksum"))


@query(
    "WITH m AS (SELECT l_orderkey, sum(l_extendedprice) AS base, sum(l_extendedprice * (1 - l_discount)) AS challenger FROM lineitem GROUP BY 1) SELECT count(*) AS n, round(avg(challenger - base), 2) AS mean_delta, sum(CASE WHEN challenger < base THEN 1 ELSE 0 END) AS losses FROM m"
)
def paired_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """Two candidates on the same ids: mean difference and how often the second loses."""
    m = _table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("base"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("challenger"))
    return m.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("challenger") - F.col("base")), 2).alias("mean_delta"), F.sum((F.col("challenger") < F.col("base")).cast("int")).alias("losses"))


@query("SELECT coalesce(l_returnflag, 'all') AS tag, coalesce(l_linestatus, 'all') AS status, count(*) AS n, round(avg(l_quantity), 6) AS mean, min(l_quantity) AS least FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def tag_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    g = _table(spark, sf, "lineitem").groupingSets([["l_returnflag"], ["l_linestatus"], []], "l_returnflag", "l_linestatus")
    out = g.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.min("l_quantity").alias("least"))
    return out.select(F.coalesce("l_returnflag", F.lit("all")).alias("tag"), F.coalesce("l_linestatus", F.lit("all")).alias("status"), "n", "mean", "least")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, quantile_disc(value, 0.95) AS p95, count(*) AS n FROM events GROUP BY 1")
def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Median (mean of the two middle ones) and nearest-rank 95th percentile."""
    return _table(spark, sf, "events").groupBy("event_type").agg(F.round(F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY value)"), 6).alias("median"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"), F.count(F.lit(1)).alias("n"))


@query("SELECT vec_id AS image_id, list_position(embedding, list_max(embedding)) - 1 AS best FROM embeddings")
def argmax_first_tie(spark: SparkSession, sf: str) -> DataFrame:
    """The class with the largest logit, of equal ones the first."""
    return _table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), (F.array_position("embedding", F.array_max("embedding")) - 1).cast("int").alias("best"))


@query("WITH e AS (SELECT label, unnest(range(0, 64)) AS idx, unnest(embedding) AS v FROM embeddings) SELECT label, CAST(idx AS INTEGER) AS idx, max(v) AS v FROM e GROUP BY ALL")
def candidate_union_max(spark: SparkSession, sf: str) -> DataFrame:
    """The union of a group's masks: the largest value at each place."""
    e = _table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("idx", "v"))
    return e.groupBy("label", "idx").agg(F.max("v").alias("v"))


_STEPS = (("untouched", "evaluate", "evaluated"), ("evaluated", "influence", "retired"), ("retired", "register", "untouched"))


@query(
    "WITH s AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'untouched' WHEN 1 THEN 'evaluated' ELSE 'retired' END AS state, CASE event_id % 4 WHEN 0 THEN 'evaluate' WHEN 1 THEN 'influence' WHEN 2 THEN 'register' ELSE 'other' END AS action FROM events), t AS (SELECT * FROM (VALUES ('untouched', 'evaluate', 'evaluated'), ('evaluated', 'influence', 'retired'), ('retired', 'register', 'untouched')) AS v(state, action, next)) SELECT s.event_id, coalesce(t.next, s.state) AS next, t.next IS NOT NULL AS allowed FROM s LEFT JOIN t USING (state, action)"
)
def blind_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    """Steps of a set that may be looked at once; what isn't a step leaves the state as it is."""
    k = lambda n, names: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("event_id") % n + 1).cast("int"))
    s = _table(spark, sf, "events").select("event_id", k(3, ("untouched", "evaluated", "retired")).alias("state"), k(4, ("evaluate", "influence", "register", "other")).alias("action"))
    step = F.coalesce(*[F.when((F.col("state") == a) & (F.col("action") == b), F.lit(c)) for a, b, c in _STEPS])
    return s.select("event_id", F.coalesce(step, "state").alias("next"), step.isNotNull().alias("allowed"))


@query("SELECT d.doc_id, l.doc_id IS NOT NULL AS hit FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def cache_reuse(spark: SparkSession, sf: str) -> DataFrame:
    hits = _table(spark, sf, "labels").select(F.col("doc_id").alias("k"))
    return _table(spark, sf, "documents").select("doc_id").join(hits, F.col("doc_id") == F.col("k"), "left").select("doc_id", F.col("k").isNotNull().alias("hit"))


def xorshift(state: np.uint64) -> np.uint64:
    with np.errstate(over="ignore"):
        state ^= state << np.uint64(13)
        state ^= state >> np.uint64(7)
        return state ^ (state << np.uint64(17))


def bootstrap_interval(values: list[float], resamples: int = 1024, seed: int = 0x15) -> tuple[float, float]:
    """The 26th and 999th of the sorted means of resamples, drawn by one continuing xorshift stream."""
    if not values:
        return 0.0, 0.0
    means, state, n, x = [], np.uint64(seed), len(values), np.array(values)
    for _ in range(resamples):
        picks = []
        for _ in range(n):
            state = xorshift(state)
            picks.append(int(state % np.uint64(n)))
        means.append(float(x[picks].mean()))
    means.sort()
    return means[25], means[998]


@query()
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals of the mean retail price of each type's brand means: a bounded list for each group."""
    rows = _table(spark, sf, "part").groupBy("p_type", "p_brand").agg(F.avg("p_retailprice").alias("v"))

    def interval(part: pd.DataFrame) -> pd.DataFrame:
        low, high = bootstrap_interval(part.sort_values("p_brand")["v"].tolist())
        return pd.DataFrame({"p_type": [part["p_type"].iloc[0]], "n": [len(part)], "low": [low], "high": [high]})

    return rows.groupBy("p_type").applyInPandas(interval, "p_type string, n long, low double, high double")
