"""Manifest checks: predicates, duplicates, leakage, consistency of two tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from .base import query


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_SPLIT = "CASE doc_id % 3 WHEN 0 THEN 'tune' WHEN 1 THEN 'validation' ELSE 'blind' END"


def _split():
    k = F.col("doc_id") % 3
    return F.when(k == 0, "tune").when(k == 1, "validation").otherwise("blind")


@query("SELECT sha256(text) AS hash, count(DISTINCT doc_id) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id) > 1")
def hash_collisions(spark: SparkSession, sf: str) -> DataFrame:
    """Inputs with one hash under several ids."""
    docs = _table(spark, sf, "documents").select("doc_id", X.sha256_hex(F.col("text")).alias("hash"))
    return docs.groupBy("hash").agg(F.count_distinct("doc_id").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query(f"SELECT sha256(text) AS duplicate_group, count(DISTINCT {_SPLIT}) AS splits FROM documents GROUP BY 1 HAVING count(DISTINCT {_SPLIT}) > 1")
def duplicate_group_leakage(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of copies that span splits."""
    docs = _table(spark, sf, "documents").select(X.sha256_hex(F.col("text")).alias("duplicate_group"), _split().alias("split"))
    return docs.groupBy("duplicate_group").agg(F.count_distinct("split").alias("splits")).where("splits > 1")


@query("SELECT coalesce(d.doc_id, l.doc_id) AS id, CASE WHEN l.doc_id IS NULL THEN 'manifest only' WHEN d.doc_id IS NULL THEN 'arena only' ELSE 'both' END AS side FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def manifest_arena_consistency(spark: SparkSession, sf: str) -> DataFrame:
    d = _table(spark, sf, "documents").select(F.col("doc_id").alias("d"))
    a = _table(spark, sf, "labels").select(F.col("doc_id").alias("l"))
    side = F.when(F.col("l").isNull(), "manifest only").when(F.col("d").isNull(), "arena only").otherwise("both")
    return d.join(a, F.col("d") == F.col("l"), "full").select(F.coalesce("d", "l").alias("id"), side.alias("side"))


@query("SELECT * FROM (VALUES ('de'), ('en'), ('es'), ('fr'), ('it'), ('pt')) AS v(tag) EXCEPT SELECT lang FROM documents")
def taxonomy_gap(spark: SparkSession, sf: str) -> DataFrame:
    """Tags of a fixed taxonomy that no record has."""
    wanted = spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in ("de", "en", "es", "fr", "it", "pt")])).alias("tag"))
    return wanted.join(_table(spark, sf, "documents").select(F.col("lang").alias("tag")).distinct(), "tag", "left_anti")


@query(f"SELECT {_SPLIT} AS split, count(*) AS n, count(DISTINCT lang) AS tags FROM documents GROUP BY 1")
def split_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").groupBy(_split().alias("split")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lang").alias("tags"))


#: What is put after a hash or date: some of it spoils the shape.
_TAILS = ("", "\n", "T", "T1", " ", "Tx\ny", "0")
_TAIL_SQL = "CASE doc_id % 7 " + " ".join(f"WHEN {k} THEN " + " || ".join([repr(p) for p in t.split(chr(10))] if chr(10) not in t else [f"{t.split(chr(10))[0]!r}", "chr(10)", f"{t.split(chr(10))[1]!r}"]) for k, t in enumerate(_TAILS)) + " END"


def _tail():
    return F.element_at(F.array(*[F.lit(t) for t in _TAILS]), (F.col("doc_id") % 7 + 1).cast("int"))


@query(f"WITH h AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN upper(sha256(text)) ELSE sha256(text) END || {_TAIL_SQL} AS h FROM documents) SELECT doc_id, length(h) = 64 AND translate(h, '0123456789abcdef', '') = '' AS ok FROM h")
def sha256_hex_check(spark: SparkSession, sf: str) -> DataFrame:
    """A hash is 64 lower-case hex digits and nothing else; some are spoilt here."""
    docs = _table(spark, sf, "documents").select("doc_id", X.sha256_hex(F.col("text")).alias("h"))
    return docs.select("doc_id", X.is_sha256_hex(F.concat(F.when(F.col("doc_id") % 5 == 0, F.upper("h")).otherwise(F.col("h")), _tail())).alias("ok"))


@query(
    f"""WITH d AS (SELECT doc_id, printf('2024-%02d-%02d', doc_id % 14, doc_id % 33) || {_TAIL_SQL} AS d FROM documents)
SELECT doc_id, length(d) >= 10 AND CAST(substr(d, 6, 2) AS INTEGER) BETWEEN 1 AND 12 AND CAST(substr(d, 9, 2) AS INTEGER) BETWEEN 1 AND 31 AND (length(d) = 10 OR (substr(d, 11, 1) = 'T' AND length(d) > 11)) AS ok FROM d"""
)
def iso_date_shape(spark: SparkSession, sf: str) -> DataFrame:
    made = F.concat(F.format_string("2024-%02d-%02d", (F.col("doc_id") % 14).cast("int"), (F.col("doc_id") % 33).cast("int")), _tail())
    return _table(spark, sf, "documents").select("doc_id", X.is_iso_date_shape(made).alias("ok"))


@query("SELECT page_id, sha256(encode(url) || '\\x00'::BLOB || encode(sha256(html))) AS key FROM pages")
def cache_key(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "pages").select("page_id", X.cache_key(F.col("url"), X.sha256_hex(F.col("html"))).alias("key"))


@query("""SELECT page_id, sha256(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS h FROM pages""")
def escape_html(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "pages").select("page_id", X.sha256_hex(X.escape_html(F.col("html"))).alias("h"))


@query(
    f"""SELECT p_partkey, p_brand AS segmenter, CASE WHEN p_partkey % 3 = 0 THEN 'none' ELSE 'symmetric' END AS trimap, CASE WHEN p_partkey % 3 = 2 THEN 'closed-form' ELSE 'none' END AS refiner, CASE WHEN p_partkey % 3 = 2 THEN 'fast' ELSE 'original' END AS foreground FROM part"""
)
def pipeline_id_parse(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    made = F.when(k == 0, F.col("p_brand")).when(k == 1, F.concat("p_brand", F.lit("+symmetric"))).otherwise(F.concat("p_brand", F.lit("+symmetric+closed-form+fast")))
    parts = (("segmenter", 1, ""), ("trimap", 2, "none"), ("refiner", 3, "none"), ("foreground", 4, "original"))
    return _table(spark, sf, "part").select("p_partkey", *[X.pipeline_part(made, i, d).alias(n) for n, i, d in parts])


@query(
    """SELECT doc_id, concat_ws('; ', CASE WHEN lang IS NULL OR trim(lang) = '' THEN 'blank lang' END, CASE WHEN length(text) <> n_chars THEN 'n_chars differs' END, CASE WHEN n_chars < 100 THEN 'too short' END, CASE WHEN n_chars > 20000 THEN 'over the limit' END) AS errors FROM documents"""
)
def record_errors(spark: SparkSession, sf: str) -> DataFrame:
    """All failed checks of a record in one text, in a fixed order."""
    c = F.col
    checks = [(c("lang").isNull() | (F.trim("lang") == ""), "blank lang"), (F.length("text") != c("n_chars"), "n_chars differs"), (c("n_chars") < 100, "too short"), (c("n_chars") > 20000, "over the limit")]
    return _table(spark, sf, "documents").select("doc_id", F.concat_ws("; ", *[F.when(k, v) for k, v in checks]).alias("errors"))


@query("SELECT lang, sum(n_chars) AS pixels, sum(n_chars) <= 33554432 AS in_budget, max(n_chars) <= 16777216 AS each_in_limit FROM documents GROUP BY lang")
def pixel_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Size limits checked before anything is decoded."""
    return _table(spark, sf, "documents").groupBy("lang").agg(F.sum("n_chars").alias("pixels"), (F.sum("n_chars") <= 33554432).alias("in_budget"), (F.max("n_chars") <= 16777216).alias("each_in_limit"))


@query("SELECT page_id, url NOT LIKE '/%' AND NOT list_contains(string_split(url, '/'), '..') AND url <> '' AS ok FROM pages")
def contained_paths(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "pages").select("page_id", X.contained_path(F.col("url")).alias("ok"))
