"""The queries opN_<name> over whole tables, with production parameters; and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, media, mixing, near_dup, packing, pii, quality_model, quality_rules, sharding, token_codes
from .common import documents, new_path


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.train(docs, held_out=language_id.held_out())
    found = language_id.identify(docs, model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op2_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pyarrow as pa

    from .common import crc32_of

    path = new_path(spark, "token-codes")
    token_codes.write_token_codes(documents(spark, sf_dir), path, "word_bpe_49k.json", end_id=1)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    return token_codes.map_documents(spark, path, lambda d, s, ids: (d, s, len(ids), crc32_of(ids)), schema, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(documents(spark, sf_dir), 2048, "byte_bpe_50k.json", end_id=1)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(documents(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.groups(documents(spark, sf_dir), shingle=3, radius=2, seed=42)
    return found.select("doc_id", near_dup.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.stored_and_read(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality_model.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out=quality_model.held_out())
    return quality_model.score(docs, model).select("doc_id", quality_model.held_out().alias("held_out"), "score", "predicted")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(documents(spark, sf_dir), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def queries() -> dict:
    import corpus_pipeline

    own = (op1_language_id, op2_token_codes, op3_packing, op4_pii, op5_mixing, op6_simhash, op7_media, op8_quality, op9_quality_rules, op10_sharding)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """None: models, tokenizers and graph searches aren't SQL, nor are XXH64, CRC-32 or the draws of mixing and sharding.

    tests/llm checks each query against a plain computation of its own on a small table instead.
    """
    import corpus_pipeline

    return {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
