"""The registered queries of the training-data operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm.common import crc_mod, table


def op1_improbable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm import fingerprint

    docs = table(spark, sf_dir, "documents")
    return fingerprint.compare_edits(docs, fingerprint.rarity(docs))


def op2_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).drop("source")


def op3_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm import quality

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = quality.classify(docs, quality.learn(docs, labels.where(crc_mod("doc_id", 3) != 1)))
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_karmarkar_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from weirflow.llm.packing import pack

    out = pack(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    return out.withColumn("tokens", F.crc32("tokens")).withColumnRenamed("tokens", "ids_crc32")


def op5_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.hilbert import shard

    out = shard(table(spark, sf_dir, "documents"), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op6_longest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from weirflow.llm.wordpiece import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), str(public_tokenizers.path("piece_bpe_32k.model")))


def op7_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents"), wrapped=True).withColumn("templates", F.array_join(F.col("templates").cast("array<string>"), ","))


def op8_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.ann import search

    return search(table(spark, sf_dir, "embeddings"), lambda vec_id: F.pmod(vec_id, F.lit(20)) == 0, top=20)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)


def op10_segmentation_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from weirflow.llm import langid

    docs, path = table(spark, sf_dir, "documents"), str(public_tokenizers.path("piece_bpe_32k.model"))
    model = langid.learn(docs, crc_mod("doc_id", 4) != 2, path)
    out = langid.identify(docs, model, path)
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, fn in sorted(globals().items()) if name.startswith("op") and callable(fn)}


def oracle_sql() -> dict[str, str]:
    from weirflow.llm.oracles import ORACLES

    return dict(ORACLES)
