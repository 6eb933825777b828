"""The corpus pipeline: quality, language, near-duplicates, source mix, packing.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept. All but the last return
the columns of documents. run() writes each stage's rows to the shared checkpoint folder and reads them
back, so that a lost executor costs one stage's tasks and nothing is computed twice.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm import langid, packing, quality, simhash
from weirflow.llm.common import ensure_checkpoint_dir, remove, ship, table
from weirflow.llm.mixing import mix

#: The similarity of near copies, and the radius (of 256 bits) within which SimHash proposes them.
SIMILARITY, RADIUS, BITS, SHINGLE = 0.8, 76, 256, 5
PIECES = "piece_bpe_32k.model"
RANKS = "byte_bpe_50k.tiktoken"


def apart(docs: DataFrame, *named: str) -> DataFrame:
    """The named columns as they are and all others in one struct `rest`, so that no column of a stage meets a user's."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in named]
    return docs.select(*[F.col(c) for c in named], *([F.struct(*others).alias("rest")] if others else []))


def together(df: DataFrame, docs: DataFrame, *named: str) -> DataFrame:
    """The columns of docs in their order, from what apart() made."""
    return df.select(*[F.col(c) if c in named else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model, learned from the labels of these documents, finds likelier good than bad.

    Without labels of both classes nothing is rejected. Repeated rows are judged alike.
    """
    ship(spark)
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    rows = apart(docs, "doc_id", "text")
    found = quality.classify(rows, model, keep=tuple(rows.columns[1:])).where("score >= 0.5")
    return together(found, docs, "doc_id", "text")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without text or letters go, and those no language gets half of the belief for.

    Where no language could be learned nothing is rejected.
    """
    ship(spark)
    path = str(public_tokenizers.path(PIECES))
    model = langid.learn(docs, F.lit(True), path)
    if not model[0]:
        return docs
    rows = apart(docs, "doc_id", "text")
    found = langid.identify(rows, model, path, keep=tuple(rows.columns[1:])).where("lang_pred <> 'und' and score >= 0.5")
    return together(found, docs, "doc_id", "text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the document of smallest id; of repeated rows one.

    Of several texts under one id those stay whose group has no smaller id. Rows without an id stay
    unless an equal text has an id; of equal ones among them one stays.
    """
    ship(spark)
    groups = simhash.near_duplicates(docs.select("doc_id", "text"), SHINGLE, RADIUS, BITS, repeats=False, similarity=SIMILARITY)
    rows = apart(docs, "doc_id", "text").withColumn("mark", simhash.mark("text"))
    kept = groups.where("doc_id = component_id").select("doc_id", "mark").distinct()
    # Joined and made different on the same two columns: whole texts move once.
    named = rows.where("doc_id is not null").join(kept, ["doc_id", "mark"], "left_semi").dropDuplicates(["doc_id", "mark"])
    free = groups.where("doc_id is null and component_id is null").select("mark").distinct()
    nameless = rows.where("doc_id is null").join(free, "mark", "left_semi").dropDuplicates(["mark"])
    return together(named.unionByName(nameless), docs, "doc_id", "text")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in whole; the last time cut to the words that are left of the quota."""
    ship(spark)
    rest = apart(docs, "doc_id", "text", "source")
    rows = mix(rest, keep=tuple(c for c in rest.columns if c not in ("doc_id", "source"))).where("taken > 0")
    rows = rows.withColumn("copy", F.explode(F.expr("sequence(1L, (taken + size - 1) div size)")))
    words = F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size")).cast("int")
    word = F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+")
    some = F.array_join(F.slice(F.regexp_extract_all("text", word, F.lit(0)), F.lit(1), words), "")
    rows = rows.withColumn("cut", words < F.col("size"))
    rows = rows.withColumn("text", F.when(F.col("cut"), some).otherwise(F.col("text")))
    if "n_chars" not in docs.columns:
        return together(rows, docs, "doc_id", "text", "source")
    # The number of characters follows the text that is left.
    kind = docs.schema["n_chars"].dataType
    chars = F.when(F.col("cut"), F.length("text").cast(kind)).otherwise(F.col("rest.n_chars"))
    named = ("doc_id", "text", "source")
    return rows.select(*[chars.alias(c) if c == "n_chars" else F.col(c) if c in named else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token runs of all documents, with their checksums, in windows of 2048; see weirflow.llm.packing."""
    ship(spark)
    return packing.pack(docs, str(public_tokenizers.path(RANKS)), public_tokenizers.PATTERN).withColumn("ids_crc32", F.crc32("tokens"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", source_mix),
    ("packing", pack),
]
#: SQL can't express the trained stages; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    at = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        if k:  # read by nobody any more
            remove(spark, f"{at}/{k - 1}")
    return docs
