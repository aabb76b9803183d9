"""Corpus pipeline: quality rules, SimHash near-dedup, suffix dedup, decontamination, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir). ``docs`` is what the stage
before it kept, written as Parquet and read again. All but the last return the columns of ``documents``.

Defined results: extra columns pass through all stages but the last; a row with a null ``doc_id`` has no
duplicates; of rows equal in id and text one stays after near-dedup, different texts of one id are
documents of their own; a text that is wholly cut stays as an
empty text (packed as its end id); empty tables give empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import checkpointed, table
from touchline.llm.decontamination import drop_leaks
from touchline.llm.packing import pack
from touchline.llm.quality_rules import judge
from touchline.llm.simhash_dedup import RADIUS, SHINGLE, near_duplicates
from touchline.llm.suffix_dedup import remove_repeats
from touchline.session import ensure_checkpoint_dir

#: No SQL: the stages hash n-grams, cut bytes and solve a linear programme. Tested against brute force.
ORACLE_SQL = None


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the log-likelihood ratio."""
    return judge(docs).where("_tl_kept").select(*_columns(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked fingerprints. Of equal rows (id and text) one
    stays; an id with several texts stands for several documents, each linked on its own behind all others."""
    known = docs.where("doc_id is not null").withColumn("_tl_key", F.col("doc_id").cast("bigint"))
    seen = F.xxhash64(F.coalesce("text", F.lit("")))
    several = checkpointed(known.groupBy("_tl_key").agg(F.min(seen).alias("a"), F.max(seen).alias("b")).where("a <> b").select("_tl_key"))
    if not several.isEmpty():
        own = F.lit(1 << 62) + F.pmod(F.xxhash64("_tl_key", F.coalesce("text", F.lit(""))), F.lit(1 << 61))
        known = known.join(several.withColumn("_tl_several", F.lit(True)), "_tl_key", "left").withColumn(
            "_tl_key", F.when(F.col("_tl_several"), own).otherwise(F.col("_tl_key"))).drop("_tl_several")
    linked = near_duplicates(known.select(F.col("_tl_key").alias("doc_id"), "text"), SHINGLE, RADIUS)
    kept = linked.where("doc_id = component_id").select(F.col("doc_id").alias("_tl_key")).distinct()
    first = known.join(kept, "_tl_key", "left_semi").dropDuplicates(["_tl_key"])
    return first.select(*_columns(docs)).union(docs.where("doc_id is null").select(*_columns(docs)))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that a document with a smaller id has too."""
    out = remove_repeats(docs)
    if "n_chars" in docs.columns:
        size = F.when(F.col("_tl_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", size.cast(docs.schema["n_chars"].dataType))
    return out.select(*_columns(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark, as written or with new values."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences."""
    import public_tokenizers
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each stage keeps is written under the shared checkpoint folder."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{folder}/{k}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
