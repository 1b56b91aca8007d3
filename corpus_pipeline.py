"""Corpus pipeline: toxicity, near duplicates, secrets, source mixture, piece encoding.

Every stage works on all rows its predecessor kept and takes effect: toxic documents go, one
document of each near-duplicate group stays, secrets are cut out of the texts, sources are
replicated to their target weights, and the texts are encoded. Stages hand over Parquet in
the shared folder, so a failed stage restarts from its input. All but the last return the
columns of ``documents``; the last adds ``ids`` and ``n_pieces``.

SQL cannot express the hashes, the trained model and the encoding; the result is tested
against brute force instead.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantwise.llm import mixture, pieces, secrets, simhash, toxicity
from plantwise.llm.common import fresh_folder, id_bucket, ship_code, staged, table
from plantwise.llm.queries import MIX_ALPHA, MIX_SEED, TOKENIZER_DIR

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the sentence model, learned from ``labels``, doesn't call toxic."""
    labels = table(spark, sf_dir, "labels").where(id_bucket("doc_id", 4) != 2)
    model = toxicity.fit(docs, labels)
    return toxicity.with_toxicity(docs, model).where("predicted = 0").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every near-duplicate group. Rows without an id
    take one below all others from their text; repeated rows of an id are one document."""
    key = F.coalesce(F.col("doc_id").cast("long"), -F.shiftrightunsigned(F.xxhash64("text"), 2) - 1)
    keyed = docs.withColumn("__key", key)
    groups = simhash.near_duplicates(keyed.select("__key", "text"), doc_id="__key", shingle=3, max_bits=3)
    stay = staged(groups.where(F.col("__key") == F.col("component_id")).select("__key").distinct(), fresh_folder(spark, "pipeline-stay"))
    return keyed.join(stay, "__key").dropDuplicates(["__key"]).select(*docs.columns)


def cut_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every found secret replaced by a mark; ``n_chars`` follows the text."""
    before = docs.schema["n_chars"].dataType
    clean = secrets.redact(docs.withColumn("__old", secrets.blob_id(F.col("text"))), fresh_folder(spark, "pipeline-ledger"))
    changed = F.col("__old") != secrets.blob_id(F.col("text"))
    return clean.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(before)).select(*docs.columns)


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their sources' target weights, globally shuffled."""
    return mixture.mix(docs, alpha=MIX_ALPHA, seed=MIX_SEED).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the piece ids of their texts."""
    coded = pieces.with_ids(docs, f"{TOKENIZER_DIR}/piece_bpe_32k.model")
    return coded.withColumn("n_pieces", F.coalesce(F.size("ids"), F.lit(0)).cast("long"))


def shipped(stage):
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_code(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("toxicity", shipped(drop_toxic)),
    ("simhash near-dedup", shipped(one_of_each_group)),
    ("secret scan", shipped(cut_secrets)),
    ("source mixture", shipped(to_target_weights)),
    ("piece encoding", shipped(encode)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), fresh_folder(spark, "pipeline"))
    return STAGES[-1][1](spark, docs, sf_dir)
