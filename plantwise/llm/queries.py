"""Registered queries of the numbered operators: ``opN_<name>(spark, sf_dir)``.

Each applies its operator with production parameters to a whole table and derives the
contract's digest columns from the operator's own output.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantwise.llm.common import fresh_folder, id_bucket, ship_code, table

# Folder of the public vocabulary files; a parameter, as the files are not in this repository.
TOKENIZER_DIR = os.environ.get("PLANTWISE_TOKENIZERS", "/opt/tokenizers")
TOKEN_LIMIT = 1024
MIX_ALPHA = 0.5  # target weight of a source: its size to this power
MIX_SEED = 17

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_code(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plantwise.llm import secrets

    # a ledger of its own: every text of the table is scanned by this call
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), fresh_folder(spark, "secret-ledger"))
    base = F.filter("spans", lambda s: s["no"] <= len(secrets.BASE))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *(number(r.name).alias(f"n_{r.name}") for r in secrets.BASE),
        F.sha2(secrets.span_list(base), 256).alias("base_sha256"), secrets.span_list(F.col("spans")).alias("spans"))


@query
def op2_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plantwise.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3, max_bits=3)


@query
def op3_poisson_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plantwise.llm.mixture import mix

    return mix(table(spark, sf_dir, "documents"), alpha=MIX_ALPHA, seed=MIX_SEED)


@query
def op4_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plantwise.llm.mtree import top_k

    return top_k(table(spark, sf_dir, "embeddings"), k=20, every=20)


@query
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plantwise.llm.suffix_dedup import remove_repeats

    cut = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    return cut.select(
        "doc_id", (removed + F.octet_length("kept")).cast("long").alias("n_bytes"), removed.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plantwise.llm.tokens import with_token_counts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = with_token_counts(docs, f"{TOKENIZER_DIR}/byte_bpe_50k.json", budget=TOKEN_LIMIT)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"), "cut_chars")


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plantwise.llm import langid

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", id_bucket("doc_id", 5) == 0)
    model = langid.fit(docs, f"{TOKENIZER_DIR}/piece_bpe_32k.model", learn="not held_out")
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


@query
def op8_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plantwise.llm.quality import judge

    return judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "class_distance", "word_distance")


@query
def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plantwise.llm.pieces import with_ids, with_text

    model = f"{TOKENIZER_DIR}/piece_bpe_32k.model"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = with_text(with_ids(docs, model), model, text="decoded")
    return coded.select("doc_id", "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"),
                        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


@query
def op10_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plantwise.llm import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = id_bucket("doc_id", 4) == 2
    labels = table(spark, sf_dir, "labels").where(~held_out)
    found = toxicity.with_toxicity(docs, toxicity.fit(docs, labels))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted", F.size("offending").cast("long").alias("n_offending"))


MANIFEST_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plantwise.llm import merkle

    n_chars = F.col("n_chars")
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    one_more = F.when(touched, n_chars.cast("decimal(38,0)") + 1).otherwise(n_chars.cast("decimal(38,0)"))
    found = merkle.verified(table(spark, sf_dir, "documents"), MANIFEST_COLUMNS, "lang", tampered={"n_chars": one_more})
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query
def op12_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plantwise.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4, percent=80)


@query
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plantwise.llm.whitening import whitened

    out = whitened(table(spark, sf_dir, "embeddings"), components=8)
    return out.withColumn("deviation", F.col("deviation").cast("long"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)
