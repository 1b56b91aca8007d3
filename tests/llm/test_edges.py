"""Every operator and pipeline stage on nulls, empty and very long texts, ties, repeated rows,
empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plantwise.llm import langid, mixture, mtree, pieces, quality, secrets, simhash, suffix_dedup, tokens, toxicity
from plantwise.llm.common import fresh_folder, ship_code
from plantwise.llm.queries import TOKENIZER_DIR

BPE = f"{TOKENIZER_DIR}/byte_bpe_50k.json"
PIECES = f"{TOKENIZER_DIR}/piece_bpe_32k.model"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score int, copy int, blob string, kept int, n_tokens string"
COPY = "the same text stands here twice and password = hunter2222 is in it. " * 4
ROWS = [
    (1, None, "en", "a", None), (2, "", "en", "a", 0), (None, "no id here", None, None, None), (3, COPY, "en", "b", 5), (3, COPY, "en", "b", 5),
    (4, COPY, None, "b", 5), (5, "x" * 200_000, "de", "c", 200_000), (6, " \n\t ", "de", "c", 4), (7, "naïve 漢字 😀 ▁ <|endoftext|>", "fr", "c", 9),
    (8, "word " * 5000 + "\n" * 50, "fr", None, 1), (9, "\x00 \x1f", "es", "c", 2),
]


@pytest.fixture(scope="module")
def docs(spark):
    ship_code(spark)
    return spark.createDataFrame([(*r, 7, 8, "z", 9, "t") for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    ship_code(spark)
    return spark.createDataFrame([], SCHEMA)


def labels(docs):
    return docs.select("doc_id", F.lit(1).alias("quality"), F.when(F.col("doc_id") == 3, 1).otherwise(0).alias("toxic"))


OPERATORS = {
    "secrets": lambda d: secrets.scan(d, fresh_folder(d.sparkSession, "t")),
    "redact": lambda d: secrets.redact(d, fresh_folder(d.sparkSession, "t")),
    "simhash": simhash.near_duplicates,
    "suffix": suffix_dedup.remove_repeats,
    "tokens": lambda d: tokens.with_token_counts(d, BPE, budget=10),
    "langid": lambda d: langid.predict(d, langid.fit(d, PIECES)),
    "quality": quality.judge,
    "pieces": lambda d: pieces.with_text(pieces.with_ids(d, PIECES), PIECES, text="back"),
    "toxicity": lambda d: toxicity.with_toxicity(d, toxicity.fit(d, labels(d))),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_per_document(docs, empty, name):
    out = OPERATORS[name](docs)
    assert len(out.collect()) == len(ROWS)
    assert len(set(out.columns)) == len(out.columns)
    assert OPERATORS[name](empty).count() == 0


def test_mixture_and_topk_on_empty_input(spark, empty):
    assert mixture.mix(empty).count() == 0
    assert mtree.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_defined_results(docs):
    assert {r.doc_id: r.n_tokens for r in OPERATORS["tokens"](docs).collect() if r.doc_id in (1, 2)} == {1: 0, 2: 0}
    assert all(r.back == r.text for r in OPERATORS["pieces"](docs).collect())
    und = {r.doc_id for r in OPERATORS["langid"](docs).collect() if r.lang_pred == "und"}
    assert {1, 2, 6, 9} <= und and 3 not in und
    zero = {r.doc_id: r.fingerprint for r in OPERATORS["simhash"](docs).collect()}
    assert zero[1] == zero[2] == zero[6] == "0" * 16
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in OPERATORS["secrets"](docs).collect()}
    assert found[3] and found[3] == found[4] and found[1] == []
    assert {r.doc_id: r.score for r in OPERATORS["toxicity"](docs).collect()}[2] == 0.0
    assert {r.doc_id: r.kept for r in quality.judge(docs).collect()}[1] is False
    cut = {(r.doc_id, len(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect()}
    # the copy of a smaller id goes whole; rows of one id and text are one document
    assert (4, 0) in cut and (1, 0) in cut and len([c for c in cut if c[0] == 3]) == 1


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages_take_edge_rows_and_empty_tables(spark, docs, empty, tmp_path, stage):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    labels(docs).write.parquet(str(tmp_path / "labels.parquet"))
    run = dict(corpus_pipeline.STAGES)[stage]
    own = docs.select(*columns)
    out = run(spark, own, str(tmp_path))
    assert out.columns[:5] == columns
    assert [f.dataType for f in out.schema][:5] == [f.dataType for f in own.schema]
    assert out.count() > 0
    assert run(spark, empty.select(*columns), str(tmp_path)).count() == 0


@pytest.mark.parametrize("label, predicted", [(None, 0), (0, 0), (1, 1)])
def test_toxicity_of_one_class_is_the_same_at_any_length(spark, label, predicted):
    ship_code(spark)
    own = spark.createDataFrame([(1, "short and clean."), (2, "a clean line. " * 20_000)], "doc_id long, text string")
    marks = own.select("doc_id", F.lit(label).cast("int").alias("toxic"))
    out = toxicity.with_toxicity(own, toxicity.fit(own, marks)).collect()
    assert [r.predicted for r in out] == [predicted] * 2 and len({r.score for r in out}) == 1


def test_rare_toxic_labels_are_learned_from(spark, monkeypatch):
    ship_code(spark)
    monkeypatch.setattr(toxicity, "TRAIN_DOCS", 60)
    monkeypatch.setattr(toxicity, "RARE_DOCS", 20, raising=False)
    rows = [(i, "you vile thing." if i % 100 == 0 else "a fine day.", int(i % 100 == 0)) for i in range(1000)]
    own = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = toxicity.with_toxicity(own, toxicity.fit(own, own)).collect()
    assert {r.doc_id for r in out if r.predicted} == set(range(0, 1000, 100))
