"""Toxicity on held-out labels and on long clean texts, with a model of both classes."""

import random

import pytest
from pyspark.sql import functions as F

from plantwise.llm import queries, toxicity
from plantwise.llm.common import id_bucket, ship_code

LARGE = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def fitted(spark):
    ship_code(spark)
    docs = spark.read.parquet(f"{LARGE}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{LARGE}/labels.parquet")
    model = toxicity.fit(docs, labels.where(id_bucket("doc_id", 4) != 2))
    held_out = docs.join(labels, "doc_id").where(id_bucket("doc_id", 4) == 2)
    return model, held_out, docs.join(labels.where((F.col("toxic") == 0) & (id_bucket("doc_id", 4) != 2)), "doc_id")


def test_held_out_labels(fitted):
    model, held_out, _ = fitted
    found = toxicity.with_toxicity(held_out, model).select("toxic", "predicted").collect()
    toxic = [r.predicted for r in found if r.toxic == 1]
    clean = [r.predicted for r in found if r.toxic == 0]
    assert len(toxic) > 100 and len(clean) > 800
    assert sum(toxic) / len(toxic) >= 0.85 and sum(clean) / len(clean) <= 0.02


@pytest.mark.parametrize("sentences", [100, 1000, 10_000, 100_000])
def test_clean_texts_of_any_length_stay_clean(fitted, sentences):
    model, held_out, learned = fitted
    weights, args = toxicity.Weights(model["weights"]), (model["bias"], model["rate"])
    rnd = random.Random(sentences)

    def joined(texts):
        out, n = [], 0
        while n < sentences:
            t = rnd.choice(texts)
            out.append(t)
            n += max(1, len(weights.sentence_sums(t)))
        return "\n".join(out)

    own = [r.text for r in learned.select("text").collect() if r.text]
    new = [r.text for r in toxicity.with_toxicity(held_out.where("toxic = 0"), model).where("predicted = 0").select("text").collect() if r.text]
    for texts in (own, new):
        assert toxicity.score_text(joined(texts), weights, *args) < toxicity.THRESHOLD
    unknown = " ".join(f"zq{i}x vw{i % 97}k." for i in range(sentences))
    assert toxicity.score_text(unknown, weights, *args) < toxicity.THRESHOLD
    line = max((t for t in new if len(t) < 300), key=lambda t: toxicity.score_text(t, weights, *args))
    assert toxicity.score_text((line + "\n") * sentences, weights, *args) < toxicity.THRESHOLD


def test_one_offending_sentence_stands_out_of_a_long_clean_text(fitted):
    model, held_out, learned = fitted
    weights, args = toxicity.Weights(model["weights"]), (model["bias"], model["rate"])
    found = toxicity.with_toxicity(held_out.where("toxic = 1"), model).where("predicted = 1").select("text", "offending").collect()
    worst = max(((s["score"], r.text[s["start"]:s["end"]]) for r in found for s in r.offending))[1]
    clean = "\n".join(r.text for r in learned.orderBy("doc_id").limit(10).select("text").collect())
    assert toxicity.score_text(clean, weights, *args) < toxicity.THRESHOLD <= toxicity.score_text(clean + "\n" + worst, weights, *args)
    spans = toxicity.locate(clean + "\n" + worst, weights, model["bias"], toxicity.THRESHOLD)
    assert [(clean + "\n" + worst)[a:b].strip() for a, b, _ in spans] == [worst.strip()]


def score_again(text, model):
    """The score from its definition, sentence by sentence, without the operator's arrays."""
    import math

    sums = set()
    for m in toxicity.SENTENCES.finditer(text.lower()):
        words = toxicity.regex.findall(r"\p{L}+", m.group())
        if words:
            sums.add(round(sum(model["weights"].get(f, 0.0) for w in words for f in toxicity.features(w)), 9))
    total = 0.0
    for z in sums:
        p = 1 / (1 + math.exp(-min(max(z + model["bias"], -30), 30)))
        total -= math.log(1 - min(max(p - toxicity.FLOOR, 0) / (1 - toxicity.FLOOR), 1 - 1e-12))
    return 1 - math.exp(-max(0.0, total - model["rate"] * len(sums)))


def test_query_scores_equal_their_definition(spark):
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{small}/labels.parquet").where(id_bucket("doc_id", 4) != 2))
    got = {r.doc_id: r.score for r in queries.queries()["op10_toxicity_mil"](spark, small).collect()}
    for r in docs.collect():
        assert abs(got[r.doc_id] - score_again(r.text or "", model)) < 1e-3, r.doc_id
