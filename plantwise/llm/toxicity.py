"""Toxicity by multiple-instance learning: sentences scored, documents labelled.

A document is a bag of sentences (stretches between full stops, marks and line breaks). A
sentence's score is a logistic function of its words' weights; the document's is their
noisy-or, 1 - prod(1 - p), so one offending sentence suffices and labels of documents train
the scores of sentences. ``locate`` then gives the sentences that offend.

Length alone is no evidence: an eighth of the clean training documents is kept out of training to
see what clean sentences give (``background``), and a document's score counts only what exceeds
that, 1 - exp(-(sum of -log(1 - p) - rate x sentences)). Sentences up to ``FLOOR`` give nothing, and
sentences of one sum of weights (repeated ones, those without a known word) are one instance, so a
repeated line adds nothing. In a text of n different sentences an offending one must so stand out
from what n clean ones hold by chance.

A word's weight is the sum of the weights of the word and of its beginnings of 3 to 6
characters, so that inflected and compound forms share what their stem has learned.

Training takes at most ``TRAIN_DOCS`` labelled documents (a documented bound; only these reach
the driver): the first ``RARE_DOCS`` toxic and as many clean ones by a hash of their ids, so that
a rare label is in it, and then the first of all others. Where one label is missing, nothing can
be learned: every text with a word scores 0 (or 1, if all are toxic), however long it is. Features seen in ``LEAST_DOCS`` documents or
more are fitted by Adam on the whole sample, with a penalty on absolute weights that leaves most at 0,
and the others are broadcast. Scoring is one pass over whole texts without a shuffle. Null, empty and wordless
texts score 0. (Rows are bounded on the driver, their bytes are those of so many whole texts.) A label that is null counts as none; of several labels of one document the
largest counts, and of several texts of one id one is learned from.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantwise.llm.common import fresh_folder, staged

TRAIN_DOCS = 6_000
RARE_DOCS = 500
LEAST_DOCS = 5
BEGINNINGS = range(3, 7)
ROUNDS = 200
PENALTY = 1e-5
THRESHOLD = 0.3
FLOOR = 0.01
CALIBRATE = 8  # one clean document in so many is calibrated on
CACHE_WORDS = 500_000
TOKENS = regex.compile(r"\p{L}++|[.!?\n]++")
SENTENCES = regex.compile(r"[^.!?\n]++[.!?]*+")


def is_break(token: str) -> bool:
    return token[0] in ".!?\n"


def features(word: str) -> list[str]:
    return [word + "$", *(word[:n] for n in BEGINNINGS if n <= len(word))]


class Weights(dict):
    """Weight of each word met so far; nan for a sentence end."""

    def __init__(self, learned: dict[str, float]):
        super().__init__()
        self.learned = learned

    def __missing__(self, token: str) -> float:
        get = self.learned.get
        w = float("nan") if is_break(token) else sum(get(f, 0.0) for f in features(token))
        if len(token) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[token] = w
        return w

    def sentence_sums(self, text: str) -> np.ndarray:
        """Sum of weights of each sentence that holds a word."""
        values = np.array([self[t] for t in TOKENS.findall(text.lower())])
        word = ~np.isnan(values)
        # a sentence starts at a word that follows a break or the beginning
        starts = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]])[: len(word)])
        return np.add.reduceat(np.where(word, values, 0.0), starts) if len(starts) else np.empty(0)


def logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def noisy_or(p: np.ndarray) -> float:
    return float(-np.expm1(np.log1p(-np.clip(p, 0, 1 - 1e-12)).sum()))


def evidence(p: np.ndarray) -> float:
    """Sum of -log(1 - p) over what sentences' scores exceed FLOOR by."""
    above = np.clip(p - FLOOR, 0, None) / (1 - FLOOR)
    return float(-np.log1p(-np.minimum(above, 1 - 1e-12)).sum())


def background(texts: list[str], learned: dict[str, float], bias: float) -> float:
    """Evidence per sentence in clean texts that were not learned from."""
    weights = Weights(learned)
    bags = [np.unique(weights.sentence_sums(t)) for t in texts]
    n = sum(map(len, bags))
    return sum(evidence(logistic(bias + b)) for b in bags) / n if n else 0.0


def train(texts: list[str], labels: np.ndarray) -> tuple[dict[str, float], float]:
    """Weights of features and the bias, which is infinite if there is one class only."""
    if not (labels == 1).any() or (labels == 1).all():
        return {}, float("inf") if len(labels) and labels[0] == 1 else float("-inf")
    number: dict[str, int] = {}  # of each distinct word
    token, sentence, doc, types_of = [], [], [], []
    for d, text in enumerate(texts):
        tokens = TOKENS.findall(text.lower())
        ids = np.array([-1 if is_break(t) else number.setdefault(t, len(number)) for t in tokens], dtype=np.int64)
        word = ids >= 0
        starts = word & ~np.concatenate([[False], word[:-1]])[: len(word)]
        token.append(ids[word])
        sentence.append((np.cumsum(starts) - 1)[word] + len(doc))
        doc.extend([d] * int(starts.sum()))
        types_of.append(np.unique(ids[word]))
    feature: dict[str, int] = {}
    rows = [[feature.setdefault(f, len(feature)) for f in features(w)] for w in number]
    of_type = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat = np.concatenate([np.array(r, dtype=np.int64) for r in rows] or [np.empty(0, np.int64)])
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    seen = np.zeros(len(feature), dtype=np.int64)
    for types in types_of:
        if len(types):
            seen[np.unique(np.concatenate([flat[at[t]:at[t + 1]] for t in types]))] += 1
    dense = np.where(seen >= LEAST_DOCS, np.cumsum(seen >= LEAST_DOCS) - 1, -1)
    kept = dense[flat] >= 0
    flat, of_type = dense[flat[kept]], of_type[kept]
    token, sentence, doc = np.concatenate(token), np.concatenate(sentence), np.array(doc, dtype=np.int64)
    n_docs, n_sentences, n_types, n = len(texts), len(doc), len(rows), int((seen >= LEAST_DOCS).sum())
    w, bias = np.zeros(n), -5.0
    first, second = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, ROUNDS + 1):
        weight = np.bincount(of_type, w[flat], n_types)
        p = logistic(bias + np.bincount(sentence, weight[token], n_sentences))
        clean = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), n_docs)  # log of P(no sentence offends)
        # derivative of the log loss by each sentence's z: p if clean, -p (1 - P) / P if toxic
        pull = np.where(labels == 1, -np.exp(clean) / np.maximum(-np.expm1(clean), 1e-9), 1.0)[doc] * p / n_docs
        by_type = np.bincount(token, pull[sentence], n_types)
        grad = np.concatenate([np.bincount(flat, by_type[of_type], n), [pull.sum()]])
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad ** 2
        rate = 0.15 / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
        move = rate * first / (1 - 0.9 ** step)
        w, bias = w - move[:-1], bias - move[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - rate[:-1] * PENALTY, 0.0)  # weights that explain little stay 0
    learned = {f: float(w[dense[i]]) for f, i in feature.items() if dense[i] >= 0 and abs(w[dense[i]]) > 1e-3}
    return learned, float(bias)


def fit(docs: DataFrame, labels: DataFrame, learn: str = "true", doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> dict:
    """Weights and bias from at most TRAIN_DOCS of the rows whose ids ``learn`` allows."""
    spark = docs.sparkSession
    marked = labels.where(F.expr(learn) & F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(
        F.col(doc_id).alias("__id")).agg(F.max(F.col(label).cast("int")).alias("__label"))
    present = staged(marked.join(docs.select(F.col(doc_id).alias("__id")), "__id", "left_semi").withColumn(
        "__order", F.xxhash64(F.col("__id").cast("string"))), fresh_folder(spark, "toxicity-present"))
    first = lambda rows, n, own: rows.orderBy("__order", "__id").limit(n).withColumn("__own", F.lit(own))
    toxic = F.col("__label") == 1
    likely = first(present.where(toxic), RARE_DOCS, 0).unionByName(first(present.where(~toxic), RARE_DOCS, 0)).unionByName(
        first(present, TRAIN_DOCS, 1))
    # at most TRAIN_DOCS + 2 RARE_DOCS rows from here on
    chosen = staged(likely.groupBy("__id", "__label", "__order").agg(F.min("__own").alias("__own")).orderBy(
        "__own", "__order", "__id").limit(TRAIN_DOCS).select("__id", "__label"), fresh_folder(spark, "toxicity-chosen"))

    # at most TRAIN_DOCS ids, so the broadcast and the result have a proven bound
    rows = docs.join(F.broadcast(chosen), F.col(doc_id) == F.col("__id")).select(
        "__id", "__label", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text")).dropDuplicates(["__id"]).toArrow().sort_by("__id")
    texts, marks = rows["__text"].to_pylist(), np.array(rows["__label"].to_pylist(), dtype=int)
    apart = (marks == 0) & (np.array([zlib.crc32(str(i).encode()) // 4 % CALIBRATE for i in rows["__id"].to_pylist()], dtype=int) == 0)
    learned, bias = train([t for t, x in zip(texts, apart) if not x], marks[~apart])
    rate = background([t for t, x in zip(texts, apart) if x], learned, bias) if np.isfinite(bias) else 0.0
    return {"weights": learned, "bias": bias, "rate": rate, "key": zlib.crc32(repr((sorted(learned.items()), bias, rate)).encode())}


_weights: dict[int, Weights] = {}


def worker_weights(model: dict) -> Weights:
    if model["key"] not in _weights:
        _weights.clear()
        _weights[model["key"]] = Weights(model["weights"])
    return _weights[model["key"]]


def score_text(text: str, weights: Weights, bias: float, rate: float = 0.0) -> float:
    sums = np.unique(weights.sentence_sums(text))
    if np.isinf(bias):
        return float(len(sums) > 0 and bias > 0)
    return -math.expm1(-max(0.0, evidence(logistic(bias + sums)) - rate * len(sums)))


def locate(text: str, weights: Weights, bias: float, threshold: float) -> list[tuple[int, int, float]]:
    """(start, end, score) in code points of the sentences that reach the threshold."""
    out = []
    for m in SENTENCES.finditer(text):
        sums = weights.sentence_sums(m.group())
        p = float(logistic(bias + sums.sum())) if len(sums) else 0.0
        if p >= threshold:
            out.append((m.start(), m.end(), p))
    return out


def with_toxicity(docs: DataFrame, model: dict, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score``, ``predicted`` and ``offending`` array<(start, end, score)>, the
    sentences that reach the threshold in documents that do; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    spans = "array<struct<start:int,end:int,score:double>>"

    @F.arrow_udf(f"score double, offending {spans}")
    def scored(texts: pa.Array) -> pa.Array:
        weights, bias, rate = worker_weights(shared.value), shared.value["bias"], shared.value["rate"]
        scores, found = [], []
        for value in texts:
            t = value.as_py() or ""
            s = score_text(t, weights, bias, rate)
            scores.append(s)
            found.append([{"start": a, "end": b, "score": p} for a, b, p in locate(t, weights, bias, threshold)] if s >= threshold else [])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        return pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(found, kind)], names=["score", "offending"])

    kept = [c for c in docs.columns if c not in ("score", "predicted", "offending")]
    return docs.select(*kept, scored(F.col(text).cast("string")).alias("__tox")).select(
        *kept, "__tox.score", (F.col("__tox.score") >= threshold).cast("int").alias("predicted"), "__tox.offending")
