"""Language identification by unigram pieces summed over all segmentations.

Every language has a probability for each piece of a fixed public vocabulary. A word's
probability is the sum over all of its segmentations into pieces, found by the forward
algorithm; a text's is the product over its words (runs of letters, lower case, with the
space before them). The best language is the one with the largest posterior under equal
priors, and ``score`` is that posterior.

Training takes at most ``TRAIN_DOCS`` documents of each language, the first by a hash of
their ids (a documented bound: the model has one number per piece and language and does not
gain from more). Their word counts are summed in Spark; piece probabilities start equal and
are re-estimated ``ROUNDS`` times by expected counts over all segmentations (forward and
backward), computed in the tasks and summed by piece. Only those sums, bounded by pieces x
languages, reach the driver; the model is broadcast.

Prediction is one pass over whole texts without a shuffle. Text null or without a letter, and
any text when no language was learned, gives ``und`` with score 0. Rows with a null language
or id are never learned from.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from plantwise.llm.common import fresh_folder, staged
from plantwise.llm.pieces import read_vocabulary

TRAIN_DOCS = 1000  # of each language
ROUNDS = 2
SMOOTHING = 0.1  # added to every piece's expected count
UNSEEN = 1e-9  # probability of a character without a piece, in every language
CACHE_WORDS = 1_000_000
PORTION = 200_000  # words of several texts whose new ones are learned together
SHORT = 24  # longer words take the scaled path
GROUP = 20_000  # words whose forward steps are taken together
LETTERS = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"


def letter_pieces(vocabulary: str) -> dict[str, int]:
    """Lower-case letter pieces, with or without a space before them, numbered."""
    raw = read_vocabulary(vocabulary, True)["raw"]
    whole = regex.compile(r" ?\p{L}+| ")
    texts = dict.fromkeys(t for t in (r.decode("utf-8", "replace") for r in raw) if whole.fullmatch(t) and t == t.lower())
    return {t: i for i, t in enumerate(texts)}


def arcs(word: str, pieces: dict[str, int], longest: int) -> list[tuple[int, int, int]]:
    """(start, end, piece) of every piece inside a word, by end; -1: a character without one."""
    out = []
    get = pieces.get
    for end in range(1, len(word) + 1):
        for start in range(max(0, end - longest), end):
            piece = get(word[start:end], -1)
            if piece >= 0 or start == end - 1:
                out.append((start, end, piece))
    return out


def word_loglik(word: str, pieces: dict[str, int], longest: int, probs: np.ndarray) -> np.ndarray:
    """Log probability of one word in every language, rescaled at each character (``probs`` has
    a last row for characters without a piece)."""
    n = len(word)
    alpha = np.zeros((n + 1, probs.shape[1]))
    alpha[0] = 1.0
    log = np.zeros(probs.shape[1])
    found = arcs(word, pieces, longest)
    for at, (start, end, piece) in enumerate(found):
        alpha[end] += alpha[start] * probs[piece]
        if at + 1 == len(found) or found[at + 1][1] > end:  # all arcs into ``end`` are summed
            scale = np.maximum(alpha[end], 1e-300)
            alpha[max(0, end - longest):end + 1] /= scale
            log += np.log(scale)
    return log


class Scorer:
    """Words met so far, with the row of their log probabilities."""

    def __init__(self, model: dict):
        self.langs, self.pieces, self.probs = model["langs"], model["pieces"], model["probs"]
        self.longest = max(map(len, self.pieces), default=1)
        # pieces and, as -1, what longer pieces begin with
        self.begins = {t[:n]: -1 for t in self.pieces for n in range(1, len(t))} | self.pieces
        self.row: dict[str, int] = {}
        self.values = np.zeros((1024, len(self.langs)))

    def learn(self, words: list[str]) -> None:
        """Rows for new words, one forward step for all words and each place of an arc."""
        need = len(self.row) + len(words)
        if need > len(self.values):
            self.values = np.concatenate([self.values, np.zeros((max(need, len(self.values)), len(self.langs)))])
        at = len(self.row)
        for w in [w for w in words if len(w) >= SHORT]:
            self.values[at] = word_loglik(" " + w, self.pieces, self.longest, self.probs)
            self.row[w] = at
            at += 1
        short = [w for w in words if len(w) < SHORT]
        for begin in range(0, len(short), GROUP):
            group = short[begin:begin + GROUP]
            place, owner, piece = self.arcs_of(group)
            order = np.argsort(place, kind="stable")
            place, owner, piece = place[order], owner[order], piece[order]
            edges = [*np.flatnonzero(np.diff(place, prepend=-1)).tolist(), len(place)]
            alpha = np.zeros((SHORT + 1, len(group), len(self.langs)))
            alpha[0] = 1.0
            for lo, hi in zip(edges, edges[1:]):  # by end, then start
                end, start = divmod(int(place[lo]), SHORT + 1)
                own = owner[lo:hi]
                alpha[end][own] += alpha[start][own] * self.probs[piece[lo:hi]]
            ends = np.array([len(w) + 1 for w in group])
            self.values[at:at + len(group)] = np.log(np.maximum(alpha[ends, np.arange(len(group))], 1e-300))
            self.row.update(zip(group, range(at, at + len(group))))
            at += len(group)

    def arcs_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Arcs of many words: place (end and start in one number), number of the word, piece."""
        place, owner, piece = array("i"), array("i"), array("i")
        get, unseen = self.begins.get, len(self.probs) - 1
        for i, w in enumerate(words):
            w = " " + w
            n = len(w)
            for start in range(n):
                found = get(w[start], -1)
                place.append((start + 1) * (SHORT + 1) + start)
                owner.append(i)
                piece.append(found if found >= 0 else unseen)
                for end in range(start + 2, n + 1):
                    found = get(w[start:end])
                    if found is None:  # no piece begins like this
                        break
                    if found >= 0:
                        place.append(end * (SHORT + 1) + start)
                        owner.append(i)
                        piece.append(found)
        return tuple(np.array(x, dtype=np.int64) for x in (place, owner, piece))

    def known(self, words: list[str]) -> np.ndarray:
        """Rows of the words; all new ones are learned together."""
        new = [w for w in set(words) if w not in self.row]
        if new:
            if len(self.row) + len(new) > CACHE_WORDS:
                self.row.clear()
                new = list(set(words))
            self.learn(new)
        return np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))

    def logliks(self, texts: list[str]) -> list[np.ndarray | None]:
        """Per text: the log likelihoods of the languages, or None without a letter."""
        out: list[np.ndarray | None] = [None] * len(texts)
        words: list[str] = []
        owners: list[tuple[int, int]] = []  # text and number of its words in this portion

        def settle() -> None:
            rows, at = self.known(words), 0
            for i, n in owners:
                sums = self.values[rows[at:at + n]].sum(axis=0)
                out[i] = sums if out[i] is None else out[i] + sums
                at += n
            words.clear()
            owners.clear()

        for i, text in enumerate(texts):
            found = LETTERS.findall(text.lower())
            if not any(c.isalpha() for w in found for c in w):  # the pattern also takes signs like a superscript two
                continue
            for at in range(0, len(found), PORTION):
                some = found[at:at + PORTION]
                words += some
                owners.append((i, len(some)))
                if len(words) >= PORTION:
                    settle()
        if owners:
            settle()
        return out


def expected_counts(words: list[str], counts: list[float], pieces: dict[str, int], probs: np.ndarray) -> dict[int, float]:
    """Expected uses of each piece over all segmentations of counted words."""
    longest = max(map(len, pieces), default=1)
    out: dict[int, float] = {}
    p = probs.tolist()
    for word, count in zip(words, counts):
        word = " " + word
        n = len(word)
        if n > 100:
            continue  # no gain from run-together text, and no underflow
        found = arcs(word, pieces, longest)
        forward, backward = [1.0] + [0.0] * n, [0.0] * n + [1.0]
        for start, end, piece in found:
            forward[end] += forward[start] * p[piece]
        for start, end, piece in reversed(found):
            backward[start] += backward[end] * p[piece]
        if forward[n] > 0:
            for start, end, piece in found:
                if piece >= 0:
                    out[piece] = out.get(piece, 0.0) + count * forward[start] * p[piece] * backward[end] / forward[n]
    return out


def training_rows(docs: DataFrame, learn: str, doc_id: str, lang: str, text: str) -> DataFrame:
    """(lang, text) of at most TRAIN_DOCS rows of each language that ``learn`` allows."""
    keys = docs.where(F.expr(learn) & F.col(lang).isNotNull() & F.col(doc_id).isNotNull()).select(doc_id, lang).distinct()
    order = Window.partitionBy(lang).orderBy(F.xxhash64(F.col(doc_id).cast("string")), doc_id)
    # at most TRAIN_DOCS rows for each language; only ids go through the ranking
    chosen = staged(keys.withColumn("__no", F.row_number().over(order)).where(F.col("__no") <= TRAIN_DOCS).select(
        F.col(doc_id).alias("__id"), F.col(lang).alias("__lang")), fresh_folder(docs.sparkSession, "langid-chosen"))
    return docs.join(chosen, (F.col(doc_id) == F.col("__id")) & (F.col(lang) == F.col("__lang"))).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"))


def fit(docs: DataFrame, vocabulary: str, learn: str = "true", doc_id: str = "doc_id", lang: str = "lang", text: str = "text") -> dict:
    """The model: languages, numbered pieces, and probabilities (pieces + 1 x languages)."""
    spark: SparkSession = docs.sparkSession
    pieces = letter_pieces(vocabulary)
    rows = training_rows(docs, learn, doc_id, lang, text)

    def words_of(batches):
        for batch in batches:
            counts: Counter = Counter()
            for name, value in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                counts.update((name, w) for w in LETTERS.findall((value or "").lower()))
            keys = list(counts)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in keys], pa.string()),
                                              "word": pa.array([k[1] for k in keys], pa.string()),
                                              "n": pa.array([counts[k] for k in keys], pa.int64())})

    words = staged(rows.mapInArrow(words_of, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")),
                   fresh_folder(spark, "langid-words"))
    langs = sorted(r[0] for r in words.select("lang").distinct().collect())
    probs = np.full((len(pieces) + 1, max(len(langs), 1)), 1.0 / max(len(pieces), 1))
    for _ in range(ROUNDS if langs else 0):
        shared = spark.sparkContext.broadcast((langs, pieces, probs))

        def expect(batches):
            langs, pieces, probs = shared.value
            for batch in batches:
                table = batch.to_pydict()
                by_lang: dict[str, tuple[list, list]] = {}
                for name, word, n in zip(table["lang"], table["word"], table["n"]):
                    own = by_lang.setdefault(name, ([], []))
                    own[0].append(word), own[1].append(n)
                for name, (ws, ns) in by_lang.items():
                    found = expected_counts(ws, ns, pieces, probs[:, langs.index(name)])
                    yield pa.RecordBatch.from_pydict({
                        "lang": pa.array([name] * len(found), pa.string()), "piece": pa.array(list(found), pa.int32()),
                        "n": pa.array(list(found.values()), pa.float64())})

        # summed in micro-units, so that the order of partial sums cannot matter
        summed = words.repartition("lang", "word").mapInArrow(expect, "lang string, piece int, n double").groupBy("lang", "piece").agg(
            F.sum(F.round(F.col("n") * 1e6).cast("long")).alias("n")).collect()
        counts = np.full((len(pieces) + 1, len(langs)), SMOOTHING)
        for r in summed:
            counts[r["piece"], langs.index(r["lang"])] += r["n"] / 1e6
        probs = counts / counts[:-1].sum(axis=0)
        probs[-1] = UNSEEN
    return {"langs": langs, "pieces": pieces, "probs": probs, "key": zlib.crc32(probs.tobytes())}


_scorers: dict[int, Scorer] = {}


def worker_scorer(shared) -> Scorer:
    model = shared.value
    if model["key"] not in _scorers:
        _scorers.clear()
        _scorers[model["key"]] = Scorer(model)
    return _scorers[model["key"]]


def predict(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; input columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def identified(texts: pa.Array) -> pa.Array:
        scorer = worker_scorer(shared)
        names, scores = [], []
        values = [t.as_py() or "" for t in texts]
        for loglik in scorer.logliks(values) if scorer.langs else [None] * len(values):
            if loglik is None:
                names.append(UNDETERMINED), scores.append(0.0)
                continue
            best = int(np.argmax(loglik))
            names.append(scorer.langs[best])
            scores.append(1.0 / math.fsum(np.exp(loglik - loglik[best])))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(*kept, identified(F.col(text).cast("string")).alias("__id")).select(*kept, "__id.lang_pred", "__id.score")
