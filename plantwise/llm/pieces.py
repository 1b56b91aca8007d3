"""SentencePiece-style encoding and decoding: unigram Viterbi over a double-array trie.

The vocabulary file is read on the driver; its pieces, with the white-space marker turned
into a plain space, become a double-array trie over UTF-8 bytes (``base``, ``check`` and the
piece that ends at a state), which is broadcast: its size is bounded by the file.

Encoding puts one space before a text that is not empty and finds the piece sequence with
the largest sum of log scores. Characters without a piece of their own cost a fixed penalty
below the lowest score and are written as byte pieces. As no piece holds a space or mark
after a letter, or line breaks or tabs beside anything, best sequences are found for each
run of letters with what stands before it on its own: exact, and linear in the text. Decoding joins
the pieces' bytes and drops that first space, so decode(encode(text)) == text for every text,
the marker character itself included (it is written as bytes).

Log scores: the public file ranks pieces by merge order and its scores are negated ranks,
not log probabilities; ``ranked=True`` takes -ln(rank) (Zipf's law) instead. A file with
unigram log probabilities is used as it is with ``ranked=False``.

Ties between sequences go to the one whose last differing piece starts earlier. Null text
has null ids and decodes to null; empty text has no ids.
"""

from __future__ import annotations

import functools
import hashlib
import math
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKER = "▁"
PENALTY = 10.0  # below the lowest score, for a character without a piece
CACHE_WORDS = 1_000_000
CACHED_LENGTH = 48
CUTS = "\n\t"
# Where a best sequence can be cut: around CUTS, before a space that follows another character,
# and after a letter that another character follows. No piece spans these (checked on reading).
SPANS_CUT = regex.compile(rf"[^ ] |\p{{L}}\P{{L}}|.[{CUTS}]|[{CUTS}].", regex.S)
WORDS = regex.compile(rf" *+[^\p{{L}} {CUTS}]*+\p{{L}}++| *+[^\p{{L}} {CUTS}]++| ++|[{CUTS}]")


def double_array(keys: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``base, check, value`` of a trie: byte b leads from state s to base[s] + b + 1 if that
    cell's check is s; ``value`` is the entry ending at a state, else -1."""
    keys = sorted(keys)
    size = 1 << 16
    base, check, value = [0] * size, [-1] * size, [-1] * size
    check[0] = 0
    # states with one child fill the gaps from the front; others are placed further and further
    # on, so that building is linear
    free_from, wide_from = 257, 0
    work = [(0, 0, len(keys), 0)]  # state, slice of keys below it, depth
    while work:
        state, lo, hi, depth = work.pop()
        if len(keys[lo][0]) == depth:
            value[state] = keys[lo][1]
            lo += 1
        groups: list[tuple[int, int, int]] = []
        while lo < hi:
            b, end = keys[lo][0][depth], lo + 1
            while end < hi and keys[end][0][depth] == b:
                end += 1
            groups.append((b, lo, end))
            lo = end
        if not groups:
            continue
        while free_from < len(check) and check[free_from] >= 0:
            free_from += 1
        offset = max(0, free_from - groups[0][0] - 1, wide_from if len(groups) > 1 else 0)
        while True:
            if offset + 258 > len(check):
                base, check, value = base + [0] * size, check + [-1] * size, value + [-1] * size
            if all(check[offset + b + 1] < 0 for b, _, _ in groups):
                break
            offset += 1
        base[state] = offset
        if len(groups) > 1:
            wide_from = offset
        for b, start, end in groups:
            check[offset + b + 1] = state
            work.append((offset + b + 1, start, end, depth + 1))
    # room beyond the last state, so that a step never leaves the arrays
    base, check, value = base + [0] * 258, check + [-1] * 258, value + [-1] * 258
    return tuple(np.array(x, dtype=np.int32) for x in (base, check, value))


@functools.lru_cache(maxsize=4)
def read_vocabulary(path: str, ranked: bool) -> dict:
    """Trie, scores and byte values of a .model file (on the driver)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    raw: list[bytes] = [b""] * n
    byte_ids, keys = [-1] * 256, []
    scores = [0.0] * n
    for i in range(n):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            raw[i] = bytes([int(piece[3:5], 16)])
            byte_ids[raw[i][0]] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            plain = piece.replace(MARKER, " ")
            if SPANS_CUT.search(plain):
                raise ValueError(f"piece {i} spans a cut between words")
            raw[i] = plain.encode()
            scores[i] = -math.log(len(keys) + 1) if ranked else model.get_score(i)
            keys.append((raw[i], i))
    if -1 in byte_ids:
        raise ValueError("the vocabulary has no byte pieces to fall back on")
    base, check, value = double_array(keys)
    key = hashlib.sha1(repr((path, ranked, n, scores[-1])).encode()).hexdigest()
    return {"key": key, "base": base, "check": check, "value": value, "scores": scores, "raw": raw, "bytes": byte_ids,
            "unknown": min(scores[i] for _, i in keys) - PENALTY}


class Codec(dict):
    """Encoded ids (as bytes of C ints) of the words met so far, found on demand."""

    def __init__(self, vocabulary: dict):
        super().__init__()
        self.base, self.check, self.value = (vocabulary[n].tolist() for n in ("base", "check", "value"))
        self.scores, self.raw, self.bytes, self.unknown = (vocabulary[n] for n in ("scores", "raw", "bytes", "unknown"))
        self.words = WORDS.findall

    def best(self, word: bytes) -> tuple[list[int], float]:
        """Ids and score of the best piece sequence of one word."""
        n = len(word)
        score = [0.0] + [-math.inf] * n
        origin, last = [0] * (n + 1), [-1] * (n + 1)  # start of the last piece; its id, -1 for a fallback
        base, check, value, scores = self.base, self.check, self.value, self.scores
        at = 0
        while at < n:
            lead = word[at]
            here, state, end = score[at], 0, at
            after = at + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            single = False
            while end < n:
                cell = base[state] + word[end] + 1
                if check[cell] != state:
                    break
                state = cell
                end += 1
                piece = value[cell]
                if piece >= 0:
                    if end == after:
                        single = True
                    s = here + scores[piece]
                    if s > score[end]:
                        score[end] = s
                        origin[end] = at
                        last[end] = piece
            if not single and here + self.unknown > score[after]:
                score[after], origin[after], last[after] = here + self.unknown, at, -1
            at = after
        out: list[int] = []
        at = n
        while at:
            start, piece = origin[at], last[at]
            if piece >= 0:
                out.append(piece)
            else:
                out += [self.bytes[b] for b in reversed(word[start:at])]
            at = start
        out.reverse()
        return out, score[n]

    def __missing__(self, word: str) -> bytes:
        ids = array("i", self.best(word.encode())[0]).tobytes()
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        words = self.words(" " + text) if text else []
        return np.frombuffer(b"".join(map(self.__getitem__, words)), dtype=np.intc)

    def decode(self, ids) -> str:
        """Ids outside the vocabulary and control ids stand for nothing; bytes that are no
        valid UTF-8 become replacement characters."""
        raw = self.raw
        try:
            found = b"".join(map(raw.__getitem__, ids)) if min(ids, default=0) >= 0 else None
        except (IndexError, TypeError):
            found = None
        if found is None:
            found = b"".join([raw[i] for i in ids if i is not None and 0 <= i < len(raw)])
        text = found.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_codecs: dict[str, Codec] = {}


def worker_codec(shared) -> Codec:
    key = shared.value["key"]
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(shared.value)
    return _codecs[key]


def with_ids(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", ranked: bool = True) -> DataFrame:
    """``docs`` with ``ids`` (array of int), replacing a column of that name. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary, ranked))

    @F.arrow_udf("array<int>")
    def encoded(texts: pa.Array) -> pa.Array:
        codec = worker_codec(shared)
        found = [None if t is None else codec.encode(t) for t in (x.as_py() for x in texts)]
        sizes = [0 if x is None else len(x) for x in found]
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        values = np.concatenate([x for x in found if x is not None] or [np.empty(0, np.int32)]).astype(np.int32)
        null = pa.array([x is None for x in found], pa.bool_())
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()), mask=null)

    return docs.withColumn(ids, encoded(F.col(text).cast("string")))


def with_text(docs: DataFrame, vocabulary: str, ids: str = "ids", text: str = "text", ranked: bool = True) -> DataFrame:
    """``docs`` with ``text`` decoded from ``ids``, replacing a column of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary, ranked))

    @F.arrow_udf("string")
    def decoded(lists: pa.Array) -> pa.Array:
        codec = worker_codec(shared)
        if lists.values.null_count:
            return pa.array([None if x is None else codec.decode(x) for x in lists.to_pylist()], pa.string())
        values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_pylist()
        there = lists.is_valid().to_pylist()
        return pa.array([codec.decode(values[a:b].tolist()) if v else None for a, b, v in zip(offsets, offsets[1:], there)], pa.string())

    return docs.withColumn(text, decoded(ids))
