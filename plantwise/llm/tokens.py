"""Exact byte-level BPE token counts by prefix dynamic programming.

A vocabulary of merges is read once on the driver (its size is fixed by the file) and sent
to the tasks. Inside one pre-token, ``prefix_counts`` keeps for every byte prefix the last
token of that prefix's own encoding and its token count. A token that ends at position i is
the last token of prefix i exactly if it may stand after the last token of the prefix before
it, that is if no merge of the vocabulary would have crossed their boundary earlier. Each
prefix is thus solved from shorter prefixes and nothing is ever re-encoded: counts at any
prefix (``count_at``) and cuts under a token budget (``cut_at_budget``) are lookups.

Text is split into pre-tokens by the public pattern of the vocabulary; merges never cross
them. Strings of added special tokens inside a text count one token each, as the library's
default does. Null text counts as empty: 0 bytes, 0 tokens. A pre-token's cost is linear in
its length times the longest vocabulary entry, also for texts without white space.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # fixed value
CACHE_WORDS = 800_000  # distinct short pre-tokens a worker remembers before it starts afresh
CACHED_LENGTH = 64
FOREVER = 1 << 60


def byte_of_symbol() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, the other
    bytes, in order, for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_merges(path: str) -> tuple[tuple[tuple[bytes, bytes], ...], tuple[str, ...]]:
    """Merges as byte pairs in rank order, and the special strings, of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    back = byte_of_symbol()
    raw = lambda s: bytes(back[c] for c in s)
    pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
    special = tuple(t["content"] for t in spec.get("added_tokens", []))
    return tuple((raw(a), raw(b)) for a, b in pairs), special


class PrefixCounter(dict):
    """Token count of each pre-token met so far (a dict that fills itself)."""

    def __init__(self, merges, special):
        import regex

        super().__init__()
        self.findall = regex.compile(PATTERN).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.made_at = {bytes([b]): -1 for b in range(256)}
        self.parts: dict[bytes, tuple[bytes, bytes]] = {}
        self.merges_of: dict[bytes, dict[bytes, int]] = {}
        for r, (a, b) in enumerate(merges):
            self.merges_of.setdefault(a, {})[b] = r
            self.made_at.setdefault(a + b, r)
            self.parts.setdefault(a + b, (a, b))
        self.longest = max(map(len, self.made_at))
        # vocabulary entries by their last byte pair bound the lengths worth trying
        self.lengths: dict[bytes, list[int]] = {}
        for token in self.made_at:
            self.lengths.setdefault(token[-2:], set()).add(len(token))
        self.lengths = {k: sorted(v, reverse=True) for k, v in self.lengths.items()}
        self.edges: tuple[dict, dict] = ({}, {})
        self.follows: dict[bytes, dict[bytes, bool]] = {}

    def edge(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """Symbols that stand at one edge of a token while it is built (side 0: its start),
        each with the rank of the merge that swallows it."""
        out = self.edges[side].get(token)
        if out is None:
            out, at, swallowed = [], token, FOREVER
            while at is not None:
                out.append((at, swallowed))
                swallowed, at = self.made_at[at], self.parts[at][side] if at in self.parts else None
            self.edges[side][token] = out
        return out

    def may_follow(self, left: bytes, right: bytes) -> bool:
        """No merge joins an edge symbol of ``left`` with one of ``right`` while both still
        stand there; of equal ranks the leftmost pair merges first."""
        starts = self.edge(right, 0)
        for x, gone_x in self.edge(left, 1):
            row = self.merges_of.get(x)
            if row is not None:
                for y, gone_y in starts:
                    r = row.get(y)
                    if r is not None and r < gone_x and r <= gone_y:
                        return False
        return True

    def prefix_counts(self, word: bytes) -> list[int]:
        """Token counts of every byte prefix of one pre-token (index 0: empty)."""
        vocab, lengths, follows, may_follow = self.made_at, self.lengths, self.follows, self.may_follow
        last: list[bytes] = [b""]
        count = [0]
        for end in range(1, len(word) + 1):
            for length in lengths.get(word[end - 2:end] if end > 1 else b"", ()):
                if length <= end:
                    start = end - length
                    piece = word[start:end]
                    if piece not in vocab:
                        continue
                    if start:
                        known = follows.setdefault(last[start], {})
                        fits = known.get(piece)
                        if fits is None:
                            fits = known[piece] = may_follow(last[start], piece)
                        if not fits:
                            continue
                    last.append(piece)
                    count.append(count[start] + 1)
                    break
            else:
                piece = word[end - 1:end]
                last.append(piece)
                count.append(count[end - 1] + 1)
        return count

    def __missing__(self, word: str) -> int:
        n = self.prefix_counts(word.encode())[-1]
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHE_WORDS:
                self.clear()
                self.follows.clear()
            self[word] = n
        return n

    def segments(self, text: str):
        """Stretches of ordinary text, with a None where a special string stands."""
        if self.special is None:
            return [text]
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [text[at:m.start()], None]
            at = m.end()
        return [*out, text[at:]]

    def count(self, text: str) -> int:
        if self.special is not None and self.special.search(text):
            return sum(1 if s is None else self.count_plain(s) for s in self.segments(text))
        return self.count_plain(text)

    def count_plain(self, text: str) -> int:
        return sum(map(self.__getitem__, self.findall(text)))

    def index(self, text: str) -> list[tuple[int, int, str]]:
        """(start, tokens before it, piece) of every pre-token and special string."""
        out, at, n = [], 0, 0
        for segment in self.segments(text) if self.special is not None else [text]:
            if segment is None:
                piece = self.special.match(text, at).group()
                out.append((at, n, piece))
                at, n = at + len(piece), n + 1
                continue
            for piece in self.findall(segment):
                out.append((at, n, piece))
                at, n = at + len(piece), n + self[piece]
        return out

    def count_at(self, text: str, index, chars: int) -> int:
        """Exact token count of ``text[:chars]``: the count before the last pre-token but one
        is stored; the short rest is split anew, as a cut can change how white space splits."""
        import bisect

        if chars <= 0 or not index:
            return 0
        i = bisect.bisect_left(index, chars, key=lambda x: x[0]) - 1
        while i > 0 and (self.special is None or not self.special.fullmatch(index[i - 1][2])):
            i -= 1
            if not index[i][2].isspace():
                break
        start, before, _ = index[max(i, 0)]
        return before + self.count(text[start:chars])

    def cut_at_budget(self, text: str, budget: int) -> int:
        """Characters of the longest prefix whose own encoding has at most ``budget`` tokens."""
        index = self.index(text)
        if self.count_at(text, index, len(text)) <= budget:
            return len(text)
        # beyond the first pre-token that starts over budget + 1 no prefix can fit again: a
        # prefix keeps all tokens before its last two pre-tokens
        over = next((i for i, x in enumerate(index) if x[1] > budget + 1), len(index) - 1)
        for start, before, piece in reversed(index[:over + 1]):
            inside = self.prefix_counts(piece.encode())
            at = len(piece.encode())
            # special strings and contractions split otherwise when cut, as does a space that
            # its word no longer follows
            exact = piece[0] == "'" or self.special is not None and self.special.fullmatch(piece) is not None
            for chars in range(len(piece), 0, -1):
                alone = exact or chars == 1 and piece[0] == " "
                n = self.count_at(text, index, start + chars) if alone else before + inside[at]
                if n <= budget:
                    return start + chars
                at -= len(piece[chars - 1].encode())
        return 0


_counters: dict[str, PrefixCounter] = {}


def worker_counter(shared) -> PrefixCounter:
    """The counter of a broadcast vocabulary, built once in each worker."""
    key = shared.value["key"]
    if key not in _counters:
        _counters.clear()
        _counters[key] = PrefixCounter(shared.value["merges"], shared.value["special"])
    return _counters[key]


def share_vocabulary(spark, path: str):
    """Broadcast the merges of a tokenizer file; the size is bounded by the file's vocabulary."""
    import hashlib

    merges, special = load_merges(path)
    key = hashlib.sha1(repr((merges, special)).encode()).hexdigest()
    return spark.sparkContext.broadcast({"key": key, "merges": merges, "special": special})


def with_token_counts(docs: DataFrame, vocabulary: str, text: str = "text", budget: int | None = None) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` (long) and, given a budget, ``cut_chars`` (long):
    the characters of the longest prefix of at most ``budget`` tokens. Input columns of these
    names are replaced. One pass over the texts, no shuffle."""
    shared = share_vocabulary(docs.sparkSession, vocabulary)
    kind = "n_bytes bigint, n_tokens bigint, cut_chars bigint"

    @F.arrow_udf(kind)
    def counted(texts: pa.Array) -> pa.Array:
        count = worker_counter(shared)
        n_bytes, n_tokens, cuts = [], [], []
        for value in texts:
            t = value.as_py() or ""
            n_bytes.append(len(t.encode()))
            n = count.count(t)
            n_tokens.append(n)
            cuts.append(len(t) if budget is None or n <= budget else count.cut_at_budget(t, budget))
        return pa.StructArray.from_arrays(
            [pa.array(x, pa.int64()) for x in (n_bytes, n_tokens, cuts)], names=["n_bytes", "n_tokens", "cut_chars"])

    keep = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "cut_chars")]
    out = docs.select(*keep, counted(F.col(text).cast("string")).alias("__counts"))
    names = ["n_bytes", "n_tokens"] + ["cut_chars"] * (budget is not None)
    return out.select(*keep, *(F.col("__counts")[n].alias(n) for n in names))
