"""MinHash near-dedup by an inverted join on signature coordinates, confirmed on full shingle sets.

A document's set holds the 64-bit hashes of its distinct word shingles (A-Z lower-cased); its
signature is the least of them under ``COORDINATES`` hash functions, each coordinate with its value
one 64-bit token. Documents of one set are one class (combined map-side), so a third of all rows
being copies is one class.

Search: classes are posted under their tokens. Classes above the similarity share at least T tokens
but for a chance of ``MISS`` (the binomial tail fixes T), so tokens that only one class has can't
count, and of a class's m shared tokens the T - 1 most frequent are skipped: two classes with T
tokens in common meet in a list of the m - T + 1 rarest (prefix merging over one global order).
What skipped lists add is counted on the signatures of pairs that meet, and pairs of T collisions
or more are confirmed on their full sets.

Skew: lists are never expanded into all pairs first. Each list's most central class (whose tokens are
the most frequent) meets the others; what that links gets one label, and only lists that still hold
several labels go on, with pairs of different labels. Lists up to ``SMALL`` classes join with
themselves; longer ones are dealt to block pairs, the classes that share the pivot's label
against the others, and a task compares two blocks at a time and returns only links that join labels. No
list is cut: a list of any length is only more block pairs.

Sets are made twice, for the signature and again for classes with T shared tokens, rather than kept
for all texts. Components contract as in ``components``.

Defined cases: null or empty texts and texts without words have no shingles, link with nothing and
stand alone. Texts with fewer words than a shingle are one shingle. Repeated rows and ids keep one
output row each, and rows of one id are separate unless their sets link. Null ids link, but never
name a component unless all ids of it are null. Other columns take no part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantwise.llm.common import fresh_folder, staged
from plantwise.llm.components import components

COORDINATES = 32
MISS = 1e-6
SMALL = 32  # classes of a list that is joined with itself
BLOCK = 1024  # classes of a block
BLOCK_SHINGLES = 1 << 20  # shingles of a block
CHUNK = 1 << 16  # shingles hashed by all coordinates at a time

_draw = np.random.default_rng(12)
FACTORS = _draw.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
WORD_FACTORS = _draw.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_matches(similarity: float, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """T: the most collisions that pairs at ``similarity`` fall below with chance ``miss`` at most."""
    tail, t = 0.0, 0
    while t < coordinates:
        tail += math.comb(coordinates, t) * similarity ** t * (1 - similarity) ** (coordinates - t)
        if tail > miss:
            break
        t += 1
    return max(t, 1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return np.empty(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter(map(digest, words), dtype=np.uint64, count=len(words))
    size = min(shingle, len(words))
    total = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        total += h[i:len(h) - size + 1 + i] * WORD_FACTORS[i % 64]
    return np.unique(mixed(total))


def signature(hashes: np.ndarray) -> np.ndarray:
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), CHUNK):
        np.minimum(least, (hashes[None, at:at + CHUNK] * FACTORS[:, None]).min(axis=1), out=least)
    return mixed(least ^ FACTORS)  # the coordinate is part of the token


def longs(arrays: list[np.ndarray | None]) -> pa.Array:
    """Rows of signed longs (Spark has no others)."""
    sizes = np.array([0 if a is None else len(a) for a in arrays])
    flat = np.concatenate([a for a in arrays if a is not None] or [np.empty(0, dtype=np.uint64)])
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(flat.view(np.int64)))


def with_signatures(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    kind = "struct<n: bigint, key: binary, sig: array<bigint>>"

    @F.arrow_udf(kind)
    def signed(texts: pa.Array) -> pa.Array:
        sets = [shingle_set(t.as_py(), shingle) for t in texts]
        keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        return pa.StructArray.from_arrays(
            [pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), longs([signature(s) if len(s) else None for s in sets])],
            names=["n", "key", "sig"])

    return docs.withColumn("signed", signed(F.col(text)))


def like_enough(n: Column, m: Column, percent: int) -> Column:
    """Sets whose sizes differ more can't link."""
    return (100 * F.least(n, m) >= percent * F.greatest(n, m))


# ---------------------------------------------------------------- postings
def postings(classes: DataFrame, t: int) -> DataFrame:
    """``members``: node, n, sig, ``posts`` (the tokens it is posted under) and ``central`` of the classes
    with T tokens or more that others have too."""
    tokens = classes.select("node", F.explode("sig").alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    own = tokens.join(shared, "token").groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("f", "token"))).alias("own"), F.sum("f").alias("central")).where(F.size("own") >= t)
    posts = F.transform(F.slice("own", F.lit(1), F.size("own") - (t - 1)), lambda x: x["token"])
    return classes.join(own, "node").select("node", "n", "least", "id", "th", "sig", "central", posts.alias("posts"))


def sets_of(docs: DataFrame, members: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """node, hashes: the full sets of the members, from one text each."""

    @F.arrow_udf("array<bigint>")
    def hashed(texts: pa.Array) -> pa.Array:
        return longs([shingle_set(t.as_py(), shingle) for t in texts])

    wanted = members.select("node", "id", "th")
    found = docs.select(F.col(doc_id).cast("long").alias("own_id"), F.col(text).cast("string").alias("own_text")).withColumn("own_th", F.xxhash64("own_text"))
    joined = found.join(wanted, (F.col("own_th") == F.col("th")) & F.col("own_id").eqNullSafe(F.col("id")))
    return joined.dropDuplicates(["node"]).select("node", hashed("own_text").alias("hashes"))


# ---------------------------------------------------------------- pairs
def confirmed(pairs: DataFrame, members: DataFrame, sets: DataFrame, t: int, percent: int) -> DataFrame:
    """Of distinct ``pairs`` (a, b), those with T collisions whose full sets link."""
    sig = members.select("node", "sig")
    side = lambda df, value, name: df.select(F.col("node").alias(name), F.col(value).alias(f"{value}_{name}"))
    met = pairs.join(side(sig, "sig", "a"), "a").join(side(sig, "sig", "b"), "b").where(F.size(F.array_intersect("sig_a", "sig_b")) >= t)
    full = met.select("a", "b").join(side(sets, "hashes", "a"), "a").join(side(sets, "hashes", "b"), "b")
    same = F.size(F.array_intersect("hashes_a", "hashes_b"))
    counted = full.select("a", "b", same.alias("same"), (F.size("hashes_a") + F.size("hashes_b")).alias("both"))
    return counted.where(100 * F.col("same") >= percent * (F.col("both") - F.col("same"))).select("a", "b")


def pivot_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Each list's most central class with every other one of fitting size."""
    pivots = lists.groupBy("token").agg(F.max(F.struct("central", "n", "node")).alias("p"), F.count(F.lit(1)).alias("f")).where("f > 1")
    met = lists.join(pivots.select("token", "p"), "token").where((F.col("node") != F.col("p.node")) & like_enough(F.col("n"), F.col("p.n"), percent))
    return met.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()


def small_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """All pairs of different labels in lists of at most SMALL classes."""
    a = lists.select("token", F.col("node").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"))
    b = lists.select("token", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"))
    met = a.join(b, "token").where((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & like_enough(F.col("na"), F.col("nb"), percent))
    return met.select("a", "b").distinct()


class Block:
    """Classes of one block of a list: sizes, labels, signatures, which tokens are posted, and sets."""

    def __init__(self, rows: pa.Table):
        column = lambda name: rows.column(name).combine_chunks()
        self.node, self.n, self.label = (column(c).to_numpy() for c in ("node", "n", "label"))
        self.sig = column("sig").flatten().to_numpy().reshape(len(rows), COORDINATES)
        posts, hashes = column("posts"), column("hashes")
        cut = lambda c: np.split(c.flatten().to_numpy(), np.cumsum(c.value_lengths().to_numpy())[:-1])
        self.posted = np.stack([np.isin(s, p) for s, p in zip(self.sig, cut(posts))])
        self.sets = cut(hashes)


def block_links(token: int, x: Block, y: Block | None, t: int, percent: int) -> list[tuple[int, int]]:
    """Links that join labels between two blocks (or inside one) of a token's list. A pair is taken up in
    the list of its least common posted token only."""
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while (up := root.get(v, v)) != v:
            root[v] = root.get(up, up)
            v = root[v]
        return v

    out, other = [], y or x
    most = np.iinfo(np.int64).max
    for i in range(len(x.node)):
        start = 0 if y else i + 1
        n, m = int(x.n[i]), other.n[start:]
        near = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (other.label[start:] != x.label[i])
        at = np.flatnonzero(near) + start
        if not len(at):
            continue
        equal = other.sig[at] == x.sig[i]
        first = np.where(equal & other.posted[at] & x.posted[i], other.sig[at], most).min(axis=1) == token
        for j in at[(equal.sum(axis=1) >= t) & first].tolist():
            a, b = find(int(x.label[i])), find(int(other.label[j]))
            if a == b:
                continue
            same = np.isin(other.sets[j], x.sets[i], assume_unique=True).sum()
            if 100 * same >= percent * (n + int(other.n[j]) - same):
                root[max(a, b)] = min(a, b)
                out.append((int(x.node[i]), int(other.node[j])))
    return out


def block_pairs(lists: DataFrame, members: DataFrame, sets: DataFrame, t: int, percent: int) -> DataFrame:
    """Links across labels of long lists (token, node, n, label, major: has the pivot's label, and the
    numbers of blocks of both kinds)."""
    full = lists.join(members.select("node", "sig", "posts"), "node").join(sets, "node")
    salt = lambda blocks: F.pmod(F.xxhash64("node", "token"), F.col(blocks))
    # blocks 0 .. rest - 1 hold the others, those after them the classes of the pivot's label
    block = F.when(F.col("major"), F.col("rest") + salt("majors")).otherwise(salt("rest"))
    own = full.withColumn("block", block)
    partners = F.sequence(F.lit(0).cast("long"), F.when(F.col("major"), F.col("rest")).otherwise(F.col("rest") + F.col("majors")) - 1)
    dealt = own.withColumn("partner", F.explode(partners)).select(
        "token", F.least("block", "partner").alias("i"), F.greatest("block", "partner").alias("j"), (F.col("block") > F.col("partner")).alias("second"),
        "node", "n", "label", "sig", "posts", "hashes")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(key, parts) -> pa.RecordBatch:
            rows = pa.Table.from_batches(parts)
            second = rows.column("second").to_numpy()
            sides = [rows.take(np.flatnonzero(second == s)) for s in (False, True)]
            links = []
            if key[1] == key[2]:
                links = block_links(key[0], Block(sides[0]), None, t, percent)
            elif len(sides[0]) and len(sides[1]):
                links = block_links(key[0], Block(sides[0]), Block(sides[1]), t, percent)
            return pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

        key, parts = None, []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("token", "i", "j")], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if hi > lo:
                    own = tuple(keys[lo].tolist())
                    if own != key and parts:
                        yield finish(key, parts)
                        parts = []
                    key = own
                    parts.append(batch.slice(lo, hi - lo))
        if parts:
            yield finish(key, parts)

    # one block pair at a time stands in memory; a task goes through its sorted block pairs
    return dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(compared, "a long, b long")


# ---------------------------------------------------------------- operator
def links_of(docs: DataFrame, classes: DataFrame, doc_id: str, text: str, shingle: int, percent: int) -> DataFrame:
    """node, label: classes that confirmed links join, under the smallest node."""
    spark, t = docs.sparkSession, least_matches(percent / 100)
    keep = lambda df, name: staged(df, fresh_folder(spark, f"minhash-{name}"))
    members = keep(postings(classes, t), "members")
    sets = keep(sets_of(docs, members, doc_id, text, shingle), "sets")
    lists = keep(members.select("node", "n", "central", F.explode("posts").alias("token")), "lists")
    first = keep(components(keep(confirmed(pivot_pairs(lists, percent), members, sets, t, percent), "links")), "labels")
    label = first.select("node", F.col("component").alias("label"))
    lists = keep(lists.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    top = F.max(F.struct("central", "n", "node", "label"))["label"]
    counts = lists.groupBy("token").agg(F.count(F.lit(1)).alias("f"), F.min("label").alias("lo"), F.max("label").alias("hi"), top.alias("pivot")).where("lo <> hi")
    several = lists.join(counts.select("token", "f", "pivot"), "token").withColumn("major", F.col("label") == F.col("pivot"))
    small = confirmed(small_pairs(several.where(F.col("f") <= SMALL), percent), members, sets, t, percent)
    long = several.where(F.col("f") > SMALL)
    number = lambda of: F.greatest(
        F.lit(1), F.ceil(F.sum(F.when(of, 1).otherwise(0)) / BLOCK), F.ceil(F.sum(F.when(of, F.col("n")).otherwise(0)) / BLOCK_SHINGLES)).cast("long")
    sizes = long.groupBy("token").agg(number(F.col("major")).alias("majors"), number(~F.col("major")).alias("rest"))
    blocks = block_pairs(long.join(sizes, "token"), members, sets, t, percent)
    rest = keep(small.union(blocks), "links")
    on = lambda name: label.select(F.col("node").alias(name), F.col("label").alias(f"l{name}"))
    between = rest.join(on("a"), "a", "left").join(on("b"), "b", "left").select(
        F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    second = keep(components(between), "components").select(F.col("node").alias("label"), F.col("component").alias("top"))
    nodes = first.select("node", F.col("component").alias("label")).union(
        second.join(first, second["label"] == first["node"], "left_anti").select(F.col("label").alias("node"), "label"))
    return nodes.join(second, "label", "left").select("node", F.coalesce("top", "label").alias("component"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: the smallest id that chains of links reach (documents whose
    sets' intersection is at least ``percent`` hundredths of their union), itself included, and whether
    that is the row's own."""
    spark = docs.sparkSession
    keep = lambda df, name: staged(df, fresh_folder(spark, f"minhash-{name}"))
    own = docs.select(F.col(doc_id), F.col(text).cast("string").alias("__text"))
    prints = keep(with_signatures(own, "__text", shingle).select(doc_id, F.xxhash64("__text").alias("th"), "signed.*"), "prints")
    number = F.col(doc_id).cast("long")
    classes = prints.where("n > 0").groupBy("key").agg(
        F.min(number).alias("least"), F.min(F.struct("th", number.alias("id"))).alias("from"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = keep(classes.select("key", "least", "from.id", "from.th", "n", "sig", F.monotonically_increasing_id().alias("node")), "classes")
    joined = links_of(docs, classes, doc_id, text, shingle, percent)
    rooted = keep(classes.select("key", "least", "node").join(joined, "node", "left").select(
        "key", "least", F.coalesce("component", "node").alias("component")), "rooted")
    smallest = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
    named = keep(rooted.join(smallest, "component").select("key", "component_id"), "named")
    out = prints.join(named, "key", "left").select(
        doc_id, F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(number).alias("component_id"))
    return out.withColumn("kept", number.eqNullSafe(F.col("component_id")))
