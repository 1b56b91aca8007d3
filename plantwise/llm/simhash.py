"""SimHash near-dedup: exact pairs of 64-bit fingerprints by vantage-point trees.

Fingerprints: A-Z lower-cased, words are runs without white space, a document's shingles of
``shingle`` words hashed by XXH64 (seed 42); a bit is set if over half the hashes have it.

Search: equal fingerprints form one class (counted map-side, so a third of all rows being
copies is one class). A vantage-point tree splits the classes: fingerprints within ``radius``
of the vantage point go to the inner branch, the others to the outer, and those of the inner
branch within ``max_bits`` of the boundary visit the outer one too. By the triangle
inequality a pair at distance <= max_bits on both sides of a boundary then meets in the outer
branch, so every pair meets in some leaf and branches beyond the bound are never compared.
The upper levels are fitted on the driver to a bounded sample (``SAMPLE`` fingerprints; it
decides balance only) and deal the classes to shards; each task goes on splitting its shard
by further vantage points down to leaves of ``LEAF``.

A leaf grows groups breadth first: a fingerprint that has joined a group is compared only
with those that have not, so a dense cluster costs little more than its size, and emits one
link per joined fingerprint instead of all pairs. Groups are merged across leaves and shards
as connected components. Memory per task is one shard; shards that the sample misjudges only
recurse deeper.

Defined cases: null or empty text has fingerprint zero and links like any other. Repeated
rows and ids keep one output row each. Null ids link, but never name a component unless all
ids of it are null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantwise.llm.common import fresh_folder, staged
from plantwise.llm.components import components

SEED = 42
SAMPLE = 8192
SHARD = 65536
LEAF = 4096
STEP = 32  # points of a leaf compared with the others at a time
CHUNK = 1 << 16  # shingles counted at a time


def fingerprint(text: str | None, shingle: int) -> int:
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, CHUNK):
        some = words[at:at + CHUNK + shingle - 1]
        grams = map(b" ".join, zip(*(some[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(some)]
        hashes = np.array([digest(g, SEED) for g in grams], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def with_fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """``docs`` and ``fingerprint``, the 64 bits as a signed long."""

    @F.arrow_udf("long")
    def fingerprints(texts: pa.Array) -> pa.Array:
        values = np.array([fingerprint(t.as_py(), shingle) for t in texts], dtype=np.uint64)
        return pa.array(values.view(np.int64), pa.int64())

    return docs.withColumn("fingerprint", fingerprints(F.col(text).cast("string")))


def distances(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage)


def best_radius(dist: np.ndarray, max_bits: int) -> int | None:
    """The split with the least pairs left to compare; None if no radius makes both branches
    smaller."""
    per = np.bincount(dist, minlength=66).astype(float)
    within = np.cumsum(per)
    n = within[-1]
    best, cost = None, 0.98 * n ** 2
    for radius in range(65):
        inner = within[radius]
        band = inner - (within[radius - max_bits] if radius >= max_bits else 0)
        outer = n - inner + band
        if 0 < inner < n and outer < n and (c := inner ** 2 + outer ** 2) < cost:
            best, cost = radius, c
    return best


class VantageTree:
    """Upper levels: inner nodes are (vantage, radius, inner, outer), leaves are shard numbers."""

    def __init__(self, sample: np.ndarray, leaf: float, max_bits: int):
        self.max_bits, self.shards = max_bits, 0
        self.root = self.grow(sample, leaf)

    def grow(self, points: np.ndarray, leaf: float):
        if len(points) > leaf:
            for vantage in points[:4]:
                dist = distances(points, vantage)
                radius = best_radius(dist, self.max_bits)
                if radius is not None:
                    inner = self.grow(points[dist <= radius], leaf)
                    return vantage, radius, inner, self.grow(points[dist + self.max_bits > radius], leaf)
        self.shards += 1
        return self.shards - 1

    def shards_of(self, points: np.ndarray) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in points]
        stack = [(self.root, np.arange(len(points)))]
        while stack:
            node, own = stack.pop()
            if isinstance(node, int):
                for i in own.tolist():
                    out[i].append(node)
            elif len(own):
                vantage, radius, inner, outer = node
                dist = distances(points[own], vantage)
                stack.append((inner, own[dist <= radius]))
                stack.append((outer, own[dist + self.max_bits > radius]))
        return out


def leaf_links(points: np.ndarray, names: np.ndarray, max_bits: int, out: list) -> None:
    """Links (name, name) that connect exactly the points that chains of near pairs connect."""
    while len(points) > 1:
        block = points[:STEP]
        near = np.bitwise_count(block[:, None] ^ points[None, :]) <= max_bits
        np.fill_diagonal(near, False)
        linked = np.flatnonzero(near.any(axis=1))
        if not len(linked):
            points, names = points[STEP:], names[STEP:]
            continue
        # grow the group of the first linked point; those before it have no neighbour left
        seed = linked[0]
        front, front_names = points[seed:seed + 1], names[seed:seed + 1]
        points, names = points[seed + 1:], names[seed + 1:]
        while len(front) and len(points):
            joins = np.bitwise_count(points ^ front[0]) <= max_bits
            name, front, front_names = front_names[0], front[1:], front_names[1:]
            if joins.any():
                out.append((np.full(int(joins.sum()), name), names[joins]))
                front, front_names = np.concatenate([front, points[joins]]), np.concatenate([front_names, names[joins]])
                points, names = points[~joins], names[~joins]


def shard_links(points: np.ndarray, names: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Go on splitting a shard by vantage points; links of all its leaves."""
    found: list = []
    stack = [np.arange(len(points))]
    while stack:
        own = stack.pop()
        radius = None
        if len(own) > LEAF:
            for vantage in points[own[[0, len(own) // 2, -1]]]:
                dist = distances(points[own], vantage)
                radius = best_radius(dist, max_bits)
                if radius is not None:
                    stack += [own[dist <= radius], own[dist + max_bits > radius]]
                    break
        if radius is None:
            leaf_links(points[own], names[own], max_bits, found)
    if not found:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    a, b = (np.concatenate(x) for x in zip(*found))
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def near_links(classes: DataFrame, max_bits: int) -> DataFrame:
    """Links (a, b) of ``classes`` (fingerprint, name) that hold its components together."""
    spark = classes.sparkSession
    n = classes.count()
    sample = classes.orderBy(F.xxhash64("fingerprint"), "fingerprint").limit(SAMPLE).select("fingerprint").collect()  # bounded
    points = np.array([r[0] for r in sample], dtype=np.int64).view(np.uint64)
    tree = VantageTree(points, max(8.0, SHARD * len(points) / max(n, 1)), max_bits)
    shared = spark.sparkContext.broadcast(tree)

    @F.arrow_udf("array<int>")
    def shards_of(values: pa.Array) -> pa.Array:
        return pa.array(shared.value.shards_of(values.to_numpy(zero_copy_only=False).view(np.uint64)), pa.list_(pa.int32()))

    def linked(key, shard):
        points = shard["fingerprint"].combine_chunks().to_numpy().view(np.uint64)
        a, b = shard_links(points, shard["name"].combine_chunks().to_numpy(), max_bits)
        return pa.table({"a": a, "b": b})

    # a partition for each shard: their rows are few, but a task's work is not in its bytes
    dealt = classes.withColumn("shard", F.explode(shards_of("fingerprint"))).repartition(tree.shards, "shard")
    return dealt.groupBy("shard").applyInArrow(linked, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits)``, component_id``: the smallest id that chains of
    fingerprints at ``max_bits`` or fewer differing bits reach, itself included."""
    spark = docs.sparkSession
    prints = staged(with_fingerprints(docs.select(F.col(doc_id), F.col(text)), text, shingle).select(doc_id, "fingerprint"),
                    fresh_folder(spark, "simhash-prints"))
    classes = staged(prints.groupBy("fingerprint").agg(F.min(F.col(doc_id).cast("long")).alias("least")),
                     fresh_folder(spark, "simhash-classes"))
    # nodes are fingerprints, so classes whose ids are all null keep theirs
    joined = components(near_links(classes.withColumn("name", F.col("fingerprint")), max_bits))
    rooted = classes.join(joined, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "least", F.coalesce("component", "fingerprint").alias("component"))
    smallest = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
    named = staged(rooted.join(smallest, "component").select("fingerprint", "component_id"), fresh_folder(spark, "simhash-components"))
    return prints.join(named, "fingerprint").select(
        doc_id, F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
