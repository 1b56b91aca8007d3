"""Exact top-k inner products by best-first search in paged M-trees.

Components become integers floor(64 x). An M-tree node keeps a routing vector c, a covering
radius r and the distance to its parent's routing vector. For a query q and any v under the
node, q.v <= q.c + |q| r; and before q.c is computed, q.c <= q.p + |q| d(c, p) with the stored
parent distance. Both bounds are triangle inequalities of the Euclidean metric carried to
the inner product, so best-first search with them is exact.

Layout: vectors are dealt to cells by their nearest pivot, the pivots being a bounded sample
(``PIVOTS`` of ``SAMPLE`` rows; it affects balance and the first threshold, never the result),
and a cell with more than ``SHARD`` vectors is split by id hash. One task builds one shard's
tree and writes it as one row of the index. Queries get a first threshold from the sample,
skip cells whose bound is below it, and meet the remaining shards in parts of about
``QUERY_PART`` queries, so that no group grows with the data. In a shard, queries are dealt to pages by
a tree of their own, and a page of queries is searched as one: a node is dropped for all of them or
kept for those whose bounds reach it, and what is left of two pages is one matrix product.

Rows of one vector are interchangeable but for their id: at most k + 1 smallest ids of a
vector can ever be returned, so the index keeps those (exactly), and equal queries are
searched once. A vector with a third of all rows is thereby neither a hot shard nor searched
a million times. Without pruning the work is queries x rows, as the task demands.

Defined cases: a null id, a null vector, or one with null or non-finite components takes no
part. Repeated (id, vector) rows count once, and rows of one id never find each other.
Shorter vectors are filled with zeros. Products beyond 64 bits saturate.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from plantwise.llm.common import fresh_folder, staged

SAMPLE = 4096
PIVOTS = 1024
SHARD = 8192
QUERY_PART = 4096
LEAST_PART = 256
PAGE = 256
FANOUT = 32
SLACK = 1e-9  # relative, on bounds computed in doubles
BIG = np.iinfo(np.int64).max


def quantised(vector: Column) -> Column:
    """floor(64 x) of every component; null for a vector that takes no part."""
    x = vector.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.when(x.isNotNull() & ~bad, F.transform(x, lambda v: F.floor(v * 64).cast("bigint")))


def dots(rows: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    """Integer products; ``exact``: doubles hold them exactly."""
    if exact:
        return rows.astype(np.float64) @ q.astype(np.float64)
    out = rows.astype(object) @ q.astype(object)
    return np.array([max(-BIG, min(BIG, v)) for v in out.ravel()], dtype=object).reshape(out.shape)


class MTree:
    """Arrays of one tree. Node i: routing row ``centre``, ``radius``, distance to its parent's
    routing row, children [first, last) (nodes, or rows of a page), and whether it is a page.
    ``row_dist`` is each row's distance to its page's routing row."""

    FIELDS = ("rows", "ids", "centre", "radius", "parent_dist", "first", "last", "page", "row_dist")

    def __init__(self, **arrays):
        for name in self.FIELDS:
            setattr(self, name, arrays[name])

    @classmethod
    def build(cls, ids: np.ndarray, rows: np.ndarray) -> MTree:
        order = np.argsort(ids, kind="stable")
        ids, rows = ids[order], rows[order]
        x = rows.astype(np.float64)
        members = [np.arange(len(ids))]
        centre, radius, parent_dist, first, last, page = [0], [0.0], [0.0], [0], [0], [False]
        placed: list[np.ndarray] = []
        row_dist = np.zeros(len(ids))
        at, n_placed = 0, 0
        while at < len(members):  # breadth first: children of a node are numbered together
            own = members[at]
            c = x[centre[at]]
            dist = np.sqrt(((x[own] - c) ** 2).sum(axis=1))
            radius[at] = float(dist.max()) if len(own) else 0.0
            if len(own) <= PAGE:
                first[at], last[at], page[at] = n_placed, n_placed + len(own), True
                row_dist[own] = dist
                placed.append(own)
                n_placed += len(own)
            else:
                groups = cls.split(x, own)
                first[at] = len(members)
                for routing, group in groups:
                    members.append(group)
                    centre.append(routing)
                    parent_dist.append(float(np.sqrt(((x[routing] - c) ** 2).sum())))
                    radius.append(0.0), first.append(0), last.append(0), page.append(False)
                last[at] = len(members)
            at += 1
        by_page = np.concatenate(placed) if placed else np.arange(0)
        back = np.empty(len(ids), dtype=np.int64)
        back[by_page] = np.arange(len(ids))
        return cls(rows=rows[by_page], ids=ids[by_page], centre=back[np.array(centre)] if len(ids) else np.zeros(1, int),
                   radius=np.array(radius), parent_dist=np.array(parent_dist), first=np.array(first), last=np.array(last),
                   page=np.array(page), row_dist=row_dist[by_page])

    @staticmethod
    def split(x: np.ndarray, own: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Nearest of evenly spaced members as routing rows; equal slices where that fails."""
        n = min(FANOUT, -(-len(own) // (PAGE // 2)))
        routing = own[np.linspace(0, len(own) - 1, n).astype(int)]
        r = x[routing]
        nearest = np.argmin((r ** 2).sum(axis=1)[None, :] - 2 * x[own] @ r.T, axis=1)
        groups = [(int(routing[i]), own[nearest == i]) for i in range(n)]
        groups = [g for g in groups if len(g[1])]
        if max(len(g) for _, g in groups) > 0.9 * len(own):
            groups = [(int(g[0]), g) for g in np.array_split(own, n)]
        return groups

    def save(self, kind: str) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{n: getattr(self, n).astype(kind) if n == "rows" else getattr(self, n) for n in self.FIELDS})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> MTree:
        with np.load(io.BytesIO(data)) as z:
            return cls(**{n: z[n] for n in cls.FIELDS})

    def search(self, q: np.ndarray, k: int, threshold: float, exact: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows (ties to smaller ids) that reach ``threshold``."""
        length = float(np.sqrt((q.astype(np.float64) ** 2).sum())) * (1 + SLACK)
        ids, scores = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.float64 if exact else object)
        if not len(self.ids):
            return ids, scores
        least = threshold
        own = float(dots(self.rows[self.centre[:1]], q, exact)[0])
        heap = [(-(own + length * self.radius[0]), 0, own)]
        while heap:
            bound, node, own = heapq.heappop(heap)
            if self.slacked(-bound) < least:
                break
            lo, hi = self.first[node], self.last[node]
            if self.page[node]:
                near = lo + np.flatnonzero(self.slacked(own + length * self.row_dist[lo:hi]) >= least)
                found = dots(self.rows[near], q, exact)
                good = found >= least
                ids, scores = np.concatenate([ids, self.ids[near[good]]]), np.concatenate([scores, found[good]])
                if len(ids) >= k:
                    best = np.lexsort((ids, -scores))[:k]
                    ids, scores = ids[best], scores[best]
                    least = max(least, scores[-1])
            else:
                quick = own + length * (self.parent_dist[lo:hi] + self.radius[lo:hi])
                near = lo + np.flatnonzero(self.slacked(quick) >= least)
                inner = dots(self.rows[self.centre[near]], q, exact).astype(np.float64)
                for child, v, b in zip(near.tolist(), inner.tolist(), (inner + length * self.radius[near]).tolist()):
                    if self.slacked(b) >= least:
                        heapq.heappush(heap, (-b, child, v))
        return ids, scores

    def search_all(self, qs: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``search`` for many queries whose products doubles hold exactly: (query, id, score) of the k best
        of each. A tree over the queries deals them to pages of near ones; a page of queries goes
        through the nodes together, best first, each node only with the queries whose bounds reach
        it, and the products left of a query page and a row page are one matrix block."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.computed = 0
        if len(self.ids) and len(qs):
            pages = MTree.build(np.arange(len(qs)), qs)
            for lo, hi in zip(pages.first[pages.page], pages.last[pages.page]):
                own = pages.ids[lo:hi]
                q, ids, scores = self.search_page(pages.rows[lo:hi].astype(np.float64), k, least[own].astype(np.float64))
                out.append((own[q], ids, scores))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, int), np.empty(0, int), np.empty(0))

    def search_page(self, qs: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        length = np.sqrt((qs ** 2).sum(axis=1)) * (1 + SLACK)
        found = [(np.empty(0, int), np.empty(0, np.int64), np.empty(0))]
        pending, turn = 0, 1
        own = qs @ self.rows[self.centre[0]]
        heap = [(-float((own + length * self.radius[0]).max()), 0, 0, np.arange(len(qs)), own)]
        while heap:
            _, _, node, alive, own = heapq.heappop(heap)
            keep = self.slacked(own + length[alive] * self.radius[node]) >= least[alive]
            alive, own = alive[keep], own[keep]
            if not len(alive):
                continue
            lo, hi = self.first[node], self.last[node]
            reach, floor = length[alive][:, None], least[alive][:, None]
            apart = self.row_dist[lo:hi] if self.page[node] else self.parent_dist[lo:hi] + self.radius[lo:hi]
            near = self.slacked(own[:, None] + reach * apart) >= floor
            some = np.flatnonzero(near.any(axis=0))
            targets = lo + some if self.page[node] else self.centre[lo + some]
            products = qs[alive] @ self.rows[targets].T
            self.computed += products.size
            if self.page[node]:
                q, r = np.nonzero(products >= floor)
                found.append((alive[q], self.ids[lo + some[r]], products[q, r]))
                pending += len(q)
                if pending > 8 * k * len(qs):
                    found, pending = [self.best(found, k, least)], 0
            else:
                bounds = products + reach * self.radius[lo + some]
                open_ = near[:, some] & (self.slacked(bounds) >= floor)
                for j in np.flatnonzero(open_.any(axis=0)).tolist():
                    on = open_[:, j]
                    heapq.heappush(heap, (-float(bounds[on, j].max()), turn, int(lo + some[j]), alive[on], products[on, j]))
                    turn += 1
        return self.best(found, k, least)

    @staticmethod
    def best(found: list, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best (ties to smaller ids) of each query; raises ``least`` to the k-th."""
        q, ids, scores = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == k - 1
        least[q[last]] = np.maximum(least[q[last]], scores[last])
        return q[place < k], ids[place < k], scores[place < k]

    @staticmethod
    def slacked(bound):
        return bound + abs(bound) * SLACK


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Integer lists as rows, filled with zeros to ``width``."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width), dtype=np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for every row whose id is divisible by ``every``, the k
    rows of other ids with the largest integer inner products, ties to the smaller id."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), quantised(F.col(vector)).alias("vec")).where(
        "id IS NOT NULL AND vec IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    held = staged(rows.distinct().withColumn("place", place).where(F.col("place") <= k + 1).drop("place"),
                  fresh_folder(spark, "mtree-rows"))
    size = held.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("width"), F.max(F.array_max(F.transform(
        "vec", lambda v: F.abs(v)))).alias("most")).first()
    n, width, most = size["n"], size["width"] or 0, size["most"] or 0
    result = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not n:
        return spark.createDataFrame([], result)
    kind = next(t for t, top in (("int8", 127), ("int16", 32767), ("int32", 2 ** 31 - 1), ("int64", BIG)) if most <= top)
    exact = most * most * max(width, 1) < 2 ** 53

    sample = held.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()  # bounded by SAMPLE rows
    known = np.array([list(r["vec"]) + [0] * (width - len(r["vec"])) for r in sample], dtype=np.int64).reshape(len(sample), width)
    pivots = known[: max(1, min(PIVOTS, -(-n // SHARD), len(known)))].astype(np.float64)
    shared = spark.sparkContext.broadcast((known, pivots))

    @F.arrow_udf("cell int, dist double")
    def nearest(vecs: pa.Array) -> pa.Array:
        x = matrix(vecs, width).astype(np.float64)
        c = shared.value[1]
        cell = np.argmin((c ** 2).sum(axis=1)[None, :] - 2 * x @ c.T, axis=1)
        dist = np.sqrt(((x - c[cell]) ** 2).sum(axis=1))
        return pa.StructArray.from_arrays([pa.array(cell, pa.int32()), pa.array(dist)], names=["cell", "dist"])

    celled = staged(held.withColumn("in", nearest("vec")).select("id", "vec", "in.*"), fresh_folder(spark, "mtree-cells"))
    cells = celled.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("radius")).collect()  # at most PIVOTS rows
    splits = {r["cell"]: -(-r["n"] // SHARD) for r in cells}
    numbered, first_shard = 0, {}
    for c in sorted(splits):
        first_shard[c] = numbered
        numbered += splits[c]
    centres = sorted(splits)
    radii = {r["cell"]: r["radius"] for r in cells}
    plan = spark.sparkContext.broadcast((np.array(centres), np.array([radii[c] for c in centres]),
                                         [list(range(first_shard[c], first_shard[c] + splits[c])) for c in centres]))

    @F.arrow_udf("int")
    def shard_of(cell: pa.Array, mix: pa.Array) -> pa.Array:
        where = dict(zip(plan.value[0].tolist(), plan.value[2]))
        return pa.array([where[c][m % len(where[c])] for c, m in zip(cell.to_pylist(), mix.to_pylist())], pa.int32())

    def built(key, group):
        tree = MTree.build(group["id"].combine_chunks().to_numpy(), matrix(group["vec"], width))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "tree": pa.array([tree.save(kind)], pa.binary())})

    trees = staged(
        celled.withColumn("shard", shard_of("cell", F.pmod(F.xxhash64("id"), F.lit(1 << 30))))
        .select("shard", "id", "vec").groupBy("shard").applyInArrow(built, "shard int, tree binary"),
        fresh_folder(spark, "mtree-index"))

    asked = rows.where(F.col("id") % every == 0).distinct()
    classes = staged(asked.groupBy("vec").agg(F.min("id").alias("class")), fresh_folder(spark, "mtree-queries"))
    # few shards are searched by smaller parts of the queries, so that all executors have work
    asked_classes, tasks = classes.count(), 2 * spark.sparkContext.defaultParallelism
    wanted = max(-(-asked_classes // QUERY_PART), -(-tasks // max(numbered, 1)))
    parts = max(1, min(wanted, -(-asked_classes // LEAST_PART)))

    @F.arrow_udf("shards array<int>, least double")
    def route(vecs: pa.Array) -> pa.Array:
        known, pivots = shared.value
        centres, radii, shards = plan.value
        out, leasts = [], []
        for q in matrix(vecs, width):
            scores = dots(known, q, exact).astype(np.float64)
            least = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1] if len(scores) > k else -np.inf
            least -= abs(least) * SLACK if not exact else 0
            length = float(np.sqrt((q.astype(np.float64) ** 2).sum())) * (1 + SLACK)
            bound = pivots[centres] @ q.astype(np.float64) + length * radii
            near = np.flatnonzero(MTree.slacked(bound) >= least)
            out.append([s for i in near for s in shards[i]])
            leasts.append(float(least))
        return pa.StructArray.from_arrays([pa.array(out, pa.list_(pa.int32())), pa.array(leasts, pa.float64())], names=["shards", "least"])

    routed = classes.withColumn("to", route("vec")).select(
        F.explode("to.shards").alias("shard"), F.pmod(F.xxhash64("class"), F.lit(parts)).cast("int").alias("part"),
        "class", "vec", F.col("to.least").alias("least"))
    spread = trees.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def searched(left, right):
        out = ([], [], [])
        if left.num_rows and right.num_rows:
            tree = MTree.load(left["tree"][0].as_py())
            if exact:
                tree.rows = tree.rows.astype(np.float64)
                names = right["class"].combine_chunks().to_numpy()
                q, ids, scores = tree.search_all(matrix(right["vec"], width), k + 1, right["least"].combine_chunks().to_numpy())
                return pa.table({"class": names[q], "vec_id": ids.astype(np.int64), "score": scores.astype(np.int64)})
            for c, q, least in zip(right["class"].to_pylist(), matrix(right["vec"], width), right["least"].to_pylist()):
                ids, scores = tree.search(q, k + 1, least, exact)
                for column, values in zip(out, ([c] * len(ids), ids.tolist(), scores.tolist())):
                    column.extend(values)
        return pa.table({n: pa.array([int(v) for v in x], pa.int64()) for n, x in zip(("class", "vec_id", "score"), out)})

    found = spread.groupBy("shard", "part").cogroup(routed.groupBy("shard", "part")).applyInArrow(
        searched, "class bigint, vec_id bigint, score bigint")
    order = [F.desc("score"), F.asc("vec_id")]
    best = found.withColumn("place", F.row_number().over(Window.partitionBy("class").orderBy(*order))).where(
        F.col("place") <= k + 1).drop("place")
    members = asked.join(classes, "vec").select(F.col("id").alias("query_id"), "class")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return members.join(best, "class").where("query_id <> vec_id").withColumn("rank", rank).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
