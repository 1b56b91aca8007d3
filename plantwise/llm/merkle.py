"""Merkle dataset manifest: subtrees per group of rows, a root over their roots, and proofs.

A leaf is the SHA-256 of a row's columns, each written as its UTF-8 byte count, a colon and the
value (``-`` if null). Per group, leaves stand in the order of ``order``, every two consecutive
nodes become the hash of their joined hex digests until one is left, the subroot; subroots in the
bytewise order of their group (null first) are joined to the root the same way.

Build: rows are sorted by range once, and a leaf's place is its place in its range plus the rows of
its group in earlier ranges (one number per range and group), so a group with a third of all
rows is as many tasks as any other rows. ``HOP`` levels are folded at a time from blocks of
2^HOP consecutive nodes. Every node of a stored level is one row: its hash, the siblings on the
way to its parent on the next stored level, and the link to that parent.

Climb: a recursive query starts at every leaf, follows the parent links, appends the siblings and
folds a claimed leaf hash (any hash: of the row as it is now, or of a tampered copy) until the
root. Stored levels of ``BROADCAST_NODES`` rows or fewer, up to the root, are broadcast (their size
is counted); larger ones are joined on their key, below which at most a small share of all leaves
meets. Claimed rows climb without moving their texts.

Defined cases: a null column is hashed as ``-``. Rows of one id are leaves of their own, ordered by
leaf hash; equal rows get the places that follow each other. Null ids stand first. A lone leaf is its
group's subroot, a lone subroot the root; its proof is the hash of nothing. An empty table gives
no rows. Other columns take no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from plantwise.llm.common import fresh_folder, staged

HOP = 8
BROADCAST_NODES = 1 << 14
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"
TOP = "^"  # the tree over the subroots; the others are "" (null) or "=" and the group

# the next level of a list of hex digests, and all levels of a block
PARENTS = """transform(sequence(0, cast((size(element_at(acc, -1)) + 1) div 2 - 1 as int)), i ->
    sha2(concat(get(element_at(acc, -1), 2 * i), coalesce(get(element_at(acc, -1), 2 * i + 1), '')), 256))"""
LEVELS = f"aggregate(filter(sequence(0, {HOP}), j -> j > 0 and j <= up), array(digests), (acc, j) -> concat(acc, array({PARENTS})))"
# a node's siblings on the way up: whether the sibling stands left, and its hash (null: none)
PATH = f"""transform(filter(sequence(0, {HOP - 1}), j -> j < up), j -> struct(
    shiftright(i, j) % 2 = 1 as left, unhex(get(get(levels, j), shiftright(i, j) ^ 1)) as hash))"""


def fold(path: str, digest: str) -> str:
    return f"""aggregate({path}, {digest}, (acc, s) -> sha2(case when s.hash is null then acc
        when s.left then concat(lower(hex(s.hash)), acc) else concat(acc, lower(hex(s.hash))) end, 256))"""


def siblings(path: str) -> str:
    return f"aggregate({path}, X'', (acc, s) -> concat(acc, coalesce(s.hash, X'')))"


def leaf_hash(*columns: Column) -> Column:
    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*(part(c) for c in columns)), 256)


def tree_of(group: Column) -> Column:
    """The group as a key that sorts null first and is never null."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``idx``, the place in its tree by ``order``, and ``n``, the tree's rows. No window
    sees more than one number per range and tree."""
    spark = rows.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = staged(
        rows.repartitionByRange(ranges, "tree", *order).sortWithinPartitions("tree", *order)
        .select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")),
        fresh_folder(spark, "merkle-sorted"))
    runs = sorted_rows.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("c"), F.min("at").alias("first"))
    by_tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("c").over(by_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("c").over(by_tree).alias("n"))
    return sorted_rows.join(runs, ["tree", "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def blocks(nodes: DataFrame, level: int) -> DataFrame:
    """Blocks of 2^HOP nodes (tree, idx, n, digest, own) of one stored level: ``children`` with their
    paths, the block's ``digest``, and ``ends``: whether that is the tree's top."""
    rows = F.array_sort(F.collect_list(F.struct("idx", "digest", "own")))
    grouped = nodes.groupBy("tree", F.shiftright("idx", HOP).alias("block")).agg(rows.alias("rows"), F.max("n").alias("n"))
    height = F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0)
    sized = grouped.select("tree", "block", "n", "rows", (height <= level + HOP).alias("ends"),
                           F.least(F.lit(HOP), height - level).alias("up"), F.expr("transform(rows, r -> r.digest)").alias("digests"))
    full = sized.withColumn("levels", F.expr(LEVELS))
    children = F.expr(f"transform(rows, (r, i) -> struct(r.idx, r.digest, r.own, {PATH} as path))")
    return full.select("tree", "block", "n", "ends", children.alias("children"), F.expr("element_at(levels, -1)[0]").alias("digest"))


@dataclass
class Stage:
    """One stored level: node rows (stage, tree, idx, path, up_stage, up_tree, up_idx, top)."""

    name: str
    rows: DataFrame


def grow(leaves: DataFrame, kind: str, top_stage: str | None) -> tuple[list[Stage], DataFrame]:
    """All stored levels of the trees over ``leaves`` (tree, idx, n, digest, own), lowest first, and their
    tops (tree, digest). Level by level the rows are 2^HOP times fewer."""
    spark, stages, tops, level, nodes = leaves.sparkSession, [], None, 0, leaves
    while True:
        built = staged(blocks(nodes, level), fresh_folder(spark, f"merkle-{kind}-{level}"))
        up = F.when(F.col("ends"), F.lit(top_stage)).otherwise(F.lit(f"{kind}:{level + HOP}"))
        stages.append(Stage(f"{kind}:{level}", built.select(
            F.lit(f"{kind}:{level}").alias("stage"), "tree", up.alias("up_stage"), F.col("tree").alias("up_tree"),
            F.when(F.col("ends"), F.lit(0)).otherwise(F.col("block")).cast("long").alias("up_idx"),
            F.when(F.col("ends"), F.col("digest")).alias("top"), F.inline("children"))))
        ended = built.where("ends").select("tree", "digest")
        tops = ended if tops is None else tops.union(ended)
        nodes = built.where("not ends").select("tree", F.col("block").alias("idx"), "n", "digest", F.lit(None).cast("int").alias("own"))
        if nodes.isEmpty():
            return stages, tops
        level += HOP


def climb(start: DataFrame, nodes: DataFrame, broadcast: bool) -> DataFrame:
    """Ascend from every row of ``start`` while ``nodes`` has its node, by one recursive query. Its rows
    of all steps are written, and only those whose next node is elsewhere are returned."""
    spark = start.sparkSession
    hint = "/*+ BROADCAST(n) */" if broadcast else ""
    climbed = spark.sql(f"""
        WITH RECURSIVE climb(own, stage, tree, idx, folded, siblings, subroot, root) AS (
          SELECT own, stage, tree, idx, folded, siblings, subroot, root FROM {{start}}
          UNION ALL
          SELECT {hint} c.own, n.up_stage, n.up_tree, n.up_idx, unhex({fold("n.path", "lower(hex(c.folded))")}),
                 concat(c.siblings, {siblings("n.path")}), coalesce(c.subroot, unhex(n.top)),
                 CASE WHEN n.up_stage IS NULL THEN unhex(n.top) END
          FROM climb c JOIN {{nodes}} n ON n.stage = c.stage AND n.tree = c.tree AND n.idx = c.idx)
        SELECT * FROM climb""", start=start, nodes=nodes)
    stored = [r[0] for r in nodes.select("stage").distinct().collect()]  # names of levels: a handful
    out = climbed.where(F.col("stage").isNull() | ~F.col("stage").isin(stored))
    # all leaves climb: Spark's default bound on the rows of a recursion is for runaway queries
    before = spark.conf.get(ROW_LIMIT, None)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        return staged(out, fresh_folder(spark, "merkle-climb"))
    finally:
        spark.conf.unset(ROW_LIMIT) if before is None else spark.conf.set(ROW_LIMIT, before)


def manifest(leaves: DataFrame, order: list[str]) -> tuple[list[Stage], DataFrame]:
    """Stored levels of the whole manifest over ``leaves`` (tree, digest, own and the columns of
    ``order``): those of the groups' trees, then those of the tree over their roots."""
    spark = leaves.sparkSession
    own_stages, tops = grow(placed(leaves, order).select("tree", "idx", "n", "digest", "own"), "tree", "roots:0")
    tops = staged(tops.select(F.lit(TOP).alias("tree"), F.col("tree").alias("group"), "digest"), fresh_folder(spark, "merkle-tops"))
    ranked = placed(tops, ["group"]).select("tree", "idx", "n", "digest", F.col("group").alias("own"))
    top_stages, roots = grow(ranked, "roots", None)
    # a subroot is found by its group, not by its place
    first = top_stages[0].rows
    top_stages[0] = Stage("roots:0", first.withColumns({"tree": F.col("own"), "idx": F.lit(0).cast("long")}))
    return own_stages + top_stages, roots


def proofs(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Per row of ``leaves`` (tree, digest, own, claimed, columns of ``order``): ``own`` and ``digest`` as
    they are, ``subroot``, ``root``, ``siblings`` (32 bytes each, leaf to root) and ``folded``, the root
    that ``claimed`` gives with them."""
    spark = leaves.sparkSession
    kept = leaves.withColumn("own", F.struct("own", "digest", "claimed"))
    stages, _ = manifest(kept, order)
    bottom, *above = stages
    # hashes climb as 32 bytes: every step's rows are shuffled
    start = bottom.rows.select(
        F.struct("own.own", F.unhex("own.digest").alias("digest")).alias("own"), F.col("up_stage").alias("stage"),
        F.col("up_tree").alias("tree"), F.col("up_idx").alias("idx"), F.unhex("top").alias("subroot"), F.lit(None).cast("binary").alias("root"),
        F.unhex(F.expr(fold("path", "own.claimed"))).alias("folded"), F.expr(siblings("path")).alias("siblings"))
    columns = ["stage", "tree", "idx", "path", "up_stage", "up_tree", "up_idx", "top"]
    sizes = [s.rows.count() for s in above]
    small = len(above)
    while small and sizes[small - 1] <= BROADCAST_NODES:
        small -= 1
    for part, broadcast in ((above[:small], False), (above[small:], True)):
        if part:
            nodes = part[0].rows.select(*columns)
            for s in part[1:]:
                nodes = nodes.unionByName(s.rows.select(*columns))
            start = climb(start, nodes, broadcast)
    as_hex = lambda c: F.lower(F.hex(c))
    return start.select("own.own", as_hex("own.digest").alias("digest"), as_hex("subroot").alias("subroot"), as_hex("root").alias("root"),
                        "siblings", as_hex("folded").alias("folded"))


def verified(docs: DataFrame, columns: list[str], group: str, doc_id: str = "doc_id", tampered: dict[str, Column] | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, siblings, proof_sha256, folded_root, verified`` per row of ``docs``: leaves
    from ``columns``, trees per ``group``, and the claimed leaf from the columns as ``tampered`` has
    them. ``proof_sha256`` is the hash of the siblings' hex digests, joined."""
    spark = docs.sparkSession
    now = [(tampered or {}).get(c, F.col(c)) for c in columns]
    leaves = docs.select(tree_of(F.col(group)).alias("tree"), F.col(doc_id).alias("own"), leaf_hash(*(F.col(c) for c in columns)).alias("digest"),
                         leaf_hash(*now).alias("claimed"))
    leaves = staged(leaves, fresh_folder(spark, "merkle-leaves")).withColumn("place", F.col("own"))
    found = proofs(leaves, ["place", "digest"])
    return found.select(
        F.col("own").alias(doc_id), F.col("digest").alias("leaf"), "subroot", "root", "siblings",
        F.sha2(F.lower(F.hex("siblings")), 256).alias("proof_sha256"), F.col("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"))
