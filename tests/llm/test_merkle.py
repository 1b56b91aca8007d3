"""Merkle manifest against a plain recomputation."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from plantwise.llm import merkle, queries
from plantwise.llm.common import ship_code
from tests.conftest import SF_SMALL

COLUMNS = queries.MANIFEST_COLUMNS
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, idx int, n int, digest string, own int, stage string, path int"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i:i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def plain(rows):
    """(doc_id, text, lang, source, n_chars) -> expected result rows."""
    def leaf(r, more=0):
        values = (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1])
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    ordered = {k: sorted(groups[k], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for k in langs}
    trees = {k: levels([leaf(r) for r in ordered[k]]) for k in langs}
    top = levels([trees[k][-1][0] for k in langs])
    out = []
    for place, k in enumerate(langs):
        for i, r in enumerate(ordered[k]):
            folded = leaf(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))
            siblings = []
            for tree, at in ((trees[k], i), (top, place)):
                for level in tree[:-1]:
                    other = level[at ^ 1] if at ^ 1 < len(level) else ""
                    siblings.append(other)
                    folded = h(other + folded if at % 2 else folded + other)
                    at //= 2
            out.append((r[0], trees[k][0][i], trees[k][-1][0], top[-1][0], h("".join(siblings)), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def run(df):
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    more = F.when(touched, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    out = merkle.verified(df, COLUMNS, "lang", tampered={"n_chars": more})
    assert len(set(out.columns)) == len(out.columns)
    return sorted((tuple(r) for r in out.drop("siblings").collect()), key=str)


@pytest.fixture()
def frame(spark):
    ship_code(spark)
    return lambda rows: spark.createDataFrame([(*r, "x", 1, 2, "y", 3, "z", 4) for r in rows], SCHEMA).repartition(3)


def test_query_equals_plain_recomputation(spark):
    got = sorted((tuple(r) for r in queries.queries()["op11_merkle_manifest"](spark, SF_SMALL).collect()), key=str)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    assert got == plain([(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs])
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 256, 257, 700])
def test_one_large_group_beside_small_ones(spark, frame, n):
    rows = [(i, f"text {i}", "en", "s", i) for i in range(n)] + [(10_000 + i, "t", f"l{i}", None, None) for i in range(3)]
    assert run(frame(rows)) == plain(rows)


def test_large_levels_are_joined_and_small_ones_broadcast(spark, frame, monkeypatch):
    rows = [(i, f"text {i}", ["en", "de", None][i % 3], "s", i) for i in range(900)]
    for bound in (0, 3, 1 << 14):
        monkeypatch.setattr(merkle, "BROADCAST_NODES", bound)
        assert run(frame(rows)) == plain(rows), bound


def test_nulls_ties_repeated_rows_and_long_texts(spark, frame):
    rows = [
        (None, None, None, None, None), (None, "no id", None, "s", 1), (3, "a", "é", "s", 2), (3, "a", "é", "s", 2), (3, "b", "é", "s", 2),
        (4, "", "", "", 0), (7, "x" * 300_000, "en", "ß", 2**62), (-5, "漢字 😀", "en", "s", None), (2**60, "-", "-", "-", -1),
    ]
    got = run(frame(rows))
    assert got == plain(rows) and len(got) == len(rows)


def test_many_groups_and_an_empty_table(spark, frame):
    rows = [(i, "t", f"lang {i}", "s", 1) for i in range(600)]
    assert run(frame(rows)) == plain(rows)
    assert run(frame([]).limit(0)) == []


def test_recursion_limit_is_put_back(spark, frame):
    spark.conf.set(merkle.ROW_LIMIT, "123")
    try:
        run(frame([(i, "t", "en", "s", 1) for i in range(300)]))
        assert spark.conf.get(merkle.ROW_LIMIT) == "123"
    finally:
        spark.conf.unset(merkle.ROW_LIMIT)
