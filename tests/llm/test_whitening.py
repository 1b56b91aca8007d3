"""Embedding whitening against numpy's own eigenvectors."""

import numpy as np
import pytest

from plantwise.llm import queries, whitening
from plantwise.llm.common import ship_code
from tests.conftest import SF_SMALL

SCHEMA = "vec_id long, embedding array<float>, component string, n int, deviation int, whitened int, p int, width int"


def plain(vectors, components=8):
    x = np.array([[int(np.floor(1024 * np.float64(np.float32(c)))) + 100_000 for c in v] for v in vectors])
    n, s = len(x), x.sum(axis=0)
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    y = x - s / n
    v = y.T @ y / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return deviation, values / np.trace(v), y @ vectors / np.sqrt(values)


def run(spark, rows, **options):
    ship_code(spark)
    df = spark.createDataFrame([(*r, "c", 1, 2, 3, 4, 5) for r in rows], SCHEMA).repartition(3)
    out = whitening.whitened(df, **options)
    assert len(set(out.columns)) == len(out.columns)
    return out.collect()


def check(found, ids, vectors, components=8):
    deviation, shares, white = plain(vectors, components)
    got = {(r.vec_id, r.component): r for r in found}
    k = white.shape[1]
    assert len(found) == len(got) == len(ids) * k
    for j in range(k):
        own = np.array([got[i, j + 1].whitened for i in ids])
        assert min(np.abs(own - white[:, j]).max(), np.abs(own + white[:, j]).max()) < 1e-8
        assert all(abs(got[i, j + 1].explained / shares[j] - 1) < 1e-9 and got[i, j + 1].n == len(ids) for i in ids)
    assert all(int(got[i, 1].deviation) == d for i, d in zip(ids, deviation))
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9


def test_query(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()
    found = queries.queries()["op13_embedding_whitening"](spark, SF_SMALL)
    assert dict(found.dtypes)["deviation"] == "bigint"
    check(found.collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_rows_that_take_no_part(spark):
    draw = np.random.default_rng(1)
    good = [(i, draw.normal(size=12).astype(np.float32).tolist()) for i in range(60)]
    bad = [(100, None), (101, []), (102, [None, *[1.0] * 11]), (103, [float("nan")] * 12), (104, [float("inf"), *[1.0] * 11]),
           (105, [1.0] * 5), (106, [-float("inf")] * 12), (107, [1.0] * 13)]
    check(run(spark, good + bad), [i for i, _ in good], [v for _, v in good])


def test_fewer_components_than_asked_for(spark):
    draw = np.random.default_rng(2)
    flat = [(i, [float(a), float(b), 0.5, float(a + b)]) for i, (a, b) in enumerate(draw.integers(-9, 9, (40, 2)))]
    found = run(spark, flat)
    assert {r.component for r in found} == {1, 2} and found[0].identity_error < 1e-9
    assert run(spark, [(i, [1.0, 2.0]) for i in range(5)]) == []  # one distinct vector: no variance
    assert run(spark, [(1, [1.0, 2.0])]) == [] and run(spark, []) == [] and run(spark, [(1, None)]) == []


def test_repeated_and_null_ids_and_huge_entries(spark):
    rows = [(None, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [3.4e38, -3.4e38]), (3, [-1.0, 2.0])]
    found = run(spark, rows)
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component) for r in found if r.component == 1) == [
        (False, 1, 1), (False, 1, 1), (False, 2, 1), (False, 3, 1), (True, 0, 1)]
    assert max(int(r.deviation) for r in found) > 2**80  # exact beyond 64 bits


def orthogonal(n, seed):
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))[0]


CASES = {
    "random": lambda: (lambda x: x.T @ x)(np.random.default_rng(0).normal(size=(90, 30))),
    "equal": lambda: np.eye(20),
    "cluster": lambda: orthogonal(40, 1) @ np.diag([9, 9, 9 - 1e-13, 9 - 1e-9, 4, 4, 4, 4, 4, *[1] * 31]) @ orthogonal(40, 1).T,
    "split": lambda: np.diag([5.0, 5, 5, 3, 3, 1, 1, 1, 0, 0]),
    "low rank": lambda: np.ones((12, 12)),
    "graded": lambda: np.diag([1e-20, 1e20, 1.0]),
    "one": lambda: np.array([[7.0]]),
    "two": lambda: np.array([[2.0, 1.0], [1.0, 2.0]]),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_eigenvectors(name):
    a = CASES[name]()
    a = (a + a.T) / 2
    values, vectors = whitening.eigen(a, 8)
    want = np.linalg.eigvalsh(a)[::-1][:len(values)]
    scale = np.abs(a).max()
    assert len(values) == min(8, len(a)) and np.abs(values - want).max() <= 1e-13 * scale
    assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-12
    assert np.abs(a @ vectors.T - vectors.T * values).max() <= 1e-12 * scale


def test_householder_keeps_the_spectrum():
    a = CASES["random"]()
    diag, off, _ = whitening.tridiagonal(a)
    t = np.diag(diag) + np.diag(off, 1) + np.diag(off, -1)
    assert np.allclose(np.linalg.eigvalsh(t), np.linalg.eigvalsh(a))
    x = np.array([0.0, 10.0, 60.0, 1e9])
    assert whitening.below(diag, off, x, 1e-300).tolist() == [(np.linalg.eigvalsh(a) < v).sum() for v in x]
