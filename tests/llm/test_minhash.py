"""MinHash near-dedup against exact set similarities of all pairs."""

import math
import random

import pytest

from plantwise.llm import minhash, queries
from plantwise.llm.common import ship_code
from tests.conftest import SF_SMALL

SCHEMA = "doc_id long, text string, node int, sig int, n string, key int, label int, token int, th int"


def shingles(text, k=4):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def plain(rows):
    """Per row of (id, text): set size and component."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            same = len(a & sets[j])
            if a and 100 * same >= 80 * (len(a) + len(sets[j]) - same) and sets[j]:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i)), d == least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def run(spark, rows):
    ship_code(spark)
    df = spark.createDataFrame([(*r, 1, 2, "n", 3, 4, 5, 6) for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in minhash.near_duplicates(df).collect()), key=str)


def family(rnd, size, words, edits, vocabulary=4000):
    """Texts around one base: each has up to ``edits`` words exchanged, so pairs lie on both sides of the bound."""
    base = [f"w{rnd.randrange(vocabulary)}" for _ in range(words)]
    out = []
    for _ in range(size):
        own = list(base)
        for _ in range(rnd.randrange(edits + 1)):
            own[rnd.randrange(words)] = f"x{rnd.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_query_equals_all_pairs(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    got = sorted((tuple(r) for r in queries.queries()["op12_minhash_neardup"](spark, SF_SMALL).collect()), key=str)
    assert got == plain([(r.doc_id, r.text) for r in docs])


@pytest.mark.parametrize("small, block", [(32, 1024), (2, 16)])
def test_large_families_and_common_passages(spark, monkeypatch, small, block):
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "BLOCK", block)
    rnd = random.Random(small)
    texts = family(rnd, 120, 150, 12) + family(rnd, 40, 60, 6) + ["the same copy of one text stands here often"] * 60
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [f"{passage} " + " ".join(f"u{rnd.randrange(10**6)}" for _ in range(rnd.randrange(5, 120))) for _ in range(60)]
    rows = list(enumerate(texts))
    rnd.shuffle(rows)
    assert run(spark, rows) == plain(rows)


def test_defined_cases(spark):
    long = " ".join(f"v{i}" for i in range(40_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "One two"), (5, "one TWO"), (6, "one two three"), (7, "Ünï one"), (8, "ÜNÏ one"),
        (9, long), (10, long + " end"), (9, long), (None, long), (None, "without id alone here"), (None, "Without ID alone here"),
        (11, "a b c d"), (11, "e f g h"), (12, "e f g h"), (13, "\xa0 a b c d"),
    ]
    got = run(spark, rows)
    want = plain(rows)
    # a null id whose group has no id is kept; plain() compares None == None the same way
    assert got == want


def test_empty_table(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("k", [8, 32, 64])
def test_threshold_follows_the_binomial_tail(k):
    t = minhash.least_matches(0.8, k)
    tail = sum(math.comb(k, i) * 0.8 ** i * 0.2 ** (k - i) for i in range(t))
    assert (t == 1 or tail <= minhash.MISS) and tail + math.comb(k, t) * 0.8 ** t * 0.2 ** (k - t) > minhash.MISS


def test_collisions_estimate_the_similarity():
    rnd = random.Random(3)
    got = []
    for _ in range(40):
        a, b = (minhash.signature(minhash.shingle_set(t, 4)) for t in family(rnd, 2, 200, 8))
        got.append((a == b).mean())
    assert 0.6 < sum(got) / len(got) <= 1.0


def test_hash_of_short_texts_depends_on_their_length():
    one = {int(minhash.shingle_set(t, 4)[0]) for t in ("a", "a a", "a a a", "a a a a", "A")}
    assert len(one) == 4
