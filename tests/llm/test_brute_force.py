"""Operators that SQL cannot express, against brute force, round trips and held-out accuracy."""

import collections
import functools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plantwise.llm import components, mixture, mtree, pieces, quality, queries, secrets, simhash, suffix_dedup, suffixes, tokens, toxicity
from plantwise.llm.common import fresh_folder, ship_code
from tests.conftest import SF_MID, SF_SMALL

Q = queries.queries()
BPE = f"{queries.TOKENIZER_DIR}/byte_bpe_50k.json"
PIECES = f"{queries.TOKENIZER_DIR}/piece_bpe_32k.model"


def texts(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


# ---------------------------------------------------------------- 1 secrets
def spans_of(text):
    base = [("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
            ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)]
    found = [(m.start(), no, m.end(), kind) for no, (kind, p, g, n) in enumerate(base, 1) for m in re.finditer(p, text) if len(m.group(g)) >= n]
    return sorted(found)


def test_secret_ledger_is_incremental_and_joins_back_to_all_paths(spark):
    ship_code(spark)
    t = ["secret: token = abcdefgh Token='zzzzzzzz'", "é AKIA" + "A" * 16 + " " + "0123456789abcdef" * 2, "password=abc api_key:" + "f" * 30, "clean"]
    first = spark.createDataFrame([("a/1", t[0]), ("a/2", t[1]), ("b/1", t[0]), ("c", t[3])], "path string, text string")
    folder = fresh_folder(spark, "test-ledger")
    got = {r.path: [tuple(s) for s in r.spans] for r in secrets.scan(first, folder, secrets.BASE, ["path"]).collect()}
    assert got == {"a/1": spans_of(t[0]), "b/1": spans_of(t[0]), "a/2": spans_of(t[1]), "c": []}
    assert secrets.read_ledger(spark, folder).count() == 3  # three blobs
    again = first.union(spark.createDataFrame([("a/1", t[2])], "path string, text string"))
    out = secrets.scan(again, folder, secrets.BASE, ["path"])
    assert sorted((r.path, len(r.spans)) for r in out.collect()) == sorted(
        [("a/1", len(spans_of(t[0]))), ("a/1", len(spans_of(t[2]))), ("a/2", 2), ("b/1", len(spans_of(t[0]))), ("c", 0)])
    assert secrets.read_ledger(spark, folder).count() == 4  # only the new blob was scanned
    newer = (*secrets.BASE[:2], secrets.Rule("hex", 2, r"[0-9a-f]{30,}", least=30, group=0))
    secrets.scan(again, folder, newer, ["path"]).collect()
    rescanned = secrets.read_ledger(spark, folder).where(F.array_contains("rules", "hex@2")).collect()
    assert len(rescanned) == 4 and all(r.rules == ["hex@2"] for r in rescanned)


def test_redaction_cuts_overlapping_spans_together(spark):
    d = spark.createDataFrame([(1, "x password=" + "0123456789abcdef" * 2 + " end"), (2, "clean")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in secrets.redact(d, fresh_folder(spark, "t")).collect()}
    assert out == {1: "x [SECRET] end", 2: "clean"}


# ---------------------------------------------------------------- 2 simhash
def reference_components(points, ids, bits):
    root = list(range(len(points)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(points)):
        for j in range(i):
            if bin(points[i] ^ points[j]).count("1") <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(points))]


def test_vantage_trees_find_all_links(monkeypatch):
    rnd = random.Random(5)
    points = []
    for _ in range(40):
        center = rnd.getrandbits(64)
        for _ in range(12):
            p = center
            for _ in range(rnd.randrange(6)):
                p ^= 1 << rnd.randrange(64)
            points.append(p)
    points = sorted(set(points))
    monkeypatch.setattr(simhash, "LEAF", 8)
    names = np.arange(len(points))
    array = np.array(points, dtype=np.uint64)
    want = reference_components(points, list(range(len(points))), 3)
    tree = simhash.VantageTree(array[::3], 10, 3)
    assert tree.shards > 3
    links = []
    shards = tree.shards_of(array)
    for s in range(tree.shards):
        own = np.array([i for i, x in enumerate(shards) if s in x], dtype=int)
        links += list(zip(*(x.tolist() for x in simhash.shard_links(array[own], names[own], 3))))
    root = list(range(len(points)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(points))] == want


def test_simhash_query(spark):
    import xxhash

    got = Q["op2_simhash_neardup"](spark, SF_SMALL).collect()
    docs = texts(spark, SF_SMALL)
    prints = {}
    for r in got:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), docs[r.doc_id])) if w]
        grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints[r.doc_id] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert r.fingerprint == f"{prints[r.doc_id]:016x}"
    ids = sorted(prints)
    want = reference_components([prints[i] for i in ids], ids, 3)
    assert {r.doc_id: r.component_id for r in got} == dict(zip(ids, want))


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(5, 5)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(40)}}


# ---------------------------------------------------------------- 3 mixture
def test_mixture_reaches_target_shares_and_repeats(spark):
    n = {"a": 6000, "b": 2000, "c": 1000}
    rows = [(i, s, "x" * 10) for i, s in enumerate(s for s, k in n.items() for _ in range(k))]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    weights = spark.createDataFrame([("a", 0.2), ("b", 0.3), ("c", 0.5)], "source string, weight double")
    out = mixture.mix(docs, weights)
    shares = {r.source: r["count"] / 9000 for r in out.groupBy("source").count().collect()}
    assert all(abs(shares[s] - w) < 0.03 for s, w in (("a", 0.2), ("b", 0.3), ("c", 0.5)))
    again = mixture.mix(docs.repartition(7), weights)
    assert sorted(map(tuple, out.select("doc_id", "copy").collect())) == sorted(map(tuple, again.select("doc_id", "copy").collect()))


# ---------------------------------------------------------------- 4 top-k
def test_mtree_equals_brute_force_with_many_ties(spark, monkeypatch):
    ship_code(spark)
    monkeypatch.setattr(mtree, "SHARD", 150)
    monkeypatch.setattr(mtree, "QUERY_PART", 20)
    rnd = np.random.default_rng(2)
    x = (rnd.integers(-3, 4, (700, 6)) / 64).tolist()
    for i in range(0, 300):
        x[i] = [1 / 64] * 6  # one vector with nearly half of the rows
    rows = [(i, v) for i, v in enumerate(x)] + [(900, None), (901, [1.0, None]), (902, [float("nan")] * 6), (None, [1.0] * 6), (40, x[40])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in mtree.top_k(df, 20, 20).collect()}
    q = np.floor(64 * np.array(x)).astype(int)
    want = {}
    for i in range(0, 700, 20):
        order = sorted((-int(q[i] @ q[j]), j) for j in range(700) if j != i)[:20]
        want |= {(i, k + 1): (j, -s) for k, (s, j) in enumerate(order)}
    assert got == want


# ---------------------------------------------------------------- 5 suffixes
def test_two_stage_order_and_prefixes():
    rnd = np.random.default_rng(1)
    for _ in range(200):
        depth = int(rnd.integers(2, 8))
        text, wanted = [], []
        for _ in range(int(rnd.integers(1, 6))):
            n = int(rnd.integers(depth, depth + 14))
            text += [*rnd.integers(97, 97 + int(rnd.integers(1, 4)), n), suffixes.END]
            wanted += [True] * (n - depth + 1) + [False] * depth
        text, wanted = np.array(text, dtype=np.int16), np.array(wanted)
        order = suffixes.sorted_starts(text, wanted, depth)
        strings = [bytes(text[i:i + depth].astype(np.uint8)) for i in order]
        assert sorted(order) == list(np.flatnonzero(wanted)) and strings == sorted(strings)
        prefix = suffixes.common_prefixes(text, order, depth)
        assert all(prefix[i] == next((j for j in range(depth) if strings[i][j] != strings[i - 1][j]), depth) for i in range(1, len(order)))


def test_repeats_equal_brute_force_with_hot_passages(spark, monkeypatch):
    ship_code(spark)
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abé") for _ in range(rnd.randrange(1, 9)))
    passage = " ".join(word() for _ in range(40))
    rows = []
    for i in range(60):
        t = " ".join(word() for _ in range(rnd.randrange(0, 120)))
        if i % 3 == 0:
            t = t[:50] + passage[:rnd.randrange(90, 160)] + t[50:]
        if i % 7 == 0:
            t += "a" * rnd.randrange(0, 300)
        rows.append((i, t))
    rows += [(70, rows[5][1]), (71, rows[5][1]), (72, None)]
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    seen = set()
    for i, t in sorted(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            if raw[k:k + 100] in seen:
                gone[k:k + 100] = b"\1" * 100
            seen.add(raw[k:k + 100])
        assert got[i] == bytes(b for b, g in zip(raw, gone) if not g), i


def test_passage_in_many_surroundings_is_no_single_group(spark, monkeypatch, tmp_path):
    ship_code(spark)
    rnd = np.random.default_rng(8)
    passage = bytes(rnd.integers(97, 123, 150).astype(np.uint8))
    around = lambda: bytes(rnd.integers(97, 123, 150).astype(np.uint8))
    rows = [(i, (around() + passage + around()).decode()) for i in range(2000)]
    monkeypatch.setattr(suffix_dedup, "BUCKET", 1 << 14)
    monkeypatch.setattr(suffix_dedup, "fresh_folder", lambda _, name: str(tmp_path / name))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r.doc_id: bytes(r.kept).decode() for r in suffix_dedup.remove_repeats(docs).collect()}
    seen = set()
    for i, t in rows:
        gone = {p for k in range(351) if t[k:k + 100] in seen for p in range(k, k + 100)}
        seen |= {t[k:k + 100] for k in range(351)}
        assert got[i] == "".join(c for p, c in enumerate(t) if p not in gone)
    columns = [c for c in ("stretches", "texts", "strings") if c in spark.read.parquet(str(tmp_path / "suffix-cuts")).columns]
    held = [F.coalesce(F.aggregate(c, F.lit(0), lambda a, b: a + F.octet_length(b)), F.lit(0)) for c in columns]
    groups = spark.read.parquet(str(tmp_path / "suffix-cuts")).where("shard IS NOT NULL").groupBy("shard").agg(
        F.sum(functools.reduce(lambda a, b: a + b, held)).alias("n"))
    # 8 * HOT different stretches of one anchor are the most that go to a shard together
    assert groups.agg(F.max("n")).first()[0] < 8 * suffix_dedup.HOT * 192 + (1 << 14)


# ---------------------------------------------------------------- 6 tokens
def test_counts_at_every_prefix_equal_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    n = lambda s: len(library.encode(s, add_special_tokens=False).ids)
    counter = tokens.PrefixCounter(*tokens.load_merges(BPE))
    rnd = random.Random(1)
    for _ in range(300):
        s = "".join(rnd.choice([rnd.choice("ab  \n\t'stre1.é漢😀"), "aaa", "  ", "'re", "<|endoftext|>", " the"]) for _ in range(rnd.randrange(25)))
        index = counter.index(s)
        counts = [n(s[:k]) for k in range(len(s) + 1)]
        assert counter.count(s) == counts[-1]
        assert [counter.count_at(s, index, k) for k in range(len(s) + 1)] == counts, s
        budget = rnd.randrange(12)
        assert counter.cut_at_budget(s, budget) == max(k for k, c in enumerate(counts) if c <= budget)


def test_token_query_equals_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    docs = texts(spark, SF_SMALL)
    for r in Q["op6_token_counts"](spark, SF_SMALL).collect():
        t = docs[r.doc_id]
        want = len(library.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), want, want > 1024)


# ---------------------------------------------------------------- 7 language
def test_language_accuracy_on_held_out_documents(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()}
    got = Q["op7_language_id"](spark, SF_MID).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.98 and all(0 <= r.score <= 1 for r in got)


def test_forward_sums_all_segmentations():
    from plantwise.llm.langid import Scorer, word_loglik

    pieces_ = {" ": 0, "a": 1, "b": 2, "ab": 3, " a": 4, "ba": 5, "aba": 6}
    rnd = np.random.default_rng(0)
    probs = np.concatenate([rnd.random((7, 2)), [[1e-9, 1e-9]]])

    @functools.cache
    def total(s):
        if not s:
            return np.ones(2)
        return sum((probs[pieces_[s[:n]]] * total(s[n:]) for n in range(1, min(3, len(s)) + 1) if s[:n] in pieces_), np.zeros(2))

    for w in ("a", "ab", "abab", "bbaab" * 3, "ab" * 16):
        want = np.log(total(" " + w))
        assert np.allclose(word_loglik(" " + w, pieces_, 3, probs), want)
        scorer = Scorer({"langs": ["x", "y"], "pieces": pieces_, "probs": probs})
        assert np.allclose(scorer.logliks([w])[0], want)


# ---------------------------------------------------------------- 8 quality
def test_quality_counts_and_clean_documents(spark):
    docs = texts(spark, SF_SMALL)
    rows = Q["op8_quality_divergence"](spark, SF_SMALL).collect()
    for r in rows:
        t = docs[r.doc_id]
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = {}
        for i in range(len(words) - 7):
            windows.setdefault(tuple(words[i:i + 8]), []).append(i)
        covered = {j for v in windows.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.base_failed and r.kept)
    good = {r.doc_id for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").where("quality = 1").collect()}
    judged = [r for r in rows if r.doc_id in good and not r.base_failed]
    assert all(r.kept for r in judged)


def test_quality_rejects_other_languages_and_texts_without_common_words(spark):
    words = {"en": "the of and to in is it for that was on as".split(), "de": "der die und in den von zu das mit sich des auf".split()}
    rnd = random.Random(6)
    rare = lambda: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randrange(5, 9)))
    text = lambda own, n: " ".join(rnd.choice(own) if rnd.random() < 0.25 else rare() for _ in range(n))
    rows = [(f"{lang} {i}", lang, text(words[lang], 60 + i)) for lang in words for i in range(0, 600, 3)]
    rows += [(f"other {i}", "en", text(words["de"], 150 + i)) for i in range(5)]
    rows += [(f"rare {i}", "de", " ".join(rare() for _ in range(150 + i))) for i in range(5)]
    out = quality.judge(spark.createDataFrame(rows, "doc_id string, lang string, text string")).collect()
    assert all(r.kept == (r.doc_id.split()[0] in words) and not r.base_failed for r in out)


def word_distance_rows():
    rnd = random.Random(11)
    short = "the of and to in is it for that was on as".split()
    long = {lang: ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randrange(6, 10))) for _ in range(400)] for lang in ("en", "xx")}
    text = lambda own, n: " ".join(rnd.choice(short if rnd.random() < 0.2 else own) for _ in range(n))
    rows = [(f"own {i}", "en", text(long["en"], 200 + i)) for i in range(120)]
    rows += [(f"other {i}", "en", text(long["xx"], 200 + i).title()) for i in range(4)]
    return rows + [("twice", "xx", rows[0][2])] * 2 + [(None, None, rows[0][2]), ("null", "en", None), ("short", "en", "The of and"), ("xx", "xx", text(long["xx"], 900))]


@pytest.mark.parametrize("hot_part", [1, 200, 1 << 22])
def test_word_distance_counts_every_word(spark, monkeypatch, hot_part):
    monkeypatch.setattr(quality, "HOT_PART", hot_part)
    rows = word_distance_rows()
    words = {t: collections.Counter(t.lower().split()) for _, _, t in rows if t}
    refs = {lang: sum((words[t] for _, x, t in rows if x == lang and t), collections.Counter()) for lang in ("en", "xx")}

    def distance(lang, text):
        if lang is None or text is None or words[text].total() < 50:
            return None
        p, q = words[text], refs[lang]
        shares = [(p[w] / p.total(), q[w] / q.total()) for w in q]
        part = lambda a, b: a * math.log2(2 * a / (a + b)) if a else 0.0
        return math.sqrt(sum(part(a, b) + part(b, a) for a, b in shares) / 2)

    out = quality.judge(spark.createDataFrame(rows, "doc_id string, lang string, text string")).collect()
    assert len(out) == len(rows)
    got = sorted((r.doc_id or "", r.lang or "", r.word_distance) for r in out)
    want = sorted((d or "", lang or "", distance(lang, t)) for d, lang, t in rows)
    for g, w in zip(got, want, strict=True):
        assert g[:2] == w[:2] and (g[2] is w[2] is None or abs(g[2] - w[2]) < 1e-9)
    # same short words, but none of the language's long ones
    assert all(r.kept == (r.doc_id.split()[0] == "own") for r in out if r.doc_id and r.doc_id.split()[0] in ("own", "other"))


def test_chance_is_the_mean_divergence_of_draws(spark):
    counts = [4000, 1500, 700, 300] + [60] * 40 + [5] * 300 + [1] * 2000
    total = sum(counts)
    table = spark.createDataFrame([("en", i, n) for i, n in enumerate(counts)], "ref_lang string, key long, n long")
    levels = quality.chance_levels(table, spark.createDataFrame([("en", total)], "ref_lang string, ref_n long")).first().ref_chance
    q, rnd = np.array(counts) / total, np.random.default_rng(5)
    for level in (5, 8, 11):
        p = rnd.multinomial(2 ** level, q, size=60) / 2 ** level
        terms = np.where(p > 0, p * np.log2(np.where(p > 0, 2 * p / (p + q), 1)), 0) + q * np.log2(2 * q / (p + q))
        assert abs(terms.sum(axis=1).mean() / 2 - levels[level]) < 0.015


def test_jensen_shannon_distance(spark):
    p, q = [0.5, 0.5, 0.0], [0.25, 0.25, 0.5]
    got = spark.range(1).select(quality.jensen_shannon(F.array(*map(F.lit, p)), F.array(*map(F.lit, q)))).first()[0]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x)
    assert abs(got - math.sqrt((kl(p) + kl(q)) / 2)) < 1e-12


# ---------------------------------------------------------------- 9 pieces
def test_viterbi_equals_brute_force_and_round_trips():
    vocabulary = pieces.read_vocabulary(PIECES, True)
    codec = pieces.Codec(vocabulary)
    byte_ids = set(vocabulary["bytes"])
    known = {r: i for i, r in enumerate(vocabulary["raw"]) if r and i not in byte_ids}
    rnd = random.Random(3)

    def best(t):
        score = [0.0]
        for j in range(1, len(t) + 1):
            options = [score[i] + vocabulary["scores"][known[t[i:j].encode()]] for i in range(j) if t[i:j].encode() in known]
            score.append(max([*options, *([score[j - 1] + vocabulary["unknown"]] if t[j - 1].encode() not in known else [])]))
        return score[-1]

    for _ in range(600):
        s = "".join(rnd.choice([rnd.choice("1_'#. ab the\n\t▁é漢😀.ing  "), "the", "ing", "  ", "tion", "\r\n"]) for _ in range(rnd.randrange(14)))
        assert codec.decode(codec.encode(s).tolist()) == s
        if s:
            assert "".join(codec.words(" " + s)) == " " + s
            assert abs(sum(codec.best(w.encode())[1] for w in codec.words(" " + s)) - best(" " + s)) < 1e-6


def test_piece_query_round_trips(spark):
    rows = Q["op9_piece_codec"](spark, SF_SMALL).collect()
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in rows)


# ---------------------------------------------------------------- 10 toxicity
def test_noisy_or_and_located_sentences():
    texts_ = [("good day to all. you awful foul thing! fine." if i % 3 == 0 else "good day to all. fine thing today.") for i in range(60)]
    learned, bias = toxicity.train(texts_, np.array([int(i % 3 == 0) for i in range(60)]))
    weights = toxicity.Weights(learned)
    bad, fine = texts_[0], texts_[1]
    assert toxicity.score_text(bad, weights, bias) > 0.5 > 0.3 > toxicity.score_text(fine, weights, bias)
    assert [bad[a:b].strip() for a, b, _ in toxicity.locate(bad, weights, bias, 0.3)] == ["you awful foul thing!"]
    p = np.array([0.1, 0.5, 0.2])
    assert abs(toxicity.noisy_or(p) - (1 - 0.9 * 0.5 * 0.8)) < 1e-12


def test_toxicity_query(spark):
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF_MID}/labels.parquet").collect()}
    rows = Q["op10_toxicity_mil"](spark, SF_MID).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) for r in rows)
    learned = [r for r in rows if r.doc_id in label and not r.held_out]
    assert sum(r.predicted == label[r.doc_id] for r in learned) / len(learned) > 0.97


# ---------------------------------------------------------------- pipeline
def test_pipeline_equals_its_parts_in_plain_python(spark):
    """Later stages against plain Python on what the first two kept (tested above)."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    first = stages["toxicity"](spark, docs, SF_SMALL).persist()
    toxic = {r.doc_id for r in Q["op10_toxicity_mil"](spark, SF_SMALL).where("predicted = 1").collect()}
    assert {r.doc_id for r in first.collect()} == {r.doc_id for r in docs.collect()} - toxic
    second = stages["simhash near-dedup"](spark, first, SF_SMALL).persist()
    groups = simhash.near_duplicates(first).collect()
    assert {r.doc_id for r in second.collect()} == {r.component_id for r in groups}
    expected = {}
    for r in second.collect():
        t, out, at = r.text, "", 0
        for start, _, end, _ in [(s["start"], 0, s["end"], 0) for s in sorted(secrets_of(spark, second).get(r.doc_id, []), key=lambda s: s["start"])]:
            if start >= at:
                out += t[at:start] + "[SECRET]"
            at = max(at, end)
        expected[r.doc_id] = out + t[at:]
    out = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert {r.doc_id: r.text for r in out} == {i: expected[i] for i in {r.doc_id for r in out}}
    size = {}
    rows = [(r.doc_id, r.source, len(expected[r.doc_id].encode())) for r in second.collect()]
    for _, s, n in rows:
        size[s] = size.get(s, 0) + n
    weight = {s: n ** 0.5 for s, n in size.items()}
    import hashlib

    want = {}
    for i, s, _ in rows:
        rate = weight[s] / sum(weight.values()) * sum(size.values()) / size[s]
        u = (int(hashlib.md5(f"17|{i}".encode()).hexdigest()[:13], 16) + 0.5) / 16 ** 13
        n, p, total = 0, math.exp(-rate), math.exp(-rate)
        while total <= u:
            n += 1
            p *= rate / n
            total += p
        if n:
            want[i] = n
    got = {}
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == want
    codec = pieces.Codec(pieces.read_vocabulary(PIECES, True))
    assert all(codec.decode(r.ids) == r.text and r.n_pieces == len(r.ids) for r in out)


_spans: dict = {}


def secrets_of(spark, docs):
    if not _spans:
        _spans.update({r.doc_id: r.spans for r in secrets.scan(docs, fresh_folder(spark, "t")).collect()})
    return _spans


def test_pipeline_is_registered():
    import __spark_entry__ as E

    assert E.queries()["pipeline"] is corpus_pipeline.run
    assert pytest.approx(len(corpus_pipeline.STAGES)) == 5
