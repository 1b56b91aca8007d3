"""Quality rules by distribution divergence, in DataFrame operations only.

References are learned over all documents: per language, the shares of five character
classes and of every word (lower case; each word is a bin of its own). A document is compared
with its language's reference by the Jensen-Shannon distance (square root of the divergence in
bits, 0 to 1) of both histograms, and rejected when either is farther than its limit. The
limit of words lies, as a divergence, ``WORD_SHARE`` squared of the way from what chance gives
a text of its length to 1 (no word in common). Chance is the expected divergence of n words
drawn from the reference: the sum over its words, whose counts in the draw are taken as
Poisson, at powers of two and interpolated between them. Length guards: documents under
``MIN_WORDS`` words and languages with a reference of under ``MIN_REFERENCE`` words are not
judged by divergence.

The base rules count over whole texts: words, symbols, repeated lines, and words inside
8-word windows that the text holds twice or more. Windows are compared by 64-bit hashes,
combined from their words' hashes by doubling (2, 4, 8 words) and, in texts where one
repeats, sorted: n log n for long texts.

Scale: one pass over the texts measures each document on its own and writes a narrow table
with its different words (64-bit hashes of language and word) and their counts. The references
are summed from that table. The words of a document meet theirs by two joins that give the
same terms: words with at least one of ``HOT_PART`` parts of all words (so at most that many) are
broadcast, and a document's terms of them summed map-side; all others are joined by a shuffle
on the word, where none has more rows than that part. Terms are summed as integers of 2^-50:
their order can't change a verdict. A hot language is a few rows after the partial sums; the
reference rows are joined at their measured size.

Defined cases: null text has no words (base_failed, not kept). A null or unknown language
has no reference: the base rules alone decide. Repeated rows are judged alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantwise.llm.common import SPACE_CLASS, fresh_folder, staged

HOT_PART = 1 << 22
MIN_WORDS = 50
MIN_REFERENCE = 1000
CLASS_LIMIT = 0.25
WORD_SHARE = 0.65
SYMBOLS = "#*$%&|<>"  # fixed value
DIGITS = "0123456789"
STOPS = ".,;:!?'\"()-"
WINDOW = 8
UNIT = float(1 << 50)  # of summed terms
WIDE_DICTIONARY = {"parquet.dictionary.page.size": str(8 << 20)}  # holds a file's different words
LEVELS = 40  # lengths 2^0 to 2^40
RATES = range(-40, 33)  # quarters of log2 of a word's expected count, where chance is tabulated


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_CLASS), lambda w: w != "")


def long_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def pairs(hashes: Column, step: int) -> Column:
    """Each hash combined with the one ``step`` places on."""
    n = F.greatest(F.size(hashes) - step, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(1 + step), n), lambda x, y: F.xxhash64(x, y))


def with_base_counts(docs: DataFrame) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and __plain (the text's
    characters that are neither letters nor white space) from __text."""
    t = F.col("__text")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumn("__words", words_of(t)).withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w)))
    for n, source in ((1, "__hashes"), (2, "__two"), (4, "__four")):
        out = out.withColumn({1: "__two", 2: "__four", 4: "__windows"}[n], pairs(F.col(source), n))
    out = (
        out.withColumn("__lines", lines)
        .withColumn("__plain", F.regexp_replace(t, r"[\p{L}\x20\x09-\x0D]+", ""))
        .select("*", F.size("__words").cast("long").alias("n_words"),
                F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
                (F.length("__plain") - F.length(F.translate("__plain", SYMBOLS, ""))).cast("long").alias("n_symbols"),
                (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
                (F.size("__windows") > F.size(F.array_distinct("__windows"))).alias("__repeats"))
    )
    ordered = F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("__sorted", F.when(F.col("__repeats"), ordered))
    same = lambda x, i: F.coalesce(F.get("__sorted", i)["h"] == x["h"], F.lit(False))
    twice = F.filter("__sorted", lambda x, i: same(x, i - 1) | same(x, i + 1))
    covered = F.aggregate(
        F.array_sort(F.transform(twice, lambda x: x["i"])), F.struct(F.lit(0).alias("next"), F.lit(0).alias("sum")),
        lambda acc, p: F.struct((p + WINDOW).alias("next"),
                                (acc["sum"] + p + WINDOW - F.greatest(acc["next"], p)).alias("sum")),
        lambda acc: acc["sum"].cast("long"))
    return out.withColumn("n_repeat_words", F.when(F.col("__repeats"), covered).otherwise(F.lit(0).cast("long"))).drop(
        "__hashes", "__two", "__four", "__windows", "__lines", "__repeats", "__sorted")


def class_counts() -> Column:
    """Digits, sentence marks, other marks, white space, letters."""
    plain = F.length("__plain").cast("long")
    digits = plain - F.length(F.translate("__plain", DIGITS, ""))
    stops = plain - F.length(F.translate("__plain", STOPS, ""))
    space = F.length("__text") - F.col("word_chars")
    return F.array(digits, stops, plain - digits - stops, space, F.col("word_chars") - plain)


def word_counts(docs: DataFrame, lang: str) -> DataFrame:
    """__hist: the different words of __words with their counts, as (key, n); a key is the hash
    of language and lower-case word."""
    key = lambda w: F.xxhash64(F.col(lang), F.lower(w))
    out = docs.withColumn("__keys", F.sort_array(F.transform("__words", key)))
    out = out.withColumn("__ends", F.filter(F.transform("__keys", lambda x, i: i), lambda i: ~F.get("__keys", i).eqNullSafe(F.get("__keys", i + 1))))
    return out.withColumn("__hist", F.transform("__ends", lambda e, j: F.struct(
        F.get("__keys", e).alias("key"), (e - F.coalesce(F.get("__ends", j - 1), F.lit(-1))).alias("n")))).drop("__keys", "__ends")


def shares(counts: Column) -> Column:
    """Counts as shares of their sum (all zero where the sum is)."""
    return F.transform(counts, lambda x: F.when(long_sum(counts) > 0, x / long_sum(counts)).otherwise(0.0))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Distance of two share arrays of equal length."""
    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    terms = F.zip_with(p, q, lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)))


def expected_term(rate: float) -> float:
    """Expected term of a word's divergence, as a part of ``rate``, its expected count in a draw."""
    total, chance = 0.0, math.exp(-rate)
    for k in range(int(rate + 12 * math.sqrt(rate)) + 20):
        seen = k * math.log2(2 * k / (k + rate)) if k else 0.0
        total += chance * (seen + rate * math.log2(2 * rate / (k + rate))) / 2
        chance *= rate / (k + 1)
    return total / rate


def chance_levels(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """ref_lang and ref_chance: expected word divergence of 2^0, 2^1, ... words drawn from the
    reference, from the words' counts."""
    steps = F.array(*(F.lit(expected_term(2 ** (j / 4))) for j in RATES))
    rate = F.pow(F.lit(2.0), F.col("level")) * F.col("n") / F.col("ref_n")
    place = 4 * F.log2(rate) - RATES[0]
    low = F.floor(place).cast("int")
    between = F.get(steps, low) + (place - low) * (F.get(steps, low + 1) - F.get(steps, low))
    term = F.when(place < 0, 1.0).when(place >= len(RATES) - 1, 1 / (8 * math.log(2)) / rate).otherwise(between)
    spectrum = counts.groupBy("ref_lang", "n").agg(F.count("*").alias("words")).join(totals, "ref_lang")
    sums = spectrum.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))).groupBy("ref_lang", "level").agg(
        F.sum(F.col("words") * F.col("n") / F.col("ref_n") * term).alias("sum"))
    return sums.groupBy("ref_lang").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("level", "sum"))), lambda x: x["sum"]).alias("ref_chance"))


def word_limit(chance: Column, n_words: Column) -> Column:
    """Limit of the word distance of a text of ``n_words`` words."""
    level = F.log2(n_words)
    low = F.floor(level).cast("int")
    drawn = F.get(chance, low) + (level - low) * (F.get(chance, low + 1) - F.get(chance, low))
    return F.sqrt(drawn + WORD_SHARE * WORD_SHARE * (1 - drawn))


def word_distances(measured: DataFrame, counts: DataFrame, totals: DataFrame, lang: str) -> DataFrame:
    """__row and word_distance of the documents to be judged, from all of their words."""
    spark = measured.sparkSession
    every = counts.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT_PART >= every
    frequent = F.broadcast(counts.where(hot).select("key", F.col("n").alias("ref_count")))
    entries = (
        measured.where(F.col("n_words") >= MIN_WORDS).select("__row", "n_words", "__hist", F.col(lang).alias("ref_lang"))
        .join(totals, "ref_lang")
        .select("__row", "n_words", "ref_n", F.explode("__hist").alias("__entry"))
        .select("__row", "n_words", "ref_n", "__entry.key", F.col("__entry.n").alias("count")))
    p, q = F.col("count") / F.col("n_words"), F.col("ref_count") / F.col("ref_n")
    # both terms of a word, without the half that q gives where the text lacks the word
    term = (p * F.log2(2 * p / (p + q)) + q * F.log2(2 * q / (p + q)) - q) / 2
    summed = lambda rows: rows.groupBy("__row").agg(F.sum(F.round(term * UNIT).cast("long")).alias("sum"))
    near = summed(entries.join(frequent, "key"))
    rest = summed(entries.join(frequent, "key", "left_anti").join(
        counts.where(~hot).select("key", F.col("n").alias("ref_count")), "key"))
    return staged(
        near.unionByName(rest).groupBy("__row").agg(
            F.sqrt(F.greatest(F.lit(0.0), F.lit(0.5) + F.sum("sum") / UNIT)).alias("word_distance")),
        fresh_folder(spark, "quality-distances"))


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
VERDICT = ["base_failed", "class_distance", "word_distance", "kept"]


def judge(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """``docs`` without the text, with the base counts, ``base_failed``, ``class_distance``,
    ``word_distance`` (null where the guards apply) and ``kept``; input columns of these names
    are replaced."""
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in [*MEASURES, *VERDICT, text]]
    counted = word_counts(with_base_counts(docs.select(*kept, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))), lang)
    measured = staged(
        counted.select(*kept, *MEASURES, class_counts().alias("__classes"), F.monotonically_increasing_id().alias("__row"),
                       F.when(F.col(lang).isNotNull(), F.col("__hist")).alias("__hist")),
        fresh_folder(spark, "quality-measures"), **WIDE_DICTIONARY)
    total = lambda name, n: F.array(*(F.sum(F.col(name)[i]) for i in range(n)))
    totals = staged(
        measured.where(F.col(lang).isNotNull()).groupBy(F.col(lang).alias("ref_lang")).agg(
            F.sum("n_words").alias("ref_n"), total("__classes", 5).alias("classes"))
        .where(F.col("ref_n") >= MIN_REFERENCE).select("ref_lang", "ref_n", shares(F.col("classes")).alias("ref_classes")),
        fresh_folder(spark, "quality-totals"))
    sizes = totals.select("ref_lang", "ref_n")
    counts = staged(
        measured.select(F.col(lang).alias("ref_lang"), F.explode("__hist").alias("__entry"))
        .groupBy("ref_lang", "__entry.key").agg(F.sum("__entry.n").alias("n")),
        fresh_folder(spark, "quality-words"))
    refs = staged(totals.join(chance_levels(counts, sizes), "ref_lang"), fresh_folder(spark, "quality-references"))
    distances = word_distances(measured, counts, sizes, lang)
    judged = F.col("ref_lang").isNotNull() & (F.col("n_words") >= MIN_WORDS)
    out = measured.join(refs, F.col(lang) == F.col("ref_lang"), "left").join(distances, "__row", "left").select(
        *kept, *MEASURES,
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        F.when(judged, jensen_shannon(shares(F.col("__classes")), F.col("ref_classes"))).alias("class_distance"),
        "word_distance",
        F.when(judged, word_limit(F.col("ref_chance"), F.col("n_words"))).alias("__word_limit"))
    far = (F.coalesce("class_distance", F.lit(0.0)) > CLASS_LIMIT) | F.coalesce(F.col("word_distance") > F.col("__word_limit"), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~far).drop("__word_limit")
