"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

Each source has a size (bytes of its texts) and a target weight, its wanted share of the
mixture. Its mean repetition rate is weight x wanted total / size. Every document draws a
uniform number from a hash of (seed, id) and inverts the Poisson distribution of that mean,
so the expected share of a source is its weight, whole and fractional rates alike, and a
rerun or a recomputed task draws the same counts. A document is exploded by its count and
the copies are dealt and sorted by a hash of (seed, id, copy): a global shuffle.

Only two numbers per source are aggregated (partial sums map-side, so a hot source costs
nothing extra). The distribution of a source is a table of the counts that 52 bits can reach, 12
deviations and 40 about the mean, built by running sums of log ratios (``count_table``): its length
grows with the root of the rate. It is searched through a guide table: [0, 1) is cut into
``GUIDE`` parts or more, and a document meets only the counts whose interval touches its number's
part, by a join on (source, part), broadcast or not as the table's measured size allows. Where a rate
is above ``CHUNK``, documents are dealt in chunks of that many copies before they are exploded, so
that copies of one document come from many tasks.

Defined cases: a null source is a source of its own. A null text has size 0. A source of
total size 0, or one that the given weights lack, or with a null, negative or NaN weight,
has rate 0. Rates of any size are drawn (at 1e7 a table has about 76,000 rows). Rows with equal ids draw equal counts. A null id hashes as empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from plantwise.llm.common import fresh_folder, staged

HASH_DIGITS = 13  # hex digits of md5: 52 bits, exact in a double
GUIDE = 64  # parts of a source's guide table, at least
CHUNK = 4096  # copies that are exploded from one row


def hash_number(seed: int, *parts: Column) -> Column:
    """The first 52 bits of md5 over the seed and the parts, joined by bars, as a long."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, HASH_DIGITS), 16, 10).cast("long")


def source_sizes(docs: DataFrame, source: str, size: Column) -> DataFrame:
    return docs.groupBy(F.col(source).alias("mix_source")).agg(
        F.sum(F.coalesce(size, F.lit(0)).cast("double")).alias("mix_size"))


def repetition_rates(sizes: DataFrame, weights: DataFrame | None, alpha: float, total: float) -> DataFrame:
    """``mix_source, mix_rate``. ``weights``: (source, weight); else weight = size^alpha."""
    if weights is None:
        weighted = sizes.withColumn("mix_weight", F.when(F.col("mix_size") > 0, F.pow("mix_size", F.lit(alpha))).otherwise(0.0))
    else:
        w = weights.toDF("w_source", "w_weight").groupBy("w_source").agg(F.sum("w_weight").alias("w_weight"))
        weight = F.col("w_weight").cast("double")
        weighted = sizes.join(w, F.col("mix_source").eqNullSafe(F.col("w_source")), "left").select(
            "mix_source", "mix_size", F.when((weight > 0) & ~F.isnan(weight) & (F.col("mix_size") > 0), weight).otherwise(0.0).alias("mix_weight"))
    sums = weighted.agg(F.sum("mix_size").alias("all_size"), F.sum("mix_weight").alias("all_weight"))
    rate = F.col("mix_weight") / F.col("all_weight") * F.col("all_size") * F.lit(float(total)) / F.col("mix_size")
    # one row of two sums meets one row per source
    return weighted.join(F.broadcast(sums)).select(
        "mix_source", F.when(F.col("mix_weight") > 0, rate).otherwise(0.0).alias("mix_rate"))


def count_table(rates: DataFrame) -> DataFrame:
    """``mix_source, k, low, high``: count k is drawn by numbers in [low, high). Probabilities follow from
    their ratios rate / k, summed as logarithms from the first count that can be reached, and are
    divided by their sum; sources of rate 0 have no rows."""
    rate, spread = F.col("mix_rate"), 12 * F.sqrt("mix_rate") + 40
    first = F.greatest(F.floor(rate - spread), F.lit(0)).cast("long")
    listed = rates.where(rate > 0).select("mix_source", "mix_rate", first.alias("first"), F.explode(F.sequence(first, F.ceil(rate + spread).cast("long"))).alias("k"))
    whole = Window.partitionBy("mix_source")
    upto = whole.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ratio = F.when(F.col("k") > F.col("first"), F.log(rate / F.col("k"))).otherwise(0.0)
    logs = listed.withColumn("log", F.sum(ratio).over(upto))
    sums = logs.withColumn("sum", F.sum(F.exp(F.col("log") - F.max("log").over(whole))).over(upto))
    high = sums.withColumn("high", F.col("sum") / F.max("sum").over(whole))
    return high.select("mix_source", "k", F.lag("high", 1, 0.0).over(whole.orderBy("k")).alias("low"), "high")


def guide_table(counts: DataFrame) -> DataFrame:
    """``mix_source, mix_part, mix_parts, mix_choice``: per part of [0, 1) the counts (high, k) whose
    interval touches it, in order. A source has at least as many parts as counts."""
    sized = counts.withColumn("mix_parts", F.greatest(F.lit(GUIDE), F.count(F.lit(1)).over(Window.partitionBy("mix_source"))))
    part = lambda x: F.least(F.floor(F.col(x) * F.col("mix_parts")), F.col("mix_parts") - 1).cast("long")
    dealt = sized.where("high > low").withColumn("mix_part", F.explode(F.sequence(part("low"), part("high"))))
    return dealt.groupBy("mix_source", "mix_parts", "mix_part").agg(F.sort_array(F.collect_list(F.struct("high", "k"))).alias("mix_choice"))


def mix(docs: DataFrame, weights: DataFrame | None = None, alpha: float = 0.5, total: float = 1.0, seed: int = 17,
        doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mixture: ``docs``' columns, ``copy`` (from 1) and ``shuffle_key`` (long), dealt and
    sorted by that key. ``total``: wanted size over the input's. Input columns named ``copy``
    or ``shuffle_key`` are replaced."""
    spark = docs.sparkSession
    docs = docs.select(*(c for c in docs.columns if c not in ("copy", "shuffle_key")))
    sizes = source_sizes(docs, source, F.octet_length(F.col(text).cast("string")))
    rates = staged(repetition_rates(staged(sizes, fresh_folder(spark, "mix-sizes")), weights, alpha, total), fresh_folder(spark, "mix-rates"))
    guide = staged(guide_table(count_table(rates)), fresh_folder(spark, "mix-guide"))
    parts = guide.groupBy("mix_source").agg(F.first("mix_parts").alias("own_parts")).withColumnRenamed("mix_source", "own_source")
    u = (hash_number(seed, F.col(doc_id)) + F.lit(0.5)) / F.lit(float(16 ** HASH_DIGITS))
    drawn = docs.withColumn("mix_u", u).join(parts, F.col(source).eqNullSafe(F.col("own_source")))
    own_part = F.least(F.floor(F.col("mix_u") * F.col("own_parts")), F.col("own_parts") - 1).cast("long")
    met = drawn.withColumn("own_part", own_part).join(
        guide, F.col("own_source").eqNullSafe(F.col("mix_source")) & (F.col("own_part") == F.col("mix_part")))
    count = F.filter("mix_choice", lambda c: F.col("mix_u") < c["high"])[0]["k"]
    counted = met.withColumn("mix_count", count).where("mix_count > 0").select(*docs.columns, "mix_count")
    dealt = counted.withColumn("mix_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(mix_count - 1) div {CHUNK}"))))
    if (rates.agg(F.max("mix_rate")).first()[0] or 0.0) > CHUNK:
        dealt = dealt.repartition(F.col(doc_id), F.col("mix_chunk"))
    own = F.sequence(F.col("mix_chunk") * CHUNK + 1, F.least((F.col("mix_chunk") + 1) * CHUNK, F.col("mix_count")))
    counted = dealt.select(*docs.columns, F.explode(own.cast("array<int>")).alias("copy")).withColumn(
        "shuffle_key", hash_number(seed + 1, F.col(doc_id), F.col("copy")))
    return counted.repartition("shuffle_key").sortWithinPartitions("shuffle_key", doc_id, "copy")
