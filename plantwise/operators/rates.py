"""As-of rate lookup with a staleness limit and a fallback source.

For every demand time t: the newest primary quote with ts <= t and age < its limit,
else the newest secondary quote with ts <= t and age < its limit, else null.

Exact as-of without a range join or a cross product, reading every source once:

1. quotes and demands become one tagged stream, dealt once by (pair, bucket of time); a hot
   pair is one partition per bucket, and a narrow bucket bounds every partition by the data
   rate;
2. inside a bucket a running ``last(quote, ignorenulls)`` gives each demand the newest quote
   of its own bucket;
3. the *carry* of a bucket, the newest quote of any earlier one, comes from the buckets'
   closing quotes in two levels: a running ``last`` over the closings of a span of
   2^SPAN_BITS buckets, and one over the closings of spans. Closings are aggregated from the stream as it
   was dealt (the same shuffle files, not the sources), one row per bucket and pair; no
   window sees more rows than a span has buckets or the time has spans;
4. demands take their bucket's carry by an equal-key join that keeps the stream's partitioning;
5. the age check is applied last, so the result is exact for any staleness limit and any
   bucket width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
QUOTE = "struct<_us:bigint,quote_id:bigint,rate:double>"
SPAN_BITS = 12


def epoch_micros(ts: str) -> Column:
    """Microseconds since the epoch, independent of the session time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, cast({ts} as timestamp_ntz))")


def carries(dealt: DataFrame, quotes: list[str]) -> DataFrame:
    """Per bucket of ``dealt`` the newest quote of any earlier bucket, for every column of ``quotes``."""
    order = F.struct("_us", "_kind", "_qid")
    closings = dealt.groupBy("_key", "_b").agg(
        *(F.max_by(q, F.when(F.col(q).isNotNull(), order)).alias(q) for q in quotes), F.count("_demand").alias("_demands"))
    spans = closings.withColumn("_span", F.shiftright("_b", SPAN_BITS))
    earlier = Window.unboundedPreceding, -1
    inside = Window.partitionBy("_key", "_span").orderBy("_b").rowsBetween(*earlier)
    within = spans.select("_key", "_b", "_span", "_demands", *(F.last(q, ignorenulls=True).over(inside).alias(q) for q in quotes))
    # spans without demands serve later ones; their number is used so that both readers of the
    # closings (and of the stream) need the same columns, and Spark runs one shuffle for both
    tops = spans.groupBy("_key", "_span").agg(
        *(F.max_by(q, F.when(F.col(q).isNotNull(), F.col("_b"))).alias(q) for q in quotes), F.sum("_demands").alias("_asked"))
    before = Window.partitionBy("_key").orderBy("_span").rowsBetween(*earlier)
    tops = tops.select("_key", "_span", "_asked", *(F.last(q, ignorenulls=True).over(before).alias(f"{q}_top") for q in quotes))
    return within.filter(F.col("_demands") > 0).join(tops.filter(F.col("_asked") > 0), ["_key", "_span"]).select(
        "_key", "_b", *(F.coalesce(q, f"{q}_top").alias(f"{q}_carry") for q in quotes))


def asof_sources(
    sources: dict[str, tuple[DataFrame, int]],
    demands: DataFrame,
    key: str = "pair",
    bucket_seconds: int = 300,
) -> DataFrame:
    """Newest fresh quote per demand for each source.

    ``sources``: name -> (quotes with key, ts, quote_id, rate; max age in seconds).
    ``demands``: key, ts (+ any other columns, carried through).
    Adds ``{name}_rate`` and ``{name}_id`` per source (null when no quote is fresh).
    A quote at exactly t counts; ties on ts are broken by quote id. Quotes without key or time never
    count, and a demand without them gets no rate.
    """
    width = int(bucket_seconds) * 1_000_000
    quotes = {n: f"_q_{n}" for n in sources}
    packed = F.struct(*demands.columns)

    def tagged(df: DataFrame, kind: int, qid: Column, name: str | None, demand: Column) -> DataFrame:
        timed = df.withColumn("_us", epoch_micros("ts"))
        own = F.struct("_us", "quote_id", "rate").cast(QUOTE) if name else None
        # never null, so that no reader of the stream gets a null test of its own
        bucket = F.coalesce(F.floor(F.col("_us") / F.lit(width)), F.lit(-1).cast("bigint"))
        return timed.select(
            F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"), bucket.alias("_b"), "_us", F.lit(kind).alias("_kind"),
            qid.cast("bigint").alias("_qid"), *((own if n == name else F.lit(None).cast(QUOTE)).alias(q) for n, q in quotes.items()),
            demand.alias("_demand"))

    shape = demands.select(packed.alias("d")).schema["d"].dataType
    stream = tagged(demands, 1, F.lit(None), None, packed)
    for n, (q, _) in sources.items():
        known = q.select(key, "ts", "quote_id", "rate").filter(F.col(key).isNotNull() & F.col("ts").isNotNull())
        stream = stream.unionByName(tagged(known, 0, F.col("quote_id"), n, F.lit(None).cast(shape)))
    dealt = stream.repartition("_key", "_b")

    inside = Window.partitionBy("_key", "_b").orderBy("_us", "_kind", "_qid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = dealt.select("_key", "_b", "_us", "_demand", *(F.last(q, ignorenulls=True).over(inside).alias(q) for q in quotes.values()))
    asked = local.filter(F.col("_demand").isNotNull())
    found = asked.join(carries(dealt, list(quotes.values())), ["_key", "_b"], "left")

    out = [F.col(f"_demand.{c}").alias(c) for c in demands.columns]
    for n, (_, age) in sources.items():
        newest = F.coalesce(F.col(quotes[n]), F.col(f"{quotes[n]}_carry"))
        fresh = F.col(f"_demand.{key}").isNotNull() & ((F.col("_us") - newest["_us"]) < F.lit(int(age) * 1_000_000))
        out += [F.when(fresh, newest["rate"]).alias(f"{n}_rate"), F.when(fresh, newest["quote_id"]).alias(f"{n}_id")]
    return found.select(*out)


def fx_asof(
    primary: DataFrame,
    secondary: DataFrame,
    demands: DataFrame,
    primary_max_age: int = 600,
    secondary_max_age: int = 3600,
    key: str = "pair",
    bucket_seconds: int = 300,
) -> DataFrame:
    """Primary quote if fresh, else secondary if fresh, else null; with its source."""
    out = asof_sources({"primary": (primary, primary_max_age), "secondary": (secondary, secondary_max_age)},
                       demands, key, bucket_seconds)
    return out.withColumns(
        {
            "rate": F.coalesce(F.col("primary_rate"), F.col("secondary_rate")),
            "source": F.when(F.col("primary_rate").isNotNull(), F.lit("primary"))
            .when(F.col("secondary_rate").isNotNull(), F.lit("secondary")),
        }
    )


def with_rate(df: DataFrame, primary: DataFrame, secondary: DataFrame, key: str = "pair", ts: str = "ts",
              needed: Column | None = None, **limits: int) -> DataFrame:
    """``df`` with the ``rate`` in force at its ``ts`` and that rate's ``source`` (both null where no quote is
    fresh). Only the distinct moments of rows that need a rate go through the as-of, so wide
    rows (texts) aren't dealt by time, and one moment of many rows is looked up once."""
    rows = df if needed is None else df.filter(needed)
    moments = rows.select(F.col(key), F.col(ts).alias("ts")).dropna().distinct()
    found = fx_asof(primary, secondary, moments, key=key, **limits).select(key, F.col("ts").alias(ts), "rate", "source")
    return df.join(found, [key, ts], "left")
