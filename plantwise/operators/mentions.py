"""Money mentions as corpus jobs (T1, T4, T5): explode mentions, parse, convert by the rate in force
at the moment, aggregate. Per-row work is native expressions. Rates are looked up per distinct
moment (``rates.with_rate``): texts aren't dealt by time, and T5 adds amounts up per group and
moment before any rate is needed, so a hot pair or moment is one row of the lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plantwise.functions.text import money_mentions, parse_money, rewrite_money_frame
from plantwise.operators.rates import with_rate


def explode_mentions(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per dollar mention: position, mention text and parsed amount."""
    return df.select(*keep, F.posexplode(money_mentions(F.col(text_col))).alias("pos", "mention")).withColumn(
        "amount", parse_money(F.col("mention"))
    )


def rewrite_texts(df: DataFrame, text_col: str = "text", rate_col: str = "rate", out_col: str = "rewritten") -> DataFrame:
    """T4 over a text column with a per-row rate column."""
    return rewrite_money_frame(df, text_col, rate_col, out_col)


def rewrite_texts_asof(texts: DataFrame, primary: DataFrame, secondary: DataFrame, text_col: str = "text", key: str = "pair",
                       ts: str = "ts", out_col: str = "rewritten", **limits: int) -> DataFrame:
    """T4 with the rate in force at each text's ``ts`` (J2): a text whose moment has no fresh quote stays as
    it is. Only texts with a dollar sign ask for a rate."""
    rated = with_rate(texts, primary, secondary, key, ts, F.col(text_col).contains("$"), **limits)
    return rewrite_money_frame(rated, text_col, "rate", out_col)


def converted_by_group_asof(mentions: DataFrame, primary: DataFrame, secondary: DataFrame, group_cols: tuple[str, ...],
                            key: str = "pair", ts: str = "ts", **limits: int) -> DataFrame:
    """T5 with the rate in force at each mention's ``ts`` (J2): mentions, parsed and converted ones, and both
    totals per group. Amounts without a fresh quote count in dollars only."""
    per_moment = mentions.groupBy(*group_cols, key, ts).agg(
        F.count(F.lit(1)).alias("_n"), F.count("amount").alias("_parsed"), F.sum("amount").alias("_usd"))
    rated = with_rate(per_moment, primary, secondary, key, ts, F.col("_parsed") > 0, **limits)
    converted = F.when(F.col("rate").isNotNull(), F.col("_parsed")).otherwise(0)
    return rated.groupBy(*group_cols).agg(
        F.sum("_n").alias("n_mentions"), F.sum("_parsed").alias("n_parsed"), F.sum(converted).alias("n_converted"),
        F.sum("_usd").alias("usd_total"), F.sum(F.col("_usd") * F.col("rate")).alias("brl_total"))


def converted_by_group(
    mentions: DataFrame,
    rates: DataFrame,
    group_cols: tuple[str, ...],
    date_col: str = "order_date",
    rate_date_col: str = "rate_date",
) -> DataFrame:
    """T5 where one rate per day is given: converted spend per group = sum(amount x rate of the day).

    Amounts and rates keep their given precision (doubles, as parsed and as T4 converts
    them). The rate table has one row per day; the join's kind is left to its measured size.
    """
    r = rates.select(F.col(rate_date_col).alias(date_col), "rate")
    joined = mentions.join(r, [date_col], "left")
    return joined.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n_mentions"),
        F.count("amount").alias("n_parsed"),
        F.sum("amount").alias("usd_total"),
        F.sum(F.col("amount") * F.col("rate")).alias("brl_total"),
    )


def mention_census(df: DataFrame, group_cols: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """T1 over a corpus of whole texts: per group, documents, dollar signs, mentions and
    mentions that parse (``$`` junk without digits is not a mention). Map-side partial
    aggregation; texts are never exploded or moved."""
    from plantwise.functions.text import parse_money_array

    text = F.col(text_col)
    found = money_mentions(text)
    staged = df.select(
        *group_cols,
        (F.length(text) - F.length(F.replace(text, F.lit("$"), F.lit("")))).alias("_dollars"),
        found.alias("_m"),
    )
    staged = staged.select(*group_cols, "_dollars", F.size("_m").alias("_n"),
                           F.size(F.filter(parse_money_array(F.col("_m")), lambda v: v.isNotNull())).alias("_ok"))
    return staged.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum("_dollars").alias("n_dollar_signs"),
        F.sum("_n").cast("bigint").alias("n_mentions"),
        F.sum("_ok").cast("bigint").alias("n_parsed"),
    )
