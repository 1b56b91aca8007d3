"""Link segmentation, classification and census (T6-T13) as explode + aggregate jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plantwise.functions.text import (
    LINK_SEGMENT_PATTERN,
    answer_cleanup,
    drive_direct_url,
    drive_id,
    link_parts,
    link_tag,
    link_url,
    media_type,
    render_kind,
    rewrite_money_frame,
)

HOST_PATTERN = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]+)"


def explode_links(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per link with its tag, cleaned URL, media type, render kind and
    Drive id."""
    links = df.select(*keep, F.posexplode(link_parts(F.col(text_col))).alias("pos", "link"))
    links = links.select(*keep, "pos", link_tag(F.col("link")).alias("tag"), link_url(F.col("link")).alias("url"))
    links = links.withColumn("media_type", media_type(F.col("url")))
    links = links.withColumn("render_kind", render_kind(F.col("tag"), F.col("media_type")))
    return links.withColumns(
        {"drive_id": drive_id(F.col("url")), "direct_url": drive_direct_url(F.col("url"), F.col("render_kind"))})


def answer_parts(df: DataFrame, text_col: str = "text", rate_col: str = "rate", keep: tuple[str, ...] = ()) -> DataFrame:
    """T6 with T12 and T4: a text as its parts in order, links and the stretches between them.

    One row per part: ``pos``, ``kind`` ('text' or 'link'), ``text`` (cleaned, with converted
    amounts; blank stretches are dropped) and the link columns (null for text parts)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = df.select(*keep, rate_col, F.split(text, LINK_SEGMENT_PATTERN, -1).alias("_t"), link_parts(text).alias("_l"))
    parts = F.flatten(F.transform("_t", lambda t, i: F.array(
        F.struct(F.lit("text").alias("kind"), t.alias("part")), F.struct(F.lit("link").alias("kind"), F.get("_l", i).alias("part")))))
    rows = split.select(*keep, rate_col, F.posexplode(F.filter(parts, lambda p: p["part"].isNotNull())).alias("pos", "p"))
    rows = rows.select(*keep, rate_col, "pos", "p.kind", F.when(F.col("p.kind") == "text", answer_cleanup(F.col("p.part"))).alias("_clean"),
                       F.when(F.col("p.kind") == "link", F.col("p.part")).alias("link"))
    rows = rows.filter((F.col("kind") == "link") | F.col("_clean").isNotNull())
    rows = rewrite_money_frame(rows, "_clean", rate_col, "text")
    tag, url = link_tag(F.col("link")), link_url(F.col("link"))
    rows = rows.withColumns({"tag": tag, "url": url}).withColumn("media_type", media_type(F.col("url")))
    rows = rows.withColumn("render_kind", render_kind(F.col("tag"), F.col("media_type")))
    is_link = F.col("kind") == "link"
    out = {c: F.when(is_link, F.col(c)).alias(c) for c in ("tag", "url", "media_type", "render_kind")}
    return rows.select(*keep, "pos", "kind", "text", *out.values(), drive_direct_url(F.col("url"), F.col("render_kind")).alias("direct_url"))


def link_counts(df: DataFrame, group_cols: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """T6 over a corpus: per group its texts, those with a link, and links. Texts are neither exploded
    nor moved."""
    found = df.select(*group_cols, F.coalesce(F.size(link_parts(F.col(text_col))), F.lit(0)).alias("_n"))
    return found.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n_texts"), F.count(F.when(F.col("_n") > 0, 1)).alias("n_with_link"),
        F.sum(F.greatest("_n", F.lit(0))).cast("bigint").alias("n_links"))


def link_census(links: DataFrame) -> DataFrame:
    """Links per render kind, media type and host (partial aggregation map-side)."""
    host = F.nullif(F.regexp_extract(F.col("url"), HOST_PATTERN, 1), F.lit(""))
    return links.groupBy("render_kind", "media_type", host.alias("host")).agg(F.count(F.lit(1)).alias("n_links"))
