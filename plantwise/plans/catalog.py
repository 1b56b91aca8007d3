"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each query reads the driver's tables (or views Spark derives from them), runs one or more
operators of the library and rounds doubles to 6 decimals so that results can be compared
with the SQL oracle regardless of summation order.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, FloatType

from plantwise.functions import cleaning as C
from plantwise.operators import activity as act
from plantwise.operators import facts as fx
from plantwise.operators import measures as ms
from plantwise.operators import reconcile as rc
from plantwise.sources.fixtures import PERIOD, TARGET_OVERALL, TARGETS_BY_SHIFT, sheet_raw

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Parameters of the checks (the library takes them as arguments).
ONE_DAY = "2024-01-10"
RECENT_SINCE = "2024-01-20"
POINT = ("105- CX-360G", "2024-01-10", "Turno A")
PREVIOUS_GAP_POINTS = 5.20
TARGET_OEE = 0.6247
PERIODS = {
    "inclusive": (PERIOD[0], PERIOD[1], "both"),
    "half_open": (PERIOD[0], PERIOD[1], "left"),
    "from_next_day": ("2024-01-03", PERIOD[1], "both"),
}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn

    return deco


def round_doubles(df: DataFrame, decimals: int = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(F.round(F.col(f.name), decimals).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def rounded(fn):
    def wrapper(spark, sf_dir):
        return round_doubles(fn(spark, sf_dir))

    wrapper.__name__ = fn.__name__
    wrapper.__doc__ = fn.__doc__
    return wrapper


# ---------------------------------------------------------------- populations
def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned sheet (written once, partitioned by date)."""
    from plantwise.sources.fixtures import typed_sheet_table

    return typed_sheet_table(spark, sf_dir)


def verified_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Period, Mon-Fri, shifts A/B, hours 6-21 (before the activity filter)."""
    return fx.filter_facts(typed(spark, sf_dir), period=PERIOD, weekdays_below=5)


def period_facts(spark: SparkSession, sf_dir: str, validate: bool = True, weekdays_below=None) -> DataFrame:
    return fx.filter_facts(typed(spark, sf_dir), period=PERIOD, validate=validate, weekdays_below=weekdays_below)


# ---------------------------------------------------------------- A: aggregations
@register("oee_overall")
@rounded
def q_oee_overall(spark, sf_dir):
    """A1 flagship: overall mean TEEP/OEE of the verified population (one scan: slot
    sums, slot activity on the small table, sums / counts over active slots)."""
    return act.active_means(verified_population(spark, sf_dir))


@register("oee_by_shift")
@rounded
def q_oee_by_shift(spark, sf_dir):
    return act.active_means(verified_population(spark, sf_dir), ("turno",))


@register("oee_by_day_shift")
@rounded
def q_oee_by_day_shift(spark, sf_dir):
    return act.active_means(verified_population(spark, sf_dir), ("data", "turno"))


@register("mean_of_daily")
@rounded
def q_mean_of_daily(spark, sf_dir):
    return ms.mean_of_means_two_levels(verified_population(spark, sf_dir), "data", "turno")


@register("mean_of_machine")
@rounded
def q_mean_of_machine(spark, sf_dir):
    return ms.mean_of_means_two_levels(verified_population(spark, sf_dir), "maquina", "turno")


@register("weighted_daily")
@rounded
def q_weighted_daily(spark, sf_dir):
    return ms.weighted_group_means(verified_population(spark, sf_dir), "data", "turno", "teep")


@register("slot_activity")
@rounded
def q_slot_activity(spark, sf_dir):
    return act.slot_activity(period_facts(spark, sf_dir, weekdays_below=5))


@register("rows_per_date")
@rounded
def q_rows_per_date(spark, sf_dir):
    return act.active_means(verified_population(spark, sf_dir), ("data",), measures=()).orderBy("data")


@register("shift_sets")
@rounded
def q_shift_sets(spark, sf_dir):
    return ms.shift_sets(period_facts(spark, sf_dir, weekdays_below=5))


@register("filter_funnel")
@rounded
def q_filter_funnel(spark, sf_dir):
    return ms.filter_funnel(typed(spark, sf_dir), PERIOD)


@register("threshold_sweep")
@rounded
def q_threshold_sweep(spark, sf_dir):
    return ms.threshold_sweep(period_facts(spark, sf_dir, validate=False), target_oee=TARGET_OEE)


@register("scope_means")
@rounded
def q_scope_means(spark, sf_dir):
    return ms.scope_means(typed(spark, sf_dir), PERIOD)


@register("dates_present")
@rounded
def q_dates_present(spark, sf_dir):
    return ms.dates_present(typed(spark, sf_dir), PERIOD)


# ---------------------------------------------------------------- F: filters
@register("active_slots_global")
@rounded
def q_active_slots_global(spark, sf_dir):
    """Rows kept by the global slot filter, summarised per shift."""
    return act.active_means(period_facts(spark, sf_dir, weekdays_below=5), ("turno",), "global")


@register("active_slots_shift")
@rounded
def q_active_slots_shift(spark, sf_dir):
    return act.active_means(period_facts(spark, sf_dir, weekdays_below=5), ("turno",), "shift")


@register("active_rows_global")
@rounded
def q_active_rows_global(spark, sf_dir):
    """the rows themselves that the global slot filter keeps."""
    return act.keep_active(verified_population(spark, sf_dir), "global").select("maquina", "data", "turno", "hora", "teep", "oee")


@register("active_rows_shift")
@rounded
def q_active_rows_shift(spark, sf_dir):
    """F8: the rows themselves that the per-shift slot filter keeps."""
    return act.keep_active(verified_population(spark, sf_dir), "shift").select("maquina", "data", "turno", "hora", "teep", "oee")


@register("active_hours_one_day")
@rounded
def q_active_hours_one_day(spark, sf_dir):
    facts = fx.filter_facts(typed(spark, sf_dir), weekdays_below=5)
    return act.active_hours_one_day(facts, ONE_DAY).select("maquina", "data", "turno", "hora", "teep", "oee")


@register("valid_rows")
@rounded
def q_valid_rows(spark, sf_dir):
    """rows that pass the machine and date tests."""
    raw = sheet_raw(spark, sf_dir)
    typed = fx.typed_facts(raw, validate=True)
    return typed.select("maquina", "data", "oee")


@register("raw_population")
@rounded
def q_raw_population(spark, sf_dir):
    """F1': subtotal and machine-less rows take part."""
    return ms.means_by(fx.filter_facts(typed(spark, sf_dir), period=PERIOD, validate=False), ["turno"])


@register("recent_machines")
@rounded
def q_recent_machines(spark, sf_dir):
    """machines seen on or after a date (open-ended period)."""
    facts = fx.filter_facts(typed(spark, sf_dir), period=(RECENT_SINCE, None), shifts=None, hours=None)
    return facts.groupBy("maquina").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("data").alias("first_date"), F.max("data").alias("last_date")
    )


@register("positive_only_means")
@rounded
def q_positive_only_means(spark, sf_dir):
    return rc.positive_only_means(period_facts(spark, sf_dir, validate=False))


# ---------------------------------------------------------------- R: reconciliation
@register("method_comparison")
@rounded
def q_method_comparison(spark, sf_dir):
    return rc.method_comparison(period_facts(spark, sf_dir), TARGET_OVERALL)


@register("closest_method")
@rounded
def q_closest_method(spark, sf_dir):
    return rc.closest_method(rc.method_comparison(period_facts(spark, sf_dir), TARGET_OVERALL))


@register("daytype_activity_grid")
@rounded
def q_daytype_activity_grid(spark, sf_dir):
    return rc.daytype_activity_grid(period_facts(spark, sf_dir), TARGET_OVERALL)


@register("activity_mode_fit")
@rounded
def q_activity_mode_fit(spark, sf_dir):
    return rc.activity_mode_fit(period_facts(spark, sf_dir, weekdays_below=5), TARGETS_BY_SHIFT)


@register("tolerance_bands")
@rounded
def q_tolerance_bands(spark, sf_dir):
    """R5 + R7 on the overall and per-shift verified means."""
    values = act.active_means(verified_population(spark, sf_dir), ("turno",), measures=("teep",),
                              with_total=True).withColumnRenamed("turno", "scope")
    targets = {"all": TARGET_OVERALL, **TARGETS_BY_SHIFT}
    tmap = F.create_map(*[F.lit(x) for kv in targets.items() for x in (kv[0], float(kv[1]))])
    values = values.withColumn("target", F.element_at(tmap, F.col("scope")))
    return rc.tolerance_bands(values, "teep_mean", F.col("target"), PREVIOUS_GAP_POINTS)


@register("period_sensitivity")
@rounded
def q_period_sensitivity(spark, sf_dir):
    facts = fx.filter_facts(typed(spark, sf_dir), period=("2024-01-02", PERIOD[1]))
    return rc.period_sensitivity(facts, PERIODS)


@register("teep_formula_variants")
@rounded
def q_teep_formula_variants(spark, sf_dir):
    out = rc.teep_formula_variants(period_facts(spark, sf_dir), TARGET_OVERALL)
    return out.withColumn(
        "matched", rc.first_match(F.col("teep_active"), F.col("teep_file"), TARGET_OVERALL,
                                  ("active_formula", "sheet_column", "none"))
    )


# ---------------------------------------------------------------- C: cleaning
def _sheet_named(spark, sf_dir):
    raw = sheet_raw(spark, sf_dir)
    return raw.select(F.col("c0").cast("bigint").alias("row_id"), *[F.col(f"c{i}") for i in range(1, 12)])


@register("clean_percent")
@rounded
def q_clean_percent(spark, sf_dir):
    s = _sheet_named(spark, sf_dir)
    return s.select("row_id", *[C.percent_fraction(f"c{i}").alias(n) for i, n in
                                zip(range(7, 12), fx.PERCENT_COLUMNS)])


@register("clean_percent_null")
@rounded
def q_clean_percent_null(spark, sf_dir):
    s = _sheet_named(spark, sf_dir)
    return s.select("row_id", *[C.percent_fraction(f"c{i}", bad_as_zero=False).alias(n) for i, n in
                                zip(range(7, 12), fx.PERCENT_COLUMNS)])


@register("clean_date")
def q_clean_date(spark, sf_dir):
    s = _sheet_named(spark, sf_dir)
    return s.select("row_id", C.day_first_date("c2").alias("data"))


@register("shift_label")
def q_shift_label(spark, sf_dir):
    s = _sheet_named(spark, sf_dir)
    return s.select("row_id", C.shift_label("c3").alias("turno"))


@register("shift_valid")
def q_shift_valid(spark, sf_dir):
    s = _sheet_named(spark, sf_dir)
    return s.select("row_id", C.shift_valid("c3").alias("shift_ok"))


@register("clean_hour")
@rounded
def q_clean_hour(spark, sf_dir):
    s = _sheet_named(spark, sf_dir)
    return s.select("row_id", C.hour_value("c4").alias("hora"))


@register("oee_product")
def q_oee_product(spark, sf_dir):
    """A x P x Q next to the sheet's OEE (9 decimals: the product of three
    3-decimal fractions is exact there; and 4 decimals half-even)."""
    facts = fx.filter_facts(typed(spark, sf_dir), shifts=None, hours=None)
    return facts.select(
        "maquina", "data", "hora", "oee",
        F.round(C.oee_product("disponibilidade", "performance", "qualidade"), 9).alias("oee_calc"),
        C.oee_product("disponibilidade", "performance", "qualidade", decimals=4).alias("oee_calc_4"),
    )


@register("nz_components")
@rounded
def q_nz_components(spark, sf_dir):
    s = _sheet_named(spark, sf_dir)
    return s.select(
        "row_id",
        C.zero_as_null(C.percent_fraction("c8")).alias("performance_nz"),
        C.zero_as_null(C.percent_fraction("c9")).alias("qualidade_nz"),
    )


@register("calendar_attrs")
def q_calendar_attrs(spark, sf_dir):
    facts = fx.filter_facts(typed(spark, sf_dir), shifts=None, hours=None)
    return facts.select("data").distinct().select(
        "data",
        C.weekday_index("data").alias("weekday"),
        C.day_month_label("data").alias("day_month"),
        C.weekday_name("data").alias("weekday_name"),
        C.weekday_name_pt("data").alias("weekday_pt"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


# ---------------------------------------------------------------- T: money and rates
from plantwise.functions import text as T  # noqa: E402
from plantwise.operators import context as ctx  # noqa: E402
from plantwise.operators import links as lk  # noqa: E402
from plantwise.operators import mentions as mn  # noqa: E402
from plantwise.operators import rates as rt  # noqa: E402
from plantwise.sources import fixtures as fxt  # noqa: E402

CONTEXT_BUDGET = 1000


def _money_limits() -> dict[str, int]:
    return {"primary_max_age": fxt.PRIMARY_AGE, "secondary_max_age": fxt.SECONDARY_AGE, "bucket_seconds": 3600}


@register("money_mentions")
def q_money_mentions(spark, sf_dir):
    """Every dollar mention of every text ("R$" amounts are not mentions)."""
    return mn.explode_mentions(fxt.money_text(spark, sf_dir), keep=("o_orderkey",)).select("o_orderkey", "pos", "mention")


@register("money_parse")
@rounded
def q_money_parse(spark, sf_dir):
    return mn.explode_mentions(fxt.money_text(spark, sf_dir), keep=("o_orderkey",)).select("o_orderkey", "amount")


@register("money_format")
def q_money_format(spark, sf_dir):
    o = fxt.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", T.format_brl(F.col("o_totalprice")).alias("brl"))


@register("money_rewrite")
def q_money_rewrite(spark, sf_dir):
    """T4 on J2: amounts converted by the quote in force when the text was written; on days
    without a fresh quote texts stay as they are."""
    t = fxt.money_text(spark, sf_dir).select("o_orderkey", "text", "pair", "asked_at")
    return mn.rewrite_texts_asof(t, *fxt.money_quotes(spark, sf_dir), ts="asked_at", **_money_limits()).select("o_orderkey", "rewritten")


@register("money_by_group")
@rounded
def q_money_by_group(spark, sf_dir):
    """T5 on J2: spend per priority, converted mention by mention."""
    m = mn.explode_mentions(fxt.money_text(spark, sf_dir), keep=("o_orderpriority", "pair", "asked_at"))
    out = mn.converted_by_group_asof(m, *fxt.money_quotes(spark, sf_dir), ("o_orderpriority",), ts="asked_at", **_money_limits())
    return out.withColumns({c: F.round(c, 3) for c in ("usd_total", "brl_total")})


@register("fx_asof")
@rounded
def q_fx_asof(spark, sf_dir):
    primary, secondary, demands = fxt.rate_quotes(spark, sf_dir)
    return rt.fx_asof(primary, secondary, demands, 600, 3600)


# ---------------------------------------------------------------- T: links
def _links(spark, sf_dir):
    return lk.explode_links(fxt.link_text(spark, sf_dir), keep=("page_id",))


@register("link_mentions")
def q_link_mentions(spark, sf_dir):
    return _links(spark, sf_dir).select("page_id", "pos", "tag", "url")


@register("media_type")
def q_media_type(spark, sf_dir):
    return _links(spark, sf_dir).select("page_id", "url", "media_type")


@register("render_kind")
def q_render_kind(spark, sf_dir):
    return _links(spark, sf_dir).select("page_id", "tag", "media_type", "render_kind")


@register("drive_id")
def q_drive_id(spark, sf_dir):
    return _links(spark, sf_dir).select("page_id", "drive_id", "direct_url")


@register("strip_drive_links")
def q_strip_drive_links(spark, sf_dir):
    return fxt.link_text(spark, sf_dir).select("page_id", T.strip_drive_links(F.col("text")).alias("text"))


@register("answer_parts")
def q_answer_parts(spark, sf_dir):
    """T6 + T12 + T4: answers as ordered text and link parts, amounts converted."""
    return lk.answer_parts(fxt.answer_text(spark, sf_dir), keep=("page_id",))


@register("answer_cleanup")
def q_answer_cleanup(spark, sf_dir):
    conv = fxt.table(spark, sf_dir, "conversations")
    cleaned = conv.select("conv_id", "turn", T.answer_cleanup(F.col("text")).alias("text"))
    return cleaned.filter(F.col("text").isNotNull())


@register("links_in_texts")
def q_links_in_texts(spark, sf_dir):
    """T6 over whole texts as they are: page sources, conversations, documents and answers."""
    corpora = {"pages": ("pages", "html"), "conversations": ("conversations", "text"), "documents": ("documents", "text")}
    texts = [fxt.table(spark, sf_dir, t).select(F.lit(name).alias("corpus"), F.col(c).alias("text")) for name, (t, c) in corpora.items()]
    texts.append(fxt.link_text(spark, sf_dir).select(F.lit("answers").alias("corpus"), "text"))
    whole = texts[0].unionByName(texts[1]).unionByName(texts[2]).unionByName(texts[3])
    return lk.link_counts(whole, ("corpus",))


@register("link_census")
def q_link_census(spark, sf_dir):
    return lk.link_census(_links(spark, sf_dir))


# ---------------------------------------------------------------- T: rows and contexts
@register("row_lines")
def q_row_lines(spark, sf_dir):
    """Every column of every row."""
    return ctx.row_lines(fxt.table(spark, sf_dir, "conversations"), keep=["conv_id", "turn"])


@register("context_by_group")
def q_context_by_group(spark, sf_dir):
    lines = ctx.row_lines(fxt.table(spark, sf_dir, "conversations"), keep=["conv_id", "turn"])
    return ctx.context_by_group(lines, "conv_id", ["turn"], F.col("conv_id"), CONTEXT_BUDGET)


# ---------------------------------------------------------------- S: sources, L/F/A: browsing
from plantwise.operators import browse as br  # noqa: E402
from plantwise.sources import sheets as sh  # noqa: E402

FACT_TEXT_NAMES = ["maquina", "data", "turno", "hora", "disponibilidade", "performance", "qualidade", "teep", "oee"]


@register("scan_sheet")
def q_scan_sheet(spark, sf_dir):
    """Positional scan of the sheet file, nine named text columns."""
    return fx.positional(sheet_raw(spark, sf_dir))


def _production_sheet_path(spark, sf_dir):
    """A headerless sheet whose one file begins with three lines that are no rows (title, blank cells,
    caption); some keys are no numbers."""
    from plantwise.sources.staging import stage_once

    def build():
        key = F.col("s_suppkey").cast("string")
        s = fxt.table(spark, sf_dir, "supplier").select(
            F.when(F.col("s_suppkey") % 10 == 0, F.concat(F.lit("K-"), key)).otherwise(key).alias("c0"), F.col("s_name").alias("c1"),
            F.col("s_nationkey").cast("string").alias("c2"))
        junk = spark.createDataFrame(
            [("PRODUCAO", None, None), (None, None, None), ("Cod", "Maquina", "Setor")], "c0 string, c1 string, c2 string")
        return junk.coalesce(1).unionByName(s).coalesce(1)

    src = [fxt.os.path.join(sf_dir, "supplier.parquet")]
    return stage_once(spark, "production", src, build, fmt="csv", options={"header": "false"})


@register("scan_headerless")
def q_scan_headerless(spark, sf_dir):
    """S2 + A10: machines of a headerless sheet whose first three lines are skipped by position."""
    rows = sh.read_skipping(spark, _production_sheet_path(spark, sf_dir), 3, 3)
    return br.distinct_values(rows, "c1", "machine")


@register("scan_skipping")
def q_scan_skipping(spark, sf_dir):
    """All rows after the first three lines, those with other than numeric keys included."""
    return sh.read_skipping(spark, _production_sheet_path(spark, sf_dir), 3, 3)


@register("scan_from_first_row")
def q_scan_from_first_row(spark, sf_dir):
    """S2 with no row skipped: every line of a headerless sheet, title lines included."""
    return sh.read_sheet_csv(spark, _production_sheet_path(spark, sf_dir), 3)


@register("source_profile")
def q_source_profile(spark, sf_dir):
    """S3: every record sheet with rows, width and whether a modification time is known
    (the time itself differs from run to run)."""
    paths = [fxt.record_sheet_path(spark, sf_dir, name) for name in fxt.RECORD_SHEETS]
    prof = sh.source_profile(spark, paths)
    sheet = F.regexp_extract("file_path", r"(sheet-[a-z]+)-", 1)
    # a sheet landed as several files has a header in each
    return prof.groupBy(sheet.alias("file_path")).agg(
        (F.sum("n_rows") - F.count(F.lit(1))).alias("n_records"), F.max("n_cols").alias("n_cols"),
        F.bool_and(F.col("modified").isNotNull()).alias("has_time"), F.bool_and("has_machine_column").alias("has_machine_column"))


@register("record_scan")
def q_record_scan(spark, sf_dir):
    """A record sheet read from its header row, all values text."""
    return sh.read_record_sheet(spark, fxt.record_sheet_path(spark, sf_dir, "erros"), "erros")


@register("record_scan_split")
def q_record_scan_split(spark, sf_dir):
    """S4 with files read split by split: records may cross splits inside quoted cells."""
    from plantwise.sources.records import read_record_files

    return read_record_files(spark, fxt.record_sheet_path(spark, sf_dir, "erros"))


@register("table_scan")
@rounded
def q_table_scan(spark, sf_dir):
    """The technical-sheet table with its declared 22-column schema."""
    return sh.read_table(spark, fxt.spec_table_path(spark, sf_dir), br.SPEC_SCHEMA)


@register("source_counts")
def q_source_counts(spark, sf_dir):
    """S6 + U1: rows per record sheet; an absent sheet counts 0 rows."""
    sources = {name: sh.read_record_sheet(spark, fxt.record_sheet_path(spark, sf_dir, name), name)
               for name in [*fxt.RECORD_SHEETS, fxt.MISSING_SHEET]}
    return sh.source_counts(sources)


@register("ink_per_thousand")
@rounded
def q_ink_per_thousand(spark, sf_dir):
    spec = sh.read_table(spark, fxt.spec_table_path(spark, sf_dir), br.SPEC_SCHEMA)
    return br.ink_per_thousand(spec, [(c, friendly) for c, _, friendly in fxt.INKS])


@register("head_tail")
@rounded
def q_head_tail(spark, sf_dir):
    o = fxt.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return br.head_tail(o, "o_orderkey", 5)


def _order_pages(spark, sf_dir):
    """The orders and the folder of their page index (built on first use)."""
    from plantwise.sources.staging import stage_folder

    o = fxt.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return o, stage_folder(spark, "order-pages", [fxt.os.path.join(sf_dir, "orders.parquet")])


@register("paginate")
def q_paginate(spark, sf_dir):
    o, folder = _order_pages(spark, sf_dir)
    return br.paginate(o, "o_orderkey", page=3, size=20, folder=folder)


@register("paginate_deep")
def q_paginate_deep(spark, sf_dir):
    """L2 beyond the end: the last page, read from its own range only."""
    o, folder = _order_pages(spark, sf_dir)
    return br.paginate(o, "o_orderkey", page=100_000_000, size=20, folder=folder)


@register("distinct_machines")
def q_distinct_machines(spark, sf_dir):
    return br.distinct_values(sheet_raw(spark, sf_dir), "c1", "maquina")


@register("value_counts_top")
def q_value_counts_top(spark, sf_dir):
    """Ten most frequent TEEP cells (as text) of the period."""
    raw = sheet_raw(spark, sf_dir)
    in_p = fx.in_period(C.day_first_date("c2"), PERIOD[0], PERIOD[1])
    return br.value_counts_top(raw.filter(in_p), "c10", 10)


@register("point_lookup")
@rounded
def q_point_lookup(spark, sf_dir):
    facts = fx.filter_facts(typed(spark, sf_dir), shifts=None, hours=None)
    equals = {"maquina": POINT[0], "data": dt.date.fromisoformat(POINT[1]), "turno": POINT[2]}
    return br.point_lookup(facts, equals, ["maquina", "data", "turno", "hora", "teep", "oee"])


@register("substring_one")
def q_substring_one(spark, sf_dir):
    return br.substring_one(sheet_raw(spark, sf_dir).select(F.col("c1").alias("maquina")), "maquina", "11")


@register("substring_all_columns")
def q_substring_all_columns(spark, sf_dir):
    cust = fxt.table(spark, sf_dir, "customer")
    return br.substring_all_columns(cust, "12", 5, cust.columns)


@register("context_all_sources")
def q_context_all_sources(spark, sf_dir):
    """Every column of every record sheet in one context of 30,000 characters; an absent
    sheet is skipped."""
    sources = []
    for name in fxt.RECORD_SHEETS:
        sheet = sh.read_record_sheet(spark, fxt.record_sheet_path(spark, sf_dir, name), name)
        sources.append((name, sheet.select(F.col(sheet.columns[0]).cast("bigint").alias("key"), T.row_line(sheet.columns).alias("line"))))
    return ctx.context_all_sources(sources, ["key"])


# ---------------------------------------------------------------- ST: streams
from plantwise.streaming import ingest as st  # noqa: E402


def _landing(spark, sf_dir):
    from plantwise.sources.staging import stage_once

    src = fxt.os.path.join(sf_dir, "events.parquet")
    files = max(1, spark.sparkContext.defaultParallelism)
    return stage_once(spark, "sheet", [src], lambda: fxt.render_sheet(spark, sf_dir), fmt="csv",
                      options={"header": "false"}, files=files)


@register("stream_ingest")
@rounded
def q_stream_ingest(spark, sf_dir):
    """ST1: the sheet files ingested by a file stream equal the batch facts."""
    return st.ingest_facts(spark, _landing(spark, sf_dir)).select("maquina", "data", "turno", "hora", "teep", "oee")


@register("landing_refresh")
@rounded
def q_landing_refresh(spark, sf_dir):
    """The landing folder's files, each in its newest version."""
    return st.refresh_landing(spark, _landing(spark, sf_dir)).select("maquina", "data", "turno", "hora", "teep", "oee")


@register("stream_slots")
@rounded
def q_stream_slots(spark, sf_dir):
    """ST2: (date, hour, shift) sums of everything landed, from the stream."""
    return st.ingest_slot_sums(spark, _landing(spark, sf_dir))


@register("landing_replaced")
@rounded
def q_landing_replaced(spark, sf_dir):
    """S7 on a landing whose files are shrunk, emptied, restored and replaced by older copies, with a
    refresh after every step."""
    found = []
    fxt.replayed_landing(spark, sf_dir, lambda folder: found.append(st.refresh_landing(spark, folder)))
    return found[-1].select("maquina", "data", "turno", "hora", "teep", "oee")


@register("stream_slots_replaced")
@rounded
def q_stream_slots_replaced(spark, sf_dir):
    """ST2 on the same sequence: sums of replaced file versions are retracted."""
    found = []
    fxt.replayed_landing(spark, sf_dir, lambda folder: found.append(st.ingest_slot_sums(spark, folder)))
    return found[-1]


@register("money_in_documents")
def q_money_in_documents(spark, sf_dir):
    """T1 robustness over whole document texts: '$' junk yields no amount."""
    return mn.mention_census(fxt.table(spark, sf_dir, "documents"), ("lang",))


@register("page_index")
def q_page_index(spark, sf_dir):
    """L2 for deep paging: position and page of every order, without a global window."""
    o, folder = _order_pages(spark, sf_dir)
    return br.page_numbers(o, "o_orderkey", size=20, folder=folder)


@register("stream_active_means")
@rounded
def q_stream_active_means(spark, sf_dir):
    """ST2 -> F7 + A2: per-shift means over active slots, from the stream's slot sums."""
    return st.means_from_slot_sums(st.ingest_slot_sums(spark, _landing(spark, sf_dir)))


def _period_state(spark, sf_dir):
    from plantwise.operators.period_state import PeriodState

    return PeriodState.build(st.ingest_slot_sums(spark, _landing(spark, sf_dir)))


@register("state_overall")
@rounded
def q_state_overall(spark, sf_dir):
    """A1 from the stream's slot state, by two lookups."""
    return _period_state(spark, sf_dir).means(*PERIOD, weekdays_below=5)


@register("state_by_shift")
@rounded
def q_state_by_shift(spark, sf_dir):
    """A2 from the stream's slot state."""
    return _period_state(spark, sf_dir).means(*PERIOD, by=("turno",), weekdays_below=5)


@register("state_by_day_shift")
@rounded
def q_state_by_day_shift(spark, sf_dir):
    """A3 from the stream's slot state."""
    return _period_state(spark, sf_dir).day_means(*PERIOD, weekdays_below=5)


@register("state_period_sensitivity")
@rounded
def q_state_period_sensitivity(spark, sf_dir):
    """R6 from the stream's slot state."""
    return _period_state(spark, sf_dir).period_means(PERIODS)
