"""Test views derived at run time from the driver's parquet tables.

The effectiveness sheet the source works on is not shipped, so a sheet with the same
shape and the same kinds of dirt is rendered from ``events`` (hourly rows, machines,
shifts, percent text). Everything here is a lazy DataFrame over the given tables, so
its size grows with them.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

# Fixed values of the test views.
MACHINE_SUFFIX = "- CX-360G"
SUBTOTAL_TEXT = "Turno 1"
BAD_DATE_TEXT = "x"
BAD_HOUR_TEXT = "n/d"
BAD_PERCENT_TEXT = "1.234,5"
# Period and targets used by the reconciliation checks (arguments, not constants of the library).
PERIOD = ("2024-01-02", "2024-01-15")
TARGET_OVERALL = 0.15
TARGETS_BY_SHIFT = {"Turno A": 0.16, "Turno B": 0.165}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def fact_numbers(events: DataFrame) -> DataFrame:
    """Clean numbers behind the sheet (tenths of a percent, integer codes)."""
    d, h, eid = F.col("d"), F.col("h"), F.col("event_id")
    base = events.select(
        "event_id",
        "event_type",
        F.to_date("ts").alias("d"),
        F.hour("ts").alias("h"),
        (F.lit(101) + F.col("user_id") % 12).alias("m"),
    )
    code = (
        F.when(h.between(6, 12), F.lit(1))
        .when(h.isin(13, 14), F.lit(1) + (eid % 2).cast("int"))
        .when(h.between(15, 21), F.lit(2))
        .otherwise(F.lit(3))
    )
    base = base.withColumn("code", code)
    idle = (
        (F.col("event_type") == "error")
        | (((F.dayofmonth(d) * 24 + h) % 11) == 0)
        | (h.isin(13, 14) & (F.col("code") == 1) & ((F.dayofmonth(d) % 2) == 0))
    )
    base = base.withColumns(
        {
            "a10": F.when(idle, F.lit(0)).otherwise((eid * 37) % 1001),
            "p10": F.when(idle, F.lit(0)).otherwise(400 + (eid * 53) % 601),
            "q10": F.when(idle, F.lit(0)).otherwise(800 + (eid * 71) % 201),
        }
    )
    base = base.withColumn("o10", F.expr("(cast(a10 as bigint) * p10 * q10) div 1000000"))
    return base.withColumn("t10", F.expr("(2 * o10) div 3"))


def _percent_text(tenths: str, eid: F.Column) -> F.Column:
    t = F.col(tenths)
    sep = F.when(eid % 2 == 0, F.lit("%")).otherwise(F.lit(" %"))
    return F.concat(F.expr(f"cast({tenths} div 10 as string)"), F.lit(","), (t % 10).cast("string"), sep)


SHEET_COLUMNS = 12


def sheet_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messy effectiveness sheet as a CSV file scanned by position.

    It is rendered once from ``events`` into the shared folder (see ``staging``) and
    read back with twelve text columns, as a sheet export would be.
    """
    from plantwise.sources.sheets import read_sheet_csv
    from plantwise.sources.staging import stage_once

    src = os.path.join(sf_dir, "events.parquet")
    files = max(1, spark.sparkContext.defaultParallelism)
    path = stage_once(spark, "sheet", [src], lambda: render_sheet(spark, sf_dir), fmt="csv",
                      options={"header": "false"}, files=files)
    return read_sheet_csv(spark, path, SHEET_COLUMNS)


def render_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messy effectiveness sheet: twelve text columns ``c0..c11`` by position.

    Defects injected by rule: null machine, subtotal rows, bad date, other shift,
    bad hour, a thousands-formatted percent.
    """
    n = fact_numbers(table(spark, sf_dir, "events"))
    eid = F.col("event_id")
    machine = (
        F.when(eid % 101 == 0, F.lit(None).cast("string"))
        .when(eid % 97 == 0, F.lit(SUBTOTAL_TEXT))
        .otherwise(F.concat(F.col("m").cast("string"), F.lit(MACHINE_SUFFIX)))
    )
    date_text = (
        F.when(eid % 89 == 0, F.lit(BAD_DATE_TEXT))
        .when(eid % 3 == 0, F.date_format("d", "yyyy-MM-dd"))
        .when(eid % 3 == 1, F.date_format("d", "dd/MM/yyyy"))
        .otherwise(F.date_format("d", "d/M/yyyy"))
    )
    shift_text = F.when(eid % 2 == 0, F.col("code").cast("string")).otherwise(
        F.concat(F.col("code").cast("string"), F.lit(".0"))
    )
    hour_text = F.when(eid % 83 == 0, F.lit(BAD_HOUR_TEXT)).otherwise(F.col("h").cast("string"))
    avail_text = F.when(eid % 79 == 0, F.lit(BAD_PERCENT_TEXT)).otherwise(_percent_text("a10", eid))
    return n.select(
        eid.cast("string").alias("c0"),
        machine.alias("c1"),
        date_text.alias("c2"),
        shift_text.alias("c3"),
        hour_text.alias("c4"),
        F.col("event_type").alias("c5"),
        F.lit("").alias("c6"),
        avail_text.alias("c7"),
        _percent_text("p10", eid).alias("c8"),
        _percent_text("q10", eid).alias("c9"),
        _percent_text("t10", eid).alias("c10"),
        _percent_text("o10", eid).alias("c11"),
    )


# File of a sheet row and, per replacement of the landing: (file, kept third of its rows, age in days
# of the copy); None keeps all rows, -1 none. The last entry of a file is what counts.
LANDING_FILES = 8
REPLACEMENTS = [
    [(1, 0, 0), (2, -1, 0), (3, 1, 400)],  # shrunk, emptied, replaced by an older copy
    [(1, None, 30), (4, 2, 0), (2, 0, 10)],  # restored, shrunk, filled again
    [(2, -1, 0), (5, 2, 0), (5, None, 500)],  # emptied again, changed and restored before the refresh
]


def replayed_landing(spark: SparkSession, sf_dir: str, refresh) -> None:
    """Land the sheet as LANDING_FILES files in a new folder, then copy other versions over them
    step by step, as REPLACEMENTS lists them; ``refresh(folder)`` is called after every step."""
    import time
    import uuid

    from plantwise.session import shared_dir
    from plantwise.sources.staging import _fs, stage_once

    src = os.path.join(sf_dir, "events.parquet")
    row = F.col("c0").cast("bigint")
    whole, third = F.lit("all"), F.concat(F.lit("r"), (row % 3).cast("string"))

    def versions():
        sheet = render_sheet(spark, sf_dir).withColumn("file", row % LANDING_FILES)
        return sheet.withColumn("version", F.explode(F.array(whole, third))).repartition("file", "version")

    staged = stage_once(spark, "landing-versions", [src], versions, fmt="csv", options={"header": "false"}, partition_by=["version", "file"])
    folder = shared_dir(spark, f"plantwise-replay/{uuid.uuid4().hex}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    now = int(time.time())

    def land(file: int, kept: int | None, days: int, step: int) -> None:
        fs, target = _fs(spark, f"{folder}/sheet-{file}.csv")
        if kept == -1:
            fs.create(target, True).close()
        else:
            _, version = _fs(spark, f"{staged}/version={'all' if kept is None else f'r{kept}'}/file={file}")
            parts = [x.getPath() for x in fs.listStatus(version) if x.getPath().getName().startswith("part-")]
            jvm.org.apache.hadoop.fs.FileUtil.copy(fs, parts[0], fs, target, False, True, conf)
        fs.setTimes(target, 1000 * (now - 86_400 * days + step), -1)

    for step, changes in enumerate([[(f, None, 30) for f in range(LANDING_FILES)], *REPLACEMENTS]):
        for file, kept, days in changes:
            land(file, kept, days, 0 if kept is None else step)
        refresh(folder)


# ---------------------------------------------------------------- money, rates, links, records
MONEY_PREFIX = "Pedido "
MONEY_MIDDLE = " custa "
MONEY_SUFFIX = " total"


def money_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer-like texts with one amount each, rendered six ways by ``o_orderkey % 6``:
    US thousands, BR with a space, ``R$`` (no mention), BR thousands without cents, plain
    decimal, plain decimal with a trailing dot. ``asked_at`` is a moment of the order's day."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate", "o_totalprice")
    p = F.col("o_totalprice")
    us = F.format_number(p, 2)
    br = F.translate(us, ",.", ".,")
    br_int = F.translate(F.format_number(F.floor(p), 0), ",", ".")
    plain = F.format_string("%.2f", p)
    k = F.col("o_orderkey") % 6
    amount = (
        F.when(k == 0, F.concat(F.lit("$"), us))
        .when(k == 1, F.concat(F.lit("$ "), br))
        .when(k == 2, F.concat(F.lit("R$ "), br))
        .when(k == 3, F.concat(F.lit("$"), br_int))
        .when(k == 4, F.concat(F.lit("$"), plain))
        .otherwise(F.concat(F.lit("$"), plain, F.lit(".")))
    )
    text = F.concat(F.lit(MONEY_PREFIX), F.col("o_orderkey").cast("string"), F.lit(MONEY_MIDDLE), amount, F.lit(MONEY_SUFFIX))
    return o.select(
        "o_orderkey",
        "o_orderpriority",
        F.to_date("o_orderdate").alias("order_date"),
        text.alias("text"),
        F.lit("USD-BRL").alias("pair"),
        F.expr("cast(to_date(o_orderdate) as timestamp_ntz) + make_dt_interval(0, cast(o_orderkey % 24 as int), cast(o_orderkey % 60 as int), 0)").alias("asked_at"),
    )


# Seconds after which a money quote is stale, and the hours of primary and secondary quotes by
# day number % 5: days without any, with one source or both.
PRIMARY_AGE, SECONDARY_AGE = 6 * 3600, 30 * 3600
PRIMARY_HOURS = {1: (9, 15), 3: (8,), 4: (0,)}
SECONDARY_HOURS = {2: (10,), 3: (12,)}


def money_quotes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Primary and secondary quotes on the order dates: gaps, stale quotes and fallback all occur."""
    day = F.datediff("d", F.lit("1992-01-01"))
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).distinct().withColumn("n", day)

    def quotes(hours: dict[int, tuple[int, ...]], base: float, source: int) -> DataFrame:
        when = F.when(F.lit(False), F.array(F.lit(0)))
        for rest, own in hours.items():
            when = when.when(F.col("n") % 5 == rest, F.array(*map(F.lit, own)))
        each = days.select("d", "n", F.explode(when).alias("h"))
        ts = F.expr("cast(d as timestamp_ntz) + make_dt_interval(0, h, 0, 0)")
        rate = F.lit(base) + (F.dayofmonth("d") % 7).cast("double") / F.lit(10.0) + F.col("h").cast("double") / F.lit(100.0)
        return each.select(F.lit("USD-BRL").alias("pair"), ts.alias("ts"), ((F.col("n") * 24 + F.col("h")) * 2 + source).cast("bigint").alias("quote_id"), rate.alias("rate"))

    return quotes(PRIMARY_HOURS, 4.0, 0), quotes(SECONDARY_HOURS, 3.0, 1)


def rate_quotes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(primary quotes, secondary quotes, demands) from ``events``: views are primary
    quotes, signups secondary quotes, purchases the moments a rate is needed."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    pair = F.lit("USD-BRL").alias("pair")
    rate = (F.lit(4.0) + F.col("value") / F.lit(1000.0)).alias("rate")
    primary = e.filter(F.col("event_type") == "view").select(pair, "ts", F.col("event_id").alias("quote_id"), rate)
    secondary = e.filter(F.col("event_type") == "signup").select(pair, "ts", F.col("event_id").alias("quote_id"), rate)
    demands = e.filter(F.col("event_type") == "purchase").select(pair, "ts", "event_id")
    return primary, secondary, demands


LINK_IMAGE_TAG = "Link de Imagem: "
LINK_VIDEO_TAG = "LINK DE VÍDEO: "
LINK_MACHINE_TAG = "Link de Máquina: "
DRIVE_FILE_URL = "https://drive.google.com/file/d/ID{}/view?usp=drive_link"
DRIVE_OPEN_URL = "https://drive.google.com/open?id=ID{}&x=1"


def link_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer-like texts with links, rendered six ways by ``page_id % 6``."""
    pg = table(spark, sf_dir, "pages").select("page_id", "url")
    pid = F.col("page_id").cast("string")
    k = F.col("page_id") % 6
    body = (
        F.when(k == 0, F.concat(F.lit(LINK_IMAGE_TAG), F.col("url"), F.lit(".png")))
        .when(k == 1, F.concat(F.lit(LINK_VIDEO_TAG), F.col("url"), F.lit(".mp4).")))
        .when(k == 2, F.col("url"))
        .when(k == 3, F.concat(F.lit(LINK_MACHINE_TAG), F.lit("https://drive.google.com/file/d/ID"), pid,
                                F.lit("/view?usp=drive_link")))
        .when(k == 4, F.concat(F.lit("https://drive.google.com/open?id=ID"), pid, F.lit("&x=1")))
        .otherwise(F.lit("sem link"))
    )
    return pg.select("page_id", F.concat(F.lit("Veja item "), pid, F.lit(". "), body).alias("text"))


# ---------------------------------------------------------------- record sheets and the spec table
# Record sheet name -> driver table it is rendered from.
RECORD_SHEETS = {"erros": "customer", "dacen": "supplier", "psi": "nation", "gerais": "region"}
MISSING_SHEET = "trabalhos"
NOTE_SHEET = "erros"
# Ink columns of the spec sheet, their multiplier in the test rule, and friendly names.
INKS = [("cyan", 3, "Ciano"), ("magenta", 5, "Magenta"), ("yellow", 7, "Amarelo"),
        ("black", 11, "Preto"), ("white", 13, "Branco"), ("varnish", 17, "Verniz")]


def record_sheet_path(spark: SparkSession, sf_dir: str, name: str) -> str | None:
    """Stage a record sheet (header CSV, all text) rendered from its driver table."""
    from plantwise.sources.staging import stage_once

    if name not in RECORD_SHEETS:
        return None
    tname = RECORD_SHEETS[name]
    src = os.path.join(sf_dir, f"{tname}.parquet")

    def build():
        rows = table(spark, sf_dir, tname)
        if name != NOTE_SHEET:
            return rows
        # a cell with doubled quotes, a separator and a line break
        note = F.concat(F.lit('peca "'), F.col("c_name"), F.lit('", furo,\nfim'))
        return rows.withColumn("nota", note)

    return stage_once(spark, f"sheet-{name}", [src], build, fmt="csv", options={"header": "true", "escape": '"'})


def answer_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with an amount, one or two links and text around them: the body of
    ``link_text`` after a price, then a second link. ``rate`` is 2."""
    pid = F.col("page_id").cast("string")
    body = F.expr("substr(text, instr(text, '. ') + 2)")
    url = table(spark, sf_dir, "pages").select("page_id", "url")
    text = F.concat(F.lit("- Item "), pid, F.lit(" por $ "), pid, F.lit(" cada: "), body, F.lit(" e ainda Link de Foto: "),
                    F.col("url"), F.lit(".jpg fim"))
    return link_text(spark, sf_dir).join(url, "page_id").select("page_id", text.alias("text"), F.lit(2.0).alias("rate"))


def spec_table_path(spark: SparkSession, sf_dir: str) -> str:
    """Stage the technical-sheet table (22 columns) rendered from ``part``."""
    from plantwise.sources.staging import stage_once

    def build():
        p = table(spark, sf_dir, "part")
        cols = {
            "id": F.col("p_partkey"),
            "referencia": F.col("p_brand"),
            "produto": F.col("p_name"),
        }
        for name, k, _ in INKS:
            cols[name] = ((F.col("p_partkey") * k) % 97).cast("double") / F.lit(1000.0)
        return p.select(*[c.alias(n) for n, c in cols.items()])

    src = os.path.join(sf_dir, "part.parquet")
    return stage_once(spark, "spec", [src], build, fmt="parquet")


def typed_sheet_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned sheet as a parquet table partitioned by date and clustered by machine, written once
    (the 'clean once, report many times' layer; see ``layout``)."""
    from pyspark.sql.types import BooleanType, DateType, DoubleType, StringType, StructField, StructType

    from plantwise.operators.facts import PERCENT_COLUMNS, typed_sheet
    from plantwise.sources.layout import bloom_options, clustered
    from plantwise.sources.staging import stage_once

    src = os.path.join(sf_dir, "events.parquet")

    def build():
        return clustered(typed_sheet(sheet_raw(spark, sf_dir)), ["data"], ["maquina", "turno", "hora"])

    path = stage_once(spark, "typed-sheet", [src], build, fmt="parquet", options=bloom_options(["maquina"]), partition_by=["data"])
    schema = StructType(
        [StructField("maquina", StringType()), StructField("turno", StringType()), StructField("hora", DoubleType())]
        + [StructField(c, DoubleType()) for c in PERCENT_COLUMNS]
        + [StructField("machine_ok", BooleanType()), StructField("data", DateType())]
    )
    return spark.read.schema(schema).parquet(path).select(
        "maquina", "data", "turno", "hora", *PERCENT_COLUMNS, "machine_ok")
