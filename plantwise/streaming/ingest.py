"""Forms of the refresh habit: file streams (ST1, ST2) and a landing refresh.

ST1 picks up new sheet files from a landing folder and appends their cleaned fact rows
to a parquet table, each file exactly once (the checkpoint remembers processed files).
ST2 keeps the mergeable state behind the active-slot filter and the means -- sum of
OEE, sum of TEEP and row count per (date, hour, shift) -- as partial sums per file, so
that rows count whenever they arrive and a replaced file's sums can be retracted. S7
keeps the raw rows the same way. The state of both is a ledger (``landing``).

ST1 and ST2 run with ``Trigger.AvailableNow``: process what is there, then stop; schedule the
same call again to pick up new files. Sink and checkpoint live in the shared folder.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from plantwise.operators.facts import oee_facts
from plantwise.session import shared_dir
from plantwise.sources.sheets import positional_schema
from plantwise.streaming.landing import VERSION, Ledger


def sheet_stream(spark: SparkSession, landing: str, n_cols: int = 12, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(positional_schema(n_cols)).option("header", "false")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.csv(landing)


SLOT_SUMS = "data date, hora double, turno string, oee_sum double, teep_sum double, n_rows bigint"


def slot_sums(facts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Sums and counts per (date, hour, shift) and ``by``: partial states that merge by adding."""
    return facts.groupBy(*by, "data", "hora", "turno").agg(
        F.sum("oee").alias("oee_sum"), F.sum("teep").alias("teep_sum"), F.count(F.lit(1)).alias("n_rows"))


def _run_available_now(df: DataFrame, name: str, key: str, output_mode: str = "append") -> str:
    spark = df.sparkSession
    base = state_dir(spark, f"{name}-{key}")
    sink, ckpt = f"{base}/data", f"{base}/_checkpoint"
    q = (
        df.writeStream.format("parquet")
        .outputMode(output_mode)
        .option("checkpointLocation", ckpt)
        .trigger(availableNow=True)
        .start(sink)
    )
    q.awaitTermination()
    return sink


def _key(*parts: object) -> str:
    """Sink/checkpoint key: the inputs plus this module's code, so a changed query never
    resumes from an old checkpoint."""
    with open(__file__, "rb") as fh:
        code = hashlib.sha1(fh.read()).hexdigest()[:12]
    return hashlib.sha1("|".join(map(str, (*parts, code))).encode()).hexdigest()[:16]


def ingest_facts(spark: SparkSession, landing: str, **facts_kwargs) -> DataFrame:
    """ST1: landing folder of sheet files -> cleaned facts table; returns the table."""
    facts = oee_facts(sheet_stream(spark, landing), **facts_kwargs)
    sink = _run_available_now(facts, "facts", _key(landing, sorted(facts_kwargs.items())))
    return spark.read.parquet(sink)


NAMESPACE = "plantwise.state.namespace"  # session setting: states under another one start empty


def state_dir(spark: SparkSession, name: str) -> str:
    return shared_dir(spark, f"plantwise-state{spark.conf.get(NAMESPACE, '')}/{name}")


def landed_rows(spark: SparkSession, landing: str, n_cols: int = 12) -> Ledger:
    """Ledger of a landing folder's raw rows."""
    schema = ", ".join(f"{c} string" for c in positional_schema(n_cols).names)
    return Ledger(spark, state_dir(spark, f"landing-{_key(landing, n_cols)}"), landing, n_cols, schema)


def refresh_landing(spark: SparkSession, landing: str, n_cols: int = 12, deep: bool = False, **facts_kwargs) -> DataFrame:
    """Landing folder -> facts of the current version of every file, reading only files that
    changed since the last call (see ``landing``)."""
    ledger = landed_rows(spark, landing, n_cols)
    ledger.refresh(deep)
    return oee_facts(ledger.read().drop("file_path"), **facts_kwargs)


def landed_slot_sums(spark: SparkSession, landing: str, n_cols: int = 12, **facts_kwargs) -> Ledger:
    """Ledger of a landing folder's sums per (file, date, hour, shift)."""

    def sums(raw: DataFrame) -> DataFrame:
        return slot_sums(oee_facts(raw, carry=("file_path",), **facts_kwargs), ("file_path",))

    base = state_dir(spark, f"slots-{_key(landing, n_cols, sorted(facts_kwargs.items()))}")
    return Ledger(spark, f"{base}/ledger", landing, n_cols, SLOT_SUMS, sums)


def ingest_slot_sums(spark: SparkSession, landing: str, n_cols: int = 12, **facts_kwargs) -> DataFrame:
    """ST2: landing folder -> sums per (date, hour, shift) of everything landed so far.

    Every micro-batch lands its files' partial sums, so no row is ever too late. A file stream
    knows files by name; what it can't see, files copied over since, is landed after it, and the
    sums of their old versions are retracted. A batch that is run again after a failure lands its
    files again, which replaces them. The result adds the current partial sums of all files."""
    ledger = landed_slot_sums(spark, landing, n_cols, **facts_kwargs)
    version = [F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_size").alias("size")]

    def land(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()  # read once for sums and versions
        try:
            versions = rows.select(*VERSION).distinct()
            while not ledger.land([rows.drop("modified", "size")], versions, ledger.commits()):
                pass
        finally:
            rows.unpersist()

    stream = sheet_stream(spark, landing, n_cols)
    path = ledger.with_path(stream)
    query = (
        path.select("*", *version).writeStream.foreachBatch(land)
        .option("checkpointLocation", f"{ledger.base}-checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    ledger.refresh()
    return slot_sums_of(ledger.read())


def slot_sums_of(partial: DataFrame) -> DataFrame:
    return partial.groupBy("data", "hora", "turno").agg(
        F.sum("oee_sum").alias("oee_sum"), F.sum("teep_sum").alias("teep_sum"), F.sum("n_rows").alias("n_rows"))


def means_from_slot_sums(sums: DataFrame, split: str = "turno") -> DataFrame:
    """F7 + A2 from the mergeable slot state: a slot is active when its summed OEE over
    all shifts is > 0; means per shift are sum / count over active slots. Works on the
    (small) slot-sums table, never on fact rows."""
    from pyspark.sql import Window

    total = F.sum("oee_sum").over(Window.partitionBy("data", "hora"))
    active = sums.withColumn("_slot_oee", total).filter(F.col("_slot_oee") > 0)
    return active.groupBy(split).agg(
        F.sum("n_rows").alias("n_rows"),
        (F.sum("teep_sum") / F.sum("n_rows")).alias("teep_mean"),
        (F.sum("oee_sum") / F.sum("n_rows")).alias("oee_mean"),
    )
