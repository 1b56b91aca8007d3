"""Secret scans over an incremental, content-addressed blob ledger, in DataFrame operations.

Every version of every path is addressed by the sha256 of its text. The ledger, a Parquet
table in a folder the caller names, holds one row per scan of a blob: the keys (name and
version) of the rules that were run and the spans they found. A scan

1. writes the versions' addresses (no texts) to the shared folder,
2. compares the distinct blobs with the ledger and keeps the missing (blob, rule) pairs,
3. joins those back to one text each and runs only the missing rules on it,
4. appends to the ledger, and joins the ledger's spans back to all paths of each blob.

A copy is scanned once however many paths hold it, a rerun over known blobs scans nothing,
and a new rule version runs alone. Texts move only for unseen blobs, dealt by blob and path
hash, so a blob with a third of all paths is no hot task.

Positions come from the lengths of the pieces between matches, summed by a window per blob
and rule: linear in the number of matches also for texts with very many of them.

Defined cases: a null text is the empty blob. Repeated rows and repeated paths give one
result row each. Empty input gives an empty result and an unchanged ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from plantwise.llm.common import fresh_folder, staged


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and non-overlapping; those whose ``group`` has under
    ``least`` characters are dropped afterwards. ``needs``: a literal of every match."""

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    needs: str | None = None

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))
# fixed values: the patterns and lengths of the base kinds, in their order
BASE = (
    Rule("assign", 1, rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", least=20, needs="AKIA"),
    Rule("hex", 1, r"[0-9a-f]{24,}", least=24),  # runs are maximal, so the length can stand in the pattern
)
ADDED = (
    Rule("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", needs="-----BEGIN "),
    Rule("forge_token", 1, r"gh[opsur]_[A-Za-z0-9]{36,}", needs="gh"),
    Rule("signed_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", needs="eyJ"),
)
RULES = BASE + ADDED

SPAN = "struct<rule:string,start:bigint,end:bigint>"
LEDGER = T.StructType([
    T.StructField("blob", T.StringType()),
    T.StructField("rules", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("rule", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(LEDGER).parquet(folder) if there else spark.createDataFrame([], LEDGER)


def pieces(text: Column, rule: Rule) -> Column:
    """array of (rule, no, gap, size, ok): the characters before each match, its length and
    whether it is long enough."""
    pattern = F.lit(rule.pattern)
    zipped = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, pattern, 0).alias("all"),
        F.regexp_extract_all(text, pattern, rule.group).alias("part"),
    )
    found = F.transform(zipped, lambda z, i: F.struct(
        F.lit(rule.key).alias("rule"), i.cast("long").alias("no"), F.length(z["gap"]).cast("long").alias("gap"),
        F.length(z["all"]).cast("long").alias("size"), (F.length(z["part"]) >= rule.least).alias("ok")))
    return F.filter(found, lambda z: z["size"].isNotNull())  # the last piece has no match


def scan_texts(unseen: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Ledger rows of ``unseen`` (blob, text, missing rule keys)."""
    found = []
    for r in rules:
        hit = F.array_contains("missing", r.key)
        if r.needs:
            hit = hit & F.contains("text", F.lit(r.needs))
        hit = hit & F.col("text").rlike(r.pattern)
        found.append(F.when(hit, pieces(F.col("text"), r)).otherwise(F.array().cast(
            "array<struct<rule:string,no:bigint,gap:bigint,size:bigint,ok:boolean>>")))
    rows = unseen.select("blob", F.col("missing").alias("rules"), F.explode_outer(F.concat(*found)).alias("m"))
    # equal rows of one path and text scan alike: one row per match is kept
    single = rows.select("blob", "rules", "m.*").repartition("blob").groupBy("blob", "rule", "no").agg(
        F.first("rules").alias("rules"), F.first("gap").alias("gap"), F.first("size").alias("size"), F.first("ok").alias("ok"))
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("blob", "rule").orderBy("no"))
    placed = single.withColumn("end", end)
    span = F.when(F.col("ok"), F.struct("rule", (F.col("end") - F.col("size")).alias("start"), "end"))
    return placed.groupBy("blob").agg(F.first("rules").alias("rules"), F.collect_list(span).alias("spans"))


def update_ledger(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, paths: list[str] = ["doc_id"],  # noqa: B006
                  text: str = "text") -> DataFrame:
    """Scan what the ledger lacks, append it, and return the addresses: paths and ``blob``."""
    spark = versions.sparkSession
    row = F.xxhash64(*paths)  # equal hashes of two paths of one blob only mean a repeated scan
    blob = blob_id(F.col(text))
    addresses = staged(versions.select(*paths, blob.alias("blob"), row.alias("at")), fresh_folder(spark, "secret-addresses"))
    known = read_ledger(spark, ledger).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("known"))
    keys = F.array(*(F.lit(r.key) for r in rules))
    missing = F.array_except(keys, F.coalesce("known", F.array().cast("array<string>")))
    unseen = staged(
        addresses.groupBy("blob").agg(F.min("at").alias("at")).join(known, "blob", "left")
        .select("blob", "at", missing.alias("missing")).where(F.size("missing") > 0),
        fresh_folder(spark, "secret-unseen"))
    texts = versions.select(blob.alias("blob"), row.alias("at"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    found = scan_texts(texts.join(unseen, ["blob", "at"]), rules)
    found.select(*LEDGER.names).write.mode("append").parquet(ledger)
    return addresses.drop("at")


def current_spans(spark: SparkSession, ledger: str, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, spans of the given rule versions, by start and then in the rules' order."""
    names = [r.key for r in rules]
    order = F.array(*map(F.lit, names))
    spans = F.array_distinct(F.flatten(F.collect_list("spans")))
    wanted = F.transform(
        F.filter(spans, lambda s: F.array_contains(order, s["rule"])),
        lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["rule"]).alias("no"), s["end"].alias("end"),
                           F.substring_index(s["rule"], "@", 1).alias("kind")))
    some = read_ledger(spark, ledger).where(F.size("spans") > 0)
    return some.groupBy("blob").agg(F.array_sort(wanted).alias("spans"))


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, paths: list[str] = ["doc_id"],  # noqa: B006
         text: str = "text") -> DataFrame:
    """One row per version: its paths, ``blob`` and ``spans`` array<(start, no, end, kind)>."""
    addresses = update_ledger(versions, ledger, rules, paths, text)
    spans = current_spans(versions.sparkSession, ledger, rules)
    empty = F.array().cast("array<struct<start:bigint,no:bigint,end:bigint,kind:string>>")
    return addresses.join(spans, "blob", "left").withColumn("spans", F.coalesce("spans", empty))


def redact(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, paths: list[str] = ["doc_id"],  # noqa: B006
           text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span, overlapping ones together, replaced by ``mark``."""
    spark = docs.sparkSession
    update_ledger(docs, ledger, rules, paths, text)
    spans = staged(current_spans(spark, ledger, rules).select(
        F.col("blob").alias("__blob"), F.col("spans").alias("__spans")), fresh_folder(spark, "secret-spans"))
    t = F.col(text)

    def cut(acc: Column, s: Column) -> Column:
        starts = s["start"] >= acc["at"]
        before = F.array(t.substr((acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(starts, F.concat(acc["out"], before)).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate(
        "__spans", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")), cut,
        lambda acc: F.concat(F.array_join(acc["out"], ""), t.substr((acc["at"] + 1).cast("int"), F.length(t))))
    joined = docs.withColumn("__blob", blob_id(t)).join(spans, "__blob", "left")
    return joined.withColumn(text, F.when(F.col("__spans").isNull(), t).otherwise(clean)).select(*docs.columns)


def span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
