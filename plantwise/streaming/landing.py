"""A landing folder's files and what was made of them, by version (S7, state of ST2).

Sheets are copied over old ones, often with the time of their source, so neither a file's name nor
the order of times says what is current. The ledger keeps, apart from the data, one manifest row per
landed file version: path, time, size, rows, a hash of what was made of it, the landing's number
and ``home``, the folder with its data. The newest *landing* of a file counts, whatever its time: an
older copy, a restored file and a file without rows replace what was there. A file that vanishes
keeps its last version.

A landing writes its data and manifest rows to folders of its own and is then committed by a rename
to the next number that fails if that number exists. Whoever comes second plans again from the
winner's state, so two refreshes at once add nothing twice, and a run that dies before its commit has
changed nothing. (The rename is atomic where Hadoop's ``FileContext.rename`` is, as on HDFS.)

Files are compared by path, time and size; ``deep`` reads every file and compares hashes instead.
Names of changed files cross the driver in portions of ``FILES_PER_READ``, as a scan needs them, and
so do those of files that the listing lost: Spark lists no empty file, so each of them is looked up
to tell an emptied file from one that vanished.

After ``COMPACT_AFTER`` commits a snapshot replaces them: one manifest, and the data of small homes
rewritten together. A home stays as it is while it holds as many rows as all smaller ones together,
so homes grow geometrically, their number is logarithmic in the rows and a row is
rewritten logarithmically often. Folders that no commit names are deleted once older than ``grace_s``.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

from plantwise.sources.sheets import positional_schema, read_sheet_csv
from plantwise.sources.staging import _fs, exists

FILES_PER_READ = 4096
COMPACT_AFTER = 16
DAY = 86_400
VERSION = ["file_path", "modified", "size"]
VERSION_SCHEMA = "file_path string, modified timestamp, size bigint"
ENTRY = f"{VERSION_SCHEMA}, n_rows bigint, content decimal(38,0), landing bigint, home string"


def file_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Path, time and size of every file of a folder; contents are not read."""
    found = spark.read.format("binaryFile").load(folder)
    return found.select(F.col("path").alias("file_path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def literal_path(path: str) -> str:
    """A path that a reader doesn't take for a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def portions(files: DataFrame) -> Iterator[list[str]]:
    """Names of a written table of files, about FILES_PER_READ at a time."""
    n = -(-files.count() // FILES_PER_READ)
    dealt = files.withColumn("portion", F.pmod(F.xxhash64("file_path"), F.lit(max(n, 1))))
    for p in range(n):
        if names := [r.file_path for r in dealt.where(F.col("portion") == p).select("file_path").collect()]:
            yield names


def raw_rows(raw: DataFrame) -> DataFrame:
    return raw


@dataclass
class Ledger:
    """State of ``landing`` under ``base``. ``payload`` makes the kept rows from the raw rows of some
    files (both with ``file_path``); ``schema`` is its DDL without ``file_path``."""

    spark: SparkSession
    base: str
    landing: str
    n_cols: int
    schema: str
    payload: Callable[[DataFrame], DataFrame] = raw_rows
    grace_s: int = DAY

    # ------------------------------------------------------------ commits
    def commits(self) -> list[tuple[int, str]]:
        """Number and attempt of the commits since the last snapshot, in order (a bounded list)."""
        folder = f"{self.base}/commits"
        if not exists(self.spark, folder):
            return []
        lines = self.spark.read.text(folder).select("value", F.col("_metadata.file_name").alias("name")).collect()
        found = sorted((int(r.name), *r.value.split(" ")) for r in lines if r.name.isdigit())
        last = max((i for i, (_, _, kind) in enumerate(found) if kind == "snapshot"), default=0)
        return [(number, attempt) for number, attempt, _ in found[last:]]

    def commit(self, number: int, attempt: str, kind: str = "landing") -> bool:
        """Make ``attempt`` the ``number``-th commit; False if another one is."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        # a leading dot keeps half-written files out of every listing
        fs, pending = _fs(self.spark, f"{self.base}/commits/.{attempt}-{kind}")
        out = fs.create(pending, True)
        out.write(bytearray(f"{attempt} {kind}", "ascii"))
        out.close()
        target = jvm.org.apache.hadoop.fs.Path(f"{self.base}/commits/{number:012d}")
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(pending, target, options)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            fs.delete(pending, False)
            return False
        return True

    # ------------------------------------------------------------ state
    def manifest(self, commits: list[tuple[int, str]] | None = None) -> DataFrame:
        """The newest landing of every file."""
        commits = self.commits() if commits is None else commits
        if not commits:
            return self.spark.createDataFrame([], ENTRY)
        entries = self.spark.read.schema(ENTRY).parquet(*(f"{self.base}/manifest/{attempt}" for _, attempt in commits))
        rest = [c for c in entries.columns if c != "file_path"]
        newest = entries.groupBy("file_path").agg(F.max_by(F.struct(*rest), "landing").alias("v"))
        return newest.select("file_path", "v.*")

    def data(self, homes: list[str]) -> DataFrame:
        schema = f"file_path string, home string, {self.schema}"
        if not homes:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.base}/data/{h}" for h in homes))

    def read(self) -> DataFrame:
        """What was made of the current files: rows of superseded versions are retracted by a semi
        join with the manifest on (file, home)."""
        live = self.manifest()
        homes = [r.home for r in live.where("n_rows > 0").select("home").distinct().collect()]  # bounded by compaction
        return self.data(homes).join(live.select("file_path", "home"), ["file_path", "home"], "left_semi").drop("home")

    # ------------------------------------------------------------ landing
    def land(self, raw: list[DataFrame], versions: DataFrame, commits: list[tuple[int, str]]) -> bool:
        """Write and commit the payload of ``raw`` (frames of raw rows with ``file_path``) and the manifest
        rows of ``versions``; False if another landing came first."""
        number = commits[-1][0] + 1 if commits else 1
        attempt = uuid.uuid4().hex
        home = f"{self.base}/data/{attempt}"
        for part in raw:
            self.payload(part).withColumn("home", F.lit(attempt)).write.mode("append").parquet(home)
        made = self.data([attempt]) if raw else self.data([])
        values = [c for c in made.columns if c not in ("file_path", "home")]
        per_file = made.groupBy("file_path").agg(
            F.count(F.lit(1)).alias("n_rows"), F.sum(F.xxhash64(*values).cast("decimal(38,0)")).cast("decimal(38,0)").alias("content"))
        # the same content again (a touched file) stays where it is
        known = self.manifest(commits).select(
            "file_path", F.col("n_rows").alias("old_rows"), F.col("content").alias("old_content"), F.col("home").alias("old_home"))
        entries = versions.join(per_file, "file_path", "left").join(known, "file_path", "left").select(
            *VERSION, F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"), "content", F.lit(number).cast("bigint").alias("landing"),
            F.when(F.col("n_rows").eqNullSafe(F.col("old_rows")) & F.col("content").eqNullSafe(F.col("old_content")), F.col("old_home"))
            .otherwise(F.lit(attempt)).alias("home"))
        entries.write.parquet(f"{self.base}/manifest/{attempt}")
        if not self.commit(number, attempt):
            return False
        if len(commits) + 1 >= COMPACT_AFTER:
            self.compact()
        return True

    def refresh(self, deep: bool = False) -> bool:
        """Land every file whose path, time and size are not those of its newest landing (``deep``:
        every file); whether anything was landed."""
        while True:
            commits = self.commits()
            files, known = file_versions(self.spark, self.landing), self.manifest(commits)
            plan = f"{self.base}/plans/{uuid.uuid4().hex}"
            (files if deep else files.join(known, VERSION, "left_anti")).write.parquet(f"{plan}/changed")
            known.where("size > 0").join(files, "file_path", "left_anti").select("file_path").write.parquet(f"{plan}/lost")
            changed = self.spark.read.schema(VERSION_SCHEMA).parquet(f"{plan}/changed")
            lost = self.spark.read.schema("file_path string").parquet(f"{plan}/lost")
            emptied = [v for names in portions(lost) for v in self.emptied(names)]
            raw = [self.with_path(read_sheet_csv(self.spark, [literal_path(n) for n in names], self.n_cols)) for names in portions(changed)]
            if not raw and not emptied:
                return False
            if self.land(raw, changed.union(self.spark.createDataFrame(emptied, VERSION_SCHEMA)), commits):
                return True

    def emptied(self, names: list[str]) -> list[tuple]:
        """Versions of those of ``names`` that exist without a byte."""
        out = []
        for name in names:
            fs, path = _fs(self.spark, name)
            if fs.exists(path) and (status := fs.getFileStatus(path)).getLen() == 0:
                out.append((name, dt.datetime.fromtimestamp(status.getModificationTime() / 1000), 0))
        return out

    def with_path(self, raw: DataFrame) -> DataFrame:
        """Raw rows with the path as the listing writes it (``_metadata`` has it percent-encoded)."""
        path = F.expr("try_url_decode(replace(_metadata.file_path, '+', '%2B'))")
        return raw.select(*positional_schema(self.n_cols).names, path.alias("file_path"))

    # ------------------------------------------------------------ compaction
    def compact(self) -> bool:
        """Replace the commits by one snapshot; False if a landing came between."""
        commits = self.commits()
        if not commits:
            return False
        number, attempt = commits[-1][0] + 1, uuid.uuid4().hex
        live = self.manifest(commits)
        sizes = sorted(((r.n, r.home) for r in live.where("n_rows > 0").groupBy("home").agg(F.sum("n_rows").alias("n")).collect()), reverse=True)
        kept = len(sizes)
        rest = 0
        for i in range(len(sizes) - 1, -1, -1):  # from the smallest: merge up to the last that smaller ones outweigh
            if sizes[i][0] < rest:
                kept = i
            rest += sizes[i][0]
        merged = [home for _, home in sizes[kept:]]
        if merged:
            rows = self.data(merged).join(live.select("file_path", "home"), ["file_path", "home"], "left_semi")
            rows.withColumn("home", F.lit(attempt)).write.parquet(f"{self.base}/data/{attempt}")
        moved = F.col("home").isin(merged) if merged else F.lit(False)
        live.withColumn("home", F.when(moved, F.lit(attempt)).otherwise(F.col("home"))).write.parquet(f"{self.base}/manifest/{attempt}")
        if not self.commit(number, attempt, "snapshot"):
            return False
        self.vacuum()
        return True

    def vacuum(self) -> None:
        """Delete folders that no commit since the last snapshot names, once older than ``grace_s``
        (a reader or a landing under way may still use younger ones)."""
        commits = self.commits()
        named = {attempt for _, attempt in commits}
        homes = {r.home for r in self.manifest(commits).select("home").distinct().collect()} | named
        limit = self.spark.sparkContext._jvm.System.currentTimeMillis() - 1000 * self.grace_s
        for kind, keep in (("data", homes), ("manifest", named), ("plans", set()), ("commits", {f"{n:012d}" for n, _ in commits})):
            fs, folder = _fs(self.spark, f"{self.base}/{kind}")
            for status in fs.listStatus(folder) if fs.exists(folder) else []:
                if status.getPath().getName() not in keep and status.getModificationTime() <= limit:
                    fs.delete(status.getPath(), True)
