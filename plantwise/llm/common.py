"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantwise.session import shared_dir

# \x20 and \x09-\x0D: the white space of every word pattern here
SPACE_CLASS = r"[\x20\x09-\x0D]+"


_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Give this package to the Python workers by Spark's own file distribution, once per
    application, so that no worker needs it on its path beforehand."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    import plantwise

    root = os.path.dirname(os.path.abspath(plantwise.__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="plantwise-code-"), "plantwise.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("plantwise", os.path.relpath(path, root)))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared root, so two runs never share or overwrite a stage."""
    return shared_dir(spark, f"plantwise-llm/{name}-{uuid.uuid4().hex}")


def staged(df: DataFrame, folder: str, mode: str = "errorifexists", **options: str) -> DataFrame:
    """Write ``df`` to ``folder`` and read it back: lineage ends there, a lost executor costs
    a re-read, and Catalyst knows the size of what it joins next."""
    spark = df.sparkSession
    df.write.mode(mode).option("compression", "zstd").options(**options).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def id_bucket(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (a null id counts as empty text)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % F.lit(modulus)
