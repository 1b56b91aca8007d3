"""Clustered layout of stored tables, so that lookups skip files and row groups.

Rows are dealt by the partition columns, each task's rows sorted by the cluster columns, and Parquet
keeps Bloom filters on columns that are looked up by equality. A lookup then prunes folders by the
partition columns, row groups by the ranges of the cluster columns, and by Bloom filters where a
looked-up value lies inside a range but not in the group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

ROW_GROUP_BYTES = 32 << 20


def bloom_options(columns: Sequence[str], row_group_bytes: int = ROW_GROUP_BYTES) -> dict[str, str]:
    """Writer options: a Bloom filter on each column, sized by Parquet to the values a row group can hold."""
    out = {"parquet.block.size": str(row_group_bytes), "parquet.page.size.row.check.min": "10"}
    for c in columns:
        out[f"parquet.bloom.filter.enabled#{c}"] = "true"
        out[f"parquet.bloom.filter.adaptive.enabled#{c}"] = "true"
    return out


def clustered(df: DataFrame, partition_by: Sequence[str], cluster_by: Sequence[str]) -> DataFrame:
    """``df`` dealt by ``partition_by`` (hot values over several tasks, small ones together) and sorted by
    both inside each task."""
    dealt = df.hint("rebalance", *partition_by) if partition_by else df
    return dealt.sortWithinPartitions(*partition_by, *cluster_by)


def write_clustered(df: DataFrame, path: str, partition_by: Sequence[str] = (), cluster_by: Sequence[str] = (), bloom: Sequence[str] = (),
                    row_group_bytes: int = ROW_GROUP_BYTES) -> str:
    writer = clustered(df, partition_by, cluster_by).write.mode("overwrite").options(**bloom_options(bloom, row_group_bytes))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path
