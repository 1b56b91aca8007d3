"""Broadcast only behind a proven bound.

A table is hinted for broadcast only where an upper bound on its rows follows from the
parameters (targets, modes, columns) and fits the session's own broadcast threshold. Any
other join carries no hint: Catalyst and adaptive execution choose by measured size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def max_broadcast_rows(df: DataFrame, row_bytes: int = 64) -> int:
    """Row limit derived from the session's broadcast threshold; 0 where it is switched off."""
    jvm_conf = df.sparkSession._jsparkSession.sessionState().conf()
    return max(0, int(jvm_conf.autoBroadcastJoinThreshold())) // row_bytes


def broadcast_if_bounded(df: DataFrame, bound_rows: int) -> DataFrame:
    """Hint a broadcast when a static upper bound on the rows is known and small."""
    return F.broadcast(df) if bound_rows <= max_broadcast_rows(df) else df
