"""Exact numbers and batches over rows in order, without any task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citelink.sources.scratch import stored


def number_rows(df: DataFrame, keys: tuple[str, ...] = ("doc_id", "ref_no"), name: str = "row_no") -> DataFrame:
    """``df`` with ``name``, each row's place (from 0) in ascending order of the keys, nulls first; rows of equal keys follow each other in any order.

    Rows are sorted in range partitions and numbered inside them; a prefix sum over one row for each partition gives where each
    partition starts. An empty table stays empty.
    """
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    placed = stored(placed, "placed")
    spans = placed.groupBy("_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = spans.select("_part", "_first", before.alias("_before"))  # a row for each partition
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.expr("_at - _first + _before")).drop("_part", "_at", "_first", "_before")


def number_batches(df: DataFrame, size: int, keys: tuple[str, ...] = ("doc_id", "ref_no")) -> DataFrame:
    """``df`` with ``batch``: runs of exactly ``size`` rows in order of the keys, only the last one may be shorter."""
    return number_rows(df, keys, "_row").withColumn("batch", F.expr(f"_row div {int(size)}")).drop("_row")
