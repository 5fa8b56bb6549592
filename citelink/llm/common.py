"""What the corpus operators share: shared scratch tables, text buffers, components."""

from __future__ import annotations

import functools
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from citelink.sources.scratch import dropped, stored

#: Bytes of text that a vectorized pass holds at once; a longer document is a pass of its own.
CHUNK_BYTES = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of an ASCII string: a list of its bytes, each followed by eight shifts (256), folded up. Null stays null."""
    bits = f"flatten(list_transform(range(1, strlen({text}) + 1), lambda i: list_concat([unicode(({text})[i])::UBIGINT], list_transform(range(8), lambda j: 256::UBIGINT))))"
    step = "CASE WHEN o < 256 THEN xor(c, o) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END"
    return f"xor(list_reduce(list_concat([4294967295::UBIGINT], {bits}), lambda c, o: {step}), 4294967295::UBIGINT)"


def small(ids: DataFrame, most: int) -> bool:
    """Whether a table has at most ``most`` rows; counting stops there."""
    return ids.limit(most + 1).count() <= most


def only_ids(rows: DataFrame, ids: DataFrame, key: str, most: int = 1_000_000) -> DataFrame:
    """``rows`` whose key is in ``ids`` (distinct). The ids are broadcast only up to ``most`` rows (16 bytes each)."""
    return rows.join(F.broadcast(ids) if small(ids, most) else ids, key, "left_semi")


def with_fields(df: DataFrame, added: str, without: tuple[str, ...] = ()) -> StructType:
    """The schema of ``df`` less some columns, with the columns of a DDL string after them; whatever types and names it has."""
    kept = [StructField(f.name, f.dataType, True) for f in df.schema.fields if f.name not in without]
    return StructType(kept + StructType.fromDDL(added).fields)


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES, most_rows: int = 1 << 16) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, UTF-8 bytes, row offsets) of a string column, about ``limit`` bytes and at most so many rows at a time. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    _, ends, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at, n = 0, len(column)
    while at < n:
        to = min(max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1), at + most_rows)
        yield at, to - at, raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer over uint64, so that every bit of a sum reaches every bit of the result."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def lean(run):
    """A function over Arrow batches that gives freed memory back when it ends, since its Python worker stays for later tasks."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()

    return wrapped


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected edges (a bigint, b bigint): (id, root), root the smallest id reachable.

    Each round points every node at the neighbour of lowest random priority (or itself) and contracts the edges
    along these pointers, which removes a constant share of the nodes whatever the shape of the graph. Rounds
    are tables in the shared folder. Loops, repeated edges and an empty table are fine; nodes without an edge
    to another node have no row.
    """
    flat = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = stored(flat, "edges")
    steps: list[DataFrame] = []

    def rank(c: Column) -> Column:
        return F.struct(F.xxhash64(F.lit(len(steps)), c).alias("p"), c.alias("to"))

    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("m"))
        step = stored(best.select("a", F.least(F.col("m"), rank(F.col("a")))["to"].alias("to")), "step")
        to_a, to_b = step.select("a", F.col("to").alias("ta")), step.select(F.col("a").alias("b"), F.col("to").alias("tb"))
        moved = left.join(to_a, "a").join(to_b, "b").where("ta <> tb")
        old, left = left, stored(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
        dropped(old)
        steps.append(step)
    if not steps:
        return left.select(F.col("a").alias("id"), F.col("b").alias("root"))
    found = steps[-1]
    for step in reversed(steps[:-1]):  # as many joins as rounds, a logarithm of the nodes
        later = found.select(F.col("a").alias("to"), F.col("to").alias("far"))
        found = step.join(later, "to", "left").select("a", F.coalesce("far", "to").alias("to"))
    found = stored(found, "roots")
    least = found.groupBy("to").agg(F.min(F.least("a", "to")).alias("root"))
    roots = stored(found.join(least, "to").select(F.col("a").alias("id"), "root"), "components")
    dropped(found, left, *steps)
    return roots
