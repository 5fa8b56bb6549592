"""Near-duplicate embeddings: spherical-cap filters from structured random product codes, joined on filters and verified."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelink.llm.common import components, lean, small
from citelink.sources.scratch import dropped, stored

COSINE = 0.95
SEED = 41
#: Independent codes, parts of a direction, vectors of a filter aimed at, and filters that a pair at the threshold shares on average.
CODES, BLOCKS, FILTER_SIZE, SHARED = 24, 2, 48, 20
#: Bytes of all codewords at most. A code that needs more filters has more parts, so it stays small at any number of vectors; vectors
#: are less even over these, so that more filters have to be shared.
CODE_BYTES, SHARED_BEYOND = 64 << 20, 2.4
#: Vectors of a tile: a filter with more is compared in pairs of tiles, so no task holds a whole large filter.
TILE = 1024


def _cap(dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(grid, share of the sphere above it) of one coordinate of a random unit vector."""
    t = np.linspace(-1, 1, 40_001)
    weight = np.maximum(1 - t * t, 1e-300) ** ((dims - 3) / 2)
    above = np.cumsum(weight[::-1])[::-1]
    return t, above / above[0]


class Code:
    """Structured random product codes, whose codewords are the centres of spherical caps.

    Each of ``CODES`` codes turns the dimensions at random and cuts them in ``BLOCKS`` parts with random codewords of their
    own; a filter direction joins one codeword of each part. A vector is in every filter whose direction has a dot
    product of at least ``alpha`` with it. Decoding lists them all: of each part it keeps the codewords
    that can still reach alpha with the best of the other parts, and joins what is kept. Alpha follows from
    the number of vectors, the number of filters from alpha, so that filters stay small and pairs meet at any size.
    """

    def __init__(self, dims: int, rows: int, cosine: float = COSINE, seed: int = SEED, aim: float = FILTER_SIZE, shared: float = SHARED, codes: int = CODES):
        self.dims = dims
        grid, above = _cap(max(dims, 4))
        share = min(0.25, max(1e-9, aim / max(rows, 1)))
        self.alpha = float(grid[np.searchsorted(-above, -share)])
        inner_grid, inner = _cap(max(dims - 1, 4))
        s = np.linspace(self.alpha, 1, 2000)
        mass = np.maximum(1 - s * s, 1e-300) ** ((max(dims, 4) - 3) / 2)
        need = (self.alpha - cosine * s) / np.maximum(np.sqrt((1 - cosine * cosine) * (1 - s * s)), 1e-12)
        both = float((mass * np.interp(need, inner_grid, inner)).sum() / mass.sum())
        wanted, most = shared / both / codes / share, max(64, CODE_BYTES // (8 * codes * dims))
        blocks = min(BLOCKS, dims)
        if wanted > most**blocks:
            wanted *= SHARED_BEYOND
        while blocks < dims and wanted > most**blocks:
            blocks += 1
        self.per_block = max(2, math.ceil(wanted ** (1 / blocks)))
        rng = np.random.default_rng(seed)
        cuts = [round(dims * i / blocks) for i in range(blocks + 1)]
        self.codes = []
        for _ in range(codes):
            turn = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
            parts = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                w = rng.standard_normal((self.per_block, b - a))
                parts.append(turn[:, a:b] @ (w / np.linalg.norm(w, axis=1, keepdims=True) / math.sqrt(blocks)).T)
            self.codes.append(parts)
        self.filters = codes * self.per_block**blocks

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters that the rows (unit vectors) are in, sorted."""
        out = []
        for c, words in enumerate(self.codes):
            parts = [unit @ w for w in words]
            best = np.array([p.max(1) for p in parts])
            rows, filters, score = np.arange(len(unit)), np.full(len(unit), c, np.int64), np.zeros(len(unit))
            for j, part in enumerate(parts):
                others = best.sum(0) - best[j]
                r, k = np.nonzero(part >= (self.alpha - others)[:, None])
                first, many = np.searchsorted(r, rows), np.bincount(r, minlength=len(unit))[rows]
                again = np.repeat(np.arange(len(rows)), many)
                at = np.repeat(first, many) + np.arange(len(again)) - np.repeat(np.cumsum(many) - many, many)
                rows, score = rows[again], score[again] + part[r[at], k[at]]
                filters = filters[again] * self.per_block + k[at]
                rest = best[j + 1 :].sum(0)
                ok = score + rest[rows] >= self.alpha
                rows, filters, score = rows[ok], filters[ok], score[ok]
            out.append((rows, filters))
        rows, filters = (np.concatenate([x[i] for x in out]) for i in (0, 1))
        order = np.lexsort((filters, rows))
        return rows[order], filters[order]


@functools.lru_cache(maxsize=4)
def code_for(dims: int, rows: int, cosine: float, seed: int, aim: float) -> Code:
    """The code for vectors of one length. It follows from these numbers alone, so every worker makes its own and nothing is sent."""
    return Code(dims, rows, cosine, seed, aim)


def unit_rows(column: pa.Array, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(usable rows, their unit vectors in double precision): not null, not zero, all components finite, of the common length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.array([len(x) if x.is_valid else -1 for x in column]) if column.null_count else np.diff(column.offsets.to_numpy())
    values = column.flatten()
    has_null = np.zeros(len(values), bool) if not values.null_count else np.asarray(values.is_null().to_numpy(zero_copy_only=False))
    flat = np.where(has_null, np.nan, values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)) if len(values) else np.zeros(0)
    ends = np.cumsum(np.maximum(size, 0))
    keep = np.flatnonzero((size > 0) if dims is None else (size == dims))
    if not len(keep):
        return keep, np.zeros((0, dims or 0))
    d = dims or int(size[keep[0]])
    x = flat[(ends[keep] - size[keep])[:, None] + np.arange(d)]
    with np.errstate(over="ignore", invalid="ignore"):
        top = np.abs(x).max(1)
        ok = np.isfinite(x).all(1) & (top > 0)
        x = x[ok] / top[ok, None]
    return keep[ok], x / np.linalg.norm(x, axis=1, keepdims=True)


def _members(plans: dict[int, tuple[int, int]], cosine: float, seed: int, aim: float):
    """Of each vector: its raw bytes and its filters. ``plans``: for each common length its number of vectors and its first filter."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for dims in sorted({len(x) for x in part.column(1) if x.is_valid and len(x)}):
                    keep, unit = unit_rows(part.column(1), dims)
                    if not len(keep):
                        continue
                    if dims in plans:
                        rows, first = plans[dims]
                        at_row, filters = code_for(dims, rows, cosine, seed, aim).decode(unit)
                        filters = filters + first
                    else:  # a rare length: its vectors fit one filter
                        at_row, filters = np.arange(len(keep)), np.full(len(keep), -dims, np.int64)
                    cuts = np.searchsorted(at_row, np.arange(len(keep) + 1)).astype(np.int32)
                    column = part.column(1).take(pa.array(keep))
                    raw = column.flatten().to_numpy(zero_copy_only=False).reshape(len(keep), dims)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(keep)), pa.ListArray.from_arrays(cuts, pa.array(filters)), pa.array([x.tobytes() for x in raw + 0.0], pa.binary())], ["id", "filters", "raw"]
                    )

    return run


@lean
def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each filter of a vector, with the filters before it as packed integers."""
    for batch in batches:
        ids, copies, raws = batch.column(0), batch.column(1), batch.column(3)
        filters = [x.values.to_numpy() for x in batch.column(2)]
        for s in range(0, len(filters), 256):
            own = filters[s : s + 256]
            many = [len(x) for x in own]
            if not sum(many):
                continue
            at = pa.array(np.repeat(np.arange(s, s + len(own)), many))
            before = [x[:k].tobytes() for x in own for k in range(len(x))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), pa.array(before, pa.binary()), ids.take(at), copies.take(at), raws.take(at)], ["filter", "before", "id", "copies", "raw"])


def _first_shared(own: list[np.ndarray], other: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs (i of own, j of other) share no earlier filter: only there they are counted."""
    shared = np.intersect1d(np.concatenate(own), np.concatenate(other))
    if other is own:
        every, many = np.unique(np.concatenate(own), return_counts=True)
        shared = every[many > 1]
    if not len(shared):
        return np.ones(len(i), bool)

    def table(lists: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(lists), len(shared)), bool)
        for r, x in enumerate(lists):
            at = np.searchsorted(shared, x)
            at[at == len(shared)] = 0
            out[r, at[shared[at] == x]] = True
        return np.packbits(out, axis=1)

    left = table(own)
    right = left if other is own else table(other)
    fresh = np.ones(len(i), bool)
    for s in range(0, len(i), 1 << 16):
        fresh[s : s + (1 << 16)] = ~(left[i[s : s + (1 << 16)]] & right[j[s : s + (1 << 16)]]).any(1)
    return fresh


def _compared(cosine: float, kind: type):
    """Of rows sorted by filter and pair of tiles: how many new links each vector has there, and a forest of those links."""

    def vectors(raws: list[bytes]) -> np.ndarray:
        x = np.frombuffer(b"".join(raws), kind).astype(np.float64).reshape(len(raws), -1)
        x /= np.abs(x).max(1, keepdims=True)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def links(left: list, right: list | None) -> tuple[dict[int, int], list[tuple[int, int]]]:
        ids, lists, units, copies = (list(x) for x in zip(*left, strict=True))
        x = vectors(units)
        if right is None:
            i, j = np.nonzero(np.triu(x @ x.T >= cosine, 1))
            ids_b, lists_b, copies_b = ids, lists, copies
        else:
            ids_b, lists_b, units_b, copies_b = (list(x) for x in zip(*right, strict=True))
            i, j = np.nonzero(x @ vectors(units_b).T >= cosine)
        if len(i):
            fresh = _first_shared(lists, lists_b, i, j)
            i, j = i[fresh], j[fresh]
        a, b = np.array(ids, np.int64)[i], np.array(ids_b, np.int64)[j]
        both, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        weight = np.concatenate([np.array(copies_b, np.int64)[j], np.array(copies, np.int64)[i]])
        many = dict(zip(both.tolist(), np.bincount(at, weight, len(both)).astype(np.int64).tolist(), strict=True))
        root: dict[int, int] = {}

        def find(v: int) -> int:
            while root.get(v, v) != v:
                root[v] = v = root.get(root[v], root[v])
            return v

        forest = []
        for p, q in zip(a.tolist(), b.tolist(), strict=True):
            p2, q2 = find(p), find(q)
            if p2 != q2:
                root[max(p2, q2)] = min(p2, q2)
                forest.append((p, q))
        return many, forest

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, ([], [])

        def done() -> pa.RecordBatch:
            left, right = sides
            if now[1] == now[2]:
                many, forest = links(left + right, None)
            else:
                many, forest = links(left, right) if left and right else ({}, [])
            return pa.RecordBatch.from_arrays(
                [pa.array([*many, *(a for a, _ in forest)], pa.int64()), pa.array([*([None] * len(many)), *(b for _, b in forest)], pa.int64()), pa.array([*many.values(), *([0] * len(forest))], pa.int64())], ["a", "b", "n"]
            )

        for batch in batches:
            for f, s, t, side, before, id_, copies, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (f, s, t) != now:
                    if now is not None:
                        yield done()
                    now, sides = (f, s, t), ([], [])
                sides[side].append((id_, np.frombuffer(before, np.int64), raw, copies))
        if now is not None:
            yield done()

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, seed: int = SEED, aim: float = FILTER_SIZE, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for (vec_id, embedding array<float or double>).

    Equal vectors are one class from the start; a class's vectors link with each other and as one with other classes.
    Classes that share a filter are compared by cosine in double precision; a pair that shares several is
    counted in the first. A filter of more than ``tile`` classes is dealt over tiles, and each pair of tiles is a task's
    small matrix product. Vectors of each length have filters of their own: a code where they are the commonest or more than
    a tile, else one filter for all of them. Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing, nor do vectors of different lengths. Rows without a vec_id are left out; rows that repeat a vec_id with equal
    vectors count as copies of each other.
    """
    vectors = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").where("vec_id is not null")
    lengths = vectors.where("embedding is not null and size(embedding) > 0").groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"))
    top = lengths.orderBy(F.desc("n"), "d").first()
    plain = vectors.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if top is None:
        return plain
    plans, first = {}, 0
    for r in sorted(lengths.where((F.col("n") > tile) | (F.col("d") == top["d"])).collect()):  # never more than one for each full tile of rows
        plans[r["d"]] = (r["n"], first)
        first += code_for(r["d"], r["n"], cosine, seed, aim).filters
    kind = np.float32 if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64
    decoded = stored(vectors.mapInArrow(_members(plans, cosine, seed, aim), "id bigint, filters array<bigint>, raw binary"), "decoded")
    classes = decoded.groupBy("raw").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    member = stored(decoded.select("id", "raw").join(classes, "raw").select("id", "rep", "copies"), "classes")
    reps = decoded.join(member.where("id = rep").select("id", "copies").distinct(), "id").dropDuplicates(["id"])
    spread = reps.select("id", "copies", "filters", "raw").mapInArrow(_spread, "filter bigint, before binary, id bigint, copies bigint, raw binary")
    large = decoded.select(F.explode("filters").alias("filter")).groupBy("filter").agg(F.count("*").alias("n")).where(F.col("n") > tile)
    large = stored(large.select("filter", F.ceil(F.col("n") / tile).cast("int").alias("tiles")), "large")
    tiled = spread.join(F.broadcast(large) if small(large, 100_000) else large, "filter", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("id"), "tiles").cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, "tile").alias("s"), F.greatest(t, "tile").alias("t")))
    dealt = tiled.withColumn("p", F.explode(pairs)).select("filter", "p.s", "p.t", F.when(F.col("tile") == F.col("p.t"), F.lit(1)).otherwise(0).alias("side"), "before", "id", "copies", "raw")
    dealt = dealt.repartition("filter", "s", "t").sortWithinPartitions("filter", "s", "t")
    found = stored(dealt.mapInArrow(_compared(cosine, kind), "a bigint, b bigint, n bigint"), "found")
    dropped(decoded, large)
    return _counted(plain, found, member)


def _counted(plain: DataFrame, found: DataFrame, member: DataFrame) -> DataFrame:
    """Links of classes as links of vectors: a vector links with the rest of its class and with all copies in linked classes."""
    many = found.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    roots = components(found.where("b is not null").select("a", "b")).withColumnRenamed("id", "rep")
    own = member.join(many, "rep", "left").join(roots, "rep", "left")
    own = own.groupBy("id").agg(F.max(F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"), F.min(F.coalesce("root", "rep")).alias("root"))
    rows = plain.select("vec_id").join(own.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    found = rows.select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op4_embed_dup(spark, sf_dir: str) -> DataFrame:
    """Vectors whose cosine is at least 0.95."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP4_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach(id, other) AS (
    SELECT vec_id, vec_id FROM v UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other
), least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE a = v.vec_id) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN least ON least.id = v.vec_id
"""
