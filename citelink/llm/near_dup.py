"""Near-duplicate documents: one-permutation MinHash with optimal densification, banded buckets and star-shaped candidate edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelink.llm.common import CHUNK_BYTES, components, lean, mixed, only_ids, text_chunks
from citelink.sources.scratch import dropped, stored

WORDS = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Bands and rows: a pair at 0.85 shares no bucket with probability (1 - 0.85**5)**24 < 1e-6.
BANDS, ROWS = 24, 5
#: Documents and shingles of a tile: a larger bucket that still spans several components is compared in pairs of tiles.
TILE, TILE_SHINGLES = 512, 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.array([0xD1342543DE82EF95, 0xAF251AF3B0F025B5, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD], np.uint64)

_powers = _inverses = np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, CHUNK_BYTES + 1)
        _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE)]), dtype=np.uint64)
        _inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE_INVERSE)]), dtype=np.uint64)
    return _powers, _inverses


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of UTF-8 rows, A-Z lower-cased, and for each row the index of its first word (one more at the end)."""
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    lower = data + ((data >= 65) & (data <= 90)) * np.uint8(32)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][(offsets[:-1] < len(data))]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    powers, inverses = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    h = mixed((sums[ends] - sums[starts]) * inverses[starts])
    return h, np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """For each row its sorted distinct shingle hashes. A row with fewer words is one shingle, a row without words none."""
    h, at = word_hashes(data, offsets)
    n = max(0, len(h) - words + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(words):
        rolled += h[j : j + n] * _STEP[j % len(_STEP)] * np.uint64(2 * (j // len(_STEP)) + 1)
    rolled = mixed(rolled)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= words:
            s = np.sort(rolled[a : b - words + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            out.append(mixed(np.array([sum(int(x) * (2 * i + 3) for i, x in enumerate(h[a:b].tolist())) + (b - a) & 0xFFFFFFFFFFFFFFFF], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """One-permutation MinHash: the least hash in each of ``slots`` equal ranges; an empty slot borrows from the first
    occupied one in its own random order (optimal densification). Rows without shingles get zeros."""
    out, full = np.zeros((len(sets), slots), np.uint64), np.zeros((len(sets), slots), bool)
    for i, s in enumerate(sets):
        if len(s):
            slot = ((s >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)
            first = np.concatenate([[True], slot[1:] != slot[:-1]])
            out[i, slot[first]] = s[first]
            full[i, slot[first]] = True
    row, slot = np.nonzero(~full & full.any(1)[:, None])
    source, turn = out.copy(), 0
    while len(row):
        turn += 1
        pick = (mixed(slot.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(turn)) >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)
        hit = full[row, pick]
        out[row[hit], slot[hit]] = source[row[hit], pick[hit]]
        row, slot = row[~hit], slot[~hit]
    return out


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit bucket key for each row and band."""
    parts = sig.reshape(len(sig), bands, rows)
    keys = np.zeros((len(sig), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * _BASE
    for j in range(rows):
        keys = mixed(keys + parts[:, :, j] * _STEP[j % len(_STEP)])
    return keys


def _sketch(words: int, bands: int, rows: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, data, offsets in text_chunks(batch.column(1)):
                sets = shingle_sets(data, offsets, words)
                keys = band_keys(signatures(sets, bands * rows), bands, rows).view(np.int64)
                sums = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                more = np.array([mixed(s ^ _BASE).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                sizes = np.array([len(s) for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), pa.array(sizes), pa.array(sums), pa.array(more), pa.ListArray.from_arrays(np.arange(0, (n + 1) * bands, bands, dtype=np.int32), pa.array(keys.ravel()))],
                    ["doc_id", "n_shingles", "s0", "s1", "bands"],
                )

    return run


def _sets(words: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, data, offsets in text_chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array([s.tobytes() for s in shingle_sets(data, offsets, words)], pa.binary())], ["doc_id", "shingles"])

    return run


def _linked(percent: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            kept = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], ["a", "b"])

    return run


def _verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link on their full shingle sets."""
    pairs = stored(pairs.select("a", "b").distinct(), "pairs")
    ids = stored(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids")
    texts = only_ids(docs, ids, "doc_id")
    sets = stored(texts.mapInArrow(_sets(words), "doc_id bigint, shingles binary"), "sets")
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y")
    links = stored(both.mapInArrow(_linked(percent), "a bigint, b bigint"), "links")
    dropped(sets, pairs, ids)
    return links


def _across(percent: int):
    """Of rows sorted by bucket and pair of tiles: a forest of links between documents of different components, on full sets."""

    def forest(left: list, right: list) -> list[tuple[int, int]]:
        rows = left + right
        sets = [np.frombuffer(r[2], np.uint64) for r in rows]
        sizes = np.array([len(x) for x in sets])
        at = np.cumsum(sizes) - sizes
        flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
        marks = np.zeros(int(flat.max()) + 1, np.uint8)
        labels = np.array([r[1] for r in rows], np.int64)
        root: dict[int, int] = {}

        def find(v: int) -> int:
            while root.get(v, v) != v:
                root[v] = v = root.get(root[v], root[v])
            return v

        out = []
        for i in range(len(left)):
            own = flat[at[i] : at[i] + sizes[i]]
            marks[own] = 1
            both = np.add.reduceat(marks[flat], at, dtype=np.int64)
            marks[own] = 0
            hit = (100 * both >= percent * (sizes + sizes[i] - both)) & (labels != labels[i])
            if right:
                hit[: len(left)] = False
            for j in np.flatnonzero(hit).tolist():
                p, q = find(int(labels[i])), find(int(labels[j]))
                if p != q:
                    root[max(p, q)] = min(p, q)
                    out.append((rows[i][0], rows[j][0]))
        return out

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, ([], [])

        def done() -> pa.RecordBatch:
            left, right = sides
            pairs = forest(left, right) if left and (right or now[1] == now[2]) else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for bucket, s, t, side, doc, label, shingles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (bucket, s, t) != now:
                    if now is not None:
                        yield done()
                    now, sides = (bucket, s, t), ([], [])
                sides[side].append((doc, label, shingles))
        if now is not None:
            yield done()

    return run


def _beyond_stars(shared: DataFrame, found: DataFrame, docs: DataFrame, words: int, percent: int, tile: int, tile_shingles: int) -> DataFrame:
    """Links that the stars missed: pairs (a, b) of different components in one bucket, found on whole sets.

    Only buckets of three or more that still hold several components come here. The documents outside a bucket's commonest
    component, mostly few, are compared with each other and with that component, which is never compared with itself. Both
    are dealt over tiles, and each pair of tiles is compared on its own, so no task holds a whole large bucket,
    and what leaves a tile is a forest, never its pairs.
    """
    labelled = shared.where("size > 2").join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("bucket", "doc_id", "n", F.coalesce("root", "doc_id").alias("label"))
    labelled = stored(labelled, "labelled")
    parts = labelled.groupBy("bucket", "label").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    whole = parts.groupBy("bucket").agg(F.max(F.struct("c", "label", "n")).alias("m"), F.count("*").alias("labels"), F.sum("c").alias("c"), F.sum("n").alias("n")).where("labels > 1")
    tiles = lambda c, n: F.greatest(F.ceil(c / tile), F.ceil(n / tile_shingles)).cast("int")
    split = whole.select("bucket", F.col("m.label").alias("main"), tiles(F.col("c") - F.col("m.c"), F.col("n") - F.col("m.n")).alias("few"), tiles(F.col("m.c"), F.col("m.n")).alias("many"))
    split = stored(split, "split")
    open_ = stored(labelled.join(split, "bucket"), "open")
    ids = stored(open_.select("doc_id").distinct(), "ids")
    sets = stored(only_ids(docs, ids, "doc_id").mapInArrow(_sets(words), "doc_id bigint, shingles binary"), "sets")
    inside = F.col("label") == F.col("main")
    h = F.xxhash64("doc_id")
    placed = open_.withColumn("tile", F.when(inside, F.col("few") + F.pmod(h, "many")).otherwise(F.pmod(h, "few")).cast("int"))
    others = F.sequence(F.lit(0), F.when(inside, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1)
    pairs = F.transform(others, lambda t: F.struct(F.least(t, "tile").alias("s"), F.greatest(t, "tile").alias("t")))
    side = F.when((F.col("tile") == F.col("p.t")) & (F.col("p.s") < F.col("p.t")), F.lit(1)).otherwise(0).alias("side")
    dealt = placed.withColumn("p", F.explode(pairs)).select("bucket", "p.s", "p.t", side, "doc_id", "label").join(sets, "doc_id")
    dealt = dealt.select("bucket", "s", "t", "side", "doc_id", "label", "shingles").repartition("bucket", "s", "t").sortWithinPartitions("bucket", "s", "t")
    out = stored(dealt.mapInArrow(_across(percent), "a bigint, b bigint"), "beyond")
    dropped(labelled, split, open_, ids, sets)
    return out


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, tile: int = TILE, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): groups of documents linked directly or through others.

    Documents whose shingle sets are equal are one class from the start, so copies meet in one aggregate and only
    the class's least doc_id is compared. Within a bucket one hub, the member that shares most buckets with others, is
    paired with the rest: a star, not all pairs. Buckets that then still hold several components are gone over
    in tiles for links between those, so no candidate is dropped. Every link is
    confirmed on its full sets. A null or wordless text has no shingles and links with nothing. Rows that
    repeat a doc_id each have a row in the result, and what any of them links with, all of them do.
    """
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    sketch = stored(docs.mapInArrow(_sketch(words, bands, rows), "doc_id bigint, n_shingles bigint, s0 bigint, s1 bigint, bands array<bigint>"), "sketch")
    own = ["n_shingles", "s0", "s1"]
    classes = sketch.where("n_shingles > 0").groupBy(*own).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
    classes = stored(classes.drop("copies"), "classes")
    members = stored(sketch.select("doc_id", *own).join(classes, own, "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")), "members")
    reps = members.where("doc_id = rep and n_shingles > 0").select("doc_id").distinct()
    banded = stored(sketch.join(reps, "doc_id", "left_semi").select("doc_id", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket")), "banded")
    buckets = stored(banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    shared = stored(banded.join(buckets, "bucket").select("bucket", "size", "doc_id", "n"), "shared")
    dropped(banded)
    # the text that others were made from shares most buckets with them, so it is the best hub
    load = stored(shared.groupBy("doc_id").agg(F.sum("size").alias("load")), "load")
    hub = F.max(F.struct("load", F.xxhash64("doc_id", "bucket").alias("h"), F.col("doc_id").alias("hub"), F.col("n").alias("hub_n")))
    hubs = stored(shared.join(load, "doc_id").groupBy("bucket").agg(hub.alias("hub")).select("bucket", "hub.hub", "hub.hub_n"), "hubs")
    star = shared.join(hubs, "bucket").where(f"hub <> doc_id and 100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)")
    links = _verified(star.select(F.col("hub").alias("a"), F.col("doc_id").alias("b")), docs, words, percent)
    first = components(links)
    beyond = _beyond_stars(shared, first, docs, words, percent, tile, tile_shingles)
    more = _verified(beyond, docs, words, percent)
    # the links found later join what the stars have joined, so only the roots of those go round again
    ends = more
    for c in ("a", "b"):
        ends = ends.join(first.select(F.col("id").alias(c), F.col("root").alias(f"r{c}")), c, "left").withColumn(c, F.coalesce(f"r{c}", c)).drop(f"r{c}")
    second = components(ends)
    far = second.select(F.col("id").alias("root"), F.col("root").alias("far"))
    found = first.join(far, "root", "left").select("id", F.coalesce("far", "root").alias("root"))
    found = stored(found.unionByName(second.join(first.select("id"), "id", "left_anti")), "found")
    dropped(sketch, classes, buckets, shared, load, hubs, links, first, second, beyond, more)
    rep = members.join(found.select(F.col("id").alias("rep"), "root"), "rep", "left")
    return rep.select("doc_id", "n_shingles", F.coalesce("root", "rep").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op3_near_dup(spark, sf_dir: str) -> DataFrame:
    """Groups of documents whose five-word shingle sets overlap by at least 0.85."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w
), e AS (
    SELECT doc_id, unnest(s) AS x FROM s
), shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
    SELECT a, b FROM shared JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b WHERE 100 * n >= 85 * (len(p.s) + len(q.s) - n)
), reach(id, other) AS (
    SELECT doc_id, doc_id FROM s UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other
), least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN least ON id = doc_id
"""
