"""Removal of lines that many documents share, with two Bloom filters before the exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelink.llm.common import lean, with_fields
from citelink.sources.scratch import stored

MIN_CHARS = 40
MIN_DOCS = 5
#: Bits for each line, and the most bits of a filter (32 MB); a fuller filter only lets more lines through to the exact count.
BITS_PER_LINE = 16
MOST_BITS = 1 << 28
#: Bits of one segment of the filter, which one task merges.
SEGMENT_BITS = 1 << 20


def line_keys(text: str | None, min_chars: int = MIN_CHARS) -> list[bytes | None]:
    """For each line its key's 128-bit hash; None for keys that are too short to count."""
    out: list[bytes | None] = []
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        key = line.strip(b" \t\n\x0b\x0c\r")
        long = len(key) >= min_chars and (key.isascii() or len(key) - sum(map(key.count, _TAILS)) >= min_chars)
        out.append(xxhash.xxh3_128_digest(key.lower()) if long else None)
    return out


#: UTF-8 continuation bytes, which no code point begins with.
_TAILS = [bytes([x]) for x in range(0x80, 0xC0)]


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Two filter positions for each 128-bit hash (rows of two uint64)."""
    return (hashes & np.uint64(bits - 1)).ravel()


def _touched(bits: int, min_chars: int):
    """Of each input partition: by segment, the filter bits that its lines touch once, and those touched again."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[bytes] = []
            for text in batch.column(0).to_pylist():
                found.extend({k for k in line_keys(text, min_chars) if k})
            if not found:
                continue
            at, count = np.unique(_positions(np.frombuffer(b"".join(found), np.uint64).reshape(-1, 2), bits), return_counts=True)
            segment = (at // np.uint64(SEGMENT_BITS)).astype(np.int32)
            cuts = np.flatnonzero(np.diff(segment, prepend=-1))
            inside = (at % np.uint64(SEGMENT_BITS)).astype(np.uint32)
            parts = [(inside[a:b], count[a:b] > 1) for a, b in zip(cuts, [*cuts[1:], len(at)], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(segment[cuts]), pa.array([x.tobytes() for x, _ in parts], pa.binary()), pa.array([x[m].tobytes() for x, m in parts], pa.binary())], ["segment", "once", "twice"]
            )

    return run


@lean
def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by segment: the bits set at least twice. A bit of the once filter that comes again enters the twice filter."""
    now, once, twice = None, np.zeros(0, bool), np.zeros(0, bool)

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())], ["segment", "twice"])

    for batch in batches:
        for segment, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if segment != now:
                if now is not None:
                    yield done()
                now, once, twice = segment, np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
            at = np.frombuffer(a, np.uint32)
            twice[at[once[at]]] = True
            once[at] = True
            twice[np.frombuffer(b, np.uint32)] = True
    if now is not None:
        yield done()


def twice_filter(docs: DataFrame, min_chars: int = MIN_CHARS, bits: int | None = None) -> bytes:
    """The twice-seen filter over the line keys of all documents, at most MOST_BITS bits."""
    if bits is None:
        lines = docs.select(F.sum(F.length("text") / F.lit(min_chars)).cast("bigint")).first()[0] or 0
        bits = 1 << max(20, min(MOST_BITS, int(lines) * BITS_PER_LINE // 4).bit_length() - 1)
    bits = max(bits, SEGMENT_BITS)
    parts = docs.select("text").mapInArrow(_touched(bits, min_chars), "segment int, once binary, twice binary")
    merged = parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(_merged, "segment int, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for segment, twice in merged.toLocalIterator():  # as many bytes as the filter has, never more than MOST_BITS / 8
        out[segment * SEGMENT_BITS // 8 : (segment + 1) * SEGMENT_BITS // 8] = np.frombuffer(bytes(twice), np.uint8)
    return out.tobytes()


def _suspects(shared, min_chars: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.unpackbits(np.frombuffer(shared.value, np.uint8), bitorder="little")
        for batch in batches:
            ids, keys = [], []
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = [*{k for k in line_keys(text, min_chars) if k}]
                ids += [doc] * len(own)
                keys += own
            if not keys:
                continue
            hashes = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
            hit = twice[_positions(hashes, len(twice)).reshape(-1, 2)].all(1)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()).filter(pa.array(hit)), *(pa.array(hashes[hit, i].view(np.int64)) for i in (0, 1))], ["doc_id", "k0", "k1"])

    return run


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, bits: int | None = None) -> DataFrame:
    """(doc_id, k0, k1) of the lines to drop: keys held by at least ``min_docs`` documents, in all but the largest doc_id."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(twice_filter(docs, min_chars, bits))
    seen = stored(docs.select("doc_id", "text").mapInArrow(_suspects(shared, min_chars), "doc_id bigint, k0 bigint, k1 bigint").where("doc_id is not null"), "suspects")
    per_doc = seen.groupBy("k0", "k1", "doc_id").agg(F.lit(1).alias("n"))
    confirmed = per_doc.groupBy("k0", "k1").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)
    confirmed = stored(confirmed.select("k0", "k1", "keeper"), "confirmed")  # as a table of its own the join below can split a very common line
    return seen.join(confirmed, ["k0", "k1"]).where("doc_id <> keeper").select("doc_id", "k0", "k1")


def _without(min_chars: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            texts, drops = batch.column(names.index("text")).to_pylist(), batch.column(names.index("_drop")).to_pylist()
            kept, n_lines, n_dropped = [], [], []
            for text, drop in zip(texts, drops, strict=True):
                lines, gone = (text or "").split("\n"), {(a, b) for a, b in ((x["k0"], x["k1"]) for x in drop or ())}
                if gone:
                    keys = line_keys(text, min_chars)
                    stay = [x for x, k in zip(lines, keys, strict=True) if k is None or tuple(np.frombuffer(k, np.int64).tolist()) not in gone]
                    kept.append("\n".join(stay))
                    n_dropped.append(len(lines) - len(stay))
                else:
                    kept.append(text)
                    n_dropped.append(0)
                n_lines.append(len(lines))
            arrays = [pa.array(kept, pa.string()) if n == "text" else batch.column(i) for i, n in enumerate(names) if n != "_drop"]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*(n for n in names if n != "_drop"), "_n_lines", "_n_dropped"])

    return run


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, bits: int | None = None) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with repeated lines taken out of text, and ``_n_lines``, ``_n_dropped``.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased. A key of at least ``min_chars``
    code points that occurs in at least ``min_docs`` documents goes with all its lines from every document
    but the one of largest doc_id. The rest is joined by a newline again. A null text stays null and counts as one
    empty line; a document whose lines all go is left with an empty text. Rows that repeat a doc_id count as one
    document and are treated alike; rows without a doc_id neither count nor lose lines. Columns already named as those added are replaced.
    """
    docs = docs.drop("_drop", "_n_lines", "_n_dropped")
    gone = repeated_lines(docs, min_chars, min_docs, bits)
    by_doc = gone.groupBy("doc_id").agg(F.collect_set(F.struct("k0", "k1")).alias("_drop"))
    both = docs.join(by_doc, "doc_id", "left").select(*docs.columns, "_drop")
    return both.mapInArrow(_without(min_chars), with_fields(docs, "_n_lines bigint, _n_dropped bigint"))


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Lines of at least 40 code points that five documents share, dropped but for the last document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    )


OP10_SQL = """
WITH lines AS (
    SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
    FROM (SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)
), keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), repeated AS (
    SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
    SELECT doc_id, i, line, r.k IS NOT NULL AND doc_id <> r.keeper AS gone FROM keyed LEFT JOIN repeated r USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
