"""Document fingerprints: homomorphic multiset hashes of paragraphs, with built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelink.sources.scratch import stored

#: Lanes of 32 bits that sum the hashes of whole paragraphs.
WHOLE = 4
#: Words of a run (code points, in a paragraph without blanks); runs overlap and don't go beyond their paragraph.
RUN_WORDS = 8
#: Longs of two 32-bit lanes that count, over all runs, the set bits of the runs' hashes.
LONGS, LANE = 32, 32
#: Runs that are counted in 8-bit lanes before these are added up in the wider ones.
CHUNK = 127
_M32 = 1 << 32
_ONES8, _PAIR8 = 0x0101010101010101, 0xFF | 0xFF << LANE


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _runs(paragraph: Column) -> Column:
    """The hashes of a paragraph's runs."""

    def hashed(units: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(units) - (RUN_WORDS - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(units, i, RUN_WORDS)))

    words = F.regexp_extract_all(paragraph, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    units = _bound(words, lambda w: F.when(F.size(w) == 1, F.split(F.element_at(w, 1), "")).otherwise(w))
    hashes = F.transform(units, lambda u: F.xxhash64(u))
    return _bound(hashes, lambda h: F.when(F.size(h) > 0, hashed(h)).otherwise(F.array().cast("array<bigint>")))


def _sums(items: Column, names: list[str], add: Callable[[Column, Column, int], Column]) -> Column:
    """A struct of sums over an array; ``add`` gives what an item adds to each."""
    zero = F.struct(*(F.lit(0).cast("bigint").alias(n) for n in names))
    return F.aggregate(items, zero, lambda acc, x: F.struct(*(add(acc[n], x, j).alias(n) for j, n in enumerate(names))))


def _bit_counts(runs: Column) -> Column:
    """For each of 64 bits the number of hashes that have it set: long t holds the counts of bits t and t + 32."""
    narrow, wide = [f"n{j}" for j in range(8)], [f"c{t}" for t in range(LONGS)]
    starts = F.when(F.size(runs) > 0, F.sequence(F.lit(1), F.size(runs), F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
    chunks = F.transform(starts, lambda i: _sums(F.slice(runs, i, CHUNK), narrow, lambda n, h, j: n + F.shiftrightunsigned(h, j).bitwiseAND(F.lit(_ONES8))))
    total = _sums(chunks, wide, lambda c, chunk, t: c + F.shiftrightunsigned(chunk[f"n{t % 8}"], t // 8 * 8).bitwiseAND(F.lit(_PAIR8)))
    return _bound(total, lambda x: F.array(*(x[n] for n in wide)))


def fingerprint(text: Column) -> Column:
    """A vector of WHOLE + 1 + LONGS bigints, the sum of one vector for each paragraph (line) of the text.

    A paragraph gives two 64-bit hashes in 32-bit lanes summed modulo 2**32, the number of its word runs, and for each
    of 64 bits how many of its runs' hashes have it set. Sums don't depend on order; equal texts, and
    texts of the same paragraphs in any order, have equal vectors. Null is as empty: one paragraph without runs.
    Every RUN_WORDS neighbouring words are a run, so that a word more or less changes only the runs that hold it; a paragraph of
    fewer words is one run. Words end at ASCII white space; where a paragraph has one word only, its code points stand for words.
    A count could only carry into the next from 2**31 runs on, more than a string can hold.
    """
    paragraphs = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    low, high = (lambda h: h.bitwiseAND(F.lit(_M32 - 1))), (lambda h: F.shiftrightunsigned(h, 32))
    whole = F.transform(paragraphs, lambda p: F.struct(F.xxhash64(p).alias("a"), F.xxhash64(F.lit("2"), p).alias("b")))
    lanes = [lambda h: low(h["a"]), lambda h: high(h["a"]), lambda h: low(h["b"]), lambda h: high(h["b"])]
    names = [f"w{i}" for i in range(WHOLE)]
    sums = _bound(_sums(whole, names, lambda w, h, i: (w + lanes[i](h)).bitwiseAND(F.lit(_M32 - 1))), lambda x: F.array(*(x[n] for n in names)))
    runs = F.flatten(F.transform(paragraphs, _runs))
    return F.concat(sums, _bound(runs, lambda r: F.concat(F.array(F.size(r).cast("bigint")), _bit_counts(r))))


def _lanes(a: Column, b: Column, sign: int) -> Column:
    def lane(pair: Column, i: Column) -> Column:
        x, y = pair["x"], pair["y"]
        both = x + y if sign > 0 else x - y
        return F.when(i < WHOLE, F.pmod(both, F.lit(_M32))).otherwise(both)

    return F.transform(F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lane)


def inserted(a: Column, b: Column) -> Column:
    """The fingerprint of the text of ``a`` with the paragraphs of ``b`` added."""
    return _lanes(a, b, 1)


def deleted(a: Column, b: Column) -> Column:
    """The fingerprint of the text of ``a`` without the paragraphs of ``b``, which it must hold."""
    return _lanes(a, b, -1)


def as_text(fp: Column) -> Column:
    """A fingerprint as lower-case hexadecimal digits of fixed length."""
    return F.lower(F.array_join(F.transform(fp, lambda x, i: F.lpad(F.hex(x), F.when(i <= WHOLE, 8).otherwise(16), "0")), ""))


def centred(fp: Column) -> Column:
    """The counts of set bits as signed sums, one double for each lane."""
    n = F.element_at(fp, WHOLE + 1)
    longs = F.slice(fp, WHOLE + 2, LONGS)
    lanes = F.flatten(F.transform(longs, lambda x: F.array(x.bitwiseAND(F.lit(_M32 - 1)), F.shiftrightunsigned(x, LANE))))
    return F.transform(lanes, lambda c: (c * 2 - n).cast("double"))


def likeness(a: Column, b: Column, a_lanes: Column, b_lanes: Column) -> Column:
    """About the cosine between two texts' multisets of word runs, 0 to 1: 1 for equal fingerprints, 0 where one has no runs."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a_lanes, a_lanes) * dot(b_lanes, b_lanes))
    return F.when(a == b, F.lit(1.0)).when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a_lanes, b_lanes) / norm))).otherwise(F.lit(0.0))


def next_ids(ids: DataFrame) -> DataFrame:
    """``ids`` (doc_id distinct and not null) with ``next_id``: the next in ascending order, after the last the first.

    The order is found in range partitions; only each partition's first id, a row per shuffle partition, meets in one place.
    """
    placed = stored(ids.repartitionByRange("doc_id").withColumn("_part", F.spark_partition_id()), "ordered")
    firsts = placed.groupBy("_part").agg(F.min("doc_id").alias("_first"))
    every = Window.partitionBy()
    after = firsts.select(F.col("_part"), F.coalesce(F.lead("_first").over(Window.orderBy("_part")), F.min("_first").over(every)).alias("_after"))
    inside = placed.withColumn("next_id", F.lead("doc_id").over(Window.partitionBy("_part").orderBy("doc_id")))
    return inside.join(F.broadcast(after), "_part").withColumn("next_id", F.coalesce("next_id", "_after")).drop("_part", "_after")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited, fp, edited_fp, next_fp) for each document.

    The edited text is the text with its last quarter of code points replaced by as many of the next document's first. Of the
    next document only that prefix and its fingerprint travel. Null texts are empty. Rows that repeat a
    doc_id stay rows; as somebody's next document the one with the least text counts. Without a doc_id a row has no
    next document: its edited text is its own and next_fp is null.
    """
    every = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("fp", fingerprint(F.col("text")))
    # both joins below read the same rows by the same key, so that texts are shuffled once
    full = every.where("doc_id is not null")
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.length(F.coalesce("text", F.lit("")))).alias("need"), F.count("*").alias("copies"))
    order = stored(next_ids(ids), "next")
    to_next = order.select(F.col("doc_id").alias("prev_id"), F.col("next_id").alias("doc_id"), F.expr("need div 4").alias("need"))
    sent = full.join(to_next, "doc_id").select(F.col("prev_id").alias("doc_id"), F.expr("substring(text, 1, int(need))").alias("head"), F.col("fp").alias("next_fp"), F.col("text").alias("_by"))
    if order.where("copies > 1").isEmpty():
        sent = sent.drop("_by")
    else:
        sent = sent.groupBy("doc_id").agg(F.min(F.struct("_by", "head", "next_fp")).alias("m")).select("doc_id", "m.head", "m.next_fp")
    lone = every.where("doc_id is null").withColumn("head", F.lit(None).cast("string")).withColumn("next_fp", F.lit(None).cast("array<bigint>"))
    both = full.join(sent, "doc_id", "left").unionByName(lone).withColumn("n_chars", F.length("text").cast("bigint"))
    cut = F.expr("int(n_chars div 4)")
    edited = F.when(F.col("head").isNull(), F.col("text")).otherwise(F.concat(F.expr("substring(text, 1, int(n_chars - n_chars div 4))"), F.substring("head", F.lit(1), cut)))
    return both.withColumn("edited", edited).select("doc_id", "n_chars", "edited", "fp", fingerprint(F.col("edited")).alias("edited_fp"), "next_fp")


def op6_fingerprint(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are to each other and to the next document's."""
    rows = edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    lanes = rows.select("*", *(centred(F.col(c)).alias(f"{c}_lanes") for c in ("fp", "edited_fp", "next_fp")))
    return lanes.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp"), F.col("fp_lanes"), F.col("edited_fp_lanes")).alias("near_edited"),
        F.coalesce(likeness(F.col("fp"), F.col("next_fp"), F.col("fp_lanes"), F.col("next_fp_lanes")), F.lit(0.0)).alias("near_next"),
    )
