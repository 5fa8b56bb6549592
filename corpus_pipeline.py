"""A corpus pipeline of five stages, each on all that the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, so that stages
can be left out or put in another order. Empty tables, null columns, empty and very long texts and repeated
rows pass as each operator defines; columns beyond those of documents are carried along unchanged.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelink.llm import lang_id, line_dedup, mixing, near_dup, pieces
from citelink.llm.common import read_table
from citelink.sources.scratch import stored


#: Likeness from which two documents are one, in percent, and bands: a pair at 0.80 shares no bucket with probability (1 - 0.80**5)**36 < 1e-6.
NEAR_PERCENT, NEAR_BANDS = 80, 36

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _aside(stage):
    """A stage that sees columns beyond those of documents under names no operator uses; they come back under their own."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = docs.columns
        names = [c if c in COLUMNS and c not in own[:i] else f"_x{i}" for i, c in enumerate(own)]
        back = dict(zip(names, own, strict=True))
        out = stage(spark, docs.toDF(*names), sf_dir)
        added = {c for c in out.columns if c not in back}
        kept = out.select(*(c for c in out.columns if back.get(c) not in added))  # a stage's own column takes the place of one that came so named
        return kept.toDF(*(back.get(c, c) for c in kept.columns))

    return run_stage


@_aside
def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null texts and texts without a letter) go; the others stay as they are.

    These are what ``predict`` calls "und"; which language it predicts, and its score, reject nothing. Where no document says its language,
    there is no model, and the same texts go.
    """
    model = lang_id.fit_on_documents(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    scored = lang_id.predict(docs, model)
    return scored.where(F.col("lang_pred") != lang_id.UNKNOWN).select(*docs.columns)


@_aside
def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share leave the texts; a document that loses its whole text leaves the corpus."""
    kept = line_dedup.dedup_lines(docs).where("_n_dropped = 0 or text <> ''")
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


@_aside
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of least doc_id stays. Rows that share that doc_id are one document and stay."""
    kept = near_dup.near_duplicates(docs, percent=NEAR_PERCENT, bands=NEAR_BANDS).where("kept").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns)


@_aside
def mixed_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many words of each document as the mix takes: a row for each whole time, and one for the first words of a last part.

    A document that the mix doesn't take leaves. Documents are told apart by doc_id; without one a row isn't taken.
    """
    takes = mixing.mix(docs.where("doc_id is not null")).groupBy("doc_id").agg(F.max("size").alias("_size"), F.max("taken").alias("_taken")).where("_taken > 0")
    both = docs.join(takes, "doc_id")
    size = mixing.word_count(F.col("text"))
    rest = F.expr("_taken % _size")
    pattern = F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), rest.cast("string"), F.lit("}+"))
    head = F.call_function("regexp_extract", F.col("text"), pattern, F.lit(0))
    whole = F.array_repeat(F.col("text"), F.expr("int(_taken div _size)"))
    texts = F.when(rest > 0, F.concat(whole, F.array(head))).otherwise(whole)
    taken = both.where(size > 0).withColumn("text", F.explode(texts))
    return taken.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


@_aside
def encoded_and_decoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text's sampled pieces and their number; the text is what the pieces decode to, which is the text itself."""
    back = pieces.encode(docs, decoded=True)
    return back.withColumn("n_pieces", F.coalesce(F.size("pieces"), F.lit(0)).cast("bigint")).select(*docs.columns, "pieces", "n_pieces")


STAGES = [
    ("language_id", known_languages),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", one_of_each_group),
    ("mixing", mixed_to_weights),
    ("pieces", encoded_and_decoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs


#: No SQL here expresses sampled segmentations; tests compare the stages with plain versions.
ORACLE_SQL = None
