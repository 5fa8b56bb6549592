"""Scores of citation and record pairs, and their order for each citation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelink.functions.compare import author_state, compare_doi, compare_venue, compare_year, title_state
from citelink.functions.normalize import normalize_text, present
from citelink.functions.similarity import author_similarity, is_abbreviated_title, title_similarity

REF = ("doc_id", "ref_no")
# Weights of title, authors and year, and what a year's state is worth.
WEIGHTS = (0.50, 0.35, 0.15)
YEAR_WORTH = {"MATCH": 100.0, "PARTIAL": 75.0, "MISMATCH": 0.0}
YEAR_UNKNOWN = 50.0
ABBREVIATED = 90.0
PLAUSIBLE = 50.0


def score_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs (citation's fields, the record's as w_...) with scores and field states.

    Needs norm_doi, norm_title, w_norm_doi and w_norm_title, which belong to rows and are not computed again for each pair.
    Each measure of a pair is computed once, for its score and for its state. Scores are rounded half to even on their decimal
    form, so 0.35 gives 0.4 where rounding the binary value would give 0.3.
    """
    measured = pairs.withColumns(
        {
            "_title": F.when(present(F.col("title"), "string") & present(F.col("w_title"), "string"), title_similarity(F.col("norm_title"), F.col("w_norm_title"), normalized=True)).otherwise(F.lit(0.0)),
            "_authors": author_similarity(F.col("authors"), F.col("w_authors")),
            "_short": is_abbreviated_title(F.col("norm_title"), F.col("w_norm_title"), normalized=True),
            "_year": compare_year(F.col("year"), F.col("w_year")),
        }
    )
    year = F.coalesce(*(F.when(F.col("_year") == k, F.lit(v)) for k, v in YEAR_WORTH.items()), F.lit(YEAR_UNKNOWN))
    same_doi = (F.col("norm_doi") != "") & (F.col("norm_doi") == F.col("w_norm_doi"))
    plain = WEIGHTS[0] * F.col("_title") + WEIGHTS[1] * F.col("_authors") + WEIGHTS[2] * year
    weighted = F.when(same_doi, F.lit(100.0)).when(F.col("_short"), F.greatest(plain, F.lit(ABBREVIATED))).otherwise(plain)
    states = F.struct(
        compare_doi(F.col("norm_doi"), F.col("w_norm_doi"), normalized=True).alias("doi"),
        title_state(F.col("_title"), F.col("_short"), F.col("title"), F.col("w_title")).alias("title"),
        author_state(F.col("_authors"), F.col("authors"), F.col("w_authors")).alias("authors"),
        F.col("_year").alias("year"),
        compare_venue(F.col("venue"), F.col("w_venue")).alias("venue"),
    )
    return measured.withColumns(
        {
            "title_score": F.bround("_title", 1),
            "author_score": F.bround("_authors", 1),
            "year_score": year,
            "weighted_score": F.bround(weighted, 1),
            "same_doi": same_doi,
            "states": states,
        }
    ).drop("_title", "_authors", "_short", "_year")


def _best_first(keys: tuple[str, ...], last: tuple[str, ...] = ()):
    return Window.partitionBy(*keys).orderBy(F.desc("weighted_score"), "arrival", *last)


def rank_pairs(pairs: DataFrame, keys: tuple[str, ...] = REF) -> DataFrame:
    """``rank`` in each citation, highest weighted score first, ties in order of arrival; works that arrive together by ``work_key``, if there is one."""
    last = tuple(c for c in ("work_key",) if c in pairs.columns)
    return pairs.withColumn("rank", F.row_number().over(_best_first(keys, last)))


def plausible_pairs(pairs: DataFrame, keys: tuple[str, ...] = REF) -> DataFrame:
    """Pairs with a title score of at least 50 or an equal DOI; all of a citation's pairs where none has."""
    own = (F.col("title_score") >= PLAUSIBLE) | F.coalesce("same_doi", F.lit(False))
    every = F.max(own).over(Window.partitionBy(*keys))
    return pairs.withColumn("_own", own).withColumn("_any", every).where("_own or not _any").drop("_own", "_any")


def with_margin(ranked: DataFrame, keys: tuple[str, ...] = REF) -> DataFrame:
    """``margin`` on each citation's first pair: its weighted score less the second's, and ``n_hits``; null elsewhere."""
    order = Window.partitionBy(*keys).orderBy("rank")
    gap = F.col("weighted_score") - F.lead("weighted_score", 1, 0.0).over(order)
    return ranked.withColumn("margin", F.when(F.col("rank") == 1, gap)).withColumn("n_hits", F.count("*").over(Window.partitionBy(*keys)))


def hit(prefix: str = "w_") -> Column:
    """A pair's record and scores as one struct, its rank first."""
    record = [F.col(f"{prefix}{f}").alias(f) for f in ("title", "authors", "year", "venue", "doi", "source", "sources")]
    return F.struct("rank", "title_score", "author_score", "year_score", "weighted_score", "same_doi", *record, "states")


def top_hits(ranked: DataFrame, top: int = 5, keys: tuple[str, ...] = REF) -> DataFrame:
    """Each citation's first ``top`` hits as an array in order of rank; only these rows are gathered."""
    return ranked.where(F.col("rank") <= top).groupBy(*keys).agg(F.array_sort(F.collect_list(hit())).alias("ranked"))
