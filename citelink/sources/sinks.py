"""The flat report and the queue of citations for review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The columns of the flat report.
REPORT_COLUMNS = (
    "Ref #", "Status", "Manual Check Needed", "Explanation", "Original Reference", "Submitted Title", "Submitted Authors", "Submitted Year", "Submitted DOI", "Matched Title", "Matched Authors", "Matched Year",
    "Matched DOI", "Sources Agreeing", "Verification Source",
)


def report(results: DataFrame) -> DataFrame:
    """One flat row for each citation of ``verify``'s or ``apply_verdicts``'s results, with the document it comes from."""

    def names(c: str):
        return F.coalesce(F.array_join(c, ", "), F.lit(""))

    check = F.when(F.col("status").isin("UNCERTAIN", "NOT VERIFIED"), "Yes").otherwise("No")
    values = (
        F.col("ref_no"), F.col("status"), check, F.coalesce("explanation", F.lit("")), F.coalesce("original_reference", F.lit("")), F.col("title"), names("authors"), F.col("year"), F.col("doi"), F.col("best_match.title"),
        names("best_match.authors"), F.col("best_match.year"), F.col("best_match.doi"), names("sources_agreeing"), F.coalesce("source", F.lit("")),
    )
    return results.select("doc_id", *(v.alias(n) for n, v in zip(REPORT_COLUMNS, values, strict=True)))


def write_report(results: DataFrame, path: str, fmt: str = "csv") -> None:
    """Writes the report in order of document and citation, by range, so that no single task sorts it."""
    ordered = report(results).repartitionByRange("doc_id", "Ref #").sortWithinPartitions("doc_id", "Ref #")
    ordered.write.option("header", "true").format(fmt).save(path)


def review_queue(results: DataFrame, size: int = 6, top: int = 5) -> DataFrame:
    """(doc_id, ref_no, bucket, batch, payload) of unresolved citations: the citation, its parse and its best ``top`` hits as JSON."""
    from citelink.functions.parsing import assign_batches

    open_ = results.where("status = 'PENDING_AI'")
    hits = F.transform(
        F.slice("ranked", 1, top),
        lambda r, i: F.struct(
            (i + 1).alias("candidate_index"), r["title"].alias("title"), r["authors"].alias("authors"), r["year"].alias("year"), r["doi"].alias("doi"), r["venue"].alias("venue"), r["source"].alias("source"),
            r["title_score"].alias("title_similarity"), r["author_score"].alias("author_similarity"), r["year_score"].alias("year_score"), r["weighted_score"].alias("weighted_score"), r["sources"].alias("source_agreement"),
        ),
    )
    parsed = F.struct("title", "authors", "year", "venue", "doi")
    case = F.struct(F.col("ref_no").alias("reference_id"), "original_reference", parsed.alias("parsed_metadata"), hits.alias("candidates"))
    return assign_batches(open_, size).select("doc_id", "ref_no", "bucket", "batch", F.to_json(case).alias("payload"))
