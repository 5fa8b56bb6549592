"""Summaries and texts about verification results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Signs of the statuses, and the rule and labels of a text report.
_ICONS = {"VERIFIED": "✓", "UNCERTAIN": "⚠", "NOT VERIFIED": "✗"}
_RULE = "-" * 70


def status_summary(results: DataFrame) -> DataFrame:
    """One row: how many citations there are, and how many of each status; ``error`` counts where results have such a column."""
    failed = F.count_if(F.col("error").isNotNull()) if "error" in results.columns else F.lit(0).cast("bigint")
    each = [F.count_if(F.col("status") == s).alias(n) for s, n in (("VERIFIED", "verified"), ("UNCERTAIN", "uncertain"), ("NOT VERIFIED", "not_verified"))]
    return results.agg(F.count("*").alias("total"), *each, failed.alias("errors"))


def parse_coverage(cites: DataFrame) -> DataFrame:
    """How many citations a style parsed, of how many."""
    return cites.agg(F.count_if(F.col("parse_style").isNotNull()).alias("parsed"), F.count("*").alias("total"))


def usage_summary(calls: DataFrame) -> DataFrame:
    """(chain, provider, n_calls, input_tokens, output_tokens, total_tokens) by chain, by provider and in all; a missing total is the sum of its parts."""
    given, taken = (F.coalesce(c, F.lit(0)) for c in ("prompt_tokens", "completion_tokens"))
    total = F.coalesce(F.nullif("total_tokens", F.lit(0)), given + taken)
    rows = calls.select("chain", "provider", given.alias("i"), taken.alias("o"), total.alias("t"))
    sums = (F.count("*").alias("n_calls"), F.sum("i").alias("input_tokens"), F.sum("o").alias("output_tokens"), F.sum("t").alias("total_tokens"))
    return rows.groupingSets([["chain"], ["provider"], []], "chain", "provider").agg(*sums)


def text_report(results: DataFrame) -> DataFrame:
    """(doc_id, ref_no, block): a readable paragraph on each citation."""

    def or_na(c: str):
        return F.coalesce(F.col(c).cast("string"), F.lit("N/A"))

    def names(c: str):
        return F.coalesce(F.array_join(c, ", "), F.lit(""))

    icon = F.coalesce(*(F.when(F.col("status") == s, F.lit(i)) for s, i in _ICONS.items()), F.lit("?"))
    check = F.when(F.col("status").isin("UNCERTAIN", "NOT VERIFIED"), F.lit("⚠️ MANUAL CHECK NEEDED - see reason and evidence below"))
    best = F.when(
        F.col("best_match").isNotNull(),
        F.concat(
            F.lit("\nBEST MATCH\nTitle:   "), or_na("best_match.title"), F.lit("\nAuthors: "), names("best_match.authors"), F.lit("\nYear:    "), or_na("best_match.year"), F.lit("\nDOI:     "), or_na("best_match.doi"), F.lit("\nSource:  "),
            or_na("best_match.source"),
        ),
    )
    agreeing = F.when(F.size("sources_agreeing") > 0, F.concat(F.lit("\nSources agreeing: "), names("sources_agreeing"), F.lit(" ("), F.size("sources_agreeing").cast("string"), F.lit(")")))
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("REFERENCE "), F.col("ref_no").cast("string")), F.lit(_RULE), F.concat(F.lit("Original Reference:\n"), F.coalesce("original_reference", F.lit("Unknown"))),
        F.concat(F.lit("\nSTATUS: "), icon, F.lit(" "), F.col("status")), check, F.concat(F.lit("Source: "), or_na("source")), F.concat(F.lit("\nReason: "), or_na("explanation")),
        F.concat(F.lit("\nSUBMITTED METADATA\nTitle:   "), or_na("title"), F.lit("\nAuthors: "), names("authors"), F.lit("\nYear:    "), or_na("year"), F.lit("\nDOI:     "), or_na("doi")), best, agreeing, F.lit(_RULE),
    )
    return results.select("doc_id", "ref_no", block.alias("block"))
