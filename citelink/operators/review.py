"""Merging of review verdicts into results, behind the rules that a verdict cannot overrule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelink.operators.decision import classify, strong_contradiction
from citelink.operators.ranking import REF
from citelink.operators.works import sources_agreeing

TOP = 5
# Explanations of stand-in verdicts, of the gates, and of what stays open.
UNAVAILABLE = "AI verification was unavailable (all providers failed), so this reflects the deterministic estimate instead: "
NO_VERDICT = "The AI verifier did not return a verdict for this reference; using the deterministic estimate instead."
CONTRADICTED = "AI selected a candidate, but the existing deterministic rules found a strong bibliographic contradiction: "
LEFT_OPEN = "The reference remained ambiguous and could not receive a final AI verdict."


def attach_verdicts(results: DataFrame, verdicts: DataFrame, keys: tuple[str, ...] = REF, failed: str | None = None) -> DataFrame:
    """``results`` with ``verdict`` on unresolved rows: the reviewer's, or a stand-in from the rules where none came.

    ``verdicts``: keys, status, confidence, metadata_conflicts, explanation, selected_candidate_index; of several for one key the
    least is taken. ``failed`` names a boolean column of results: the review of that row's batch failed.
    """
    fields = ("status", "confidence", "metadata_conflicts", "explanation", "selected_candidate_index")
    given = verdicts.groupBy(*keys).agg(F.min(F.struct(*fields)).alias("_given"))
    both = results.join(given, list(keys), "left")
    broken = F.coalesce(F.col(failed), F.lit(False)) if failed else F.lit(False)
    none = F.array().cast("array<string>")
    stand_in = F.struct(
        F.col("deterministic_status").alias("status"),
        F.lit(None).cast("double").alias("confidence"),
        F.when(broken, none).otherwise(F.array(F.lit("ai_missing_verdict"))).alias("metadata_conflicts"),
        F.when(broken, F.concat(F.lit(UNAVAILABLE), "deterministic_reason")).otherwise(F.lit(NO_VERDICT)).alias("explanation"),
        F.lit(None).cast("int").alias("selected_candidate_index"),
    )
    kind = "struct<status:string,confidence:double,metadata_conflicts:array<string>,explanation:string,selected_candidate_index:int>"
    own = F.when(broken | F.col("_given").isNull(), stand_in.cast(kind)).otherwise(F.col("_given").cast(kind))
    return both.withColumn("verdict", F.when(F.col("status") == "PENDING_AI", own)).drop("_given")


def apply_verdicts(results: DataFrame, verdicts: DataFrame, keys: tuple[str, ...] = REF, failed: str | None = None) -> DataFrame:
    """Final results. A verdict picks one of the first five hits or none; two gates keep a VERIFIED from overruling the rules.

    The hit's states were computed when it was scored and belong to the pair, so judging the picked hit needs no further matching.
    A row that a verdict leaves without a status, or unresolved, is UNCERTAIN.
    """
    rows = attach_verdicts(results, verdicts, keys, failed)
    index = F.col("verdict.selected_candidate_index")
    valid = index.between(1, F.least(F.lit(TOP), F.size("ranked")))
    rows = rows.withColumn("_picked", F.when(valid, F.try_element_at("ranked", index)))
    rows = rows.withColumn("_rule", F.when(F.col("_picked").isNotNull(), classify(F.col("_picked.states"))))
    judged, picked = F.col("verdict").isNotNull(), F.col("_picked").isNotNull()
    approved = judged & picked & (F.col("verdict.status") == "VERIFIED")
    contradicted = F.coalesce(approved & strong_contradiction(F.col("_picked.states")), F.lit(False))
    rejected = F.coalesce(approved & ~contradicted & (F.col("_rule.status") == "NOT VERIFIED"), F.lit(False))
    moved = F.coalesce(judged & picked & ~contradicted, F.lit(False))
    against = F.concat(F.lit("AI selected candidate #"), index.cast("string"), F.lit(", but the existing deterministic rules rejected it: "), F.col("_rule.reason"))
    open_ = (F.col("status") == "PENDING_AI") & F.coalesce(F.col("verdict.status") == "PENDING_AI", F.lit(True))
    none = F.array().cast("array<string>")
    return rows.withColumns(
        {
            "status": F.when(contradicted | rejected, "NOT VERIFIED").when(open_, "UNCERTAIN").when(judged, F.col("verdict.status")).otherwise(F.col("status")),
            "explanation": F.when(contradicted, F.concat(F.lit(CONTRADICTED), F.col("_rule.reason"))).when(rejected, against).when(open_, LEFT_OPEN).when(judged, F.col("verdict.explanation")).otherwise(F.col("explanation")),
            "source": F.when(contradicted | rejected, "deterministic safety gate").when(open_, "deterministic fallback").when(judged, "AI verification").otherwise(F.col("source")),
            "best_match": F.when(moved, F.col("_picked")).otherwise(F.col("best_match")),
            "states": F.when(moved, F.col("_picked.states")).otherwise(F.col("states")),
            "sources_agreeing": F.when(moved, sources_agreeing(F.col("_picked.sources"), F.col("_picked.source"))).otherwise(F.col("sources_agreeing")),
            "confidence": F.when(judged & ~contradicted & ~rejected, F.col("verdict.confidence")),
            "metadata_conflicts": F.when(judged, F.coalesce("verdict.metadata_conflicts", none)),
            "ai_selected_candidate_index": F.when(judged, index),
        }
    ).drop("_picked", "_rule", "verdict")
