"""Verdicts that come back from a model, as rows: which candidates and alerts they select."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import scalars as S

# Words that accept a candidate, and words that accept an alert.
ACCEPTING = ("true_positive", "true positive", "tp", "incident")
TRUTHY = ("1", "true", "yes", "y", "incident", "incident_candidate", "true_positive")
#: Least confidence of an accepted verdict, and steps kept of its remedy.
LEAST, STEPS = 0.5, 3


def accepts(value: Column) -> Column:
    """Whether an answer about an alert means yes; null means no (AUX-21)."""
    return F.lower(F.trim(F.coalesce(value.cast("string"), F.lit("")))).isin(*TRUTHY)


def candidate_verdicts(rows: DataFrame) -> DataFrame:
    """(candidate_id, verdict, confidence, selected, rationale, steps) of (candidate_id, verdict, confidence, rationale, remediation_steps), one row each (FLT-20).

    Blank verdicts are ``unknown``, confidence outside 0..1 is cut, without a number it is 0; blank steps go and three stay, as the answer's form has it.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    verdict = F.coalesce(F.nullif(F.lower(text("verdict")), F.lit("")), F.lit("unknown"))
    steps = F.filter(F.transform(F.coalesce("remediation_steps", F.array().cast("array<string>")), lambda s: F.trim(s)), lambda s: s != "")
    confidence = S.bounded("confidence")
    return rows.select(text("candidate_id").alias("candidate_id"), verdict.alias("verdict"), confidence.alias("confidence"), (verdict.isin(*ACCEPTING) & (confidence >= LEAST)).alias("selected"), text("rationale").alias("rationale"), F.slice(steps, 1, STEPS).alias("steps"))


def accepted_alerts(rows: DataFrame) -> DataFrame:
    """(alert_id, seq) of alerts that (alert_id, incident_candidate, is_incident, selected, confidence, seq) accept, each once at its first acceptance (FLT-21).

    The first of the three answers that is there counts; a missing confidence is 1 for yes. Rows without an id accept nothing.
    """
    yes = accepts(F.coalesce(*[F.col(c).cast("string") for c in ("incident_candidate", "is_incident", "selected")]))
    sure = F.when(F.col("confidence").isNull(), F.when(yes, 1.0).otherwise(0.0)).otherwise(S.bounded("confidence"))
    return rows.withColumn("alert_id", S.clean("alert_id")).filter(F.col("alert_id").isNotNull() & yes & (sure >= LEAST)).groupBy("alert_id").agg(F.min("seq").alias("seq"))
