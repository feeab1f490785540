"""Queries that ask a model, here the offline one, about the alert view and take in its answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgeline.functions import scalars as S
from ridgeline.operators import gate
from ridgeline.operators.ranking import number_rows
from ridgeline.operators.tables import scratch
from ridgeline.plans import intake, provider
from ridgeline.plans.alerts import SQL, alerts
from ridgeline.plans.registry import query
from ridgeline.sources import paged


def _fields(answers, *names):
    """Columns of the JSON inside the responses."""
    body = answers.withColumn("_v", S.json_payload(F.col("response")))
    return body.select("*", *[F.try_variant_get("_v", f"$.{n}", "string").alias(n) for n in names])


@query(f"""WITH {SQL} SELECT alert_id FROM alerts WHERE severity >= 9 AND (alert_id % 3 <> 0 OR severity / 20 >= 0.5)""")
def model_accepted_alerts(spark, sf_dir):
    """Every alert is put to the model once; those that its answers accept (EXT-01, FLT-21, AUX-21, SCL-33)."""
    prompt = F.format_string("Is alert=%d of severity=%d (%s) an incident?", "alert_id", F.col("severity").cast("int"), "tactic")
    answers = provider.ask(alerts(spark, sf_dir).select("alert_id", prompt.alias("prompt")), provider.offline, scratch(spark, "answers"))
    rows = _fields(answers, "incident_candidate", "is_incident", "selected", "confidence").withColumn("seq", F.col("alert_id"))
    return intake.accepted_alerts(rows).select(F.col("alert_id").cast("long").alias("alert_id"))


@query(f"""WITH {SQL}, u AS (SELECT usr, max(severity) AS sev, count(*) AS n FROM alerts GROUP BY 1)
SELECT usr AS candidate_id, CASE WHEN sev >= 9 AND n >= 3 THEN 'true positive' ELSE 'benign' END AS verdict, least(least(n, 12) / 10, 1) AS confidence, sev >= 9 AND n >= 3 AND least(n, 12) / 10 >= 0.5 AS selected, n || ' alerts' AS rationale, 'isolate,reset,watch' AS steps FROM u""")
def model_candidate_verdicts(spark, sf_dir):
    """A candidate for each user, judged by the model, and its verdicts taken in (FLT-20)."""
    users = alerts(spark, sf_dir).groupBy("user").agg(F.max("severity").alias("sev"), F.count(F.lit(1)).alias("n"))
    prompt = F.format_string("User %s: alerts=%d, severity=%d. Verdict?", "user", "n", F.col("sev").cast("int"))
    answers = provider.ask(users.select(F.col("user").alias("candidate_id"), prompt.alias("prompt")), provider.offline, scratch(spark, "answers"))
    rows = _fields(answers, "verdict", "confidence", "rationale").withColumn("remediation_steps", F.try_variant_get("_v", "$.remediation_steps", "array<string>"))
    return intake.candidate_verdicts(rows).withColumn("steps", F.concat_ws(",", "steps"))


@query(f"""WITH {SQL}, r AS (SELECT lower(host || '|' || target || '|' || tactic || '|' || technique) AS rel_key, count(*) AS n FROM alerts GROUP BY 1),
h AS (SELECT rel_key, n, d, CAST('0x' || substr(md5(d || ':' || rel_key), 1, 8) AS BIGINT) % 20000 AS cell FROM r CROSS JOIN range(5) t(d)),
c AS (SELECT d, cell, sum(n) AS s FROM h GROUP BY 1, 2)
SELECT rel_key, any_value(h.n) AS count, CAST(min(s) AS BIGINT) AS estimate FROM h JOIN c ON h.d = c.d AND h.cell = c.cell GROUP BY 1""")
def sketch_estimates(spark, sf_dir):
    """Every relationship's count and what a count-min sketch of 20,000 by 5 makes of it (AGG-01)."""
    c = F.col
    rows = alerts(spark, sf_dir).select(gate.edge_key(c("host"), c("target"), c("tactic"), c("technique"), c("tactic")).alias("rel_key"))
    return gate.sketch_estimates(rows, "rel_key")


@query("SELECT conv_id, turn, role, text FROM conversations")
def paged_rows(spark, sf_dir):
    """The conversations written as pages of a hundred rows and read back page by page (SRC-15)."""
    rows = number_rows(spark.read.parquet(f"{sf_dir}/conversations.parquet"), ["conv_id", "turn"])
    path = scratch(spark, "pages")
    paged.write_pages(rows, "number", path, 100)
    back = paged.read_pages(spark, path, rows.count(), 100)
    v = F.parse_json("row")
    return back.select(F.variant_get(v, "$.conv_id", "long").alias("conv_id"), F.variant_get(v, "$.turn", "long").alias("turn"), F.variant_get(v, "$.role", "string").alias("role"), F.variant_get(v, "$.text", "string").alias("text"))
