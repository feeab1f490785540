"""The canonical alert view over the test tables' events, as a DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TACTICS = {"signup": "Initial Access", "click": "Execution", "error": "Credential Access", "view": "Lateral Movement", "purchase": "Exfiltration"}
#: Least value -> severity.
SEVERITY_CUTS = ((300, 10), (150, 9), (60, 6), (20, 3))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(alert_id, ts, user, host, target, tactic, technique, severity) of every event."""
    k = F.coalesce(F.regexp_extract("props", r"([0-9]+)", 1).try_cast("int"), F.lit(0))
    severity = F.lit(2)
    for least, value in reversed(SEVERITY_CUTS):
        severity = F.when(F.col("value") >= least, value).otherwise(severity)
    tactic = F.lit("")
    for kind, name in TACTICS.items():
        tactic = F.when(F.col("event_type") == kind, name).otherwise(tactic)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("alert_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user"),
        F.concat(F.lit("h"), (F.col("user_id") % 37).cast("string")).alias("host"),
        F.concat(F.lit("h"), (k % 37).cast("string")).alias("target"),
        tactic.alias("tactic"),
        F.concat(F.lit("T"), (k % 7).cast("string")).alias("technique"),
        severity.alias("severity"),
    )


def truth(rows: DataFrame, least: int = 3) -> DataFrame:
    """(incident_id, alert_id): a user's day with at least ``least`` alerts is an incident."""
    day = rows.select(F.concat("user", F.lit(":"), F.date_format("ts", "yyyy-MM-dd")).alias("incident_id"), "alert_id")
    enough = day.groupBy("incident_id").count().filter(F.col("count") >= least).select("incident_id")
    return day.join(enough, "incident_id", "left_semi")


#: Common table expressions with the same rows.
SQL = """k0 AS (SELECT event_id, ts, user_id, event_type, value, coalesce(TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS INT), 0) AS k FROM events),
alerts AS (SELECT event_id AS alert_id, ts, 'u' || user_id AS usr, 'h' || (user_id % 37) AS host, 'h' || (k % 37) AS target,
  CASE event_type WHEN 'signup' THEN 'Initial Access' WHEN 'click' THEN 'Execution' WHEN 'error' THEN 'Credential Access'
    WHEN 'view' THEN 'Lateral Movement' WHEN 'purchase' THEN 'Exfiltration' ELSE '' END AS tactic,
  'T' || (k % 7) AS technique, CASE WHEN value >= 300 THEN 10 WHEN value >= 150 THEN 9 WHEN value >= 60 THEN 6 WHEN value >= 20 THEN 3 ELSE 2 END AS severity FROM k0),
days AS (SELECT usr || ':' || strftime(ts, '%Y-%m-%d') AS incident_id, alert_id FROM alerts),
truth AS (SELECT incident_id, alert_id FROM days WHERE incident_id IN (SELECT incident_id FROM days GROUP BY 1 HAVING count(*) >= 3))"""
#: Entities of alerts: the user, and source and target host.
ENTITY_SQL = """entity AS (SELECT DISTINCT alert_id, ts, severity, tactic, e.etype, e.entity FROM (SELECT *, unnest([{'etype': 'user', 'entity': 'user:' || usr}, {'etype': 'host', 'entity': 'host:' || host}, {'etype': 'host', 'entity': 'host:' || target}]) AS e FROM alerts))"""
