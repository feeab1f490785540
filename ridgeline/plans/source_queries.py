"""Queries that write the alert view in the formats of the sources, read it back and map it: files, not frames, are compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgeline.functions import constants as K
from ridgeline.functions import scalars as S
from ridgeline.operators.tables import scratch
from ridgeline.plans.alerts import SQL, alerts, truth
from ridgeline.plans.registry import query
from ridgeline.plans.vendor_queries import vendor_rows
from ridgeline.sources import mapping, readers, sinks

_TEXT = "lpad(CAST(alert_id AS VARCHAR), 12, '0')"
_KIND = "CASE tactic WHEN 'Initial Access' THEN 'initial_access' WHEN 'Execution' THEN 'execution' WHEN 'Credential Access' THEN 'credential_access' WHEN 'Lateral Movement' THEN 'lateral_movement' WHEN 'Exfiltration' THEN 'data_exfiltration' END"


def csv_rows(spark, sf_dir):
    """The view as alert CSV, written and read back (SNK-01, SRC-01)."""
    path = scratch(spark, "alert-csv")
    sinks.write_alert_csv(vendor_rows(spark, sf_dir), path)
    return readers.falcon_alerts(spark, path)


@query(f"""WITH {SQL} SELECT {_TEXT} AS alert_id, ts, 'host:' || host AS source, 'host:' || target AS target, {_KIND} AS kind, lower(technique) || '_exe' AS action, severity, {_KIND} || ',' || lower(technique) AS tags, usr AS user FROM alerts""")
def csv_alerts(spark, sf_dir):
    """Canonical alerts of the CSV (MAP-01)."""
    a = mapping.falcon_to_alerts(csv_rows(spark, sf_dir))
    return a.select("alert_id", "ts", F.col("source.id").alias("source"), F.col("target.id").alias("target"), "kind", "action", "severity", F.concat_ws(",", "tags").alias("tags"), "user")


@query(f"""WITH {SQL} SELECT {_TEXT} AS alert_id, 'falcon_alert' AS kind, '' AS tags, 5 AS severity FROM alerts""")
def csv_alerts_blind(spark, sf_dir):
    """The same without tactics and severity: nothing of either passes (FLT-06, MAP-12)."""
    return mapping.falcon_to_alerts(csv_rows(spark, sf_dir), False, True).select("alert_id", "kind", F.concat_ws(",", "tags").alias("tags"), "severity")


@query(f"""WITH {SQL} SELECT {_TEXT} AS alert_id, host AS source_id, target AS target_id, usr AS user_id, technique || '.exe' AS process_name, tactic, technique, severity, ts FROM alerts""")
def csv_edges(spark, sf_dir):
    """Detector edges of the CSV (MAP-03)."""
    return mapping.falcon_to_edges(csv_rows(spark, sf_dir))


# --- raw logs --------------------------------------------------------------------------------------------------------
FOLDERS = ("incident_5", "incident_34")


def _write_log(rows, path):
    rows.write.option("header", True).option("sep", K.LOG_SEPARATOR).option("quote", '"').option("escape", '"').csv(path)


def raw_root(spark, sf_dir):
    """A folder of raw logs: even alerts in one incident's single table, odd ones in another's parts, and both incident tables."""
    root = scratch(spark, "raw-logs")
    a = alerts(spark, sf_dir)
    word = S.lookup({10: "10", 9: "High", 6: "Medium", 3: "Low", 2: "Informational"}, F.col("severity"))
    entities = F.to_json(F.array(F.create_map(F.lit("Type"), F.lit("account"), F.lit("Name"), F.col("user")), F.create_map(F.lit("Type"), F.lit("host"), F.lit("HostName"), F.col("host"))))
    rows = a.select(
        F.lpad(F.col("alert_id").cast("string"), 12, "0").alias("SystemAlertId"), F.col("tactic").alias("AlertName"), word.alias("AlertSeverity"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("StartTime"),
        F.col("technique").alias("Techniques"), entities.alias("Entities"), F.col("target").alias("CompromisedEntity"), F.lit("1").alias("IsIncident"), (F.col("alert_id") % 2).alias("odd"),
    )
    t = truth(a).withColumn("odd", F.col("alert_id") % 2)
    listed = t.groupBy("odd", F.col("incident_id").alias("IncidentNumber")).agg(F.to_json(F.array_sort(F.collect_list(F.lpad(F.col("alert_id").cast("string"), 12, "0")))).alias("AlertIds"))
    for odd, folder in enumerate(FOLDERS):
        part = "SecurityAlert/SecurityAlert_1.csv" if odd else "SecurityAlert.csv"
        _write_log(rows.filter(f"odd = {odd}").drop("odd"), f"{root}/incidents/{folder}/{part}")
        _write_log(listed.filter(f"odd = {odd}").drop("odd"), f"{root}/incidents/{folder}/SecurityIncident.csv")
    return root


def _tags_sql(text: str) -> str:
    cases = [f"CASE WHEN {' OR '.join(f'contains({text}, $${w}$$)' for w in words)} THEN '{kind}' END" for kind, words in K.KIND_WORDS.items()]
    return f"list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL)"


_RAW_SQL = f"""WITH {SQL}, rw AS (SELECT *, lower(tactic || '    ' || technique || ' [{{"Type":"account","Name":"' || usr || '"}},{{"Type":"host","HostName":"' || host || '"}}]') AS t FROM alerts),
tg AS (SELECT *, {_tags_sql('t')} AS tags, CASE WHEN alert_id % 2 = 0 THEN 'incident_5' ELSE 'incident_34' END AS scope FROM rw),
kd AS (SELECT *, CASE WHEN len(tags) > 0 THEN tags[1] ELSE regexp_replace(lower(tactic), '[^a-z0-9]+', '_', 'g') END AS kind FROM tg)"""


@query(f"""{_RAW_SQL} SELECT {_TEXT} AS alert_id, ts, 'user:' || usr AS source, 'host:' || host AS target, kind, regexp_replace(lower(tactic), '[^a-z0-9]+', '_', 'g') AS action,
  CASE severity WHEN 3 THEN 4 ELSE severity END AS severity, array_to_string(tags, ',') AS tags, tactic AS name, 'user:' || usr || ',host:' || host || CASE WHEN target = host THEN '' ELSE ',host:' || target END AS entity_ids, scope FROM kd""")
def raw_log_alerts(spark, sf_dir):
    """Canonical alerts of raw logs in two folders, one a single table, one in parts (SRC-04..08, MAP-02, 13)."""
    a = mapping.security_to_alerts(readers.security_table(spark, raw_root(spark, sf_dir), "incidents"))
    return a.select("alert_id", "ts", F.col("source.id").alias("source"), F.col("target.id").alias("target"), "kind", "action", "severity", F.concat_ws(",", "tags").alias("tags"), "name", F.concat_ws(",", "entity_ids").alias("entity_ids"), "scope")


@query(f"""{_RAW_SQL} SELECT {_TEXT} AS alert_id, 'user:' || usr AS source_id, 'host:' || host AS target_id, usr AS user_id, CASE kind WHEN 'data_exfiltration' THEN 'Exfiltration' ELSE tactic END AS tactic, kind AS technique, CASE severity WHEN 3 THEN 4 ELSE severity END AS severity, ts FROM kd""")
def raw_log_edges(spark, sf_dir):
    """Detector edges of raw logs (MAP-04)."""
    return mapping.security_to_edges(readers.security_table(spark, raw_root(spark, sf_dir), "incidents")).drop("process_name")


@query(f"WITH {SQL} SELECT CASE WHEN alert_id % 2 = 0 THEN 'incident_5:' ELSE 'incident_34:' END || incident_id AS incident_id, {_TEXT} AS alert_id FROM truth")
def raw_incident_ids(spark, sf_dir):
    """Alerts that the incident tables list (SRC-09, 10, 13)."""
    return readers.incident_alert_ids(spark, raw_root(spark, sf_dir), "incidents")


# --- sinks -----------------------------------------------------------------------------------------------------------
@query(f"WITH {SQL} SELECT incident_id, string_agg(CAST(alert_id AS VARCHAR), ',' ORDER BY alert_id) AS alert_ids FROM truth GROUP BY 1")
def cluster_lines(spark, sf_dir):
    """Clusters as JSON lines, read back (SNK-04)."""
    path = scratch(spark, "cluster-lines")
    sinks.write_clusters(truth(alerts(spark, sf_dir)).withColumnRenamed("incident_id", "cluster"), path)
    lines = spark.read.schema("incident_id string, alert_ids array<long>").json(path)
    return lines.select("incident_id", F.concat_ws(",", F.transform("alert_ids", lambda x: x.cast("string"))).alias("alert_ids"))


@query(f"WITH {SQL} SELECT tactic, count(*) AS count FROM alerts GROUP BY 1")
def summary_csv(spark, sf_dir):
    """A summary as CSV, read back (SNK-05)."""
    path = scratch(spark, "summary")
    sinks.write_summary(alerts(spark, sf_dir).groupBy("tactic").count(), path)
    return spark.read.option("header", True).schema("tactic string, count long").csv(path)
