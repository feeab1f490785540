"""Raw rows to canonical alerts and detector edges; labels are left behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions import constants as K
from ridgeline.functions import scalars as S

SECURITY_TEXT = ("AlertName", "DisplayName", "Description", "Tactics", "Techniques", "Entities")
HIDDEN = ("IsIncident", "IncidentName", "IncidentNumber", "AlertIds")


def entity(kind: Column | str, value: Column) -> Column:
    k = F.lit(kind) if isinstance(kind, str) else kind
    v = S.clean(value)
    return F.when(v.isNotNull(), F.struct(k.alias("type"), v.alias("value"), S.entity_id(k, v).alias("id")))


def falcon_id() -> Column:
    """A Falcon row's id, else one made of its ends and tactic."""
    return S.first_text("alert_id", F.concat(F.lit("falcon:"), "source_node", F.lit(":"), "target_node", F.lit(":"), "tactic"))


def falcon_to_alerts(rows: DataFrame, with_tactics: bool = True, hide_severity: bool = False) -> DataFrame:
    """Canonical alerts of Falcon rows; label columns never pass (MAP-01, MAP-12)."""
    tactic = F.lower(F.trim("tactic"))
    token = F.coalesce(S.lookup(K.TACTIC_KINDS, tactic), F.nullif(S.normalize_token_unicode("tactic"), F.lit("")))
    kind = F.coalesce(token, F.lit("falcon_alert")) if with_tactics else F.lit("falcon_alert")
    tags = F.array_distinct(F.array_compact(F.array(F.when(F.lit(with_tactics), token), F.when(F.lit(with_tactics), F.nullif(S.normalize_token_unicode("technique"), F.lit(""))))))
    action = F.coalesce(F.nullif(S.normalize_token_unicode(S.first_text("process", default="observed")), F.lit("")), F.nullif(S.normalize_token_unicode("technique"), F.lit("")), F.lit("observed"))
    severity = F.lit(K.HIDDEN_SEVERITY) if hide_severity else S.severity_falcon("severity")
    return rows.select(
        falcon_id().alias("alert_id"), S.parse_time("timestamp").alias("ts"), entity("host", S.first_text("source_node", default="falcon-source")).alias("source"), entity("host", F.col("target_node")).alias("target"),
        kind.alias("kind"), action.alias("action"), severity.alias("severity"), tags.alias("tags"), F.col("user"), "seq",
    )


def security_to_alerts(rows: DataFrame) -> DataFrame:
    """Canonical alerts of security rows: first entity as source, second as target, else the scope as a service (MAP-02, 13)."""
    text = S.row_text(*SECURITY_TEXT)
    entities = S.entities_from_json("Entities", ("CompromisedEntity", "host"), ("SourceComputerId", "host"), ("ResourceId", "service"))
    base = rows.withColumn("_entities", entities).withColumn("_tags", S.attack_tags(text))
    scope = entity("service", F.col("scope"))
    name = S.first_text("AlertName", "DisplayName", default="security_alert")
    return base.select(
        S.first_text("SystemAlertId", "AlertId", "VendorOriginalId").alias("alert_id"), S.parse_time("StartTime", "TimeGenerated", "EndTime").alias("ts"),
        F.coalesce(F.get("_entities", F.lit(0)), scope).alias("source"), F.get("_entities", F.lit(1)).alias("target"), S.infer_kind(F.col("_tags"), name).alias("kind"),
        S.normalize_token(name).alias("action"), S.severity_sentinel(F.coalesce(F.nullif(F.trim("AlertSeverity"), F.lit("")), F.col("Severity"))).alias("severity"),
        F.col("_tags").alias("tags"), name.alias("name"), F.transform("_entities", lambda e: e["id"]).alias("entity_ids"), F.col("_entities").alias("entities"), "scope", "seq",
    )


def falcon_to_edges(rows: DataFrame, hide_severity: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Detector edges of Falcon rows, with further columns to keep (MAP-03)."""
    severity = F.lit(K.HIDDEN_SEVERITY) if hide_severity else S.severity_falcon("severity")
    return rows.select(
        S.first_text("alert_id", default="").alias("alert_id"), S.first_text("source_node", default="unknown-source").alias("source_id"), S.first_text("target_node", default="unknown-target").alias("target_id"),
        S.first_text("user", default="").alias("user_id"), S.first_text("process", default="").alias("process_name"), S.first_text("tactic", default="").alias("tactic"),
        S.first_text("technique", default="").alias("technique"), severity.alias("severity"), S.parse_time("timestamp").alias("ts"), *keep,
    )


#: Kind -> tactic, where the title of the kind is not it (fixed values).
KIND_TACTICS = {"data_exfiltration": "Exfiltration", "failed_login_burst": "Credential Access", "command_and_control": "Command and Control"}


def security_to_edges(rows: DataFrame) -> DataFrame:
    """Detector edges of security rows; the target defaults to the source (MAP-04)."""
    a = security_to_alerts(rows)
    users = F.filter("entities", lambda e: e["type"] == "user")
    tactic = F.coalesce(S.lookup(KIND_TACTICS, F.col("kind")), S.title(F.col("kind")))
    return a.select(
        "alert_id", F.col("source.id").alias("source_id"), F.coalesce("target.id", "source.id").alias("target_id"), F.coalesce(F.get(users, F.lit(0))["value"], F.lit("")).alias("user_id"),
        S.process_of(F.col("entities"), F.col("name")).alias("process_name"), tactic.alias("tactic"), F.col("kind").alias("technique"), "severity", "ts",
    )


def question_alerts(questions: DataFrame) -> DataFrame:
    """Alerts along each question's path, each linked to its neighbours by a shared entity (MAP-05, AUX-22, 23)."""
    path = F.when(F.size("shortest_alert_path") > 0, F.col("shortest_alert_path")).otherwise(F.array_distinct(F.array_compact(F.array("start_alert", "end_alert"))))
    steps = questions.withColumn("kind", S.question_kind(F.concat_ws(" ", "context", "question", F.concat_ws(" ", "solution")))).select("row_idx", "kind", path.alias("path"), F.posexplode(path).alias("pos", "node"))
    key = lambda n: F.format_string("excytin-%d-%d", "row_idx", n)
    before, after = F.get("path", F.col("pos") - 1), F.get("path", F.col("pos") + 1)
    joint = lambda a, b: F.format_string("service:excytin:%d:%d:%d", "row_idx", a, b)
    ents = F.array_compact(F.array(F.when(before.isNotNull(), joint(before, F.col("node"))), F.when(after.isNotNull(), joint(F.col("node"), after))))
    return steps.select("row_idx", key(F.col("node")).alias("alert_id"), "pos", "kind", ents.alias("entity_ids"))


def normalize_records(records: DataFrame) -> DataFrame:
    """Text records to learning records; rows without id or with a label of no class go, and none left is an error (MAP-06, 07)."""
    entities = F.map_filter(F.create_map(*[x for t in ("host", "user", "process", "ip") for x in (F.lit(t), S.clean(t))]), lambda k, v: v.isNotNull())
    out = records.select(
        S.clean("alert_id").alias("alert_id"), S.label_binary("label").alias("label"), S.first_text("tactic", default="<unknown>").alias("tactic"), S.first_text("technique", default="<unknown>").alias("technique"),
        S.severity_unit("severity").alias("severity"), S.epoch_guess("timestamp").alias("ts"), entities.alias("entities"),
    ).filter("alert_id is not null and label is not null")
    if out.isEmpty():
        raise ValueError("no record has an id and a known label")
    return out


def entity_rows(records: DataFrame) -> DataFrame:
    """(alert_id, ts, etype, entity) of learning records."""
    return records.select("alert_id", "ts", F.explode("entities").alias("etype", "value")).select("alert_id", "ts", "etype", F.concat("etype", F.lit(":"), "value").alias("entity"))


def drop_internal(df: DataFrame) -> DataFrame:
    """Without columns whose name begins with an underscore (MAP-14)."""
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def latest_rows(rows: DataFrame, key: str = "alert_id", order: str = "seq") -> DataFrame:
    """The last row of each id (Q5)."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
