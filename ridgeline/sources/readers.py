"""Readers of alert files in their published layouts, each giving a DataFrame of plain columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.functions import constants as K
from ridgeline.functions import scalars as S
from ridgeline.operators.ranking import number_rows

RECORD = "alert_id string, label string, timestamp string, severity string, tactic string, technique string, host string, user string, process string, ip string"


def _strings(columns) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def _file(column: str = "file") -> Column:
    return F.regexp_replace(F.col("_metadata.file_path"), r"^.*/", "").alias(column)


def _numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``seq``, the place in file order. ``row`` counts within a file by the position of its split and row."""
    return df.withColumn("seq", F.struct(*order))


def falcon_alerts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Alert CSV with a header: known columns as text, missing cells empty, row order as ``seq`` (SRC-01..03)."""
    df = spark.read.option("header", True).csv(path)
    lead = df.columns[0]
    df = df.withColumnRenamed(lead, lead.lstrip("\ufeff"))
    seen = {c: F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit("") for c in K.FALCON_COLUMNS}
    return df.select(*[v.alias(c) for c, v in seen.items()], F.monotonically_increasing_id().alias("seq"))


def raw_logs(spark: SparkSession, path: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """CSV cut by U+2756 with quoted JSON cells; missing cells empty (SRC-04)."""
    reader = spark.read.option("header", True).option("sep", K.LOG_SEPARATOR).option("quote", '"').option("escape", '"').option("multiLine", True)
    df = reader.csv(path)
    lead = df.columns[0]
    df = df.withColumnRenamed(lead, lead.lstrip("\ufeff"))
    want = columns or df.columns
    return df.select(*[(F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit("")).alias(c) for c in want], F.monotonically_increasing_id().alias("seq"))


SECURITY_COLUMNS = [
    "SystemAlertId", "AlertId", "VendorOriginalId", "AlertName", "DisplayName", "AlertSeverity", "Severity", "StartTime", "TimeGenerated", "EndTime", "Description",
    "Tactics", "Techniques", "Entities", "CompromisedEntity", "SourceComputerId", "ResourceId", "IsIncident", "IncidentName", "IncidentNumber", "AlertIds",
]


def scope_folders(scope: str) -> list[str]:
    """Folders of a scope: ``full``, ``incidents`` (the eight published ones) or ``incident_<id>`` (SRC-06)."""
    if scope == "full":
        return ["alphineskihouse"]
    if scope == "incidents":
        return [f"incidents/incident_{i}" for i in K.INCIDENT_FOLDERS]
    if scope.startswith("incident_") and scope.removeprefix("incident_") in K.INCIDENT_FOLDERS:
        return [f"incidents/{scope}"]
    raise ValueError(f"unknown scope {scope!r}")


def _exists(spark: SparkSession, path: str) -> list[str]:
    """Paths that match a pattern, by the file system that Spark uses."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(p)
    return sorted(f.getPath().toString() for f in found or [])


def security_table(spark: SparkSession, root: str, scope: str, table: str = "SecurityAlert", columns: list[str] | None = None) -> DataFrame:
    """A raw table of a scope: the single file of each folder, else its parts in order, with ``scope`` (SRC-05, 07, 08)."""
    out = None
    for i, folder in enumerate(scope_folders(scope)):
        paths = _exists(spark, f"{root}/{folder}/{table}.csv") or _exists(spark, f"{root}/{folder}/{table}/{table}_*.csv")
        if paths:
            part = raw_logs(spark, paths, columns or SECURITY_COLUMNS).withColumn("scope", F.lit(folder.split("/")[-1])).withColumn("scope_rank", F.lit(i))
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise FileNotFoundError(f"no {table} under {root} for scope {scope}")
    return out


def incident_alert_ids(spark: SparkSession, root: str, scope: str) -> DataFrame:
    """(incident_id, alert_id) of the incident table: ``scope:number`` and the listed ids (SRC-09, 10, 13)."""
    t = security_table(spark, root, scope, "SecurityIncident")
    rows = t.select(F.concat("scope", F.lit(":"), F.trim("IncidentNumber")).alias("incident_id"), F.explode(S.parse_ids("AlertIds")).alias("alert_id"))
    return rows.distinct()


def graphml_alert_ids(spark: SparkSession, root: str, ids: tuple[str, ...] = K.INCIDENT_FOLDERS) -> DataFrame:
    """(incident_id, alert_id) of incident graphs: nodes of type alert whose entry names a SystemAlertId (SRC-11, 12)."""
    paths = [p for i in ids for p in _exists(spark, f"{root}/graph_files/incident_{i}.graphml")]
    if not paths:
        return spark.createDataFrame([], "incident_id string, alert_id string")
    text = spark.read.option("wholetext", True).text(paths).select("value", F.regexp_extract(F.col("_metadata.file_path"), r"(incident_[^/]+)\.graphml$", 1).alias("incident_id"))
    names = text.select("incident_id", F.explode(F.regexp_extract_all("value", F.lit(r"(<key\b[^>]*>)"), F.lit(1))).alias("k"))
    names = names.select("incident_id", F.regexp_extract("k", r'\bid="([^"]*)"', 1).alias("key"), F.regexp_extract("k", r'attr\.name="([^"]*)"', 1).alias("name"))
    nodes = text.select("incident_id", F.posexplode(F.regexp_extract_all("value", F.lit(r"(?s)(<node\b.*?</node>)"), F.lit(1))).alias("node", "x"))
    cells = nodes.select("incident_id", "node", F.explode(F.regexp_extract_all("x", F.lit(r"(?s)(<data\b.*?</data>)"), F.lit(1))).alias("d"))
    unescape = F.regexp_extract("d", r"(?s)>(.*)<", 1)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        unescape = F.replace(unescape, F.lit(entity), F.lit(char))
    cells = cells.select("incident_id", "node", F.regexp_extract("d", r'\bkey="([^"]*)"', 1).alias("key"), unescape.alias("v")).join(names, ["incident_id", "key"], "left")
    name = F.coalesce("name", "key")
    wide = cells.groupBy("incident_id", "node").agg(F.max(F.when(name == "type", F.col("v"))).alias("type"), F.max(F.when(name == "entry", F.col("v"))).alias("entry"))
    return wide.filter("type = 'alert'").select("incident_id", F.get_json_object("entry", "$.SystemAlertId").alias("alert_id")).filter("alert_id is not null").distinct()


def json_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, seq, v): one VARIANT a non-blank line; a line that is no JSON is an error (SRC-17)."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(_file(), F.monotonically_increasing_id().alias("seq"), F.parse_json("value").alias("v"))


def json_records(spark: SparkSession, path: str | list[str], keys: tuple[str, ...] = ("alerts", "records", "data")) -> DataFrame:
    """(file, index, v) of files holding a JSON list, an object with a list under one of ``keys``, one object, or lines (SRC-19, 21..24, AUX-30, 31)."""
    text = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(_file(), "value")
    whole = text.withColumn("v", F.try_parse_json("value"))
    listed = [F.try_variant_get("v", f"$.{k}", "array<variant>") for k in keys]
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    parsed = F.when(F.col("v").isNotNull(), F.coalesce(F.try_variant_get("v", "$", "array<variant>"), *listed, F.array("v"))).otherwise(F.transform(lines, F.parse_json))
    return whole.select("file", F.posexplode(parsed).alias("index", "v"))


def field(*paths: str, type: str = "string") -> Column:
    """The first of the paths of VARIANT ``v`` that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.try_variant_get("v", f"$.{p}", type), F.lit("")) if type == "string" else F.try_variant_get("v", f"$.{p}", type) for p in paths])


def _record(**columns: Column) -> list[Column]:
    names = [f.split()[0] for f in RECORD.split(", ")]
    return [columns.get(n, F.lit(None)).cast("string").alias(n) for n in names] + [c.alias(n) for n, c in columns.items() if n not in names]


def _stem() -> Column:
    return F.regexp_replace("file", r"\.[^.]*$", "")


def _malicious(label: Column, *benign: str) -> Column:
    return F.when(F.lower(label).isin(*benign), "benign").otherwise("malicious")


def ait_records(records: DataFrame, windows: DataFrame | None = None) -> DataFrame:
    """Records of one testbed's alerts (MAP-08, SCL-37): entities, severity of 15 levels, and the attack step by label windows.

    ``records`` is (file, index, v); ``windows`` (scenario, attack, start_s, end_s, seq). A given label decides; without one
    an alert within a window is malicious.
    """
    from ridgeline.operators.joins import label_window_join

    epoch = F.coalesce(*[S.epoch_seconds(field(p)) for p in ("timestamp", "`@timestamp`", "Time", "time", "LogData.Timestamps[0]", "LogData.DetectionTimestamp[0]") if "`" not in p])
    at = S.epoch_seconds(F.try_variant_get("v", "$['@timestamp']", "string"))
    label = F.coalesce(field("Label[0]", "Label", "label[0]", "label"))
    rows = records.select("file", "index", "v", F.coalesce(S.epoch_seconds(field("timestamp")), at, epoch).alias("epoch"), S.scenario_of(F.col("file")).alias("scenario"), label.alias("given"))
    rows = rows.withColumn("alert_id", F.coalesce(field("alert_id", "id"), F.concat(F.lit("ait-"), _stem(), F.lit("-"), F.col("index").cast("string"))))
    rows = label_window_join(rows, windows) if windows is not None else rows.withColumn("attack", F.lit(None).cast("string"))
    step = F.coalesce("attack", F.trim("given"))
    kind = F.when(F.col("given").isNotNull(), _malicious(F.trim("given"), "benign", "normal", "false positive", "")).otherwise(F.when(F.col("attack").isNotNull(), "malicious").otherwise("benign"))
    signature = F.coalesce(field("rule.description", "AnalysisComponent.AnalysisComponentName", "AnalysisComponent.Message"), F.lit("<unknown>"))
    level = F.least(field("rule.level", type="double") / 15.0, F.lit(1.0))
    host = F.trim(field("AMiner.ID", "AMiner.Host", "agent.ip", "predecoder.hostname"))
    ip = F.trim(field("src_ip", "source_ip", "SourceIP", "dest_ip", "destination_ip"))
    time = F.date_format(F.timestamp_micros((F.col("epoch") * 1e6).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    cols = _record(alert_id=F.col("alert_id"), label=kind, timestamp=time, severity=F.coalesce(level, F.lit(0.5)), tactic=F.coalesce(step, signature), technique=F.coalesce(step, signature), host=host, ip=ip, scenario=F.col("scenario"), attack_step=step)
    return rows.select(*cols)


def step_truth(records: DataFrame) -> DataFrame:
    """(incident_id, alert_id): ``scenario:step`` of malicious records (AUX-28)."""
    return records.filter("label = 'malicious' and attack_step is not null").select(F.concat("scenario", F.lit(":"), "attack_step").alias("incident_id"), "alert_id")


def _cells(df: DataFrame, *names: str) -> Column:
    """The first of the named columns that exists and is not empty."""
    have = [F.nullif(F.col(f"`{n}`"), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def csv_rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV with a header as text columns, with ``file`` and the row's ``index`` in its file."""
    df = spark.read.option("header", True).csv(path)
    df = df.select("*", _file("file"), F.monotonically_increasing_id().alias("_at"))
    return df.withColumn("index", F.row_number().over(Window.partitionBy("file").orderBy("_at")) - 1).drop("_at")


def _json_cells(records: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The JSON twin of ``csv_rows``: named fields of each record as text columns."""
    return records.select("file", "index", *[F.try_variant_get("v", f"$.{n}", "string").alias(n) for n in names])


DARPA_FIELDS = ("alert_id", "sid", "signature", "Signature", "msg", "alert_type", "phase", "attack_phase", "label", "src_ip", "source_ip", "sip", "dst_ip", "destination_ip", "dip", "timestamp", "time", "priority", "severity", "host")
ISCX_FIELDS = ("alert_id", "AlertID", "scenario", "attack_scenario", "AttackScenario", "alert_type", "label", "Label", "class", "src_ip", "source_ip", "SourceIP", "dst_ip", "destination_ip", "DestinationIP", "timestamp", "Time", "date", "severity", "Priority", "signature", "Signature", "host", "Host", "user", "User")


def darpa2000_records(rows: DataFrame) -> DataFrame:
    """Records of a multi-phase attack's alerts; incident ``file:phase`` with the first known phase named (SRC-21, MAP-09)."""
    c = lambda *n: _cells(rows, *n)
    signature = F.coalesce(c("signature", "Signature", "msg", "alert_type"), F.lit("<unknown>"))
    phase = F.lower(F.trim(F.coalesce(c("phase", "attack_phase"), signature)))
    known = F.coalesce(*[F.when(phase.contains(p), p) for p in K.DARPA_PHASES], phase)
    dst = c("dst_ip", "destination_ip", "dip")
    key = F.coalesce(c("alert_id", "sid"), F.concat(F.lit("darpa2000-"), _stem(), F.lit("-"), F.col("index").cast("string")))
    return rows.select(*_record(alert_id=key, label=_malicious(F.coalesce(c("label"), F.lit("malicious")), "benign", "normal", "0"), timestamp=c("timestamp", "time"), severity=F.coalesce(c("priority", "severity"), F.lit("0.7")), tactic=phase, technique=signature, ip=F.coalesce(c("src_ip", "source_ip", "sip"), dst), host=F.coalesce(c("host"), dst), incident_id=F.concat(_stem(), F.lit(":"), known)))


def iscx2012_records(rows: DataFrame) -> DataFrame:
    """Records of a scenario data set; incident ``file:scenario`` (SRC-22, MAP-10)."""
    c = lambda *n: _cells(rows, *n)
    scenario = F.coalesce(c("scenario", "attack_scenario", "AttackScenario", "alert_type"), F.lit("<unknown>"))
    key = F.coalesce(c("alert_id", "AlertID"), F.concat(F.lit("iscx2012-"), _stem(), F.lit("-"), F.col("index").cast("string")))
    ip = F.coalesce(c("src_ip", "source_ip", "SourceIP"), c("dst_ip", "destination_ip", "DestinationIP"))
    return rows.select(*_record(alert_id=key, label=_malicious(F.coalesce(c("label", "Label", "class"), F.lit("malicious")), "benign", "normal", "legitimate", "0"), timestamp=c("timestamp", "Time", "date"), severity=F.coalesce(c("severity", "Priority"), F.lit("0.6")), tactic=scenario, technique=F.coalesce(c("signature", "Signature"), scenario), ip=ip, host=c("host", "Host"), user=c("user", "User"), incident_id=F.concat(_stem(), F.lit(":"), scenario)))


def darpa_tc_records(records: DataFrame) -> DataFrame:
    """Records of provenance events, and their incidents where named (SRC-23, MAP-11, AUX-29)."""
    kind = F.lower(F.coalesce(field("type", "objectType", "subject_type"), F.lit("")))
    flag = F.try_variant_get("v", "$.malicious", "boolean")
    label = F.coalesce(field("label"), F.when(flag, "malicious").when(~flag, "benign"), field("malicious", "ground_truth"), F.lit("benign"))
    key = field("uuid", "id", "event_id")
    process = F.when(kind.contains("process") | field("process_name").isNotNull(), field("process_name", "name", "path"))
    host = F.when(kind.contains("file") | field("path").isNotNull(), field("host", "hostname", "path"))
    ip = F.when(kind.contains("socket") | field("remote_ip", "remoteAddress").isNotNull(), field("remote_ip", "remoteAddress", "localAddress"))
    return records.select(*_record(alert_id=F.coalesce(key, F.lit("None")), label=label, timestamp=field("timestamp", "time"), severity=F.coalesce(field("severity", "score"), F.lit("0.5")), tactic=F.coalesce(field("tactic", "attack_stage"), F.lit("<unknown>")), technique=F.coalesce(field("technique", "operation"), F.lit("<unknown>")), process=process, host=host, ip=ip, user=field("user"), incident_id=field("incident_id", "attack_id", "campaign_id")))


def cicids_records(rows: DataFrame) -> DataFrame:
    """Records of labelled flows: the flow's duration stands as severity, there is no time, incident ``day:label`` (SRC-26, SCL-38)."""
    c = lambda *n: _cells(rows, *n)
    label = F.coalesce(c("Label", "label"), F.lit("BENIGN"))
    day = S.attack_day(_stem())
    ip = F.coalesce(c("Source IP", "Src IP", "source_ip"), c("Destination IP", "Dst IP", "destination_ip"))
    incident = F.when(F.upper(label) != "BENIGN", F.concat(day, F.lit(":"), label))
    return rows.select(*_record(alert_id=F.concat(F.lit("cicids-"), _stem(), F.lit("-"), F.col("index").cast("string")), label=_malicious(label, "benign"), severity=c("Flow Duration"), tactic=label, technique=label, ip=ip, host=c("Destination IP", "Dst IP", "destination_ip"), incident_id=incident))


def lanl_records(spark: SparkSession, path: str | list[str], start: str | None = None, end: str | None = None) -> DataFrame:
    """Records of a tab-separated red-team log (time, user, host, session), cut to days if given (SRC-25, FLT-18)."""
    df = spark.read.option("sep", "\t").schema(_strings(["time", "user", "host", "session"])).csv(path)
    df = df.select("*", _file("file"), F.monotonically_increasing_id().alias("index"))
    day = S.parse_day("time")
    if start or end:
        df = df.filter(day.between(F.lit(start or "0001-01-01").cast("date"), F.lit(end or "9999-12-31").cast("date")))
    return df.filter("session is not null").select(*_record(alert_id=F.concat(F.lit("lanl-"), F.col("index").cast("string")), label=F.lit("malicious"), timestamp=day.cast("string"), severity=F.lit("0.8"), tactic=F.lit("red_team"), technique=F.lit("red_team"), host=F.col("host"), user=F.col("user"), incident_id=F.col("session")))


def excytin_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(alerts as VARIANT, truth): files with alerts and incidents, a list, or nodes; incidents map ids to alerts (SRC-24)."""
    rows = json_records(spark, path, ("alerts", "nodes"))
    text = spark.read.option("wholetext", True).text(path).select(F.try_parse_json("value").alias("v"))
    pairs = text.select(F.explode(F.try_variant_get("v", "$.incidents", "map<string,array<string>>")).alias("incident_id", "ids"))
    named = rows.select(field("incident_id").alias("incident_id"), field("alert_id", "id", "SystemAlertId").alias("alert_id")).filter("incident_id is not null and alert_id is not null")
    return rows, pairs.select("incident_id", F.explode("ids").alias("alert_id")).unionByName(named).distinct()


QUESTION = "context string, question string, answer string, solution array<string>, start_alert int, end_alert int, start_entities array<int>, end_entities array<int>, shortest_alert_path array<int>"


def questions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Questions of JSON files with one list each: incident from the name, ``row_idx`` in order of path and place (SRC-16, SCL-43)."""
    text = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.parse_json("value").alias("v"))
    items = text.select("file", F.posexplode(F.variant_get("v", "$", "array<variant>")).alias("i", "q"))
    cells = [F.try_variant_get("q", f"$.{c.split()[0]}", c.split()[1]).alias(c.split()[0]) for c in QUESTION.split(", ") if not c.startswith("context")]
    context = F.coalesce(F.try_variant_get("q", "$.context", "string"), F.to_json(F.try_variant_get("q", "$.context", "variant")), F.lit("")).alias("context")
    return number_rows(items, ["file", "i"]).select((F.col("number") - 1).cast("int").alias("row_idx"), F.regexp_extract("file", r"(incident_\d+)_qa", 1).alias("incident"), context, *cells)


#: Name -> function of (spark, path) giving records (SRC-27).
DATASETS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "ait": lambda spark, path: ait_records(json_records(spark, path)),
    "darpa2000": lambda spark, path: darpa2000_records(csv_rows(spark, path)),
    "darpa2000_json": lambda spark, path: darpa2000_records(_json_cells(json_records(spark, path), DARPA_FIELDS)),
    "iscx2012": lambda spark, path: iscx2012_records(csv_rows(spark, path)),
    "iscx2012_json": lambda spark, path: iscx2012_records(_json_cells(json_records(spark, path), ISCX_FIELDS)),
    "darpa_tc": lambda spark, path: darpa_tc_records(json_records(spark, path)),
    "cicids": lambda spark, path: cicids_records(csv_rows(spark, path)),
    "lanl": lanl_records,
}


def load(spark: SparkSession, name: str, path: str) -> DataFrame:
    if name not in DATASETS:
        raise ValueError(f"unknown data set {name!r}; known: {', '.join(sorted(DATASETS))}")
    return DATASETS[name](spark, path)
