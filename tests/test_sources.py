"""Readers, mappings, sinks and streams on small files."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from ridgeline.operators import gate
from ridgeline.operators.joins import label_windows
from ridgeline.sources import infer, mapping, readers, sinks
from ridgeline.streaming.gate import replay, stream_gate

SEP = "❖"
FALCON = """alert_id,timestamp,source_node,target_node,user,tactic,technique,severity,process,is_incident,incident_id
a1,2026-01-01 10:00:00,AID-1,AID-2,USER-1,Credential Access,T1003,High,lsass.exe,1,INC-1
a2,2026-01-01 10:05:00,AID-1,AID-1,USER-1,Persistence,T1053,Low,,0,
,2026-01-01 10:06:00,AID-3,AID-4,,,,,x.exe,0,
"""


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_falcon_csv_to_alerts_and_edges(spark, tmp_path):
    rows = readers.falcon_alerts(spark, put(tmp_path / "f.csv", "﻿" + FALCON))
    a = {r.alert_id: r for r in mapping.falcon_to_alerts(rows).collect()}
    assert a["a1"].kind == "credential_access" and a["a1"].severity == 9 and a["a1"].source.id == "host:aid-1" and sorted(a["a1"].tags) == ["credential_access", "t1003"]
    assert a["a2"].kind == "privilege_escalation" and a["a2"].action == "observed" and "falcon:AID-3:AID-4:" in a
    hidden = mapping.falcon_to_alerts(rows, with_tactics=False, hide_severity=True)
    assert {(r.kind, r.severity) for r in hidden.collect()} == {("falcon_alert", 5)}
    assert not {"is_incident", "incident_id"} & set(hidden.columns)
    e = {r.alert_id: r for r in mapping.falcon_to_edges(rows).collect()}
    assert e["a1"].tactic == "Credential Access" and e["a1"].ts == dt.datetime(2026, 1, 1, 10)


def security_root(tmp_path):
    head = ["SystemAlertId", "AlertName", "AlertSeverity", "StartTime", "Description", "Tactics", "Techniques", "Entities", "CompromisedEntity", "IsIncident"]
    ents = json.dumps([{"Type": "account", "Name": "Bob"}, {"Type": "host", "HostName": "H1"}]).replace('"', '""')
    r1 = ["s1", "Lateral movement via SMB", "High", "2026-01-01T00:00:00Z", "x", "LateralMovement", "", f'"{ents}"', "", "1"]
    r2 = ["s2", "Odd thing", "Low", "2026-01-01 01:00:00", "y", "", "", "", "", ""]
    put(tmp_path / "incidents/incident_5/SecurityAlert.csv", "\n".join(SEP.join(r) for r in (head, r1)) + "\n")
    put(tmp_path / "incidents/incident_34/SecurityAlert/SecurityAlert_1.csv", "\n".join(SEP.join(r) for r in (head, r2)) + "\n")
    ids = json.dumps(["s1", "s9"]).replace('"', '""')
    put(tmp_path / "incidents/incident_5/SecurityIncident.csv", "\n".join([SEP.join(["IncidentNumber", "AlertIds"]), SEP.join(["5", f'"{ids}"'])]) + "\n")
    xml = '<graphml><key id="d0" attr.name="type"/><key id="d1" attr.name="entry"/><graph><node id="n0"><data key="d0">alert</data><data key="d1">{&quot;SystemAlertId&quot;: &quot;s1&quot;}</data></node><node id="n1"><data key="d0">entity</data></node></graph></graphml>'
    put(tmp_path / "graph_files/incident_5.graphml", xml)
    return str(tmp_path)


def test_security_tables(spark, tmp_path):
    root = security_root(tmp_path)
    rows = readers.security_table(spark, root, "incidents")
    a = {r.alert_id: r for r in mapping.security_to_alerts(rows).collect()}
    assert a["s1"].kind == "lateral_movement" and a["s1"].severity == 9 and a["s1"].source.id == "user:bob" and a["s1"].target.id == "host:h1"
    assert a["s2"].severity == 4 and a["s2"].source.id == "service:incident_34" and a["s2"].target is None and a["s2"].kind == "odd_thing"
    e = {r.alert_id: r for r in mapping.security_to_edges(rows).collect()}
    assert (e["s1"].tactic, e["s1"].source_id, e["s1"].user_id) == ("Lateral Movement", "user:bob", "Bob") and e["s2"].target_id == e["s2"].source_id
    assert {(r.incident_id, r.alert_id) for r in readers.incident_alert_ids(spark, root, "incident_5").collect()} == {("incident_5:5", "s1"), ("incident_5:5", "s9")}
    assert [(r.incident_id, r.alert_id) for r in readers.graphml_alert_ids(spark, root).collect()] == [("incident_5", "s1")]
    with pytest.raises(ValueError):
        readers.scope_folders("incident_999")


NESTED = [("a1", "malicious", "2026-01-01T10:00:00", "host-a", "alice", "cmd.exe", "10.0.0.1", "Execution", "T1059"), ("a2", "benign", "2026-01-01T11:00:00", "host-b", "bob", "x.exe", "10.0.0.2", "Discovery", "T1082"), ("a3", "odd", "2026-01-01T11:00:00", "h", "u", "p", "i", "t", "t")]


def test_schema_inference_on_nested_json(spark, tmp_path):
    lines = [json.dumps({"alert_id": i, "label": y, "timestamp": t, "severity": "High", "traces": [{"timestamp": t, "input": {"RawPayload": {"event": {"Hostname": h, "UserName": u, "FileName": p, "LocalIP": ip, "MitreAttack": [{"Tactic": ta, "Technique": te}]}}}}]}) for i, y, t, h, u, p, ip, ta, te in NESTED]
    recs = readers.json_lines(spark, put(tmp_path / "n.jsonl", "\n\n".join(lines) + "\n"))
    fields = infer.infer_fields(recs)
    assert fields["host"].endswith("['Hostname']") and fields["timestamp"].startswith("$['traces'][0]") and fields["tactic"].endswith("['Tactic']")
    out = {r.alert_id: r for r in mapping.normalize_records(infer.select_fields(recs, fields)).collect()}
    assert set(out) == {"a1", "a2"} and out["a1"].label == 1 and out["a1"].severity == 0.75 and out["a1"].entities == {"host": "host-a", "user": "alice", "process": "cmd.exe", "ip": "10.0.0.1"}
    assert recs.select(infer.nested("v", "traces.0.input.RawPayload.event.UserName")).first()[0] == "alice"
    with pytest.raises(ValueError):
        infer.infer_fields(recs.select(F.parse_json(F.lit('{"x": 1}')).alias("v")))


def test_testbed_records(spark, tmp_path):
    alerts = [{"timestamp": 100 + i, "rule": {"level": 3, "description": "d"}, "agent": {"ip": "1.1.1.1"}} for i in range(4)] + [{"@timestamp": "1970-01-01T00:10:00Z", "Label": ["benign"]}]
    recs = readers.json_records(spark, put(tmp_path / "fox_wazuh.json", json.dumps({"alerts": alerts})))
    w = spark.createDataFrame([("fox", "dirb", 101.0, 102.0, 0)], "scenario string, attack string, start_s double, end_s double, seq int")
    got = readers.ait_records(recs, label_windows(w)).orderBy("alert_id").collect()
    assert [r.label for r in got] == ["benign", "malicious", "malicious", "benign", "benign"] and got[1].tactic == "dirb" and got[0].tactic == "d" and got[0].host == "1.1.1.1"
    truth = readers.step_truth(readers.ait_records(recs, label_windows(w))).collect()
    assert {(r.incident_id, r.alert_id) for r in truth} == {("fox:dirb", "ait-fox_wazuh-1"), ("fox:dirb", "ait-fox_wazuh-2")}
    lines = readers.json_records(spark, put(tmp_path / "l/x_y.json", '{"id": "p"}\n\n{"id": "q"}\n'))
    assert [r.alert_id for r in readers.ait_records(lines).orderBy("alert_id").collect()] == ["p", "q"]


def test_csv_data_sets(spark, tmp_path):
    d = readers.load(spark, "darpa2000", put(tmp_path / "d/in.csv", "alert_id,timestamp,src_ip,phase,label\n1,t,1.1.1.1,Sadmind_Probe phase,attack\n,t,,x,normal\n")).collect()
    assert [(r.alert_id, r.label, r.incident_id) for r in d] == [("1", "malicious", "in:sadmind_probe"), ("darpa2000-in-1", "benign", "in:x")]
    i = readers.load(spark, "iscx2012", put(tmp_path / "i/in.csv", "alert_id,timestamp,scenario,src_ip,label\n1,t,HTTP DoS,1.1.1.1,Attack\n")).first()
    assert (i.tactic, i.incident_id, i.ip) == ("HTTP DoS", "in:HTTP DoS", "1.1.1.1")
    c = readers.load(spark, "cicids", put(tmp_path / "c/Friday-x.csv", "Label,Source IP,Destination IP,Flow Duration\nBENIGN,a,b,3\nDDoS,a,b,4\n")).collect()
    assert [(r.label, r.incident_id, r.severity, r.timestamp) for r in c] == [("benign", None, "3", None), ("malicious", "friday:DDoS", "4", None)]
    lanl = readers.lanl_records(spark, put(tmp_path / "r.tsv", "2015-01-01\tu\th\ts\n2015-01-02\tu\th\ts\nbad\n"), "2015-01-02")
    assert [r.timestamp for r in lanl.collect()] == ["2015-01-02"]
    t = readers.load(spark, "darpa_tc", put(tmp_path / "tc/a/b.json", json.dumps([{"uuid": "u1", "malicious": True, "process_name": "p", "campaign_id": "k"}, {"id": "u2"}]))).orderBy("alert_id").collect()
    assert [(r.alert_id, r.label, r.process, r.incident_id) for r in t] == [("u1", "malicious", "p", "k"), ("u2", "benign", None, None)]
    with pytest.raises(ValueError):
        readers.load(spark, "none", "x")


def test_graph_json_and_questions(spark, tmp_path):
    rows, truth = readers.excytin_graph(spark, put(tmp_path / "g.json", json.dumps({"alerts": [{"id": "a"}], "incidents": {"5": ["a", "b"]}})))
    assert rows.count() == 1 and {(r.incident_id, r.alert_id) for r in truth.collect()} == {("5", "a"), ("5", "b")}
    q = [{"context": {"k": 1}, "question": "which IP address?", "answer": "198.43.121.209", "solution": ["s"], "start_alert": 1, "end_alert": 3, "shortest_alert_path": [1, 9, 3]}]
    qs = readers.questions(spark, put(tmp_path / "questions/s/incident_5_qa_x.json", json.dumps(q)))
    r = qs.first()
    assert (r.row_idx, r.incident, json.loads(r.context)) == (0, "incident_5", {"k": 1})
    a = mapping.question_alerts(qs).orderBy("pos").collect()
    assert [x.alert_id for x in a] == ["excytin-0-1", "excytin-0-9", "excytin-0-3"] and len(set(a[0].entity_ids) & set(a[1].entity_ids)) == 1 and not set(a[0].entity_ids) & set(a[2].entity_ids)


def test_sinks(spark, tmp_path):
    rows = readers.falcon_alerts(spark, put(tmp_path / "f.csv", FALCON))
    sinks.write_alert_csv(rows.coalesce(1), str(tmp_path / "out"))
    assert readers.falcon_alerts(spark, str(tmp_path / "out")).count() == 3
    m = spark.createDataFrame([(1, "b"), (1, "a"), (-1, "z")], "cluster int, alert_id string")
    sinks.write_clusters(m, str(tmp_path / "clusters"))
    assert {(r.incident_id, tuple(r.alert_ids)) for r in spark.read.json(str(tmp_path / "clusters")).collect()} == {(1, ("a", "b")), (-1, ("z",))}
    table = spark.createDataFrame([("a|b", 0.5)], "name string, f1 double")
    assert sinks.markdown(table).splitlines()[2] == "| a\\|b | 0.5000 |" and r"a|b & 0.5000 \\" in sinks.latex(table)
    assert json.loads(sinks.report(table)) == [{"f1": 0.5, "name": "a|b"}]


def test_stream_gate_keeps_counts_across_batches(spark, tmp_path):
    schema = "alert_id int, rel_key string, ts timestamp, severity int, attack boolean"
    for b in range(3):
        rows = [(b * 4 + i, "k" if i % 2 else f"k{b}", dt.datetime(2026, 1, 1, b, i), 5, False) for i in range(4)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    replay(stream_gate(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {r.alert_id: (r.seen, r.reason) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert sorted(got[i][0] for i in (1, 3, 5, 7, 9, 11)) == [0, 1, 2, 3, 4, 5] and got[4][0] == 0
    assert sum(r == "rare_relationship" for _, r in got.values()) == 10
    batch = gate.gate(spark.read.parquet(str(tmp_path / "in")), "rel_key", ["ts", "alert_id"], F.col("attack"))
    assert batch.filter("store").count() == 10


def alert_files(spark, folder, batches):
    """One file a batch, written one after another: lists of (alert_id, rel_key, severity)."""
    schema = "alert_id int, rel_key string, ts timestamp, severity int, attack boolean"
    for b, rows in enumerate(batches):
        spark.createDataFrame([(i, k, dt.datetime(2026, 1, 1, b, i % 60), s, False) for i, k, s in rows], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_stream_of_many_batches_equals_the_batch_gate_and_reports(spark, tmp_path):
    import os
    import random

    rng, n = random.Random(3), iter(range(10_000))
    batches = [[(next(n), f"k{rng.randrange(6)}", rng.choice([2, 5, 9])) for _ in range(rng.randrange(1, 9))] for _ in range(10)]
    stream = alert_files(spark, str(tmp_path / "in"), batches)
    told = replay(stream_gate(stream), str(tmp_path / "out"), str(tmp_path / "state")).orderBy("batch").collect()
    assert sorted(int(f) for f in os.listdir(tmp_path / "state/commits") if f.isdigit()) == list(range(10))
    batch = gate.gate(spark.read.parquet(str(tmp_path / "in")), "rel_key", ["ts", "alert_id"], F.col("attack"))
    columns = ["alert_id", "rel_key", "seen", "reason", "store"]
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(got.select(*columns).collect()) == sorted(batch.select(*columns).collect())
    assert [(t.rows, t.processed) for t in told] == [(len(b), len(b)) for b in batches] and sum(t.stored for t in told) == got.filter("store").count()
    # started again it takes up the counts where they were
    more = alert_files(spark, str(tmp_path / "in"), [[(20_000, "k1", 2), (20_001, "k1", 2)]])
    assert replay(stream_gate(more), str(tmp_path / "out"), str(tmp_path / "state")).first().rows == 2
    before = sum(k == "k1" for b in batches for _, k, _ in b)
    assert sorted(r.seen for r in spark.read.parquet(str(tmp_path / "out")).filter("alert_id >= 20000").collect()) == [before, before + 1]


def test_state_is_asked_by_bucket_not_by_relationship(spark, tmp_path):
    batches = [[(b * 400 + i, f"k{i % 200}" if i else None, 5) for i in range(400)] for b in range(2)]
    stream = alert_files(spark, str(tmp_path / "in"), batches)
    gated = stream_gate(stream)
    assert "bucket" in gated._jdf.queryExecution().analyzed().toString()
    replay(gated, str(tmp_path / "out"), str(tmp_path / "state"))
    batch = gate.gate(spark.read.parquet(str(tmp_path / "in")), "rel_key", ["ts", "alert_id"], F.col("attack"))
    columns = ["alert_id", "rel_key", "seen", "reason", "store"]
    order = lambda df: sorted(df.select(*columns).collect(), key=lambda r: r.alert_id)
    assert order(spark.read.parquet(str(tmp_path / "out"))) == order(batch)


def test_forgotten_relationships_start_anew(spark, tmp_path):
    import time

    first = alert_files(spark, str(tmp_path / "in"), [[(1, "a", 5), (2, "a", 5), (3, "b", 5)]])
    run = lambda s: replay(stream_gate(s, ttl_ms=3_000), str(tmp_path / "out"), str(tmp_path / "state"), timed=True)
    run(first)
    time.sleep(4)
    run(alert_files(spark, str(tmp_path / "in"), [[(4, "a", 5), (5, "a", 5)]]))
    got = {r.alert_id: r.seen for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 0, 5: 1}


def test_generator_is_reproducible_and_overlaps(spark):
    from ridgeline.sources import generator

    a = generator.generate(spark, 300, 10, seed=7, profile="hard")
    assert a.columns == list(readers.K.FALCON_COLUMNS)
    rows = sorted(map(tuple, a.collect()))
    assert rows == sorted(map(tuple, generator.generate(spark, 300, 10, seed=7, profile="hard").collect())) and rows != sorted(map(tuple, generator.generate(spark, 300, 10, seed=8, profile="hard").collect()))
    s = generator.summarize(a).first()
    assert (s.alerts, s.incidents) == (300, 10) and 60 <= s.incident_alerts <= 120 and len({r[0] for r in rows}) == 300
    by = {k: {r[7] for r in rows if r[9] == k} for k in "01"}
    assert len(by["0"] & by["1"]) >= 2
    with pytest.raises(ValueError):
        generator.generate(spark, profile="odd")
