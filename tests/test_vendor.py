"""Vendor alerts judged against their labels: a fixture with known outcomes, hidden severity, repeats, nulls, empty tables."""

import pytest
from pyspark.sql import functions as F

from ridgeline.plans import vendor as V
from ridgeline.sources import generator, readers

COLUMNS = ", ".join(f"{c} string" for c in readers.K.FALCON_COLUMNS) + ", seq long"
#: A chain of four tactics over two hosts, then noise: a severe alert, and a common one.
CHAIN = ["Initial Access", "Execution", "Credential Access", "Lateral Movement"]


def table(spark, extra=()):
    rows = [(f"c{i}", f"2026-01-01 10:{10 * i:02d}:00", "AID-1", "AID-2", "USER-1", t, f"T{i}", "High", "p.exe", "1", "INC-7", i) for i, t in enumerate(CHAIN)]
    rows.append(("n1", "2026-01-03 00:00:00", "AID-8", "AID-9", "USER-9", "Execution", "T9", "Critical", "q.exe", "0", "", 10))
    rows.append(("n2", "2026-01-04 00:00:00", "AID-8", "AID-9", "USER-9", "Execution", "T9", "Low", "q.exe", "0", "", 11))
    rows.append(("m1", "2026-01-05 00:00:00", "AID-5", "AID-6", "USER-5", "Execution", "T9", "Low", "z.exe", "yes", "INC-10", 12))
    return spark.createDataFrame(rows + list(extra), COLUMNS)


def by(df, key="detector"):
    return {r[key]: r for r in df.collect()}


def test_detectors_and_incidents(spark):
    e = V.Evaluation(table(spark), with_tactics=False)
    d = by(e.detectors)
    gate = d[V.GATE_BLIND]
    assert (e.mode, gate.tp, gate.fp, gate.fn, gate.selected) == ("without_tactics", 4, 1, 1, 5)
    assert (gate.precision, gate.recall, gate.incident_recall_any, gate.incident_recall_all, gate.mean_incident_alert_recall) == (0.8, 0.8, 0.5, 0.5, 0.5)
    assert by(e.reasons, "reason")["not_interesting"]["count"] == 2
    assert [(r.incident_id, r.hits) for r in e.incidents.collect()] == [("INC-7", 4), ("INC-10", 0)]  # by number, not by text
    note = e.note.first()
    assert (note.incident_high, note.noise_high, note.separable) == (0.8, 0.5, False)
    # with tactics every alert is an attack kind
    assert by(V.Evaluation(table(spark)).detectors)[V.GATE].selected == 7


def test_hidden_severity_disables_the_baselines(spark):
    e = V.Evaluation(table(spark), False, True)
    d = by(e.detectors)
    assert e.mode == "without_tactics_severity_hidden" and d[V.SEVERITY].selected == 0 and d[V.SEVERITY].fn == 5
    assert [(r.reason, r["count"]) for r in e.reasons.collect()] == [("rare_relationship", 7)] and d[V.GATE_BLIND].selected == 7
    m = by(V.Errors(table(spark), True).detectors)
    assert len(m) == 7 and m[V.SEVERITY].selected == m[V.LOCAL].selected == 0 and m[V.LAYERED].selected >= 0


def test_discovery_with_tactics(spark):
    e = V.Evaluation(table(spark))
    c = e.clusters.first()
    assert (c.cluster_name, c.status, c.n, c.known, c.max_severity) == ("cluster-0001", "known_incident_overlap", 4, ["INC-7"], 9)
    assert c.pattern == "credential_lateral_privilege" and c.reasons == "high_severity=4"
    assert {r.alert_id for r in e.members.filter(F.col("cluster_name") == "cluster-0001").collect()} == {f"c{i}" for i in range(4)}
    s = e.summary.first()
    assert (s.stored, s.considered, s.incidents_found, s.incidents_missed) == (7, 4, 1, 1)


def test_errors_of_seven_methods(spark):
    e = V.Errors(table(spark))
    d = by(e.detectors)
    assert set(d) == set(e.names) and len(d) == 7
    assert (d[V.SEVERITY].tp, d[V.SEVERITY].fp, d[V.SEVERITY].fn) == (4, 1, 1) and d[V.SEVERITY].missed_high == 0.0
    assert (d[V.LAYERED].tp, d[V.LAYERED].fp) == (4, 0) and d[V.LOCAL].tp == 4
    h = {(r.detector, r.side, r.facet, r.value): r["count"] for r in e.histograms.collect()}
    assert h[(V.SEVERITY, "false_positive", "severity", "Critical")] == 1 and h[(V.GATE_BLIND, "true_positive", "reason", "high_severity")] == 4
    worst = [r for r in e.clusters.collect() if r.detector == V.SEVERITY]
    assert [(r.cluster, r.kind, r.by_severity, r.hosts) for r in worst] == [("severity-n1", "false_positive", "Critical=1", 2)]
    assert {(r.detector, r.incident_id) for r in e.missed.collect()} >= {(V.SEVERITY, "INC-10")}
    assert len(by(e.notes)[V.SEVERITY].notes) == 4
    assert {(r.flagged, r.alerts, r.incidents) for r in e.profile.collect()} == {(True, 5, 2), (False, 2, 0)}


def test_generated_alerts_of_the_hard_profile(spark):
    rows = generator.generate(spark, 320, 6, seed=11, profile="hard").withColumn("seq", F.monotonically_increasing_id())
    d = by(V.Errors(rows).detectors)
    assert d[V.SEVERITY].fp > 0 and d[V.SEVERITY].fn > 0 and d[V.RARE + V.VERDICT].selected <= d[V.RARE].selected
    truth = rows.filter("is_incident in ('1', 'true', 'True')").count()
    assert all(r.tp + r.fn == truth for r in d.values())


def test_repeats_nulls_and_clashes(spark):
    again = ("n2", "2026-01-04 00:00:00", "AID-8", "AID-9", "USER-9", "Execution", "T9", "Low", "q.exe", "1", "", 20)
    bare = (None,) * 11 + (21,)
    rows = table(spark, [again, again, bare]).withColumn("detector", F.lit("x")).withColumn("flagged", F.lit("y"))
    d = by(V.Evaluation(rows, False).detectors)[V.GATE_BLIND]
    assert d.tp + d.fn == 6  # the last row of an id labels it; the bare row is noise
    assert len(by(V.Errors(rows).detectors)) == 7


@pytest.mark.parametrize("hidden", [False, True])
def test_empty_table(spark, hidden):
    none = table(spark).limit(0)
    e = V.Evaluation(none, True, hidden)
    assert all((r.selected, r.tp, r.f1, r.incident_recall_any) == (0, 0, 0.0, 0.0) for r in e.detectors.collect())
    assert e.clusters.count() == 0 and e.summary.first().stored == 0
    x = V.Errors(none, hidden)
    assert len(by(x.detectors)) == 7 and x.clusters.count() == 0 and x.missed.count() == 0


def test_modes_share_labels_and_write_decisions_only(spark, monkeypatch):
    written, real = [], V.materialize
    monkeypatch.setattr(V, "materialize", lambda df, name: (written.append(name), real(df, name))[1])
    rows, one = table(spark), None
    modes = ((True, False), (False, False), (False, True))
    for mode in modes:
        one = V.Evaluation(rows, *mode, like=one)
        assert by(one.detectors) == by(V.Evaluation(rows, *mode).detectors)
    assert written.count("decided") == 0 and written.count("labels") == written.count("incidents") == 4  # one for all, and three alone
