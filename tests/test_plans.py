"""Composite plans on the small fixtures whose outcomes are known."""

import datetime as dt
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from ridgeline.plans import alert_queries as Q
from ridgeline.plans import composite_queries as CQ
from ridgeline.plans import discover as D
from ridgeline.plans import strategies as C
from ridgeline.plans import table_queries as TQ
from ridgeline.plans.alerts import SQL
from ridgeline.plans.registry import ORACLES, QUERIES

T0 = dt.datetime(2026, 1, 1, 10)
ALERT = "alert_id string, ts timestamp, severity int, kind string, tags array<string>, name string, rel_key string, attack boolean, seq int"


def alerts(spark, rows):
    """rows: (id, minutes, severity, tags, name)"""
    data = [(i, T0 + dt.timedelta(minutes=m), s, (t or ["odd"])[0], t, n, f"{n}|{i}", bool(t), k) for k, (i, m, s, t, n) in enumerate(rows)]
    return spark.createDataFrame(data, ALERT)


def ents(spark, pairs):
    return spark.createDataFrame(pairs, "alert_id string, entity string")


def truth(spark, pairs):
    return spark.createDataFrame(pairs, "incident_id string, alert_id string")


def chain(spark):
    a = alerts(spark, [("c1", 0, 9, ["credential_access"], "a"), ("c2", 10, 9, ["execution"], "b"), ("c3", 20, 9, ["lateral_movement"], "c"), ("c4", 30, 10, ["privilege_escalation"], "d"), ("n1", 5000, 2, [], "noise")])
    return a, ents(spark, [(f"c{i}", "host:h") for i in range(1, 5)] + [("n1", "host:z")])


def test_discovery_of_a_new_chain(spark):
    a, e = chain(spark)
    found = D.discover(a, e).collect()
    assert len(found) == 1
    f = found[0]
    assert (f.status, f.pattern, f.graph_score, f.alert_ids) == ("candidate_new_incident", "credential_lateral_privilege", 1.0, ["c1", "c2", "c3", "c4"])
    assert f.score == pytest.approx(min(1.0, 0.30 + 0.25 + 0.20 + 0.15 + 0.08 + 0.10)) and f.cluster_name == "cluster_0001"


def test_status_by_truth_and_vendor_references(spark):
    a, e = chain(spark)
    known = D.discover(a, e, truth(spark, [("i1", "c2")])).first()
    assert (known.status, known.known) == ("known_incident_overlap", ["i1"])
    vendor = D.discover(a, e, None, truth(spark, [("incident_5:5", "c1")])).first()
    assert (vendor.status, vendor.refs) == ("known_incident_overlap", ["incident_5:5"])
    r = {x.incident_id: x for x in D.recovery(D.discover(a, e), a, truth(spark, [("i1", "c2"), ("i1", "gone"), ("i2", "n1")])).collect()}
    assert (r["i1"].alerts, r["i1"].available, r["i1"].hits, r["i1"].recall, r["i2"].any_hit) == (2, 1, 1, 1.0, False)
    with pytest.raises(ValueError):
        D.discover(a, e, refinements=["nonsense"])
    with pytest.raises(ValueError):
        D.discover(a, e, min_score=2)


def test_refinements_drop_weak_clusters(spark):
    rows = [("i1", 0, 9, ["discovery"], "New asset detected"), ("i2", 5, 9, ["discovery"], "New port discovery"), ("s1", 2000, 6, ["command_and_control"], "beacon"), ("s2", 2010, 6, ["command_and_control"], "beacon 2"), ("b1", 4000, 9, ["execution"], "x"), ("b2", 4010, 9, ["impact"], "y"), ("b3", 4020, 9, ["impact"], "z")]
    a = alerts(spark, rows)
    e = ents(spark, [("i1", "host:i"), ("i2", "host:i"), ("s1", "host:s"), ("s2", "host:s"), ("b1", "host:b"), ("b2", "host:b"), ("b3", "host:b")])
    got = {r.variant: r for r in D.ablation(a, e, truth(spark, [("k", "b1")])).collect()}
    assert len(got) == 10 and got["baseline"].reported == 3 and got["baseline"].candidate_new == 2 and got["baseline"].known_overlap == 1
    assert got["only_suppress_generic_ics"].candidate_new == 1 and got["only_require_progression_or_severity_density"].candidate_new == 1
    assert got["all_refinements"].candidate_new == 0 and got["all_refinements"].known_overlap == 1 and got["all_refinements"].delta_candidate_new == -2


def test_leakage_and_baselines(spark):
    a, e = chain(spark)
    t = truth(spark, [("i1", "c1"), ("i1", "c2")])
    audit = D.leakage(a, e, t).first()
    assert (audit.stable, audit.candidate_new, audit.blind_candidate_new, audit.delta) == (True, 0, 1, 1)
    rows = {r.baseline: r for r in D.baselines(a, e, t).collect()}
    assert len(rows) == 8 and [n for n, r in rows.items() if r.uses_ground_truth] == ["truth_groups"]
    assert rows["truth_groups"].recall == 1.0 and rows["gate_refined"].recall == 1.0 and rows["high_severity_only"].fp == 2


def test_baselines_gate_and_cluster_once_for_all_ways(spark, monkeypatch):
    calls = {"gate": 0, "members": 0, "facts": 0}
    for module, name in ((D.gate, "gate"), (D.components, "members"), (D, "facts")):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *x, real=real, name=name, **k: (calls.update({name: calls[name] + 1}), real(*x, **k))[1])
    a, e = chain(spark)
    t = truth(spark, [("i1", "c1"), ("i1", "c2"), ("i2", "gone"), (None, "c3")])
    rows = {r.baseline: r for r in D.baselines(a, e, t, truth(spark, [("v1", "c1"), ("v1", "gone"), (None, "c2")])).collect()}
    assert calls == {"gate": 1, "members": 1, "facts": 1} and len(rows) == 8
    assert (rows["truth_groups"].tp, rows["truth_groups"].fn, rows["truth_groups"].known_overlap) == (3, 1, 1)
    assert (rows["vendor_incidents"].tp, rows["vendor_incidents"].reported, rows["gate_baseline"].incident_recall_any) == (2, 2, pytest.approx(2 / 3))


def test_detection_and_errors(spark):
    a = alerts(spark, [("p1", 0, 9, ["execution"], "x"), ("p2", 1, 1, [], "quiet"), ("f1", 2, 9, [], "loud")])
    t = truth(spark, [("i", "p1"), ("i", "p2"), ("i", "gone")])
    d = D.detection(a, t).first()
    assert (d.tp, d.fp, d.fn, d.available, d.available_recall) == (1, 1, 2, 2, 0.5)
    err = {(r.side, r.facet, r.value): r["count"] for r in D.errors(a, t).collect()}
    assert err[("missed", "reason", "not_interesting")] == 1 and err[("false_positive", "reason", "high_severity")] == 1
    assert {r.side for r in D.conclusions(D.errors(a, t)).collect()} == {"missed", "false_positive"}


def test_investigation_confidence_and_logs(spark):
    a = alerts(spark, [("r", 0, 9, ["lateral_movement"], "x"), ("q", 1, 5, [], "y"), ("lone", 900, 1, [], "z")])
    e = ents(spark, [("r", "host:h"), ("r", "user:u"), ("q", "host:h"), ("lone", "host:a"), ("lone", "user:b")])
    logs = ents(spark, [("r", "log r"), ("q", "log q"), ("lone", "log l")])
    got = {r.root: r for r in D.investigate(a, e, a.filter("alert_id != 'q'").select("alert_id"), logs).collect()}
    assert got["r"].confidence == pytest.approx(0.80) and got["r"].logs == 2 and got["lone"].confidence == pytest.approx(0.23) and got["lone"].logs == 0
    with pytest.raises(ValueError):
        D.investigate(a, e, ents(spark, [("none", "")]).select("alert_id"))


def test_question_path_recall(spark):
    schema = "row_idx int, incident string, context string, question string, answer string, solution array<string>, start_alert int, end_alert int, shortest_alert_path array<int>"
    q = spark.createDataFrame([(0, "i", "seen `198.43.121.209` there", "which IP address?", "198.43.121.209", ["s"], 1, 3, [1, 9, 3])], schema)
    r = D.question_report(q).first()
    assert r.path_recall == pytest.approx(2 / 3) and r.end_recalled is False and r.exact and r.answer == "198.43.121.209"


def falcon_edges(spark):
    names = ["Initial Access", "Execution", "Credential Access", "Lateral Movement"]
    rows = [(f"m{i}", f"AID-{i}", f"AID-{i + 1}", "USER-1", "p", t, f"T{i}", 9 + (i == 3), T0 + dt.timedelta(minutes=10 * i)) for i, t in enumerate(names)]
    rows.append(("noise", "AID-90", "AID-91", "USER-9", "q", "Execution", "T9", 2, T0 + dt.timedelta(days=3)))
    return spark.createDataFrame(rows, "alert_id string, source_id string, target_id string, user_id string, process_name string, tactic string, technique string, severity int, ts timestamp")


def test_layered_detector_and_comparison(spark):
    e = falcon_edges(spark)
    t = truth(spark, [("INC-1", f"m{i}") for i in range(4)])
    found = D.layered(e).collect()
    assert [sorted(f.alert_ids) for f in found] == [["m0", "m1", "m2", "m3"]] and found[0]["name"] == "incident-0001"
    rows = {r.detector: r for r in D.compare_detectors(e, t).collect()}
    assert len(rows) == 8 and (rows["layered"].tp, rows["layered"].fn, rows["layered"].incident_recall_any) == (4, 0, 1.0)
    assert rows["local_severity"].tp == 4 and sum(r.status == "not_run" for r in rows.values()) == 3
    assert D.feature_audit(e) == [] and D.feature_audit(e.withColumn("is_incident", F.lit(1))) == ["is_incident"]


def test_detectors_with_and_without_rarity_share_their_candidates(spark, monkeypatch):
    made, real = [], D.joins.pattern_links
    monkeypatch.setattr(D.joins, "pattern_links", lambda *a, **k: made.append(1) or real(*a, **k))
    e = falcon_edges(spark)
    rows = {r.detector: r for r in D.compare_detectors(e, truth(spark, [("INC-1", f"m{i}") for i in range(4)])).collect()}
    assert made == [1]
    alone = D.layered(e, True).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("alert_ids")).alias("k")).first()
    assert rows["layered_rare"].tp + rows["layered_rare"].fp == alone.k


def test_compared_detectors_hold_no_incident_in_one_row(spark, monkeypatch):
    written, real = [], D.materialize
    monkeypatch.setattr(D, "materialize", lambda df, name: written.append((name, df.dtypes)) or real(df, name))
    D.compare_detectors(falcon_edges(spark), truth(spark, [("INC-1", f"m{i}") for i in range(4)])).collect()
    assert {"layered", "orders"} <= {n for n, _ in written}
    assert [n for n, types in written if any(t.startswith("array") for _, t in types)] == []


NESTED = [("a1", 0, "host-a"), ("a2", 1, "host-a"), ("a3", 23, "host-b"), ("a4", 24, "host-c"), ("a5", 48, "host-a"), ("a6", 49, "host-d"), ("a7", 71, "host-e"), ("a8", 72, "host-f")]


def learned(spark):
    rows = [(i, T0 + dt.timedelta(hours=h), "Execution", "T1", host, [1.0, float(k % 2)], 0.9, 1) for k, (i, h, host) in enumerate(NESTED)]
    df = spark.createDataFrame(rows, "alert_id string, ts timestamp, tactic string, technique string, host string, embedding array<float>, probability double, prediction int")
    return df, df.select("alert_id", F.concat(F.lit("host:"), "host").alias("entity"))


def test_strategies_of_one_base_share_its_groups(spark, monkeypatch):
    df, ents = learned(spark)
    some = [s for s in C.grid() if s.name in ("dbscan_current", "dbscan_split_time_6h", "dbscan_split_tactic", "temporal_only_4h", "temporal_only_6h")]
    alone = {s.name: C.run(df, ents, s).agg(F.countDistinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("k"), F.count_if(F.col("cluster") < 0).alias("n")).first() for s in some}
    made, real = [], C.base_groups
    monkeypatch.setattr(C, "base_groups", lambda rows, entities, s: made.append(s.base) or real(rows, entities, s))
    got = {r.strategy: (r.clusters, r.noise) for r in C.compare(df, ents, truth(spark, [("I", i) for i, _, _ in NESTED]), some).collect()}
    assert sorted(made) == ["dbscan", "temporal"] and got == {n: (r.k, r.n) for n, r in alone.items()}
    assert len({C.base_key(s) for s in C.grid()}) == 13



def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.cluster, set()).add(r.alert_id)
    return {k: tuple(sorted(v)) for k, v in out.items()}


def test_strategy_grid_and_splits(spark):
    grid = {s.name: s for s in C.grid()}
    assert len(grid) == 34
    rows, e = learned(spark)
    want = {0: ("a1", "a2"), 1: ("a3", "a4"), 2: ("a5", "a6"), 3: ("a7", "a8")}
    assert groups(C.run(rows, e, grid["temporal_only_12h"])) == want
    assert groups(C.run(rows, e, grid["graph_entity_6h"])) == {0: ("a1", "a2"), -1: ("a3", "a4", "a5", "a6", "a7", "a8")}
    assert sum(map(len, groups(C.run(rows, e, grid["bayesian_blocks_p4"])).values())) == 8
    assert groups(C.run(rows, e, grid["dbscan_split_tactic_entity_time_24h"])) == {0: ("a1", "a2"), -1: ("a3", "a4", "a5", "a6", "a7", "a8")}
    cos = groups(C.run(rows, e, grid["graph_entity_semantic_cos_24h"]))
    assert sum(map(len, cos.values())) == 8
    assert C.select(rows, 0.95, "or").count() == 8 and C.select(rows, 0.95).count() == 0
    with pytest.raises(ValueError):
        C.select(rows, 0.5, "none")


def test_rule_clusters_and_triage(spark):
    rows, e = learned(spark)
    assert groups(C.rule_clusters(rows, e, 120))[0] == ("a1", "a2") and set(groups(C.rule_clusters(rows, e, 30))) == {-1}
    sev = rows.select("alert_id", F.col("probability").alias("severity"))
    assert C.median_triage(sev).count() == 8


def test_comparison_and_holdout(spark):
    rows, e = learned(spark)
    t = truth(spark, [("i", "a1"), ("i", "a2"), ("j", "a5"), ("j", "a6")])
    grid = {s.name: s for s in C.grid()}
    out = C.compare(rows, e, t, [grid["temporal_only_12h"], grid["graph_entity_6h"]]).collect()
    assert out[0].strategy == "graph_entity_6h" and out[0].f1 == 1.0 and out[1].f1 == 0.5
    h = D.holdout(rows, t, lambda part: C.run(part, e, grid["temporal_only_12h"]).filter("cluster >= 0"), 2).collect()
    assert [r.fold for r in h] == [0, 1] and all(r.f1 == 0.5 for r in h)


def rows_of(rows):
    return sorted([tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in rows], key=str)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder with a few events of all severities, and the same in DuckDB."""
    folder = str(tmp_path_factory.mktemp("small"))
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("event_id").limit(150).write.parquet(f"{folder}/events.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE TABLE events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')")
    return folder, db


@pytest.mark.parametrize("name", ["severity_sessions", "entity_time_components", "cluster_numbers", "communities", "pattern_components", "semantic_edges", "stage_sequence", "chain_lcs", "attack_edges", "cluster_scores", "structural_scores", "cluster_best_match", "coherence_span", "cluster_examples", "incident_narratives", "maximal_clusters", "homogeneous_projection", "alert_summaries", "rule_clusters"])
def test_queries_on_a_small_table_equal_sql(spark, small, name):
    folder, db = small
    out, found = QUERIES[name](spark, folder), db.execute(Q.PROJECTION_SQL if name == "homogeneous_projection" else ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(out.columns) == sorted(columns)
    assert rows_of(out.select(*columns).collect()) == rows_of(found.fetchall())


def test_composite_queries_take_all_alerts(spark, small):
    folder, db = small
    every, n = CQ.canonical(spark, folder)[0], db.execute("SELECT count(*) FROM events").fetchone()[0]
    assert every.count() == n == CQ.edges(spark, folder).count()
    # every tactic of the view is one of the gate's attack kinds
    tp, fp, fn, available = QUERIES["gate_detection"](spark, folder).first()
    true = db.execute(f"WITH {SQL} SELECT count(DISTINCT alert_id) FROM truth").fetchone()[0]
    assert (tp, fp, fn, available) == (true, n - true, 0, true)
    assert CQ.discover_incidents(spark, folder).agg(F.sum("n")).first()[0] > CQ.gate_detection(spark, folder, severity=6).first().tp


def test_strategies_and_negatives_take_all_alerts_and_settings(spark, small, monkeypatch):
    folder, db = small
    n = db.execute("SELECT count(*) FROM events").fetchone()[0]
    taken = {}
    monkeypatch.setattr(C, "compare", lambda rows, entities, truth, strategies, **_: taken.update(rows=rows.count(), names=[s.name for s in strategies]))
    CQ.clustering_grid(spark, folder)
    assert taken == {"rows": n, "names": [s.name for s in C.grid()]} and len(taken["names"]) == 34
    monkeypatch.setattr(D, "holdout", lambda rows, *_: taken.update(holdout=rows.count()))
    CQ.holdout_folds(spark, folder)
    assert taken["holdout"] == n
    monkeypatch.setattr(TQ.joins, "weak_negatives", lambda labelled, entities, seed: taken.update(negatives=labelled.count()))
    TQ.random_negatives(spark, folder)
    assert taken["negatives"] == n
