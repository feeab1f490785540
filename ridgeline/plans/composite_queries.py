"""Composite queries over the alert view: discovery, its ablation and baselines, detectors, strategies, folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgeline.functions import constants as K
from ridgeline.functions import scalars as S
from ridgeline.operators import gate
from ridgeline.operators.tables import materialize
from ridgeline.plans import alert_queries as Q
from ridgeline.plans import discover as D
from ridgeline.plans import strategies as C
from ridgeline.plans.alerts import SQL, alerts, truth
from ridgeline.plans.registry import query


def canonical(spark, sf_dir, severity=None):
    """(alerts, entities, truth) of the view, or of its alerts from a severity on, in the form that the composite plans take."""
    rows = Q.severe(spark, sf_dir, severity)
    kind = S.lookup(K.TACTIC_KINDS, F.lower("tactic"))
    key = gate.relationship_key(F.col("user"), F.col("host"), F.col("tactic"), F.lit("observed"))
    a = rows.select("alert_id", "ts", "severity", kind.alias("kind"), F.array_compact(F.array(kind)).alias("tags"), F.col("tactic").alias("name"), key.alias("rel_key"), F.lit(True).alias("attack"), F.struct("ts", "alert_id").alias("seq"))
    return a, Q.entities(rows).select("alert_id", "entity"), truth(alerts(spark, sf_dir))


#: The gate stores every alert of the view (all are attack kinds, and no key comes 10,000 times), so the clusters are those of all alerts.
SEEN_SQL = "sn AS (SELECT alert_id, row_number() OVER (PARTITION BY usr, host, tactic ORDER BY ts, alert_id) - 1 AS seen FROM alerts)"
FOUND_SQL = f"""{Q.DISC_SQL.replace(Q.SEEN_SQL, SEEN_SQL)}, {Q.PATTERN_SQL},
nm AS (SELECT cluster, 'cluster_' || lpad(CAST(row_number() OVER (ORDER BY min((ts, m.alert_id))) AS VARCHAR), 4, '0') AS cluster_name FROM m JOIN alerts USING (alert_id) GROUP BY cluster),
kn AS (SELECT DISTINCT cluster FROM m JOIN truth USING (alert_id)),
al AS (SELECT fc.cluster, cluster_name, CASE WHEN kn.cluster IS NULL THEN 'candidate_new_incident' ELSE 'known_incident_overlap' END AS status, n, mx, high, k, coalesce(most, 0) AS most, {Q.SCORE_SQL} AS score, pattern, graph_score
  FROM fc JOIN gm ON fc.cluster = gm.cluster JOIN nm ON fc.cluster = nm.cluster LEFT JOIN sh ON fc.cluster = sh.cluster LEFT JOIN kn ON fc.cluster = kn.cluster),
found AS (SELECT * FROM al WHERE score >= 0.55)"""
FOUND_IDS_SQL = "ids AS (SELECT cluster, string_agg(CAST(alert_id AS VARCHAR), ',' ORDER BY ts, alert_id) AS alert_ids FROM c GROUP BY 1)"


@query(f"""{FOUND_SQL}, {FOUND_IDS_SQL} SELECT cluster_name, status, n, CAST(mx AS INTEGER) AS max_severity, round(score, 6) AS score, pattern, round(graph_score, 6) AS graph_score, alert_ids FROM found JOIN ids USING (cluster)""")
def discover_incidents(spark, sf_dir):
    a, e, t = canonical(spark, sf_dir)
    d = D.discover(a, e, t)
    return d.select("cluster_name", "status", "n", "max_severity", F.round("score", 6).alias("score"), "pattern", F.round("graph_score", 6).alias("graph_score"), F.concat_ws(",", F.transform("alert_ids", lambda x: x.cast("string"))).alias("alert_ids"))


def _variant_sql() -> str:
    """Which clusters each variant reports: the view names no generic phrase and has no C2 stage, so two refinements leave all."""
    tests = {
        "strict_entity_continuity": "(CASE WHEN n <= 3 THEN most >= 2 WHEN n <= 10 THEN most >= 3 ELSE most >= 3 AND most / n >= 0.20 END)",
        "require_progression_or_severity_density": "(k >= 2 OR CASE WHEN n <= 3 THEN high >= 1 ELSE high / n >= 0.25 END)",
    }
    return " UNION ALL ".join(f"SELECT '{v}' AS variant, status, n FROM found WHERE {' AND '.join([tests[r] for r in sorted(chosen) if r in tests]) or 'true'}" for v, chosen in D.variants().items())


@query(f"""{FOUND_SQL}, vs AS ({_variant_sql()}), every AS (SELECT unnest([{', '.join(f"'{v}'" for v in D.variants())}]) AS variant),
ct AS (SELECT e.variant, count(status) AS reported, count(*) FILTER (WHERE status = 'candidate_new_incident') AS candidate_new, count(*) FILTER (WHERE status = 'known_incident_overlap') AS known_overlap,
  CAST(coalesce(sum(n) FILTER (WHERE status = 'candidate_new_incident'), 0) AS BIGINT) AS candidate_new_alerts FROM every e LEFT JOIN vs ON e.variant = vs.variant GROUP BY 1)
SELECT ct.*, ct.reported - b.reported AS delta_reported, ct.candidate_new - b.candidate_new AS delta_candidate_new, ct.known_overlap - b.known_overlap AS delta_known_overlap FROM ct CROSS JOIN (SELECT * FROM ct WHERE variant = 'baseline') b""")
def discovery_ablation(spark, sf_dir):
    return D.ablation(*canonical(spark, sf_dir))


@query()
def discovery_baselines(spark, sf_dir):
    return D.baselines(*canonical(spark, sf_dir))


@query(f"""{FOUND_SQL} SELECT true AS stable, count(*) FILTER (WHERE status = 'candidate_new_incident') AS candidate_new, count(*) AS blind_candidate_new,
  count(*) FILTER (WHERE status <> 'candidate_new_incident') AS delta FROM found""")
def discovery_leakage(spark, sf_dir):
    return D.leakage(*canonical(spark, sf_dir))


@query(f"""WITH {SQL}, {SEEN_SQL}, d AS (SELECT a.*, CASE WHEN severity >= 8 THEN 'high_severity' WHEN seen > 10000 THEN 'baseline_too_common' ELSE 'attack_topology' END AS reason,
  CASE tactic WHEN 'Initial Access' THEN 'initial_access' WHEN 'Execution' THEN 'execution' WHEN 'Credential Access' THEN 'credential_access' WHEN 'Lateral Movement' THEN 'lateral_movement' WHEN 'Exfiltration' THEN 'data_exfiltration' END AS kind,
  alert_id IN (SELECT alert_id FROM truth) AS t FROM alerts a JOIN sn USING (alert_id)),
w AS (SELECT *, CASE WHEN reason <> 'baseline_too_common' AND NOT t THEN 'false_positive' WHEN reason = 'baseline_too_common' AND t THEN 'missed' END AS side FROM d)
SELECT side, f.facet AS facet, f.value AS value, count(*) AS count FROM (SELECT side, unnest([{{'facet': 'reason', 'value': reason}}, {{'facet': 'kind', 'value': kind}}, {{'facet': 'severity', 'value': CAST(severity AS VARCHAR)}}, {{'facet': 'tag', 'value': kind}}]) AS f FROM w WHERE side IS NOT NULL) GROUP BY ALL""")
def gate_errors(spark, sf_dir):
    a, _, t = canonical(spark, sf_dir)
    return D.errors(a, t)


@query(f"""WITH {SQL}, a AS (SELECT alert_id FROM alerts), t AS (SELECT DISTINCT alert_id FROM truth)
SELECT (SELECT count(*) FROM a JOIN t USING (alert_id)) AS tp, (SELECT count(*) FROM a) - (SELECT count(*) FROM a JOIN t USING (alert_id)) AS fp, (SELECT count(*) FROM t) - (SELECT count(*) FROM a JOIN t USING (alert_id)) AS fn, (SELECT count(*) FROM a JOIN t USING (alert_id)) AS available""")
def gate_detection(spark, sf_dir, severity=None):
    """Every alert of the view is an attack kind, so the gate takes all of them; from a severity on, the truth counts those under it as missed."""
    a, _, t = canonical(spark, sf_dir, severity)
    return D.detection(a, t).select("tp", "fp", "fn", "available")




def edges(spark, sf_dir):
    rows = alerts(spark, sf_dir)
    return rows.select("alert_id", F.col("host").alias("source_id"), F.col("target").alias("target_id"), F.col("user").alias("user_id"), F.lit("").alias("process_name"), "tactic", "technique", "severity", "ts")


def _components_sql(name: str, nodes: str, links: str) -> str:
    """(alert_id, cluster) of the links' components, as table ``name``."""
    return Q.CC_SQL.format(nodes=nodes).replace("m(alert_id", f"{name}(alert_id").replace("JOIN l ON l.", f"JOIN {links} l ON l.").replace("FROM m JOIN", f"FROM {name} m JOIN").replace("recurring.m", f"recurring.{name}")


#: Candidates: severity-weighted communities (mc), pattern components (mp), rare components (mr), and severe components (ms).
CANDIDATE_SQL = f"""WITH RECURSIVE {SQL}, {Q.ENTITY_SQL}, {Q.PAIR_SQL},
rk AS (SELECT alert_id, row_number() OVER (PARTITION BY lower(host || '|' || target || '|' || tactic || '|' || technique) ORDER BY ts, alert_id) <= 4 AS rare FROM alerts),
lc AS (SELECT x.alert_id AS a, y.alert_id AS b FROM entity x JOIN entity y ON x.entity = y.entity AND x.alert_id <> y.alert_id
  AND abs(epoch_us(x.ts) - epoch_us(y.ts)) / 1e6 <= 7200 AND greatest(x.severity, y.severity) / ln(abs(epoch_us(x.ts) - epoch_us(y.ts)) / 1e6 + 2) >= 0.70),
{_components_sql("mc", "alerts", "lc")},
lp AS (SELECT earlier AS a, later AS b FROM pm UNION SELECT later, earlier FROM pm),
{_components_sql("mp", "(SELECT a AS alert_id FROM lp)", "lp")},
nr AS (SELECT alert_id AS b, lag(alert_id) OVER w AS a, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap FROM entity WHERE alert_id IN (SELECT alert_id FROM rk WHERE rare) WINDOW w AS (PARTITION BY entity ORDER BY ts, alert_id)),
lr AS (SELECT a, b FROM nr WHERE gap <= 10800000000 UNION SELECT b, a FROM nr WHERE gap <= 10800000000),
{_components_sql("mr", "(SELECT alert_id FROM rk WHERE rare)", "lr")},
ns AS (SELECT alert_id AS b, lag(alert_id) OVER w AS a, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap FROM entity WHERE severity >= 8 WINDOW w AS (PARTITION BY entity ORDER BY ts, alert_id)),
ls AS (SELECT a, b FROM ns WHERE gap <= 7200000000 UNION SELECT b, a FROM ns WHERE gap <= 7200000000),
{_components_sql("ms", "(SELECT alert_id FROM alerts WHERE severity >= 8)", "ls")},
hc AS (SELECT cluster, count(DISTINCT alert_id) AS n, count(DISTINCT h) AS hosts FROM (SELECT cluster, alert_id, unnest([host, target]) AS h FROM mc JOIN alerts USING (alert_id)) GROUP BY 1 HAVING count(DISTINCT alert_id) >= 4 AND count(DISTINCT h) > 1),
sc AS (SELECT 'c:' || cluster AS cluster, alert_id FROM mc WHERE cluster IN (SELECT cluster FROM hc)), sp AS (SELECT 'p:' || cluster AS cluster, alert_id FROM mp),
sr AS (SELECT 'r:' || cluster AS cluster, alert_id FROM mr WHERE cluster IN (SELECT cluster FROM mr GROUP BY 1 HAVING count(*) >= 4))"""


def layered_sql(x: str, rare: bool) -> str:
    """Table found_x of the layered detector's incidents, and in_x of their alerts."""
    share = "rare / n" if rare else "0"
    weights = (0.22, 0.18, 0.14, 0.10, 0.10, 0.09, 0.10) if rare else (0.25, 0.20, 0.15, 0.10, 0.10, 0.10, 0.10)
    terms = ("mx / 10", "high / n", "least(n / 8, 1)", "least(hosts / 3, 1)", "least(tactics / 4, 1)", "(1 - least(greatest(dur, 1), 21600) / 21600)", "least(coalesce(matches, 0) / 2, 1)")
    structural = " + ".join(f"{w} * {t}" for w, t in zip(weights, terms, strict=True))
    return f"""every_{x} AS (SELECT * FROM sc UNION ALL SELECT * FROM sp{' UNION ALL SELECT * FROM sr' if rare else ''}),
size_{x} AS (SELECT cluster, count(*) AS n FROM every_{x} GROUP BY 1),
over_{x} AS (SELECT p.cluster AS a, q.cluster AS b, count(*) AS joint FROM every_{x} p JOIN every_{x} q ON p.alert_id = q.alert_id AND p.cluster <> q.cluster GROUP BY 1, 2),
in_{x} AS (SELECT cluster, a.* FROM every_{x} JOIN alerts a USING (alert_id) WHERE cluster NOT IN (SELECT o.a FROM over_{x} o JOIN size_{x} p ON o.a = p.cluster JOIN size_{x} q ON o.b = q.cluster WHERE joint = p.n AND (p.n < q.n OR o.a > o.b))),
facts_{x} AS (SELECT cluster, count(*) AS n, max(severity) AS mx, count(*) FILTER (WHERE severity >= 8) AS high, count(DISTINCT tactic) AS tactics, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS dur,
  count(*) FILTER (WHERE rare) AS rare, 'incident-' || lpad(CAST(row_number() OVER (ORDER BY min((ts, alert_id)), cluster) AS VARCHAR), 4, '0') AS name, string_agg(CAST(alert_id AS VARCHAR), ',' ORDER BY alert_id) AS alert_ids FROM in_{x} JOIN rk USING (alert_id) GROUP BY cluster),
hosts_{x} AS (SELECT cluster, count(DISTINCT h) AS hosts FROM (SELECT cluster, unnest([host, target]) AS h FROM in_{x}) GROUP BY 1),
match_{x} AS (SELECT cluster, count(DISTINCT (pattern, earlier, later)) AS matches, count(DISTINCT pattern) AS patterns FROM (SELECT cluster, pattern, earlier, later FROM in_{x} i JOIN pm ON i.alert_id = pm.earlier UNION ALL SELECT cluster, pattern, earlier, later FROM in_{x} i JOIN pm ON i.alert_id = pm.later) GROUP BY 1),
step_{x} AS (SELECT cluster, ts, alert_id, tactic, lag(tactic) OVER (PARTITION BY cluster ORDER BY ts, alert_id) AS before FROM in_{x}),
word_{x} AS (SELECT cluster, string_agg({Q.TACTIC_LETTER}, '' ORDER BY ts, alert_id) AS w FROM step_{x} WHERE before IS NULL OR before <> tactic GROUP BY 1),
score_{x} AS (SELECT f.*, coalesce(patterns, 0) AS patterns, {Q.best_chain_sql('w')} AS o, round(least(1, {structural}{' + 0.07 * rare / n' if rare else ''}), 6) AS structural
  FROM facts_{x} f JOIN hosts_{x} h ON f.cluster = h.cluster JOIN word_{x} w ON f.cluster = w.cluster LEFT JOIN match_{x} t ON f.cluster = t.cluster),
found_{x} AS (SELECT *, least(1, structural * 0.26 + least(n / 10, 1) * 0.16 + least(tactics / 6, 1) * 0.16 + least(patterns / 4, 1) * 0.16 + o * 0.16 + high / n * 0.05 + {share} * 0.05) AS evidence FROM score_{x} WHERE structural >= 0.55)"""


@query(f"""{CANDIDATE_SQL}, {layered_sql("r", True)} SELECT name, n, structural, round(evidence, 6) AS evidence, evidence >= 0.68 AS selected, alert_ids FROM found_r""")
def layered_incidents(spark, sf_dir):
    d = D.layered(edges(spark, sf_dir), True)
    return d.select("name", "n", "structural", F.round("evidence", 6).alias("evidence"), "selected", F.concat_ws(",", F.transform("alert_ids", lambda x: x.cast("string"))).alias("alert_ids"))


def _detector_sql(name: str, ids: str) -> str:
    return f"""SELECT '{name}' AS detector, 'ok' AS status, tp, sel - tp AS fp, tru - tp AS fn, coalesce(tp / nullif(sel, 0), 0) AS precision, coalesce(tp / nullif(tru, 0), 0) AS recall, coalesce(2 * tp / nullif(sel + tru, 0), 0) AS f1, any_hit AS incident_recall_any, all_hit AS incident_recall_all
FROM (SELECT count(*) FILTER (WHERE s AND t) AS tp, count(*) FILTER (WHERE s) AS sel, count(*) FILTER (WHERE t) AS tru FROM (SELECT alert_id IN ({ids}) AS s, alert_id IN (SELECT alert_id FROM truth) AS t FROM alerts)),
(SELECT avg(CAST(hits > 0 AS INT)) AS any_hit, avg(CAST(hits = n AS INT)) AS all_hit FROM (SELECT incident_id, count(*) AS n, count(*) FILTER (WHERE alert_id IN ({ids})) AS hits FROM truth GROUP BY 1))"""


def _comparison_sql() -> str:
    ids = lambda x, where="": f"SELECT alert_id FROM in_{x} WHERE cluster IN (SELECT cluster FROM found_{x}{where})"
    chosen = " WHERE evidence >= 0.68"
    rows = [_detector_sql("layered", ids("p")), _detector_sql("layered_rare", ids("r")), _detector_sql("layered_verdict", ids("p", chosen)), _detector_sql("layered_rare_verdict", ids("r", chosen))]
    rows.append(_detector_sql("local_severity", "SELECT alert_id FROM ms WHERE cluster IN (SELECT cluster FROM ms GROUP BY 1 HAVING count(*) >= 2)"))
    rows += [f"SELECT '{h}', 'not_run', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL" for h in D.HOSTED]
    rounded = ", ".join(f"round({m}, 6) AS {m}" for m in _SHARES)
    return f"{CANDIDATE_SQL}, {layered_sql('p', False)}, {layered_sql('r', True)} SELECT detector, status, tp, fp, fn, {rounded} FROM ({' UNION ALL '.join(rows)})"


_SHARES = ("precision", "recall", "f1", "incident_recall_any", "incident_recall_all")


@query(_comparison_sql())
def detector_comparison(spark, sf_dir):
    d = D.compare_detectors(edges(spark, sf_dir), truth(alerts(spark, sf_dir)))
    return d.select("detector", "status", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in _SHARES])


def learned(spark, sf_dir):
    """All alerts with a small embedding and a probability made from their own columns; strategies select by probability (FLT-10)."""
    rows = alerts(spark, sf_dir)
    tactics = [F.when(F.col("tactic") == t, 1.0).otherwise(0.0) for t in sorted({"Initial Access", "Execution", "Credential Access", "Lateral Movement", "Exfiltration"})]
    vector = F.array(*[x.cast("float") for x in tactics], (F.col("severity") / 10).cast("float"))
    out = rows.withColumn("embedding", vector).withColumn("probability", F.col("severity") / 10).withColumn("prediction", F.lit(1))
    return materialize(out, "learned")


@query()
def clustering_grid(spark, sf_dir):
    rows = learned(spark, sf_dir)
    return C.compare(rows, Q.entities(rows).select("alert_id", "entity"), truth(alerts(spark, sf_dir)), C.grid())


@query()
def holdout_folds(spark, sf_dir):
    rows = learned(spark, sf_dir)
    ents = Q.entities(rows).select("alert_id", "entity")
    s = next(s for s in C.grid() if s.name == "temporal_only_4h")
    return D.holdout(rows, truth(alerts(spark, sf_dir)), lambda part: C.run(part, ents, s).filter("cluster >= 0"))


@query(f"""WITH RECURSIVE {SQL}, e AS (SELECT DISTINCT alert_id, ts, unnest(['u:' || usr, 'h:' || host, 'h:' || target]) AS x FROM alerts),
nb AS (SELECT alert_id AS b, lag(alert_id) OVER w AS a, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap FROM e WINDOW w AS (PARTITION BY x ORDER BY ts, alert_id)),
l AS (SELECT a, b FROM nb WHERE gap <= 7200000000 UNION SELECT b, a FROM nb WHERE gap <= 7200000000),
{Q.REACH_SQL},
g AS (SELECT cluster AS c, count(*) AS n, row_number() OVER (ORDER BY cluster) - 1 AS k FROM m GROUP BY cluster) SELECT CAST(CASE WHEN n < 2 THEN -1 ELSE k END AS INTEGER) AS cluster, alert_id FROM m JOIN g ON m.cluster = g.c""")
def rule_clusters(spark, sf_dir, severity=None):
    rows = Q.severe(spark, sf_dir, severity)
    return C.rule_clusters(rows, Q.entities(rows).select("alert_id", "entity"))
