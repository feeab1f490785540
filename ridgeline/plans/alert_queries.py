"""Queries over the alert view: gate, rarity, sessions, components, pairs, neighbours."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.functions import constants as K
from ridgeline.functions import scalars as S
from ridgeline.operators import components, evaluate, features, gate, joins, scoring, sequence, sessions
from ridgeline.operators.ranking import number_rows
from ridgeline.operators.tables import materialize
from ridgeline.plans import discover as D
from ridgeline.plans.alerts import ENTITY_SQL, SQL, alerts, truth
from ridgeline.plans.registry import query

A = f"WITH {SQL}"
AR = f"WITH RECURSIVE {SQL}"
AE, ARE = f"{A}, {ENTITY_SQL}", f"{AR}, {ENTITY_SQL}"
ENTITY_COLUMNS = {"user": "user", "host": "host", "target": "host"}


def entities(rows: DataFrame, *keep: str) -> DataFrame:
    """(alert_id, keep..., etype, entity) of user, source host and target host."""
    return joins.explode_entities(rows, ENTITY_COLUMNS, keep=keep).withColumn("etype", F.split_part("entity", F.lit(":"), F.lit(1)))


def severe(spark: SparkSession, sf_dir: str, severity: int | None = None) -> DataFrame:
    """Alerts from a severity on, or all, which every query takes."""
    rows = alerts(spark, sf_dir)
    return rows if severity is None else rows.filter(F.col("severity") >= severity)


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alerts(spark, sf_dir).withColumn("rel_key", gate.relationship_key(F.col("user"), F.col("host"), F.col("tactic"), F.lit("observed")))
    attack = F.col("tactic").isin("Lateral Movement", "Exfiltration") & (F.col("severity") >= 3)
    return gate.gate(rows, "rel_key", ["ts", "alert_id"], attack)


GATE_SQL = """g0 AS (SELECT *, row_number() OVER (PARTITION BY usr, host, tactic ORDER BY ts, alert_id) - 1 AS seen FROM alerts),
g AS (SELECT alert_id, usr, severity, tactic, ts, CAST(seen AS BIGINT) AS seen, CASE WHEN severity >= 8 THEN 'high_severity' WHEN seen > 10000 THEN 'baseline_too_common'
  WHEN tactic IN ('Lateral Movement', 'Exfiltration') AND severity >= 3 THEN 'attack_topology' WHEN seen <= 3 AND severity >= 5 THEN 'rare_relationship' ELSE 'not_interesting' END AS reason FROM g0)"""


@query(f"{A}, {GATE_SQL} SELECT alert_id, seen, reason, reason IN ('high_severity', 'attack_topology', 'rare_relationship') AS store FROM g")
def gate_decisions(spark, sf_dir):
    return gated(spark, sf_dir).select("alert_id", "seen", "reason", "store")


@query(f"{A}, {GATE_SQL} SELECT reason, count(*) AS count FROM g GROUP BY reason")
def gate_reason_counts(spark, sf_dir):
    return evaluate.histogram(gated(spark, sf_dir), "reason")


@query(f"""{A}, {GATE_SQL} SELECT count(*) AS processed, count(*) FILTER (WHERE reason IN ('high_severity', 'attack_topology', 'rare_relationship')) AS stored,
  round(count(*) FILTER (WHERE reason IN ('high_severity', 'attack_topology', 'rare_relationship')) / count(*), 6) AS stored_ratio FROM g""")
def gate_stats(spark, sf_dir):
    return gate.processing_stats(gated(spark, sf_dir)).select("processed", "stored", F.round("stored_ratio", 6).alias("stored_ratio"))


BASE_SQL = "b AS (SELECT usr, host, tactic, 9998 AS seeded FROM alerts GROUP BY 1, 2, 3 HAVING count(*) >= 15)"


@query(f"""{A}, {BASE_SQL}, g0 AS (SELECT a.*, row_number() OVER (PARTITION BY a.usr, a.host, a.tactic ORDER BY ts, alert_id) - 1 + coalesce(seeded, 0) AS seen
  FROM alerts a LEFT JOIN b ON a.usr = b.usr AND a.host = b.host AND a.tactic = b.tactic)
SELECT alert_id, CAST(seen AS BIGINT) AS seen, CASE WHEN severity >= 8 THEN 'high_severity' WHEN seen > 10000 THEN 'baseline_too_common' WHEN seen <= 3 AND severity >= 5 THEN 'rare_relationship' ELSE 'not_interesting' END AS reason FROM g0""")
def gate_with_baseline(spark, sf_dir):
    rows = alerts(spark, sf_dir).withColumn("rel_key", gate.relationship_key(F.col("user"), F.col("host"), F.col("tactic"), F.lit("observed")))
    base = rows.groupBy("rel_key").count().filter("count >= 15").select("rel_key", F.lit(9998).cast("long").alias("seeded"))
    return gate.gate(rows, "rel_key", ["ts", "alert_id"], F.lit(False), base).select("alert_id", "seen", "reason")


TWICE_SQL = "d AS (SELECT usr, ts, alert_id, seen, reason, reason IN ('high_severity', 'attack_topology', 'rare_relationship') AS store FROM g)"


@query(f"""{A}, {GATE_SQL}, {TWICE_SQL} SELECT usr AS user, arg_min(store, (NOT store, ts, alert_id)) AS store, arg_min(reason, (NOT store, ts, alert_id)) AS reason,
  arg_min(seen, (NOT store, ts, alert_id)) AS seen FROM d GROUP BY usr""")
def gate_first_or_stored(spark, sf_dir):
    return gate.first_or_stored(gated(spark, sf_dir), ["ts", "alert_id"], "user")


@query(f"""{A}, {GATE_SQL}, {TWICE_SQL} SELECT usr AS user, arg_max(store, (ts, alert_id)) AS store, arg_max(reason, (ts, alert_id)) AS reason, arg_max(seen, (ts, alert_id)) AS seen FROM d GROUP BY usr""")
def gate_last_decision(spark, sf_dir):
    return gate.last_decision(gated(spark, sf_dir), ["ts", "alert_id"], "user")


@query(f"""{A} SELECT alert_id, CAST(row_number() OVER (PARTITION BY host, tactic ORDER BY ts, alert_id) - 1 AS BIGINT) AS seen,
  row_number() OVER (PARTITION BY host, tactic ORDER BY ts, alert_id) <= 4 AS rare FROM alerts""")
def relationship_rarity(spark, sf_dir):
    seen = gate.seen_before(["host", "tactic"], ["ts", "alert_id"])
    return alerts(spark, sf_dir).select("alert_id", seen.alias("seen")).withColumn("rare", F.col("seen") <= 3)


@query(f"""{A} SELECT alert_id, lower(host || '|' || target || '|' || tactic || '|' || technique) AS rel_key FROM alerts""")
def relationship_keys(spark, sf_dir):
    c = F.col
    return alerts(spark, sf_dir).select("alert_id", gate.edge_key(c("host"), c("target"), c("tactic"), c("technique"), c("tactic")).alias("rel_key"))


@query(f"""{A}, s AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 7200000000 THEN 1 ELSE 0 END AS cut FROM alerts WINDOW w AS (PARTITION BY usr ORDER BY ts, alert_id))
SELECT alert_id, usr AS user, CAST(sum(cut) OVER (PARTITION BY usr ORDER BY ts, alert_id) AS BIGINT) AS session FROM s""")
def entity_sessions(spark, sf_dir):
    return sessions.session_numbers(alerts(spark, sf_dir), ["user"], "ts", "alert_id", 7200).select("alert_id", "user", "session")


CC_SQL = """m(alert_id, cluster) USING KEY (alert_id) AS (SELECT DISTINCT alert_id, alert_id FROM {nodes} UNION
  SELECT l.b, min(m.cluster) FROM m JOIN l ON l.a = m.alert_id JOIN recurring.m AS known ON known.alert_id = l.b WHERE m.cluster < known.cluster GROUP BY l.b)"""
#: The least alert that each row of ``alerts`` reaches by the links l (a, b), kept by key while it shrinks.
REACH_SQL = CC_SQL.format(nodes="alerts")


@query(f"""{AR}, l AS (SELECT a.alert_id AS a, b.alert_id AS b FROM alerts a JOIN alerts b ON a.host = b.host AND a.alert_id <> b.alert_id
  AND abs(epoch_us(a.ts) - epoch_us(b.ts)) / 1e6 <= 7200 AND greatest(a.severity, b.severity) / ln(abs(epoch_us(a.ts) - epoch_us(b.ts)) / 1e6 + 2) >= 0.70),
{REACH_SQL}
SELECT alert_id, cluster FROM m""")
def severity_sessions(spark, sf_dir, severity=None):
    rows = sessions.severity_sessions(severe(spark, sf_dir, severity), ["host"], "ts", "alert_id", "severity")
    first = F.min("alert_id").over(Window.partitionBy("host", "session"))
    return rows.select("alert_id", first.alias("cluster"))


def entity_components(rows: DataFrame, gap_s: float = 7200) -> DataFrame:
    """(cluster, alert_id): components of alerts linked by an entity within the gap (CLU-01, 02)."""
    links = sessions.gap_stars(entities(rows, "ts"), ["entity"], "ts", "alert_id", gap_s)
    return components.members(rows, links)


#: Alerts of an entity within the gap have the components of neighbours in time within it; a test holds that against all pairs.
LINK_SQL = f"""nb AS (SELECT alert_id AS b, lag(alert_id) OVER w AS a, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap FROM entity WINDOW w AS (PARTITION BY entity ORDER BY ts, alert_id)),
l AS (SELECT a, b FROM nb WHERE gap <= 7200000000 AND a <> b UNION SELECT b, a FROM nb WHERE gap <= 7200000000 AND a <> b),
{REACH_SQL}"""


@query(f"{ARE}, {LINK_SQL} SELECT cluster, alert_id FROM m")
def entity_time_components(spark, sf_dir, severity=None):
    return entity_components(severe(spark, sf_dir, severity))


def big_clusters(spark: SparkSession, sf_dir: str, least: int = 2, severity: int | None = None) -> DataFrame:
    """Alerts from a severity on with their component, components of at least ``least`` alerts; written once, since many queries read it twice."""
    rows = severe(spark, sf_dir, severity)
    m = entity_components(rows)
    sized = m.join(m.groupBy("cluster").count().filter(F.col("count") >= least).select("cluster"), "cluster", "left_semi")
    return materialize(rows.join(sized, "alert_id"), "clusters")


BIG_SQL = LINK_SQL + ", c AS (SELECT m.cluster, a.* FROM m JOIN alerts a USING (alert_id) WHERE cluster IN (SELECT cluster FROM m GROUP BY 1 HAVING count(*) >= 2))"


@query(f"""{ARE}, {LINK_SQL} SELECT cluster, 'cluster_' || lpad(CAST(row_number() OVER (ORDER BY min(ts), min(m.alert_id)) AS VARCHAR), 4, '0') AS name, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts
FROM m JOIN alerts USING (alert_id) GROUP BY cluster HAVING count(*) >= 1""")
def cluster_numbers(spark, sf_dir, severity=None):
    rows = severe(spark, sf_dir, severity)
    g = rows.join(entity_components(rows), "alert_id").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min("alert_id").alias("_id"))
    name = F.concat(F.lit("cluster_"), D.cluster_number(F.col("number"))).alias("name")
    return number_rows(g, ["first_ts", "_id"]).select("cluster", name, "n", "first_ts", "last_ts")


@query(f"""{ARE}, l AS (SELECT x.alert_id AS a, y.alert_id AS b FROM entity x JOIN entity y ON x.entity = y.entity AND x.alert_id <> y.alert_id
  AND abs(epoch_us(x.ts) - epoch_us(y.ts)) / 1e6 <= 7200 AND greatest(x.severity, y.severity) / ln(abs(epoch_us(x.ts) - epoch_us(y.ts)) / 1e6 + 2) >= 0.70),
{REACH_SQL},
h AS (SELECT cluster, alert_id, unnest([host, target]) AS host FROM m JOIN alerts USING (alert_id))
SELECT cluster, count(DISTINCT alert_id) AS n, count(DISTINCT host) AS hosts FROM h GROUP BY cluster HAVING count(DISTINCT alert_id) >= 4 AND count(DISTINCT host) > 1""")
def communities(spark, sf_dir, severity=None):
    rows = severe(spark, sf_dir, severity)
    by = sessions.severity_sessions(entities(rows, "ts", "severity"), ["entity"], "ts", "alert_id", "severity")
    m = components.members(rows, sessions.session_links(by, ["entity"], "alert_id", ["ts", "alert_id"]))
    hosts = m.join(rows, "alert_id").select("cluster", "alert_id", F.explode(F.array("host", "target")).alias("host"))
    g = hosts.groupBy("cluster").agg(F.countDistinct("alert_id").alias("n"), F.countDistinct("host").alias("hosts"))
    return g.filter("n >= 4 and hosts > 1")


PAIR_SQL = """p(a_tactic, b_tactic, pattern) AS (VALUES ('Credential Access', 'Execution', 'credential_execution'), ('Credential Access', 'Lateral Movement', 'credential_lateral_movement'),
  ('Initial Access', 'Lateral Movement', 'initial_lateral_movement'), ('Privilege Escalation', 'Exfiltration', 'privilege_exfiltration'), ('Lateral Movement', 'Exfiltration', 'lateral_exfiltration')),
pm AS (SELECT DISTINCT pattern, x.alert_id AS earlier, y.alert_id AS later, (epoch_us(y.ts) - epoch_us(x.ts)) / 1e6 AS gap_s FROM entity x JOIN entity y ON x.entity = y.entity
  AND (x.ts, x.alert_id) < (y.ts, y.alert_id) AND epoch_us(y.ts) - epoch_us(x.ts) <= 10800000000 JOIN p ON x.tactic = a_tactic AND y.tactic = b_tactic)"""


@query(f"{AE}, {PAIR_SQL} SELECT pattern, earlier, later, round(gap_s, 3) AS gap_s FROM pm")
def tactic_pair_matches(spark, sf_dir):
    m = joins.tactic_pair_matches(entities(alerts(spark, sf_dir), "ts", "tactic"))
    return m.select("pattern", "earlier", "later", F.round("gap_s", 3).alias("gap_s"))


@query(f"""{ARE}, {PAIR_SQL}, v AS (SELECT earlier AS a, later AS b FROM pm),
l AS (SELECT a, b FROM v UNION SELECT b, a FROM v), {CC_SQL.format(nodes="(SELECT a AS alert_id FROM l)")}
SELECT alert_id, cluster FROM m""")
def pattern_components(spark, sf_dir, severity=None):
    links = materialize(joins.pattern_links(entities(severe(spark, sf_dir, severity), "ts", "tactic")), "pattern-links")
    nodes = links.select(F.explode(F.array("a", "b")).alias("alert_id"))
    return components.members(nodes, links)


@query(f"""{ARE}, n AS (SELECT *, row_number() OVER (PARTITION BY host, tactic ORDER BY ts, alert_id) - 1 AS seen FROM alerts),
q AS (SELECT DISTINCT e.alert_id, e.ts, e.entity FROM entity e JOIN n ON e.alert_id = n.alert_id WHERE seen <= 3),
l AS (SELECT x.alert_id AS a, y.alert_id AS b FROM q x JOIN q y ON x.entity = y.entity AND x.alert_id <> y.alert_id AND abs(epoch_us(x.ts) - epoch_us(y.ts)) <= 10800000000),
r AS (SELECT alert_id AS a, alert_id AS b FROM q UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a AS alert_id, min(b) AS cluster FROM r GROUP BY a)
SELECT cluster, alert_id FROM m WHERE cluster IN (SELECT cluster FROM m GROUP BY 1 HAVING count(*) >= 4)""")
def rare_components(spark, sf_dir):
    rows = alerts(spark, sf_dir).withColumn("seen", gate.seen_before(["host", "tactic"], ["ts", "alert_id"])).filter("seen <= 3")
    m = materialize(entity_components(rows, 10800), "rare")
    return m.join(m.groupBy("cluster").count().filter("count >= 4").select("cluster"), "cluster", "left_semi")


SETS_SQL = "s AS (SELECT DISTINCT 'u' || usr AS cluster, alert_id FROM alerts UNION SELECT DISTINCT 'h' || host, alert_id FROM alerts UNION SELECT DISTINCT 'd' || usr || strftime(ts, '%Y%m%d'), alert_id FROM alerts)"


@query(f"""{A}, {SETS_SQL}, n AS (SELECT cluster, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT x.cluster AS a, y.cluster AS b, count(*) AS joint FROM s x JOIN s y ON x.alert_id = y.alert_id AND x.cluster <> y.cluster GROUP BY 1, 2)
SELECT cluster, alert_id FROM s WHERE cluster NOT IN (SELECT a FROM o JOIN n p ON o.a = p.cluster JOIN n q ON o.b = q.cluster WHERE joint = p.n AND (p.n < q.n OR (p.n = q.n AND a > b)))""")
def maximal_clusters(spark, sf_dir, severity=None):
    r = severe(spark, sf_dir, severity)
    day = F.concat(F.lit("d"), "user", F.date_format("ts", "yyyyMMdd"))
    sets = [r.select(c.alias("cluster"), "alert_id") for c in (F.concat(F.lit("u"), "user"), F.concat(F.lit("h"), "host"), day)]
    return joins.maximal_clusters(materialize(sets[0].unionByName(sets[1]).unionByName(sets[2]).distinct(), "sets"))


@query(f"{AE} SELECT DISTINCT x.alert_id AS root, y.alert_id FROM entity x JOIN entity y ON x.entity = y.entity WHERE x.severity = 10")
def two_hop(spark, sf_dir):
    rows = alerts(spark, sf_dir)
    return joins.neighbourhood(entities(rows).select("alert_id", "entity"), rows.filter("severity = 10").select("alert_id"))


CONF_SQL = """h AS (SELECT DISTINCT x.alert_id AS root, y.alert_id FROM entity x JOIN entity y ON x.entity = y.entity WHERE x.severity = 10),
f AS (SELECT root, count(DISTINCT h.alert_id) AS n, max(a.severity) AS sev, bool_or(a.tactic IN ('Lateral Movement', 'Exfiltration', 'Privilege Escalation')) AS crit FROM h JOIN alerts a ON a.alert_id = h.alert_id GROUP BY root),
k AS (SELECT root, count(DISTINCT entity) AS k FROM h JOIN entity e ON e.alert_id = h.alert_id GROUP BY root)"""


@query(f"""{AE}, {CONF_SQL} SELECT f.root, n, k AS entities, round(least(1, 0.15 + 0.4 * sev / 10 + CASE WHEN crit THEN 0.2 ELSE 0 END + 0.05 * least(n - 1, 5) + 0.02 * least(k, 5)), 6) AS confidence FROM f JOIN k ON f.root = k.root""")
def investigate_confidence(spark, sf_dir):
    rows = alerts(spark, sf_dir)
    e = entities(rows).select("alert_id", "entity")
    roots = rows.filter("severity = 10").select("alert_id")
    # the greatest of a neighbourhood is the greatest of the root's entities
    of_entity = e.join(rows, "alert_id").groupBy("entity").agg(F.max("severity").alias("sev"), F.bool_or(F.col("tactic").isin("Lateral Movement", "Exfiltration", "Privilege Escalation")).alias("crit"))
    f = e.join(roots, "alert_id", "left_semi").join(of_entity, "entity").groupBy(F.col("alert_id").alias("root")).agg(F.max("sev").alias("sev"), F.bool_or("crit").alias("crit"))
    k = joins.neighbourhood_counts(e, roots)
    c = scoring.validation_confidence(F.col("sev"), F.col("crit"), F.col("n"), F.col("entities"))
    return f.join(k, "root").select("root", "n", "entities", F.round(c, 6).alias("confidence"))


NEXT_SQL = """o AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts, alert_id) AS pos FROM entity),
nx AS (SELECT 'same_' || x.etype AS rel, x.alert_id AS a, y.alert_id AS b FROM o x JOIN o y ON x.entity = y.entity AND y.pos BETWEEN x.pos + 1 AND x.pos + 8 AND epoch_us(y.ts) - epoch_us(x.ts) <= 21600000000)"""


@query(f"{AE}, {NEXT_SQL} SELECT rel, a, b FROM nx UNION SELECT rel, b, a FROM nx")
def knn_same_entity_edges(spark, sf_dir):
    return joins.temporal_neighbours(entities(alerts(spark, sf_dir), "ts"), 6 * 3600, 8)


@query(f"""{AE}, o AS (SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY entity ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM entity WINDOW w AS (PARTITION BY entity ORDER BY ts, alert_id))
SELECT DISTINCT x.alert_id AS a, y.alert_id AS b FROM o x JOIN o y ON x.entity = y.entity AND y.pos BETWEEN x.upto + 1 AND x.upto + 8 AND epoch_us(y.ts) - epoch_us(x.ts) <= 21600000000""")
def precedes_edges(spark, sf_dir):
    return joins.precedes(entities(alerts(spark, sf_dir), "ts"), 6 * 3600, 8)


@query(f"""{AE} SELECT rel, src, dst FROM (SELECT 'connects_to' AS rel, CAST(alert_id AS VARCHAR) AS src, entity AS dst FROM entity UNION SELECT 'rev_connects_to', entity, CAST(alert_id AS VARCHAR) FROM entity)""")
def incidence_edges(spark, sf_dir):
    return joins.incidence(entities(alerts(spark, sf_dir)))


WINDOW_SQL = """w0 AS (SELECT usr AS scenario, tactic AS attack, min(epoch_us(ts)) / 1e6 AS start_s, min(epoch_us(ts)) / 1e6 + 86400 AS end_s, min(alert_id) AS seq FROM alerts WHERE severity >= 9 GROUP BY 1, 2)"""


@query(f"""{A}, {WINDOW_SQL} SELECT a.alert_id, arg_min(w0.attack, w0.seq) AS attack FROM alerts a LEFT JOIN w0 ON a.usr = w0.scenario AND epoch_us(a.ts) / 1e6 BETWEEN w0.start_s AND w0.end_s GROUP BY a.alert_id""")
def label_window_join(spark, sf_dir):
    rows = alerts(spark, sf_dir).withColumn("epoch", F.unix_micros("ts") / 1e6).withColumnRenamed("user", "scenario")
    w = rows.filter("severity >= 9").groupBy("scenario", F.col("tactic").alias("attack")).agg(F.min("epoch").alias("start_s"), (F.min("epoch") + 86400).alias("end_s"), F.min("alert_id").alias("seq"))
    return joins.label_window_join(rows, joins.label_windows(w)).select("alert_id", "attack")


#: All pairs by definition: millions of rows even at sf0.01, so this is held against the query on a small table only.
PROJECTION_SQL = f"""{AE}, q AS (SELECT DISTINCT alert_id, entity FROM entity) SELECT DISTINCT x.alert_id AS a, y.alert_id AS b FROM q x JOIN q y ON x.entity = y.entity AND x.alert_id <> y.alert_id"""


@query()
def homogeneous_projection(spark, sf_dir, severity=None):
    return joins.shared_entity_pairs(entities(severe(spark, sf_dir, severity)))


@query(f"""{A}, t AS (SELECT alert_id, ts, 'tactic' AS e, tactic AS v FROM alerts UNION ALL SELECT alert_id, ts, 'technique', technique FROM alerts),
o AS (SELECT *, row_number() OVER (PARTITION BY e, v ORDER BY ts, alert_id) AS pos FROM t),
nx AS (SELECT x.alert_id AS a, y.alert_id AS b FROM o x JOIN o y ON x.e = y.e AND x.v = y.v AND y.pos BETWEEN x.pos + 1 AND x.pos + 12 AND epoch_us(y.ts) - epoch_us(x.ts) <= 86400000000)
SELECT a, b FROM nx UNION SELECT b, a FROM nx""")
def semantic_edges(spark, sf_dir, severity=None):
    return joins.semantic_edges(severe(spark, sf_dir, severity))


SEQ_SQL = """ch AS (SELECT usr, ts, alert_id, tactic, lag(tactic) OVER (PARTITION BY usr ORDER BY ts, alert_id) AS before FROM alerts),
sq AS (SELECT usr, list(tactic ORDER BY ts, alert_id) AS seq FROM ch WHERE before IS NULL OR before <> tactic GROUP BY usr)"""


@query(f"{A}, {SEQ_SQL} SELECT usr AS user, array_to_string(seq, '>') AS sequence FROM sq")
def stage_sequence(spark, sf_dir, severity=None):
    return sequence.stage_sequence(severe(spark, sf_dir, severity), "user", "tactic", ["ts", "alert_id"]).select("user", F.concat_ws(">", "sequence").alias("sequence"))


def _lcs_sql(chain: tuple[str, ...], name: str) -> str:
    """A recursive table that carries one row of the dynamic program from stage to stage."""
    cells, prev = [], "0"
    for i, want in enumerate(chain, 1):
        cells.append(f"CASE WHEN s.seq[d.i + 1] = '{want}' THEN {'0' if i == 1 else f'd.c{i - 1}'} + 1 ELSE greatest(d.c{i}, {{c{i - 1}}}) END")
    filled = {"c0": prev}
    for i, c in enumerate(cells, 1):
        filled[f"c{i}"] = "(" + c.replace(f"{{c{i - 1}}}", filled[f"c{i - 1}"]) + ")"
    zero = ", ".join(f"0 AS c{i}" for i in range(1, len(chain) + 1))
    return f"{name} AS (SELECT usr, 0 AS i, {zero} FROM sq UNION ALL SELECT d.usr, d.i + 1, {', '.join(filled[f'c{i}'] for i in range(1, len(chain) + 1))} FROM {name} d JOIN sq s ON d.usr = s.usr WHERE d.i < len(s.seq))"


_CHAIN = K.ATTACK_CHAINS[2]


@query(f"{AR}, {SEQ_SQL}, {_lcs_sql(_CHAIN, 'lcs')} SELECT l.usr AS user, round(max(c{len(_CHAIN)}) / {len(_CHAIN)}, 6) AS ratio FROM lcs l GROUP BY 1")
def chain_lcs(spark, sf_dir, severity=None):
    seq = sequence.stage_sequence(severe(spark, sf_dir, severity), "user", "tactic", ["ts", "alert_id"])
    return seq.select("user", F.round(S.lcs_ratio(F.col("sequence"), _CHAIN), 6).alias("ratio"))


def _letters(names, column: str) -> tuple[dict[str, str], str]:
    """One letter for each stage, and the SQL that gives it, so that a sequence is a word and a subsequence a LIKE pattern."""
    letters = {n: chr(ord("a") + i) for i, n in enumerate(sorted(set(names)))}
    return letters, f"CASE {column} {' '.join(f"WHEN '{n}' THEN '{x}'" for n, x in letters.items())} ELSE '_' END"


def _common_sql(word: str, chain: tuple[str, ...], letters: dict[str, str]) -> str:
    """Length of the longest subsequence of ``chain`` that ``word`` has, by trying all of them from the longest on."""
    tries = [f"WHEN {' OR '.join(f"{word} LIKE '%{'%'.join(letters[s] for s in part)}%'" for part in combinations(chain, k))} THEN {k}" for k in range(len(chain), 0, -1)]
    return f"(CASE {' '.join(tries)} ELSE 0 END)"


_TACTICS, TACTIC_LETTER = _letters([t for c in K.ATTACK_CHAINS for t in c], "tactic")
_STAGES, _STAGE_LETTER = _letters([t for expected, _ in K.ATTACK_GRAPHS.values() for t in expected], "stage")


def best_chain_sql(word: str) -> str:
    return f"greatest({', '.join(f'{_common_sql(word, c, _TACTICS)} / {len(c)}' for c in K.ATTACK_CHAINS)})"


@query(f"""{A}, {SEQ_SQL}, w AS (SELECT usr, string_agg({TACTIC_LETTER}, '' ORDER BY ts, alert_id) AS w FROM ch WHERE before IS NULL OR before <> tactic GROUP BY usr)
SELECT usr AS user, round({best_chain_sql('w')}, 6) AS order_score FROM w""")
def best_chain_order(spark, sf_dir):
    seq = sequence.stage_sequence(severe(spark, sf_dir, None), "user", "tactic", ["ts", "alert_id"])
    return seq.select("user", F.round(S.best_chain(F.col("sequence")), 6).alias("order_score"))


def tagged(spark, sf_dir, severity: int | None = None) -> DataFrame:
    kind = S.lookup(K.TACTIC_KINDS, F.lower("tactic"))
    return big_clusters(spark, sf_dir, severity=severity).withColumn("kind", kind).withColumn("tags", F.array_compact(F.array(kind)))


TAG_SQL = """tg AS (SELECT cluster, alert_id, ts, severity, CASE tactic WHEN 'Initial Access' THEN 'initial_access' WHEN 'Execution' THEN 'execution' WHEN 'Credential Access' THEN 'credential_access'
  WHEN 'Lateral Movement' THEN 'lateral_movement' WHEN 'Exfiltration' THEN 'data_exfiltration' END AS stage FROM c),
te AS (SELECT DISTINCT cluster, alert_id, tg.ts, stage, entity FROM tg JOIN entity USING (alert_id)),
ae AS (SELECT DISTINCT x.cluster, x.stage AS l, y.stage AS r FROM te x JOIN te y ON x.cluster = y.cluster AND x.entity = y.entity AND (x.ts, x.alert_id) < (y.ts, y.alert_id) AND x.stage <> y.stage
  UNION SELECT cluster, before, stage FROM (SELECT cluster, stage, lag(stage) OVER (PARTITION BY cluster ORDER BY ts, alert_id) AS before FROM tg) WHERE before <> stage)"""


@query(f'{ARE}, {BIG_SQL}, {TAG_SQL} SELECT cluster, l AS "left", r AS "right" FROM ae')
def attack_edges(spark, sf_dir, severity=None):
    rows = tagged(spark, sf_dir, severity)
    seq = sequence.stage_sequence(sequence.tag_rows(rows), "cluster", "stage", ["ts", "alert_id", "rank"])
    return sequence.attack_edges(sequence.tag_rows(rows), entities(rows).select("alert_id", "entity"), seq)


def discovery(rows: DataFrame) -> DataFrame:
    """One row a cluster with what its score is made of, both scores (with and without C2) and the refinements as columns (AGG-02, R5)."""
    tags = sequence.tag_rows(rows)
    ents = entities(rows).select("alert_id", "entity")
    seq = sequence.stage_sequence(tags, "cluster", "stage", ["ts", "alert_id", "rank"])
    edges = sequence.attack_edges(tags, ents, seq).groupBy("cluster").agg(F.collect_set(F.concat("left", F.lit("->"), "right")).alias("edges"))
    facts = rows.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.max("severity").alias("max_severity"), F.count_if(F.col("severity") >= 8).alias("high"), F.countDistinct("kind").alias("n_kinds"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("stages"), F.count_if(F.col("seen") <= 3).alias("low"), F.min("ts").alias("first_ts"), F.min("alert_id").alias("first_id"),
    )
    counts = rows.select("cluster", "alert_id").join(ents, "alert_id").groupBy("cluster", "entity").agg(F.countDistinct("alert_id").alias("k")).filter("k > 1")
    shared = counts.groupBy("cluster").agg(F.count(F.lit(1)).alias("shared"), F.max("k").alias("most_shared"))
    empty = F.array().cast("array<string>")
    both = facts.join(shared, "cluster", "left").join(seq, "cluster", "left").join(edges, "cluster", "left")
    both = both.fillna({"shared": 0, "most_shared": 0}).withColumn("sequence", F.coalesce("sequence", empty)).withColumn("edges", F.coalesce("edges", empty))
    both = sequence.best_pattern(both)
    without = F.size(F.array_remove("stages", "command_and_control"))
    c = F.col
    score = lambda k: F.round(scoring.discovery_score(c("max_severity"), k, c("n"), c("shared"), c("n_kinds"), c("low"), c("graph_score")), 6)
    return (
        both.withColumn("score", score(F.size("stages")))
        .withColumn("score_reduced", score(without))
        .withColumn("strict_entity_continuity", scoring.continuity(c("n"), c("most_shared")))
        .withColumn("require_progression_or_severity_density", scoring.progression(without, c("n"), c("high")))
    )


def scored_clusters(spark, sf_dir, severity: int | None = None) -> DataFrame:
    rows = tagged(spark, sf_dir, severity)
    seen = alerts(spark, sf_dir).select("alert_id", gate.seen_before(["host", "tactic"], ["ts", "alert_id"]).alias("seen"))
    return discovery(materialize(rows.join(seen, "alert_id"), "tagged"))


SEEN_SQL = "sn AS (SELECT alert_id, row_number() OVER (PARTITION BY host, tactic ORDER BY ts, alert_id) - 1 AS seen FROM alerts)"


DISC_SQL = f"""{ARE}, {BIG_SQL}, {TAG_SQL}, {SEEN_SQL},
sh AS (SELECT cluster, count(*) AS shared, max(k) AS most FROM (SELECT cluster, entity, count(DISTINCT c.alert_id) AS k FROM c JOIN entity e ON c.alert_id = e.alert_id GROUP BY 1, 2 HAVING count(DISTINCT c.alert_id) > 1) GROUP BY 1),
fc AS (SELECT c.cluster, count(*) AS n, max(c.severity) AS mx, count(*) FILTER (WHERE c.severity >= 8) AS high, count(DISTINCT stage) AS k, count(*) FILTER (WHERE seen <= 3) AS low
  FROM c JOIN tg ON c.alert_id = tg.alert_id JOIN sn ON c.alert_id = sn.alert_id GROUP BY 1)"""


@query(f"""{DISC_SQL} SELECT fc.cluster, n, CAST(mx AS INTEGER) AS max_severity, high, k AS n_kinds, coalesce(shared, 0) AS shared, low,
  CASE WHEN n <= 3 THEN coalesce(most, 0) >= 2 WHEN n <= 10 THEN coalesce(most, 0) >= 3 ELSE coalesce(most, 0) >= 3 AND most / n >= 0.20 END AS strict_entity_continuity,
  k >= 2 OR CASE WHEN n <= 3 THEN high >= 1 ELSE high / n >= 0.25 END AS progression,
  round(least(1, 0.30 * mx / 10 + 0.25 * least(k / 3, 1) + 0.20 * least(1, 0.30 + CASE WHEN coalesce(shared, 0) > 0 THEN 0.25 ELSE 0 END + CASE WHEN k >= 2 THEN 0.45 ELSE 0 END) + 0.15 * low / n + 0.10 * least(n / 5, 1)), 5) AS heuristic
FROM fc LEFT JOIN sh ON fc.cluster = sh.cluster""")
def cluster_scores(spark, sf_dir, severity=None):
    d = scored_clusters(spark, sf_dir, severity)
    c = F.col
    heuristic = scoring.discovery_score(c("max_severity"), F.size("stages"), c("n"), c("shared"), c("n_kinds"), c("low"), F.lit(0.0))
    return d.select("cluster", "n", "max_severity", "high", "n_kinds", "shared", "low", "strict_entity_continuity", c("require_progression_or_severity_density").alias("progression"), F.round(heuristic, 5).alias("heuristic"))


def _list_sql(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _pattern_sql() -> str:
    """Tables of the best attack graph of each cluster, from the stages tg and the steps ae."""
    graphs = list(K.ATTACK_GRAPHS.values())
    stages = ", ".join(f"count(DISTINCT stage) FILTER (WHERE stage IN ({_list_sql(e)})) AS s{i}" for i, (e, _) in enumerate(graphs))
    steps = ", ".join(f"count(*) FILTER (WHERE l || '->' || r IN ({_list_sql(f'{a}->{b}' for a, b in pairs)})) AS e{i}" for i, (_, pairs) in enumerate(graphs))
    each = [
        f"SELECT cluster, coalesce(e{i}, 0) AS e, s{i} AS s, {-i} AS place, '{name}' AS pattern, s{i} / {len(e)} * 0.35 + coalesce(e{i}, 0) / {len(pairs)} * 0.45 + {_common_sql('word', e, _STAGES)} / {len(e)} * 0.20 AS raw FROM gr"
        for i, (name, (e, pairs)) in enumerate(K.ATTACK_GRAPHS.items())
    ]
    return f"""sq AS (SELECT cluster, ts, alert_id, stage, lag(stage) OVER (PARTITION BY cluster ORDER BY ts, alert_id) AS before FROM tg),
sw AS (SELECT cluster, string_agg({_STAGE_LETTER}, '' ORDER BY ts, alert_id) AS word, string_agg(stage, '>' ORDER BY ts, alert_id) AS sequence FROM sq WHERE before IS NULL OR before <> stage GROUP BY 1),
gs AS (SELECT cluster, {stages} FROM tg GROUP BY 1), ge AS (SELECT cluster, {steps} FROM ae GROUP BY 1),
gr AS (SELECT gs.*, ge.* EXCLUDE (cluster), word FROM gs JOIN sw ON gs.cluster = sw.cluster LEFT JOIN ge ON gs.cluster = ge.cluster),
gp AS (SELECT cluster, max((round(least(CASE WHEN e = 0 THEN raw * 0.65 ELSE raw END, 1), 6), e, s, place, pattern)) AS b FROM ({' UNION ALL '.join(each)}) GROUP BY 1),
gm AS (SELECT gp.cluster, b[1] AS graph_score, CASE WHEN b[1] > 0 THEN b[5] ELSE 'none' END AS pattern, sequence FROM gp JOIN sw ON gp.cluster = sw.cluster)"""


#: Score of a cluster from fc, sh and gm.
SCORE_SQL = """least(1, 0.30 * mx / 10 + 0.25 * least(k / 3, 1) + 0.20 * least(1, CASE WHEN n >= 2 THEN 0.30 ELSE 0 END + CASE WHEN coalesce(shared, 0) > 0 THEN 0.25 ELSE 0 END + CASE WHEN k >= 2 THEN 0.45 ELSE 0 END)
  + 0.15 * low / n + 0.10 * least(n / 5, 1) + 0.10 * graph_score)"""
PATTERN_SQL = _pattern_sql()


@query(f"""{DISC_SQL}, {PATTERN_SQL} SELECT fc.cluster, pattern, graph_score, round({SCORE_SQL}, 6) AS score, sequence
FROM fc LEFT JOIN sh ON fc.cluster = sh.cluster JOIN gm ON fc.cluster = gm.cluster""")
def pattern_match(spark, sf_dir):
    return scored_clusters(spark, sf_dir, None).select("cluster", "pattern", "graph_score", "score", F.concat_ws(">", "sequence").alias("sequence"))


STRUCT_SQL = f"""{ARE}, {BIG_SQL}, {PAIR_SQL}, {SEEN_SQL},
hs AS (SELECT cluster, count(DISTINCT h) AS hosts FROM (SELECT cluster, unnest([host, target]) AS h FROM c) GROUP BY 1),
mt AS (SELECT cluster, count(DISTINCT (pattern, earlier, later)) AS matches, count(DISTINCT pattern) AS patterns FROM c JOIN pm ON c.alert_id = pm.earlier OR c.alert_id = pm.later GROUP BY 1),
st AS (SELECT c.cluster, count(*) AS n, max(severity) AS mx, count(*) FILTER (WHERE severity >= 8) AS high, count(DISTINCT tactic) AS tactics, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS dur,
  count(*) FILTER (WHERE seen <= 3) AS rare FROM c JOIN sn ON c.alert_id = sn.alert_id GROUP BY 1),
sc AS (SELECT st.*, hosts, coalesce(matches, 0) AS matches, coalesce(patterns, 0) AS patterns, 1 - least(greatest(dur, 1), 21600) / 21600 AS temporal FROM st JOIN hs ON st.cluster = hs.cluster LEFT JOIN mt ON st.cluster = mt.cluster)"""


def structural(spark, sf_dir, severity: int | None = None) -> DataFrame:
    """Clusters with everything that the structural and the verdict score need (QRY-09)."""
    rows = big_clusters(spark, sf_dir, severity=severity)
    seen = alerts(spark, sf_dir).select("alert_id", gate.seen_before(["host", "tactic"], ["ts", "alert_id"]).alias("seen"))
    facts = scoring.cluster_facts(rows)
    rare = rows.join(seen, "alert_id").groupBy("cluster").agg(F.count_if(F.col("seen") <= 3).alias("rare"))
    hosts = rows.select("cluster", F.explode(F.array("host", "target")).alias("h")).groupBy("cluster").agg(F.countDistinct("h").alias("hosts"))
    matches = joins.match_counts(entities(severe(spark, sf_dir, severity), "ts", "tactic"), rows)
    seq = sequence.stage_sequence(rows, "cluster", "tactic", ["ts", "alert_id"])
    out = facts.join(rare, "cluster").join(hosts, "cluster").join(matches, "cluster", "left").join(seq, "cluster").fillna({"matches": 0, "patterns": 0})
    c = F.col
    args = [c(x) for x in ("max_severity", "high", "n", "hosts", "tactics", "duration_s", "matches")]
    return out.withColumn("structural", scoring.structural_score(*args)).withColumn("structural_rare", scoring.structural_score(*args, c("rare")))


@query(f"""{STRUCT_SQL} SELECT cluster, n, hosts, tactics, matches, rare,
  round(least(1, 0.25 * mx / 10 + 0.20 * high / n + 0.15 * least(n / 8, 1) + 0.10 * least(hosts / 3, 1) + 0.10 * least(tactics / 4, 1) + 0.10 * temporal + 0.10 * least(matches / 2, 1)), 6) AS structural,
  round(least(1, 0.22 * mx / 10 + 0.18 * high / n + 0.14 * least(n / 8, 1) + 0.10 * least(hosts / 3, 1) + 0.10 * least(tactics / 4, 1) + 0.09 * temporal + 0.10 * least(matches / 2, 1) + 0.07 * rare / n), 6) AS structural_rare FROM sc""")
def structural_scores(spark, sf_dir, severity=None):
    return structural(spark, sf_dir, severity).select("cluster", "n", "hosts", "tactics", "matches", "rare", "structural", "structural_rare")


_STRUCTURAL = "round(least(1, 0.25 * mx / 10 + 0.20 * high / n + 0.15 * least(n / 8, 1) + 0.10 * least(hosts / 3, 1) + 0.10 * least(tactics / 4, 1) + 0.10 * temporal + 0.10 * least(matches / 2, 1)), 6)"


@query(f"""{STRUCT_SQL}, q AS (SELECT cluster, ts, alert_id, tactic, lag(tactic) OVER (PARTITION BY cluster ORDER BY ts, alert_id) AS before FROM c),
w AS (SELECT cluster, string_agg({TACTIC_LETTER}, '' ORDER BY ts, alert_id) AS w FROM q WHERE before IS NULL OR before <> tactic GROUP BY 1),
v AS (SELECT sc.*, {_STRUCTURAL} AS structural, {best_chain_sql('w')} AS o FROM sc JOIN w ON sc.cluster = w.cluster),
e AS (SELECT *, round(least(1, structural * 0.26 + least(n / 10, 1) * 0.16 + least(tactics / 6, 1) * 0.16 + least(patterns / 4, 1) * 0.16 + o * 0.16 + high / n * 0.05 + rare / n * 0.05), 6) AS evidence FROM v WHERE structural >= 0.55)
SELECT cluster, n, structural, round(o, 6) AS "order", evidence, evidence >= 0.68 AS selected, round(CASE WHEN evidence >= 0.68 THEN evidence ELSE 1 - evidence END, 6) AS confidence FROM e""")
def verdicts(spark, sf_dir):
    """Incidents over the structural threshold with the local verdict (QRY-10)."""
    s = structural(spark, sf_dir, None).filter("structural >= 0.55").withColumn("order", S.best_chain(F.col("sequence")))
    e = scoring.verdict_score(*[F.col(x) for x in ("structural", "n", "tactics", "patterns", "order", "high", "rare")])
    return scoring.with_verdict(s, F.round(e, 6)).select("cluster", "n", "structural", F.round("order", 6).alias("order"), "evidence", "selected", F.round("confidence", 6).alias("confidence"))


@query(f"""{A}, s AS (SELECT alert_id FROM alerts WHERE severity >= 8), t AS (SELECT DISTINCT alert_id FROM truth),
m AS (SELECT (SELECT count(*) FROM s JOIN t USING (alert_id)) AS tp, (SELECT count(*) FROM s) AS sel, (SELECT count(*) FROM t) AS tru)
SELECT tp, sel - tp AS fp, tru - tp AS fn, round(tp / sel, 6) AS precision, round(tp / tru, 6) AS recall, round(2 * tp / (sel + tru), 6) AS f1 FROM m""")
def detector_eval(spark, sf_dir):
    rows = alerts(spark, sf_dir)
    m = evaluate.selection_metrics(rows.filter("severity >= 8"), truth(rows))
    return m.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""{A} SELECT t.incident_id, count(*) AS alerts, count(s.alert_id) AS hits, round(count(s.alert_id) / count(*), 6) AS recall, count(s.alert_id) > 0 AS any_hit, count(s.alert_id) = count(*) AS all_hit
FROM truth t LEFT JOIN (SELECT alert_id FROM alerts WHERE severity >= 6) s ON t.alert_id = s.alert_id GROUP BY 1""")
def incident_recall(spark, sf_dir):
    rows = alerts(spark, sf_dir)
    return evaluate.incident_recall(truth(rows), rows.filter("severity >= 6")).withColumn("recall", F.round("recall", 6))


@query(f"""{ARE}, {BIG_SQL}, z AS (SELECT cluster, count(*) AS n FROM c GROUP BY 1), w AS (SELECT incident_id, count(*) AS m FROM truth GROUP BY 1),
o AS (SELECT cluster, incident_id, count(*) AS joint FROM c JOIN truth USING (alert_id) GROUP BY 1, 2),
f AS (SELECT o.cluster, joint / n AS p, joint / m AS r, 2 * (joint / n) * (joint / m) / (joint / n + joint / m) AS f FROM o JOIN z ON o.cluster = z.cluster JOIN w ON o.incident_id = w.incident_id),
b AS (SELECT cluster, max((f, p, r)) AS b FROM f GROUP BY 1)
SELECT z.cluster, round(coalesce(b.b[2], 0), 6) AS precision, round(coalesce(b.b[3], 0), 6) AS recall, round(coalesce(b.b[1], 0), 6) AS f1 FROM z LEFT JOIN b ON z.cluster = b.cluster""")
def cluster_best_match(spark, sf_dir, severity=None):
    rows = big_clusters(spark, sf_dir, severity=severity)
    m = evaluate.best_match(rows.select("cluster", "alert_id"), truth(alerts(spark, sf_dir)))
    return m.select("cluster", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""{ARE}, {BIG_SQL}, t AS (SELECT cluster, tactic, count(*) AS n FROM c GROUP BY 1, 2), k AS (SELECT cluster, count(DISTINCT etype) AS entity_types FROM c JOIN entity e ON c.alert_id = e.alert_id GROUP BY 1)
SELECT t.cluster, CAST(sum(n) AS BIGINT) AS size, round(max(n) / sum(n), 6) AS coherence, (SELECT round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9, 6) FROM c WHERE c.cluster = t.cluster) AS span_h, any_value(entity_types) AS entity_types
FROM t JOIN k ON t.cluster = k.cluster GROUP BY t.cluster""")
def coherence_span(spark, sf_dir, severity=None):
    rows = big_clusters(spark, sf_dir, severity=severity)
    s = evaluate.cluster_summary(rows, entities(rows).select("alert_id", "entity"))
    return s.withColumn("coherence", F.round("coherence", 6)).withColumn("span_h", F.round("span_h", 6))


@query(f"""{A}, t AS (SELECT DISTINCT alert_id FROM truth) SELECT incident_id, NULL AS cluster, 0 AS hits FROM truth WHERE false UNION ALL
SELECT tr.incident_id, 's' || a.severity AS cluster, count(a.alert_id) AS hits FROM truth tr LEFT JOIN (SELECT * FROM alerts WHERE severity >= 6) a ON tr.alert_id = a.alert_id GROUP BY 1, 2""")
def cluster_overlap(spark, sf_dir):
    rows = alerts(spark, sf_dir)
    m = rows.filter("severity >= 6").select(F.concat(F.lit("s"), F.col("severity").cast("string")).alias("cluster"), "alert_id")
    return joins.cluster_overlap(truth(rows), m)


GAP_SQL = "gp AS (SELECT usr, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY usr ORDER BY ts, alert_id))) / 1e6 / 3600.0 AS gap_h FROM alerts), pg AS (SELECT * FROM gp WHERE gap_h > 0)"


def _split_sql(threshold: str) -> str:
    return f"""{A}, {GAP_SQL}, th AS ({threshold}), s AS (SELECT a.alert_id, a.usr, a.ts, CASE WHEN (epoch_us(a.ts) - epoch_us(lag(a.ts) OVER (PARTITION BY a.usr ORDER BY a.ts, a.alert_id))) / 1e6 > coalesce(th.s, 86400) THEN 1 ELSE 0 END AS cut FROM alerts a LEFT JOIN th ON a.usr = th.usr)
SELECT alert_id, CAST(sum(cut) OVER (PARTITION BY usr ORDER BY ts, alert_id) AS BIGINT) AS session FROM s"""


@query(_split_sql("SELECT usr, least(greatest(quantile_cont(gap_h, 0.9), 1), 72) * 3600 AS s FROM pg GROUP BY usr"))
def gap_quantile_split(spark, sf_dir):
    rows = alerts(spark, sf_dir)
    th = sessions.quantile_gap(sessions.positive_gaps(rows, ["user"], "ts", "alert_id"), ["user"], 0.9)
    return sessions.split_by_threshold(rows, ["user"], "ts", "alert_id", th, 86400.0).select("alert_id", "session")


@query(_split_sql("""SELECT u.usr, coalesce(least(greatest(h * 0.95, 0.25), 72), 72) * 3600 AS s FROM (SELECT DISTINCT usr FROM pg) u LEFT JOIN
  (SELECT usr, coalesce(min_by(before, pos) FILTER (WHERE r >= 2.5), max_by(before, (r, -pos))) AS h FROM (SELECT usr, before, pos, gap_h / greatest(before, 1e-9) AS r FROM
    (SELECT usr, gap_h, lag(gap_h) OVER w AS before, row_number() OVER w AS pos FROM pg WHERE gap_h BETWEEN 0.25 AND 72 WINDOW w AS (PARTITION BY usr ORDER BY gap_h)) WHERE before IS NOT NULL) GROUP BY usr) e ON u.usr = e.usr"""))
def macro_elbow_split(spark, sf_dir):
    rows = alerts(spark, sf_dir)
    th = sessions.macro_elbow(sessions.positive_gaps(rows, ["user"], "ts", "alert_id"), ["user"])
    return sessions.split_by_threshold(rows, ["user"], "ts", "alert_id", th, 86400.0).select("alert_id", "session")


@query(_split_sql("SELECT DISTINCT usr, 14400 AS s FROM alerts"))
def fixed_gap_split(spark, sf_dir):
    return sessions.session_numbers(alerts(spark, sf_dir), ["user"], "ts", "alert_id", 4 * 3600).select("alert_id", "session")


@query()
def bayesian_blocks(spark, sf_dir):
    return sessions.bayesian_blocks(alerts(spark, sf_dir).select("user", "ts", "alert_id"), ["user"], "ts", "alert_id", 8.0)


@query(f"""{A}, e AS (SELECT min(epoch_us(ts) / 1e6) AS lo, max(epoch_us(ts) / 1e6) AS hi FROM alerts), t AS (SELECT alert_id, (epoch_us(ts) / 1e6 - lo) / (hi - lo) AS t FROM alerts, e)
SELECT alert_id, round(t, 6) AS t, round(sin(2 * pi() * t), 4) AS sin_1, round(cos(2 * pi() * t), 4) AS cos_1, round(sin(4 * pi() * t), 4) AS sin_2, round(cos(4 * pi() * t), 4) AS cos_2 FROM t""")
def time_features(spark, sf_dir):
    f = features.with_time_features(alerts(spark, sf_dir), harmonics=2)
    return f.select("alert_id", F.round("t", 6).alias("t"), *[F.round(c, 4).alias(c) for c in ("sin_1", "cos_1", "sin_2", "cos_2")])


@query(f"""{A} SELECT alert_id, array_to_string([CASE WHEN tactic = x THEN '1' ELSE '0' END FOR x IN (SELECT list(DISTINCT tactic ORDER BY tactic) FROM alerts)], '') AS bits FROM alerts""")
def one_hot(spark, sf_dir):
    rows = alerts(spark, sf_dir)
    words = features.vocabulary(rows, "tactic")
    return rows.select("alert_id", F.concat_ws("", F.transform(features.one_hot(F.col("tactic"), words), lambda x: x.cast("int").cast("string"))).alias("bits"))


@query(f"""{AE}, f AS (SELECT etype, entity, min(alert_id) AS a FROM entity GROUP BY 1, 2) SELECT etype, entity, CAST(row_number() OVER (PARTITION BY etype ORDER BY a, entity) - 1 AS BIGINT) AS "index" FROM f""")
def entity_index(spark, sf_dir):
    return features.entity_index(entities(alerts(spark, sf_dir)))


@query(f"{A} SELECT alert_id, CAST(ntile(4) OVER (ORDER BY ts, alert_id) - 1 AS BIGINT) AS fold FROM alerts")
def folds(spark, sf_dir):
    return features.folds(alerts(spark, sf_dir), ["ts", "alert_id"], 4).select("alert_id", "fold")


@query(f"""{A}, f AS (SELECT alert_id, severity, ntile(4) OVER (ORDER BY ts, alert_id) - 1 AS fold, alert_id IN (SELECT alert_id FROM truth) AS t FROM alerts),
m AS (SELECT fold, tactic, count(*) FILTER (WHERE f.severity >= 6 AND t) / greatest(1, count(*) FILTER (WHERE f.severity >= 6)) AS p FROM f JOIN alerts USING (alert_id) GROUP BY 1, 2)
SELECT tactic, round(avg(p), 6) AS mean, round(stddev_pop(p), 6) AS std, round(min(p), 6) AS min FROM m GROUP BY 1""")
def fold_aggregates(spark, sf_dir):
    rows = alerts(spark, sf_dir)
    f = features.folds(rows, ["ts", "alert_id"], 4).join(truth(rows).select("alert_id", F.lit(True).alias("t")), "alert_id", "left")
    p = F.count_if((F.col("severity") >= 6) & F.col("t").isNotNull()) / F.greatest(F.lit(1), F.count_if(F.col("severity") >= 6))
    out = evaluate.fold_aggregate(f.groupBy("fold", "tactic").agg(p.alias("p")), ["tactic"], "p")
    return out.select("tactic", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min")])


@query(f"""{A}, t AS (SELECT alert_id, CASE WHEN alert_id IN (SELECT alert_id FROM truth) THEN 1 ELSE 0 END AS label FROM alerts),
n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY (alert_id * 2654435761) % 1000003, alert_id) AS k, (SELECT count(*) FROM t WHERE label = 1) AS n1 FROM t)
SELECT alert_id, label FROM n WHERE k <= CASE WHEN label = 1 THEN 850 ELSE 1000 - least(n1, 850) END""")
def stratified_cap(spark, sf_dir):
    rows = alerts(spark, sf_dir)
    t = rows.select("alert_id").join(truth(rows).select("alert_id", F.lit(1).alias("label")), "alert_id", "left").fillna({"label": 0})
    return features.stratified_cap(t, "label", "alert_id", 1000)


@query(f"{A} SELECT alert_id FROM alerts ORDER BY ((alert_id + 7) * 2654435761) % 1000003, alert_id LIMIT 500")
def seeded_sample(spark, sf_dir):
    return features.sample_ids(alerts(spark, sf_dir).select("alert_id"), "alert_id", 500, 7)


@query(f"""{A}, n AS (SELECT alert_id, tactic, row_number() OVER (PARTITION BY tactic ORDER BY (alert_id * 2654435761) % 1000003, alert_id) AS k, count(*) OVER (PARTITION BY tactic) AS n FROM alerts)
SELECT alert_id, tactic, k <= floor(n * 0.8) AS is_train FROM n""")
def stratified_split(spark, sf_dir):
    return features.split_rows(alerts(spark, sf_dir), "tactic", "alert_id").select("alert_id", "tactic", "is_train")


@query(f"""{A} SELECT severity >= 8 AS high, tactic, count(*) AS count FROM alerts GROUP BY 1, 2""")
def error_histograms(spark, sf_dir):
    return evaluate.histogram(alerts(spark, sf_dir).withColumn("high", F.col("severity") >= 8), "high", "tactic")


@query(f"""{A}, n AS (SELECT usr, technique, count(*) AS count, row_number() OVER (PARTITION BY usr ORDER BY count(*) DESC, technique) AS place FROM alerts GROUP BY 1, 2)
SELECT usr AS user, technique, count, CAST(place AS BIGINT) AS place FROM n WHERE place <= 3""")
def top_names(spark, sf_dir):
    return evaluate.top_names(alerts(spark, sf_dir), "user", "technique", 3)


@query(f"""{A}, i AS (SELECT t.incident_id, count(*) AS alerts, count(s.alert_id) AS hits FROM truth t LEFT JOIN (SELECT alert_id FROM alerts WHERE severity >= 9) s ON t.alert_id = s.alert_id GROUP BY 1)
SELECT incident_id, alerts FROM i WHERE hits = 0 ORDER BY alerts DESC, incident_id LIMIT 12""")
def top_missed_incidents(spark, sf_dir):
    rows = alerts(spark, sf_dir)
    return evaluate.missed_incidents(truth(rows), rows.filter("severity >= 9"))


@query(f"""{ARE}, {BIG_SQL}, g AS (SELECT cluster, count(*) AS size, count(*) FILTER (WHERE alert_id NOT IN (SELECT alert_id FROM truth)) AS fp FROM c GROUP BY 1)
SELECT cluster, size, fp, size - fp AS tp, CASE WHEN size = fp THEN 'fp_only' ELSE 'mixed' END AS kind FROM g WHERE fp > 0 ORDER BY fp DESC, size DESC, cluster LIMIT 12""")
def cluster_examples(spark, sf_dir, severity=None):
    return evaluate.false_positive_clusters(big_clusters(spark, sf_dir, severity=severity).select("cluster", "alert_id"), truth(alerts(spark, sf_dir)))


VARIANT_SQL = """vr(variant, least) AS (VALUES ('all', 0), ('severity_6', 6), ('severity_9', 9), ('severity_10', 10)),
vm AS (SELECT variant, count(*) FILTER (WHERE alert_id IN (SELECT alert_id FROM truth)) AS tp, count(*) AS sel FROM vr JOIN alerts ON severity >= least GROUP BY 1),
vx AS (SELECT variant, tp, sel, tp / sel AS p, tp / (SELECT count(DISTINCT alert_id) FROM truth) AS r FROM vm)"""


@query(f"""{A}, {VARIANT_SQL} SELECT variant, tp, sel - tp AS fp, round(p, 6) AS precision, round(r, 6) AS recall, round(p - (SELECT p FROM vx WHERE variant = 'all'), 6) AS delta_precision, round(r - (SELECT r FROM vx WHERE variant = 'all'), 6) AS delta_recall FROM vx""")
def ablation_variants(spark, sf_dir):
    rows = alerts(spark, sf_dir)
    marked = rows.join(truth(rows).select("alert_id", F.lit(1).alias("t")), "alert_id", "left")
    variants = F.explode(F.filter(F.array(*[F.when(F.col("severity") >= least, F.lit(v)) for v, least in (("all", 0), ("severity_6", 6), ("severity_9", 9), ("severity_10", 10))]), lambda x: x.isNotNull()))
    total = marked.agg(F.count("t").alias("truth"))
    m = marked.select(variants.alias("variant"), "t").groupBy("variant").agg(F.count("t").alias("tp"), F.count(F.lit(1)).alias("sel")).crossJoin(F.broadcast(total))
    m = m.select("variant", *evaluate.metric_columns(F.col("tp"), F.col("sel"), F.col("truth")))
    d = evaluate.with_deltas(m, "all", ["precision", "recall"])
    return d.select("variant", "tp", "fp", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "delta_precision", "delta_recall")])


@query("SELECT CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS added")
def leakage_audit(spark, sf_dir):
    """The blind run, in which label columns don't exist, must find the same clusters as the labelled one (QRY-06)."""
    rows = severe(spark, sf_dir, None)
    labelled = rows.join(truth(rows), "alert_id", "left")
    return evaluate.same_rows(entity_components(labelled.dropDuplicates(["alert_id"])), entity_components(rows.select("alert_id", "ts", "user", "host", "target")))


@query(f"""{A}, i AS (SELECT incident_id, count(*) AS n FROM truth GROUP BY 1), k AS (SELECT incident_id, row_number() OVER (ORDER BY n DESC, incident_id) AS class FROM i)
SELECT alert_id, CAST(max(class) AS INTEGER) AS class FROM truth JOIN k USING (incident_id) GROUP BY 1""")
def incident_classes(spark, sf_dir):
    return joins.incident_classes(truth(alerts(spark, sf_dir)))


@query(f"""{A}, t AS (SELECT alert_id, tactic, host, usr FROM alerts)
SELECT alert_id, tactic || ' by ' || usr || ' on ' || host AS summary FROM t""")
def alert_summaries(spark, sf_dir, severity=None):
    r = severe(spark, sf_dir, severity)
    return r.select("alert_id", F.concat("tactic", F.lit(" by "), "user", F.lit(" on "), "host").alias("summary"))


@query(f"""{ARE}, {BIG_SQL} SELECT cluster, 'from ' || arg_min(tactic, (ts, alert_id)) || ' on ' || arg_min(host, (ts, alert_id)) || ' to ' || arg_max(tactic, (ts, alert_id)) || ' on ' || arg_max(host, (ts, alert_id)) AS narrative FROM c GROUP BY 1""")
def incident_narratives(spark, sf_dir, severity=None):
    """First and last alert of each cluster as a sentence (MAP-16)."""
    at, row = F.struct("ts", "alert_id"), F.struct("tactic", "host")
    g = big_clusters(spark, sf_dir, severity=severity).groupBy("cluster").agg(F.min_by(row, at).alias("a"), F.max_by(row, at).alias("b"))
    return g.select("cluster", F.concat(F.lit("from "), "a.tactic", F.lit(" on "), "a.host", F.lit(" to "), "b.tactic", F.lit(" on "), "b.host").alias("narrative"))


@query(f"""{A} SELECT usr AS user, arg_max(host, ts) AS host, arg_max(tactic, ts) AS tactic, max(ts) AS ts FROM alerts GROUP BY 1""")
def upsert_latest(spark, sf_dir):
    rows = alerts(spark, sf_dir).select("user", "host", "tactic", "ts")
    half = rows.filter("ts < timestamp'2024-01-15'")
    return gate.upsert(half, rows.filter("ts >= timestamp'2024-01-15'"), "user", "ts")


@query(f"""{AE}, q AS (SELECT DISTINCT alert_id, ts, entity FROM entity WHERE alert_id IN (SELECT alert_id FROM truth)),
p AS (SELECT DISTINCT x.alert_id AS a, y.alert_id AS b, (epoch_us(y.ts) - epoch_us(x.ts)) AS g FROM q x JOIN q y ON x.entity = y.entity AND (x.ts, x.alert_id) < (y.ts, y.alert_id) AND epoch_us(y.ts) - epoch_us(x.ts) <= 21600000000),
n AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY g, b) AS k FROM p) SELECT a, b FROM n WHERE k <= 8""")
def weak_positive_pairs(spark, sf_dir):
    rows = alerts(spark, sf_dir)
    train = truth(rows).select("alert_id", F.lit(1).alias("label"))
    return joins.weak_positives(entities(rows, "ts"), train)
