"""Queries over documents, conversations, labels, embeddings, orders, and streams of events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ridgeline.functions import constants as K
from ridgeline.functions import scalars as S
from ridgeline.operators import evaluate, features, gate, joins, learning, similarity
from ridgeline.operators.tables import materialize, scratch
from ridgeline.plans import alert_queries as Q
from ridgeline.plans.alerts import SQL, alerts, truth
from ridgeline.plans.registry import query
from ridgeline.streaming.gate import replay, stream_gate


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tag_sql() -> str:
    cases = [f"CASE WHEN {' OR '.join(f'contains(t, $${w}$$)' for w in words)} THEN '{kind}' END" for kind, words in K.KIND_WORDS.items()]
    return f"SELECT doc_id, array_to_string(list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL), ',') AS tags FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)"


@query(_tag_sql())
def keyword_tags(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(",", S.attack_tags(S.row_text("text"))).alias("tags"))


@query("SELECT doc_id, regexp_replace(regexp_replace(lower(trim(coalesce(text, ''))), '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS token FROM documents")
def token_norm(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.normalize_token(F.coalesce("text", F.lit(""))).alias("token"))


@query(r"""SELECT conv_id, turn, len(regexp_extract_all(coalesce(text, ''), 'https?://[^\s`''"]+')) AS links, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS mails,
  len(regexp_extract_all(coalesce(text, ''), '`([^`]+)`')) AS quoted FROM conversations""")
def answer_patterns(spark, sf_dir):
    n = lambda i: F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(K.ANSWER_PATTERNS[i]), F.lit(1))).cast("long")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", n(2).alias("links"), n(3).alias("mails"), n(0).alias("quoted"))


_STRIP = K.ANSWER_STRIP.replace("'", "''")
_FOUND = " || ".join(f"regexp_extract_all(coalesce(text, ''), '{p.replace(chr(39), chr(39) * 2)}', 1)" for p in K.ANSWER_PATTERNS)


@query(rf"""WITH c AS (SELECT conv_id, turn, list_filter(list_transform({_FOUND}, lambda v: trim(trim(v), '{_STRIP}')), lambda v: v <> '') AS c FROM conversations)
SELECT conv_id, turn, CAST(len(list_distinct(list_transform(c, lambda v: lower(v)))) AS INTEGER) AS candidates,
  coalesce(list_filter(c, lambda v: regexp_matches(v, '{K.ANSWER_KINDS[2][1]}'))[1], c[1], '') AS answer FROM c""")
def answer_candidates(spark, sf_dir):
    c = S.answer_candidates(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(c).alias("candidates"), S.extract_answer(F.lit("which email address"), c).alias("answer"))


@query(r"""SELECT c.conv_id, c.turn, trim(regexp_replace(lower(coalesce(c.text, '')), '\s+', ' ', 'g')) <> '' AND contains(trim(regexp_replace(lower(coalesce(n.text, '')), '\s+', ' ', 'g')), trim(regexp_replace(lower(coalesce(c.text, '')), '\s+', ' ', 'g'))) AS contained
FROM conversations c JOIN conversations n ON c.conv_id = n.conv_id AND n.turn = c.turn + 1""")
def contains_answer(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    hit = (S.squeeze(F.col("text")) != "") & S.squeeze(F.col("next")).contains(S.squeeze(F.coalesce("text", F.lit(""))))
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", hit.alias("contained"))


@query("""SELECT conv_id, turn, CASE WHEN t LIKE '%powershell%' OR t LIKE '%command%' THEN 'command_and_control' WHEN t LIKE '%password spray%' OR t LIKE '%sign-in%' OR t LIKE '%login%' THEN 'credential_access'
  WHEN t LIKE '%lateral%' OR t LIKE '%smb%' THEN 'lateral_movement' WHEN t LIKE '%exfiltration%' OR t LIKE '%inbox%' OR t LIKE '%bec%' THEN 'data_exfiltration' ELSE 'privilege_escalation' END AS kind
FROM (SELECT conv_id, turn, lower(coalesce(text, '')) AS t FROM conversations)""")
def question_kinds(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", S.question_kind(F.coalesce("text", F.lit(""))).alias("kind"))


SCORE_SQL = "sc AS (SELECT l.doc_id, l.quality AS label, CAST(floor(sqrt(d.n_chars)) AS BIGINT) AS score FROM labels l JOIN documents d USING (doc_id))"


def scored(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.sqrt("n_chars")).cast("long").alias("score"))
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).join(docs, "doc_id")


@query(f"""WITH {SCORE_SQL}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM sc),
p AS (SELECT count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM sc)
SELECT round((sum(r) FILTER (WHERE label = 1) - any_value(p.p) * (any_value(p.p) + 1) / 2) / (any_value(p.p) * any_value(p.n)), 6) AS auc FROM r, p""")
def roc_auc(spark, sf_dir):
    return evaluate.roc_auc(scored(spark, sf_dir)).select(F.round("auc", 6).alias("auc"))


@query(f"""WITH {SCORE_SQL}, d AS (SELECT DISTINCT score FROM sc), k AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS k, count(*) OVER () AS n FROM d),
t AS (SELECT score FROM k WHERE k % greatest(1, CAST(ceil(n / 256) AS BIGINT)) = 0),
m AS (SELECT t.score, 2 * count(*) FILTER (WHERE sc.score >= t.score AND label = 1) / (count(*) FILTER (WHERE sc.score >= t.score) + count(*) FILTER (WHERE label = 1)) AS f1 FROM t, sc GROUP BY t.score)
SELECT arg_max(score, (f1, -score)) AS threshold, round(max(f1), 6) AS f1 FROM m""")
def best_threshold(spark, sf_dir):
    return evaluate.best_threshold(scored(spark, sf_dir)).select("threshold", F.round("f1", 6).alias("f1"))


COSINE = 0.35
PAIRS_SQL = f"""v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), pr AS (SELECT x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(x.e, y.e) AS cosine FROM v x JOIN v y ON x.vec_id < y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= {COSINE})"""


@query(f"WITH {PAIRS_SQL} SELECT a, b, round(cosine, 5) AS cosine FROM pr")
def cosine_pairs(spark, sf_dir):
    return similarity.cosine_pairs(table(spark, sf_dir, "embeddings"), COSINE).select("a", "b", F.round("cosine", 5).alias("cosine"))


@query(f"""WITH RECURSIVE {PAIRS_SQL}, l AS (SELECT a, b FROM pr UNION SELECT b, a FROM pr), r AS (SELECT a, a AS b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a), m AS (SELECT a AS vec_id, min(b) AS cluster FROM r GROUP BY a)
SELECT v.vec_id, cluster FROM v LEFT JOIN m ON v.vec_id = m.vec_id""")
def dbscan_clusters(spark, sf_dir):
    return similarity.dbscan(table(spark, sf_dir, "embeddings"), 1 - COSINE, 2)


@query(f"""WITH RECURSIVE {PAIRS_SQL}, l AS (SELECT a, b FROM pr UNION SELECT b, a FROM pr), k AS (SELECT a FROM l GROUP BY a HAVING count(*) >= 2), cl AS (SELECT l.a, l.b FROM l WHERE a IN (SELECT a FROM k) AND b IN (SELECT a FROM k)),
r AS (SELECT a, a AS b FROM k UNION SELECT r.a, cl.b FROM r JOIN cl ON r.b = cl.a), m AS (SELECT a AS vec_id, min(b) AS cluster FROM r GROUP BY a),
f AS (SELECT * FROM m UNION ALL SELECT l.a, min(m.cluster) FROM l JOIN m ON l.b = m.vec_id WHERE l.a NOT IN (SELECT a FROM k) GROUP BY l.a)
SELECT v.vec_id, cluster FROM v LEFT JOIN f ON v.vec_id = f.vec_id""")
def dbscan_dense_clusters(spark, sf_dir):
    return similarity.dbscan(table(spark, sf_dir, "embeddings"), 1 - COSINE, 3)


@query("""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), u AS (SELECT label, unnest(generate_series(1, len(e))) AS i, unnest(e) AS x FROM v),
m AS (SELECT label, list(x ORDER BY i) AS m FROM (SELECT label, i, avg(x) AS x FROM u GROUP BY 1, 2) GROUP BY label), s AS (SELECT vec_id, m.label, list_cosine_similarity(e, m.m) AS c FROM v, m)
SELECT vec_id, arg_max(label, (c, -label)) AS match, round(max(c), 5) AS cosine FROM s GROUP BY 1""")
def centroid_assign(spark, sf_dir):
    return similarity.assign_prototypes(table(spark, sf_dir, "embeddings")).select("vec_id", "match", F.round("cosine", 5).alias("cosine"))


@query("""WITH a AS (SELECT DISTINCT o_custkey AS c FROM orders WHERE o_totalprice > 200000), b AS (SELECT DISTINCT o_custkey AS c FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT 'both' AS op, count(*) AS n FROM (SELECT c FROM a INTERSECT SELECT c FROM b) UNION ALL SELECT 'only_a', count(*) FROM (SELECT c FROM a EXCEPT SELECT c FROM b)
UNION ALL SELECT 'only_b', count(*) FROM (SELECT c FROM b EXCEPT SELECT c FROM a) UNION ALL SELECT 'either', count(*) FROM (SELECT c FROM a UNION SELECT c FROM b)""")
def set_ops(spark, sf_dir):
    """Intersection, differences and union of two id sets from one aggregate instead of four set operations (SET-01..03, 05)."""
    o = table(spark, sf_dir, "orders")
    marks = o.groupBy("o_custkey").agg(F.coalesce(F.bool_or(F.col("o_totalprice") > 200000), F.lit(False)).alias("a"), F.coalesce(F.bool_or(F.col("o_orderpriority") == "1-URGENT"), F.lit(False)).alias("b"))
    a, b = F.col("a"), F.col("b")
    n = marks.agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"), F.count_if(a | b).alias("either"))
    return n.unpivot([], ["both", "only_a", "only_b", "either"], "op", "n")


@query("""SELECT o.o_orderkey, max(p.o_orderkey) AS previous FROM orders o LEFT JOIN (SELECT o_custkey, o_orderkey, o_orderdate FROM orders) p ON o.o_custkey = p.o_custkey AND (p.o_orderdate, p.o_orderkey) = (SELECT max((q.o_orderdate, q.o_orderkey)) FROM orders q WHERE q.o_custkey = o.o_custkey AND (q.o_orderdate, q.o_orderkey) < (o.o_orderdate, o.o_orderkey)) GROUP BY 1""")
def previous_order(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("previous"))


@query("""SELECT n_name, c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def order_histogram(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("k"), F.sum("o_totalprice").alias("s"))
    j = per.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name", "c_mktsegment").agg(F.sum("k").alias("orders"), F.round(F.sum("s"), 2).alias("total"))


def gate_stream(spark, sf_dir, batches: int = 10):
    """(decisions, statistics) of the gate over the events as a stream of ``batches`` micro-batches in order of time."""
    attack = F.col("tactic").isin("Lateral Movement", "Exfiltration") & (F.col("severity") >= 3)
    rows = alerts(spark, sf_dir).select("alert_id", gate.relationship_key(F.col("user"), F.col("host"), F.col("tactic"), F.lit("observed")).alias("rel_key"), "ts", "severity", attack.alias("attack"))
    feed = materialize(rows.repartitionByRange(batches, "ts", "alert_id").withColumn("batch", F.spark_partition_id()), "feed")
    source = scratch(spark, "stream-in")
    for i in range(batches):  # a stream reads files as they came, so later alerts are written later
        feed.filter(F.col("batch") == i).drop("batch").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(feed.drop("batch").schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = scratch(spark, "stream-out")
    told = replay(stream_gate(stream), out, scratch(spark, "stream-state"))
    return spark.read.parquet(out), told


@query(f"WITH {SQL}, {Q.GATE_SQL} SELECT alert_id, seen, reason, reason IN ('high_severity', 'attack_topology', 'rare_relationship') AS store FROM g")
def stream_gate_replay(spark, sf_dir):
    """The gate as a stream of ten micro-batches, counts carried from one to the next; its rows must be those of the batch gate."""
    return gate_stream(spark, sf_dir)[0].select("alert_id", "seen", "reason", "store")


@query(f"""WITH {SQL}, {Q.GATE_SQL} SELECT count(*) AS processed, count(*) FILTER (WHERE reason IN ('high_severity', 'attack_topology', 'rare_relationship')) AS stored FROM g""")
def stream_statistics(spark, sf_dir):
    """What the micro-batches reported while they ran, added up (STR-03)."""
    return gate_stream(spark, sf_dir, 4)[1].agg(F.sum("processed").alias("processed"), F.sum("stored").alias("stored"))


@query(f"""WITH {SQL}, s AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 7200000000 THEN 0 ELSE 1 END AS cut FROM alerts WINDOW w AS (PARTITION BY usr ORDER BY ts, alert_id)),
n AS (SELECT *, sum(cut) OVER (PARTITION BY usr ORDER BY ts, alert_id) AS k FROM s) SELECT usr AS user, min(ts) AS start, count(*) AS alerts, max(severity) AS max_severity FROM n GROUP BY usr, k""")
def session_windows(spark, sf_dir):
    g = alerts(spark, sf_dir).groupBy("user", F.session_window("ts", "120 minutes").alias("w")).agg(F.count(F.lit(1)).alias("alerts"), F.max("severity").alias("max_severity"))
    return g.select("user", F.col("w.start").alias("start"), "alerts", "max_severity")


@query()
def triage_metrics(spark, sf_dir):
    """Smoothed features and a linear model on the alert graph, with metrics of the held-out rows (QRY-16)."""
    rows = alerts(spark, sf_dir)
    labelled = rows.join(truth(rows).select("alert_id", F.lit(1).alias("label")), "alert_id", "left").fillna({"label": 0})
    ents = Q.entities(rows, "ts").select("alert_id", "ts", "etype", "entity")
    x, names = learning.graph_features(labelled, ents)
    split = materialize(features.split_rows(x, "label", "alert_id"), "features")
    out = learning.triage(split, names).filter("not is_train").select("alert_id", "label", F.col("probability").alias("score"), "prediction")
    m = evaluate.selection_metrics(out.filter("prediction = 1"), out.filter("label = 1"))
    return m.crossJoin(evaluate.roc_auc(out))


@query()
def anomaly_scores(spark, sf_dir):
    """Reconstruction error and distance to the benign mean for every alert (ML-05, ML-06)."""
    rows = alerts(spark, sf_dir)
    labelled = rows.join(truth(rows).select("alert_id", F.lit(1).alias("label")), "alert_id", "left").fillna({"label": 0})
    x, names = learning.feature_columns(labelled, Q.entities(rows, "ts"))
    split = materialize(features.split_rows(x, "label", "alert_id"), "features")
    a = learning.reconstruction_error(split, names).select("alert_id", F.round("anomaly", 6).alias("reconstruction"))
    b = learning.benign_distance(split, names).select("alert_id", F.round("anomaly", 6).alias("distance"))
    return a.join(b, "alert_id")


@query("SELECT path, count(*) AS count FROM (SELECT unnest(json_keys(CAST(props AS JSON))) AS path FROM events WHERE json_valid(props)) GROUP BY 1")
def schema_paths(spark, sf_dir):
    """Keys of the events' JSON, counted (SCH-02)."""
    v = F.try_parse_json("props")
    keys = F.json_object_keys(F.to_json(v))
    return table(spark, sf_dir, "events").select(F.explode(keys).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("count"))


@query()
def relationship_sketch(spark, sf_dir):
    """A count-min sketch of relationships; its estimates are never under the exact counts (AGG-01)."""
    return gate.sketch_counts(Q.gated(spark, sf_dir), "rel_key").select(F.length("sketch").alias("bytes"))


_DRAWN = "CAST('0x' || substr(md5(a.alert_id || ':{}'), 1, 8) AS BIGINT)"


@query(f"""WITH {SQL}, {Q.ENTITY_SQL}, n AS (SELECT greatest(1, count(*) // 512) AS n FROM alerts), o AS (SELECT alert_id, list(DISTINCT entity) AS e FROM entity GROUP BY 1),
l AS (SELECT a.alert_id, ts, tactic, a.alert_id IN (SELECT alert_id FROM truth) AS bad, e, {_DRAWN.format(3)} AS h3, {_DRAWN.format(4)} AS h4 FROM alerts a JOIN o ON a.alert_id = o.alert_id),
p AS (SELECT x.alert_id AS a, y.alert_id AS b, row_number() OVER (PARTITION BY x.alert_id ORDER BY y.h3, y.alert_id) AS k FROM n, l x JOIN l y ON x.bad AND x.alert_id <> y.alert_id WHERE x.h3 % n = y.h4 % n
  AND (NOT y.bad OR (abs(epoch_us(x.ts) - epoch_us(y.ts)) >= 86400000000 AND x.tactic <> y.tactic)) AND NOT list_has_any(x.e, y.e))
SELECT a, b FROM p WHERE k <= 16""")
def random_negatives(spark, sf_dir):
    rows = alerts(spark, sf_dir)
    t = truth(alerts(spark, sf_dir)).select("alert_id", F.lit(1).alias("label"))
    labelled = rows.join(t, "alert_id", "left").fillna({"label": 0})
    return joins.weak_negatives(labelled, Q.entities(rows).select("alert_id", "entity"), 3)
