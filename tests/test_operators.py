"""Operators against hand-worked values and brute force."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.functions import constants as K
from ridgeline.functions import scalars as S
from ridgeline.operators import components, evaluate, features, gate, joins, learning, scoring, sequence, sessions, similarity

T0 = dt.datetime(2026, 1, 1, 10)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def one(spark, *columns, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(*columns).first() if values else spark.range(1).select(*columns).first()


# --- scalars ---------------------------------------------------------------------------------------------------------
def test_severities(spark):
    words = ["High", " medium", "low", "Informational", "critical", "7.9", "-3", "99", "", None, "nan"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(S.severity_sentinel("w")).collect()] == [9, 6, 4, 2, 1, 7, 0, 10, 1, 1, 1]
    assert [r[0] for r in df.select(S.severity_falcon("w")).collect()] == [9, 6, 3, 2, 10, 1, 1, 1, 1, 1, 1]
    assert [r[0] for r in df.select(S.severity_unit("w")).collect()] == [0.75, 0.5, 0.25, 0.1, 1.0, 0.5, 0.5, 0.5, 0.5, 0.0, 0.5]
    assert one(spark, S.severity_unit(F.lit("x"), F.lit(250.0)))[0] == 1.0


def test_tokens_and_texts(spark):
    r = one(spark, S.normalize_token(F.lit(" A-b  Ç!c_ ")), S.normalize_token_unicode(F.lit(" A-b  Ç!c_ ")), S.first_text(F.lit("  "), F.lit(None), F.lit(" x ")), S.first_truthy(F.lit(""), F.lit(0), F.lit("y")), S.truthy(F.lit(" Yes")), S.truthy(F.lit("no")), S.bounded(F.lit("1.7")), S.bounded(F.lit("x")), S.numeric_suffix(F.lit("INC-12")), S.numeric_suffix(F.lit("INC")))
    assert tuple(r) == ("a_b_c", "a_b_ç_c", "x", "y", True, False, 1.0, 0.0, 12, 10**9)
    r = one(spark, S.label_binary(F.lit("Malicious!")), S.label_binary(F.lit("False Positive")), S.label_binary(F.lit("odd")), S.title(F.lit("lateral_movement")), S.scenario_of(F.lit("/d/fox_aminer.json")), S.attack_day(F.lit("x-Friday-am")), S.attack_day(F.lit("Other")), S.escape_cell(F.lit("a|b\nc")))
    assert tuple(r) == (1, 0, None, "Lateral Movement", "fox", "friday", "Other", "a\\|b c")


def test_tags_and_kinds(spark):
    text = S.row_text(F.lit("PowerShell encodedcommand"), F.lit(None), F.lit("Password spray from C2"))
    r = one(spark, S.attack_tags(text), S.infer_kind(S.attack_tags(text), F.lit("n")), S.infer_kind(F.array().cast("array<string>"), F.lit("New Name!")))
    assert sorted(r[0]) == ["command_and_control", "credential_access", "execution"] and r[1:] == ("credential_access", "new_name")
    assert one(spark, S.matches_attack_kind(F.lit("Execution"), F.lit("x"), F.array(F.lit("y"))))[0] is True


def test_ids_and_entities(spark):
    u = "12345678-1234-1234-1234-1234567890ab"
    r = one(spark, S.parse_ids(F.lit(f'["a", "", "b", "a"]')), S.parse_ids(F.lit(f"x {u}, {u}")), S.parse_ids(F.lit(None)))
    assert list(r) == [["a", "b"], [u], []]
    payload = '[{"Type":"Account","Name":"Bob","Sid":"S"},{"$ref":"1"},{"Type":"host","HostName":"none","FQDN":"H1"},{"Type":"ip","Address":"1.2.3.4"},{"Type":"account","Name":"BOB"},{"Type":"odd"}]'
    e = one(spark, S.entities_from_json(F.lit(payload), (F.lit("H1"), "host"), (F.lit("res"), "service")))[0]
    assert [x.id for x in e] == ["user:bob", "host:h1", "ip:1.2.3.4", "service:res"] and e[0].value == "Bob"
    assert one(spark, S.entities_from_json(F.lit("broken")))[0] == []
    assert one(spark, S.cluster_entities(F.array(F.lit("service:s1"), F.lit("ip:x")), F.lit(" S1")))[0] == ["ip:x"]


def test_times(spark):
    r = one(spark, S.parse_time(F.lit("bad"), F.lit("2026-01-02T03:04:05Z")), S.epoch_seconds(F.lit("2026-01-01T00:00:00.5Z")), S.epoch_guess(F.lit("1767225600000")), S.epoch_guess(F.lit("1767225600")), S.parse_day(F.lit("01/31/2026")), S.parse_day(F.lit("20260131")))
    assert r[0] == dt.datetime(2026, 1, 2, 3, 4, 5) and r[1] == 1767225600.5 and r[2] == r[3] == dt.datetime(2026, 1, 1) and r[4] == r[5] == dt.date(2026, 1, 31)


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_lcs_ratio(spark):
    rng = random.Random(1)
    chain = K.ATTACK_CHAINS[0]
    seqs = [[rng.choice([*chain, "other"]) for _ in range(rng.randrange(9))] for _ in range(40)]
    got = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "i int, s array<string>").select(S.lcs_ratio(F.col("s"), chain)).collect()
    assert [g[0] for g in got] == pytest.approx([lcs(s, chain) / len(chain) for s in seqs])


def test_answers(spark):
    text = "see `host-1`, mail bob@x.org or http://a.b/c, ip 203.0.113.77. `HOST-1`"
    c = S.answer_candidates(F.lit(text))
    r = one(spark, c, S.extract_answer(F.lit("Which IP address?"), c), S.extract_answer(F.lit("what url"), c), S.extract_answer(F.lit("which user"), c), S.extract_answer(F.lit("why"), c), S.contains_answer(F.lit("The  Answer\nis 4"), F.lit("answer IS")))
    assert r[0] == ["host-1", "203.0.113.77", "http://a.b/c", "bob@x.org"] and tuple(r[1:]) == ("203.0.113.77", "http://a.b/c", "bob@x.org", "host-1", True)
    assert one(spark, S.extract_answer(F.lit("ip address"), S.answer_candidates(F.lit(""))))[0] == ""
    assert one(spark, S.answer_question(F.lit("q"), F.lit("it is X"), F.lit("x"), "gold_if_present"))[0] == "x"
    assert one(spark, F.variant_get(S.json_payload(F.lit('say {"a": 3} end')), "$.a", "int"))[0] == 3


# --- gate ------------------------------------------------------------------------------------------------------------
def test_gate_rules(spark):
    rows = [("a", 9, 0, False), ("b", 1, 10_001, True), ("c", 1, 10_000, True), ("d", 5, 3, False), ("e", 5, 4, False), ("f", 4, 0, False)]
    df = spark.createDataFrame(rows, "id string, severity int, seen long, attack boolean")
    got = [r[0] for r in df.select(gate.decide(F.col("severity"), F.col("seen"), F.col("attack"))).collect()]
    assert got == ["high_severity", "baseline_too_common", "attack_topology", "rare_relationship", "not_interesting", "not_interesting"]


def test_mock_stream_selectivity_and_rarity(spark):
    rows = spark.range(10_000).select(F.col("id").alias("alert_id"), F.lit("k").alias("rel_key"), F.when(F.col("id") % 10 == 0, 9).otherwise(1).alias("severity"))
    stats = gate.processing_stats(gate.gate(rows, "rel_key", ["alert_id"], F.lit(False)), 2.0).first()
    assert (stats.processed, stats.stored, stats.stored_ratio, stats.alerts_per_second) == (10_000, 1_000, 0.1, 5_000.0)
    seen = [r[0] for r in spark.range(5).select(F.lit("k").alias("k"), "id").select(gate.seen_before("k", ["id"])).collect()]
    assert seen == [0, 1, 2, 3, 4] and [s <= 3 for s in seen] == [True, True, True, True, False]


def test_seeded_baseline_and_decisions_per_id(spark):
    rows = spark.createDataFrame([(1, "k", 1, 0), (2, "k", 9, 1)], "alert_id int, rel_key string, severity int, seq int")
    base = spark.createDataFrame([("k", 10_001)], "rel_key string, seeded long")
    got = gate.gate(rows, "rel_key", ["seq"], F.lit(True), base).orderBy("seq").collect()
    assert [(r.reason, r.store) for r in got] == [("baseline_too_common", False), ("high_severity", True)]
    d = spark.createDataFrame([("x", 1, False, "a", 0), ("x", 2, True, "b", 1), ("x", 3, True, "c", 2), ("y", 4, False, "d", 0), ("y", 5, False, "e", 1)], "alert_id string, seq int, store boolean, reason string, seen long")
    assert {r.alert_id: r.reason for r in gate.first_or_stored(d, ["seq"]).collect()} == {"x": "b", "y": "d"}
    assert {r.alert_id: r.reason for r in gate.last_decision(d, ["seq"]).collect()} == {"x": "c", "y": "e"}


def test_upsert_keeps_the_latest(spark):
    a = spark.createDataFrame([("k", 1, "old"), ("m", 1, "m")], "id string, seq int, v string")
    b = spark.createDataFrame([("k", 2, "new")], "id string, seq int, v string")
    assert {r.id: r.v for r in gate.upsert(a, b, "id", "seq").collect()} == {"k": "new", "m": "m"}


# --- sessions and components -----------------------------------------------------------------------------------------
def union_find(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def timed(spark, rng, n=60, keys=4, span=40_000):
    rows = [(i, f"e{rng.randrange(keys)}", at(rng.randrange(span) / 3600) if rng.random() > 0.05 else None, rng.randrange(1, 11)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "alert_id int, entity string, ts timestamp, severity int")


def test_gap_links_have_the_components_of_all_pairs(spark):
    rng = random.Random(3)
    for nulls in (False, True):
        rows, df = timed(spark, rng)
        links = [(r.a, r.b) for r in sessions.gap_links(df, ["entity"], "ts", "alert_id", 900, nulls).collect()]
        near = lambda x, y: (x[2] and y[2] and abs((x[2] - y[2]).total_seconds()) <= 900) or (nulls and (x[2] is None or y[2] is None))
        pairs = [(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[1] == y[1] and near(x, y)]
        if not nulls:
            assert union_find(60, links) == union_find(60, pairs)
        assert set(map(tuple, map(sorted, links))) <= set(pairs) or nulls


def test_severity_sessions_equal_all_pairs(spark):
    rng = random.Random(5)
    for _ in range(3):
        rows, df = timed(spark, rng, 80)
        rows = [r for r in rows if r[2]]
        got = sessions.severity_sessions(df.filter("ts is not null"), ["entity"], "ts", "alert_id", "severity").collect()
        by = {}
        for r in got:
            by.setdefault((r.entity, r.session), set()).add(r.alert_id)
        gap = lambda x, y: abs((x[2] - y[2]).total_seconds())
        pairs = [(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[1] == y[1] and gap(x, y) <= 7200 and max(x[3], y[3]) / math.log(gap(x, y) + 2) >= 0.70]
        root = union_find(80, pairs)
        want = {}
        for r in rows:
            want.setdefault((r[1], root[r[0]]), set()).add(r[0])
        assert sorted(map(sorted, by.values())) == sorted(map(sorted, want.values()))


def test_gap_stars_have_the_components_of_gap_links(spark):
    rng = random.Random(4)
    for nulls in (False, True):
        rows, df = timed(spark, rng)
        stars = [(r.a, r.b) for r in sessions.gap_stars(df, ["entity"], "ts", "alert_id", 900, nulls).collect()]
        links = [(r.a, r.b) for r in sessions.gap_links(df, ["entity"], "ts", "alert_id", 900, nulls).collect()]
        assert stars and union_find(60, stars) == union_find(60, links)
    # one run of a busy key is a star, not a path as long as the run
    run = spark.createDataFrame([(i, at(i / 10), "k") for i in range(50)], "alert_id int, ts timestamp, k string")
    assert {r.a for r in sessions.gap_stars(run, ["k"], "ts", "alert_id", 900).collect()} == {0}
    assert {r.a for r in sessions.session_links(run.withColumn("session", F.lit(0)), ["k"], "alert_id", ["ts", "alert_id"]).collect()} == {0}


def test_severity_sessions_take_no_frame_anew_for_each_row(spark):
    n = 40_000
    rows = spark.range(n).select(F.col("id").alias("alert_id"), F.timestamp_seconds(F.col("id") * 3).alias("ts"), F.lit("h").alias("entity"), F.lit(5).alias("severity"))
    got = sessions.severity_sessions(rows, ["entity"], "ts", "alert_id", "severity")
    plan = got._jdf.queryExecution().executedPlan().toString().lower()
    assert "windowspecdefinition" in plan and "unboundedfollowing" not in plan
    assert got.agg(F.max("session"), F.count("*")).first() == (0, n)


def test_session_numbers_keep_rows_without_time(spark):
    df = spark.createDataFrame([(1, "k", at(0)), (2, "k", at(2)), (3, "k", at(5)), (4, "k", None)], "id int, k string, ts timestamp")
    got = {r.id: r.session for r in sessions.session_numbers(df, ["k"], "ts", "id", 2 * 3600).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 1}


def test_macro_elbow_sizes(spark):
    hours = np.cumsum([0, 0.5, 0.6, 1, 1.5, 2.5, 4.8, 0.5, 14, 0.5])
    df = spark.createDataFrame([(i, "g", at(float(h))) for i, h in enumerate(hours)], "id int, g string, ts timestamp")
    gaps = sessions.positive_gaps(df, ["g"], "ts", "id")
    th = sessions.macro_elbow(gaps, ["g"])
    assert th.first().threshold_s == pytest.approx(4.8 * 0.95 * 3600)
    out = sessions.split_by_threshold(df, ["g"], "ts", "id", th, 86400.0).groupBy("session").count().orderBy("session").collect()
    assert [r["count"] for r in out] == [6, 2, 2]
    q = sessions.quantile_gap(gaps, ["g"], 0.9).first().threshold_s
    assert q == pytest.approx(np.quantile([0.5, 0.6, 1, 1.5, 2.5, 4.8, 0.5, 14, 0.5], 0.9) * 3600)


def test_bayesian_blocks_place_every_row_once(spark):
    rng = np.random.default_rng(2)
    t = np.sort(np.concatenate((rng.uniform(0, 1, 40), rng.uniform(50, 50.5, 40))))
    starts = sessions.block_starts(t, 8.0)
    assert starts[0] == 0 and {39, 40, 41} & set(starts.tolist()) and len(starts) <= 5
    assert sessions.block_starts(np.array([1.0]), 8.0).tolist() == [0] and len(sessions.block_starts(np.zeros(0), 1.0)) == 0
    df = spark.createDataFrame([(i, "k", at(float(x))) for i, x in enumerate(t)] + [(99, "k", None)], "id int, k string, ts timestamp")
    got = sessions.bayesian_blocks(df, ["k"], "ts", "id").collect()
    assert sorted(r.id for r in got) == list(range(80))


def test_components_equal_union_find(spark):
    rng = random.Random(7)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 600)] + [(3, 3)]
    root = union_find(700, pairs)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a int, b int")).collect()}
    assert {n: got.get(n, n) for n in range(700)} == dict(enumerate(root))
    nodes = spark.range(700).select(F.col("id").cast("int").alias("alert_id"))
    assert components.members(nodes, spark.createDataFrame([], "a int, b int")).count() == 700


# --- joins -----------------------------------------------------------------------------------------------------------
def test_range_pairs_equal_brute_force(spark):
    rng = random.Random(11)
    rows, df = timed(spark, rng, 120)
    got = {(r.a_alert_id, r.b_alert_id) for r in joins.range_pairs(df, "entity", "ts", "alert_id", 1800).collect()}
    want = {(x[0], y[0]) for x in rows for y in rows if x[1] == y[1] and x[2] and y[2] and (x[2], x[0]) < (y[2], y[0]) and (y[2] - x[2]).total_seconds() <= 1800}
    assert got == want


def test_tactic_pairs_need_order_entity_and_time(spark):
    rows = [(1, at(0), "Credential Access", "user:a"), (2, at(1), "Execution", "user:a"), (3, at(3.5), "Execution", "user:a"), (4, at(1), "Execution", "user:b"), (5, at(0), "Execution", "user:a"), (2, at(1), "Execution", "host:h"), (1, at(0), "Credential Access", "host:h")]
    got = joins.tactic_pair_matches(spark.createDataFrame(rows, "alert_id int, ts timestamp, tactic string, entity string")).collect()
    assert {(r.pattern, r.earlier, r.later) for r in got} == {("credential_execution", 1, 2), ("credential_execution", 1, 5)}


def linked_alerts(spark, rng, n=70):
    """Rows (alert_id, ts, tactic, entity) of alerts with one to three entities, some times equal, some missing; and a map of them."""
    tactics = sorted({t for pair in K.TACTIC_PAIRS for t in pair})
    of = {i: (None if rng.random() < 0.05 else at(rng.randrange(0, 60) / 4), rng.choice(tactics), set(rng.choices(["h:a", "h:b", "u:c", "u:d", "u:e"], k=rng.randrange(1, 4)))) for i in range(n)}
    rows = [(i, ts, tactic, e) for i, (ts, tactic, es) in of.items() for e in es]
    return of, spark.createDataFrame(rows, "alert_id int, ts timestamp, tactic string, entity string")


def test_pairs_are_met_once_and_not_shuffled(spark):
    of, df = linked_alerts(spark, random.Random(11))
    met = lambda x, y, s: of[x][0] and of[y][0] and of[x][2] & of[y][2] and 0 <= (of[y][0] - of[x][0]).total_seconds() <= s
    every = [(x, y) for x in of for y in of if x != y]
    want = sorted((K.TACTIC_PAIRS[of[x][1], of[y][1]], x, y) for x, y in every if (of[x][1], of[y][1]) in K.TACTIC_PAIRS and met(x, y, 5400) and (of[x][0], x) < (of[y][0], y))
    got = joins.tactic_pair_matches(df, 5400)
    assert sorted((r.pattern, r.earlier, r.later) for r in got.collect()) == want and want
    causal = joins.causal_edges(df.drop("tactic"), 5400, side=3)
    assert sorted((r.a, r.b) for r in causal.collect()) == sorted((x, y) for x, y in every if met(x, y, 5400) and of[x][0] < of[y][0])
    for pairs in (got, causal):
        plan = pairs._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Join") < (plan.index("Aggregate") if "Aggregate" in plan else len(plan))


def test_pattern_links_have_the_components_of_all_matches(spark):
    for seed in range(3):
        of, df = linked_alerts(spark, random.Random(seed), 50)
        pairs = [(r.earlier, r.later) for r in joins.tactic_pair_matches(df, 2700).collect()]
        links = [(r.a, r.b) for r in joins.pattern_links(df, 2700).collect()]
        assert union_find(50, links) == union_find(50, pairs)
        assert {x for p in links for x in p} == {x for p in pairs for x in p}
    busy = spark.range(200).select(F.col("id").alias("alert_id"), F.timestamp_seconds(F.col("id")).alias("ts"), F.when(F.col("id") % 2 == 0, "Lateral Movement").otherwise("Exfiltration").alias("tactic"), F.lit("h").alias("entity"))
    assert joins.tactic_pair_matches(busy).count() == sum(1 for x in range(0, 200, 2) for y in range(x + 1, 200, 2)) and joins.pattern_links(busy).count() == 199


def test_match_counts_equal_the_matches_of_each_cluster(spark, monkeypatch):
    for seed in range(3):
        of, df = linked_alerts(spark, random.Random(20 + seed))
        # clusters overlap, and some alerts are in none
        inside = {(c, i) for c, k in (("x", 2), ("y", 3), ("z", 5)) for i in of if i % k == 0}
        pairs = [(r.pattern, r.earlier, r.later) for r in joins.tactic_pair_matches(df, 5400).collect()]
        want = {}
        for c in "xyz":
            hit = [p for p in pairs if (c, p[1]) in inside or (c, p[2]) in inside]
            want[c] = (len(hit), len({p[0] for p in hit}))
        with monkeypatch.context() as m:
            m.delattr(joins, "tactic_pair_matches")
            got = joins.match_counts(df, spark.createDataFrame(sorted(inside), "cluster string, alert_id int"), 5400).collect()
        assert {r.cluster: (r.matches, r.patterns) for r in got} == want


def test_neighbourhood_counts_equal_the_neighbourhood(spark):
    of, df = linked_alerts(spark, random.Random(31), 40)
    ents, roots = df.select("alert_id", "entity"), spark.createDataFrame([(i,) for i in range(0, 40, 3)], "alert_id int")
    hood = {}
    for r in joins.neighbourhood(ents, roots).collect():
        hood.setdefault(r.root, set()).add(r.alert_id)
    got = {r.root: (r.n, r.entities) for r in joins.neighbourhood_counts(ents, roots).collect()}
    assert got == {r: (len(h), len(set().union(*(of[i][2] for i in h)))) for r, h in hood.items()}


def test_weak_negatives_make_no_row_of_a_pair(spark):
    of, df = linked_alerts(spark, random.Random(8), 40)
    rows = spark.createDataFrame([(i, ts, tactic, i % 2) for i, (ts, tactic, _) in of.items()], "alert_id int, ts timestamp, tactic string, label int")
    found = joins.weak_negatives(rows, df.select("alert_id", "entity"), 3, cap=4, min_gap_s=3600)
    draw = lambda i: (int(__import__("hashlib").md5(f"{i}:3".encode()).hexdigest()[:8], 16), i)
    apart = lambda x, y: of[x][0] and of[y][0] and abs((of[x][0] - of[y][0]).total_seconds()) >= 3600 and of[x][1] != of[y][1]
    fits = {x: sorted((y for y in of if y != x and (y % 2 == 0 or apart(x, y)) and not of[x][2] & of[y][2]), key=draw)[:4] for x in of if x % 2}
    assert {(r.a, r.b) for r in found.collect()} == {(x, y) for x, ys in fits.items() for y in ys}
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_weak_positives_are_the_nearest_of_all_pairs(spark):
    of, df = linked_alerts(spark, random.Random(3), 90)
    train = spark.createDataFrame([(i, int(i % 3 > 0)) for i in of], "alert_id int, label int")
    rows = {i: v for i, v in of.items() if i % 3 and v[0]}
    want = set()
    for x in rows:
        later = sorted(((rows[y][0] - rows[x][0]).total_seconds(), y) for y in rows if rows[x][2] & rows[y][2] and (rows[x][0], x) < (rows[y][0], y))
        want |= {(x, y) for g, y in [p for p in later if p[0] <= 7200][:3]}
    found = joins.weak_positives(df.drop("tactic"), train, 7200, 3)
    assert {(r.a, r.b) for r in found.collect()} == want
    assert "Join Inner" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_neighbours_and_precedes(spark):
    rows = [(i, at(h), "host", "host:a") for i, h in enumerate([0, 0, 1, 2, 9])] + [(9, None, "host", "host:a")]
    df = spark.createDataFrame(rows, "alert_id int, ts timestamp, etype string, entity string")
    near = {(r.a, r.b) for r in joins.temporal_neighbours(df, 2 * 3600, 2).collect()}
    assert {(0, 1), (1, 0), (1, 2), (0, 2), (2, 3)} <= near and (3, 4) not in near and (9, 0) in near and (9, 2) not in near
    later = {(r.a, r.b) for r in joins.precedes(df, 2 * 3600, 1).collect()}
    assert later == {(0, 2), (1, 2), (2, 3)}


def test_label_windows_first_in_order(spark):
    w = spark.createDataFrame([("s", "a", 0.0, 5.0, 0), ("s", "b", 3.0, 9.0, 1), ("s", "a", 1.0, 5.0, 2)], "scenario string, attack string, start_s double, end_s double, seq int")
    al = spark.createDataFrame([(1, "s", 0.5), (2, "s", 4.0), (3, "s", 9.0), (4, "t", 4.0)], "alert_id int, scenario string, epoch double")
    got = {r.alert_id: r.attack for r in joins.label_window_join(al, joins.label_windows(w)).collect()}
    assert got == {1: None, 2: "a", 3: "b", 4: None}


def test_maximal_clusters_equal_brute_force(spark):
    rng = random.Random(13)
    sets = {i: frozenset(rng.sample(range(12), rng.randrange(1, 6))) for i in range(40)}
    rows = [(c, a) for c, s in sets.items() for a in s]
    got = {r.cluster for r in joins.maximal_clusters(spark.createDataFrame(rows, "cluster int, alert_id int")).select("cluster").distinct().collect()}
    assert got == {c for c, s in sets.items() if not any(s < o or (s == o and d < c) for d, o in sets.items())}


def test_neighbourhood_and_alignment(spark):
    e = spark.createDataFrame([("a1", "user:x"), ("a2", "user:x"), ("a2", "host:h"), ("a3", "host:h")], "alert_id string, entity string")
    got = {r.alert_id for r in joins.neighbourhood(e, spark.createDataFrame([("a1",)], "alert_id string")).collect()}
    assert got == {"a1", "a2"}
    with pytest.raises(ValueError):
        joins.align(e, spark.createDataFrame([("a1", 1)], "alert_id string, p int"))


# --- scores ----------------------------------------------------------------------------------------------------------
def test_confidence_values(spark):
    f = lambda *a: one(spark, scoring.validation_confidence(*map(F.lit, a)))[0]
    assert f(9, True, 2, 2) == pytest.approx(0.80) and f(1, False, 1, 2) == pytest.approx(0.23)


def test_structural_and_verdict_values(spark):
    s = scoring.structural_score(*map(F.lit, (10, 4, 4, 3, 4, 1800.0, 2)))
    assert one(spark, s)[0] == pytest.approx(0.25 + 0.20 + 0.075 + 0.10 + 0.10 + 0.10 * (1 - 1800 / 21600) + 0.10, abs=1e-6)
    assert one(spark, scoring.structural_score(*map(F.lit, (10, 4, 4, 3, 4, 1800.0, 2))))[0] == 0.916667
    v = scoring.verdict_score(F.lit(0.82), F.lit(6), F.lit(6), F.lit(3), F.lit(1.0), F.lit(0), F.lit(6))
    assert one(spark, v)[0] == pytest.approx(0.26 * 0.82 + 0.096 + 0.16 + 0.12 + 0.16 + 0.05)


def test_stage_sequence_and_pattern(spark):
    stages = ["credential_access", "execution", "lateral_movement", "lateral_movement", "privilege_escalation"]
    rows = spark.createDataFrame([("c", i, at(i), [s]) for i, s in enumerate(stages)], "cluster string, alert_id int, ts timestamp, tags array<string>")
    tags = sequence.tag_rows(rows)
    seq = sequence.stage_sequence(tags, "cluster", "stage", ["ts", "alert_id", "rank"])
    assert seq.first().sequence == ["credential_access", "execution", "lateral_movement", "privilege_escalation"]
    ents = spark.createDataFrame([(i, "user:a") for i in range(5)], "alert_id int, entity string")
    edges = sequence.attack_edges(tags, ents, seq)
    assert edges.count() == 6
    c = seq.withColumn("stages", F.col("sequence")).join(edges.groupBy("cluster").agg(F.collect_set(F.concat("left", F.lit("->"), "right")).alias("edges")), "cluster")
    best = sequence.best_pattern(c).first()
    assert (best.pattern, best.graph_score) == ("credential_lateral_privilege", 1.0)


def test_attack_edges_without_entities_and_across(spark):
    rows = spark.createDataFrame([("c", 1, at(0), ["execution"]), ("c", 2, at(1), ["impact"]), ("c", 3, at(2), ["discovery"])], "cluster string, alert_id int, ts timestamp, tags array<string>")
    ents = spark.createDataFrame([(1, "user:a"), (2, "user:b")], "alert_id int, entity string")
    empty = spark.createDataFrame([], "cluster string, sequence array<string>")
    got = {(r.left, r.right) for r in sequence.attack_edges(sequence.tag_rows(rows), ents, empty).collect()}
    assert got == {("execution", "discovery"), ("impact", "discovery")}


def test_refinement_predicates(spark):
    c = lambda n, m: one(spark, scoring.continuity(F.lit(n), F.lit(m)))[0]
    assert [c(3, 2), c(3, 1), c(10, 2), c(10, 3), c(11, 3), c(20, 3)] == [True, False, False, True, True, False]
    p = lambda k, n, h: one(spark, scoring.progression(F.lit(k), F.lit(n), F.lit(h)))[0]
    assert [p(2, 9, 0), p(1, 3, 1), p(1, 3, 0), p(0, 8, 2), p(0, 9, 2)] == [True, True, False, True, False]


# --- evaluation ------------------------------------------------------------------------------------------------------
def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "alert_id string")


def test_selection_metrics_and_recalls(spark):
    truth = spark.createDataFrame([("i1", "a"), ("i1", "b"), ("i2", "c")], "incident_id string, alert_id string")
    m = evaluate.selection_metrics(ids(spark, "a", "b", "x", "x"), truth).first()
    assert (m.tp, m.fp, m.fn) == (2, 1, 1) and m.precision == pytest.approx(2 / 3) and m.f1 == pytest.approx(2 / 3)
    z = evaluate.selection_metrics(ids(spark), truth).first()
    assert (z.tp, z.fp, z.fn, z.precision, z.recall, z.f1) == (0, 0, 3, 0.0, 0.0, 0.0)
    row = evaluate.detector_row("d", ids(spark, "a", "c"), truth)
    r = row.first()
    assert (r.incident_recall_any, r.incident_recall_all) == (1.0, 0.5)
    n = evaluate.not_run(spark, "hosted", row).first()
    assert (n.detector, n.status, n.tp) == ("hosted", "not_run", None)
    assert [x.incident_id for x in evaluate.missed_incidents(truth, ids(spark, "a")).collect()] == ["i2"]


def test_auc_and_threshold_equal_brute_force(spark):
    rng = random.Random(17)
    rows = [(rng.randrange(12), int(rng.random() < 0.4)) for _ in range(120)]
    df = spark.createDataFrame(rows, "score int, label int")
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert evaluate.roc_auc(df).first().auc == pytest.approx(want)
    f1 = {t: 2 * sum(p >= t for p in pos) / (sum(s >= t for s, _ in rows) + len(pos)) for t in {s for s, _ in rows}}
    best = evaluate.best_threshold(df).first()
    assert best.f1 == pytest.approx(max(f1.values())) and best.threshold == min(t for t in f1 if f1[t] == max(f1.values()))


def test_best_match_and_summary(spark):
    m = spark.createDataFrame([(0, "a"), (0, "b"), (0, "x"), (1, "y")], "cluster int, alert_id string")
    t = spark.createDataFrame([("i", "a"), ("i", "b"), ("i", "c"), ("j", "x")], "incident_id string, alert_id string")
    got = {r.cluster: (round(r.precision, 4), round(r.recall, 4)) for r in evaluate.best_match(m, t).collect()}
    assert got == {0: (0.6667, 0.6667), 1: (0.0, 0.0)}
    same = evaluate.same_rows(m, m.filter("cluster = 0")).first()
    assert (same.missing, same.added) == (1, 0)


# --- similarity, features, learning ----------------------------------------------------------------------------------
def test_dbscan_counts_equal_vectors_as_points(spark):
    v = [[1.0, 0.0]] * 3 + [[0.0, 1.0]] + [[0.0, 0.0]] * 2 + [[0.9, 0.5]]
    got = {r.vec_id: r.cluster for r in similarity.dbscan(spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<float>"), 0.2, 4).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: None, 4: None, 5: None, 6: 0}


def test_dbscan_on_three_points(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.99, 0.01], 0), (3, [0.0, 1.0], 1)], "vec_id int, embedding array<float>, label int")
    assert {r.vec_id: r.cluster for r in similarity.dbscan(v, 0.2).collect()} == {1: 1, 2: 1, 3: None}
    assert {r.vec_id: r.match for r in similarity.assign_prototypes(v).collect()} == {1: 0, 2: 0, 3: 1}


def test_cosine_pairs_in_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 6))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id int, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if s[i, j] >= 0.6}
    assert {(r.a, r.b) for r in similarity.cosine_pairs(v, 0.6, block_rows=20).collect()} == want


@pytest.mark.parametrize("at_least,block_rows", [(0.9, 25), (0.7, 60), (0.0, 40), (-0.5, 1000)])
def test_cosine_pairs_of_clusters_repeats_and_odd_vectors(spark, at_least, block_rows):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(8, 5))
    x = [(centres[0 if i % 3 == 0 else i % 8] + 0.1 * rng.normal(size=5)).tolist() for i in range(150)] + [[1.0] * 5] * 30 + [[0.0] * 5, [0.0] * 5]
    v = spark.createDataFrame([(i, r) for i, r in enumerate(x)] + [(900, [float("nan")] * 5), (901, None), (902, [None] * 5)], "vec_id int, embedding array<double>")
    a = np.array(x)
    u = a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)
    s = u @ u.T
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if s[i, j] >= at_least}
    border = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if abs(s[i, j] - at_least) < 1e-12 and s[i, j] != 0}
    got = [(r.a, r.b) for r in similarity.cosine_pairs(v, at_least, block_rows=block_rows).collect()]
    assert len(got) == len(set(got)) and set(got) - border == want - border


def test_vectors_visit_only_balls_that_may_hold_partners(spark):
    rng = np.random.default_rng(6)
    centres = np.eye(40)
    x = [(centres[i % 40] + 0.02 * rng.normal(size=40)) for i in range(4000)]
    unit = spark.createDataFrame([(i, "", (r / np.linalg.norm(r)).tolist()) for i, r in enumerate(x)], "id int, g string, v array<double>")
    blocks = 40  # of 100 rows, which is what dealing by hash would ship each row to
    assert similarity.ball_visits(unit, 0.95, 100).count() < 4000 * blocks / 4


def test_visits_of_many_balls_leave_a_task_in_bounded_frames():
    import pandas as pd

    rng = np.random.default_rng(8)
    pivots = rng.normal(size=(600, 64))
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    home = rng.integers(0, 600, 300).astype(np.int32)
    p = pd.DataFrame({"id": range(300), "g": "", "v": [pivots[h] for h in home], "ball": home})
    frames = list(similarity._visits(p, pivots, np.full(600, np.inf)))
    assert sum(map(len, frames)) == (home + 1).sum() and max(map(len, frames)) <= similarity.TASK_NUMBERS // 64
    whole = pd.concat(frames)
    assert whole["own"].sum() == 300 and set(zip(whole["id"], whole["ball"])) == {(i, b) for i, h in enumerate(home) for b in range(h + 1)}


def test_samples_and_folds(spark):
    df = spark.range(10).select(F.col("id").alias("alert_id"), F.when(F.col("id") < 7, 1).otherwise(0).alias("label"))
    sizes = features.folds(df, ["alert_id"], 4).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in sizes] == [3, 3, 2, 2]
    capped = features.stratified_cap(df, "label", "alert_id", 5).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in capped} == {1: 4, 0: 1}
    split = features.split_rows(df, "label", "alert_id").groupBy("label").agg(F.count_if("is_train").alias("n")).collect()
    assert {r.label: r.n for r in split} == {1: 5, 0: 2}


def test_learning_contract(spark):
    rng = random.Random(23)
    rows = [(i, at(i / 4), "Execution" if (y := i % 3 == 0) else "Discovery", 9.0 if y else 2.0 + rng.random(), int(y)) for i in range(120)]
    df = spark.createDataFrame(rows, "alert_id int, ts timestamp, tactic string, severity double, label int")
    ents = df.select("alert_id", "ts", F.lit("host").alias("etype"), F.concat(F.lit("host:"), (F.col("alert_id") % 3).cast("string")).alias("entity"))
    x, names = learning.graph_features(df, ents, hops=1)
    out = learning.triage(features.split_rows(x, "label", "alert_id"), names)
    assert out.filter("prediction = label").count() == 120 and len(out.first().embedding) == len(names)
    a = learning.reconstruction_error(features.split_rows(x, "label", "alert_id"), names[:6], 2)
    assert a.filter("anomaly < 0").count() == 0


def test_isolation_and_ward(spark):
    from ridgeline.operators import anomaly

    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(200, 2)), [[9.0, 9.0]]])
    df = spark.createDataFrame([(i, float(a), float(b), int(i == 200)) for i, (a, b) in enumerate(x)], "alert_id int, a double, b double, label int")
    got = anomaly.isolation_scores(df, ["a", "b"], "label = 0", trees=30).collect()
    assert max(got, key=lambda r: r.isolation).alert_id == 200 and all(0 <= r.isolation <= 1 for r in got)
    points = np.array([[0, 0], [0.5, 0], [0, 0.5], [5, 5], [5.4, 5], [20, 0]], float)
    assert anomaly.merge_labels(points, 1.5).tolist() == [0, 0, 0, 1, 1, 2]
    g = spark.createDataFrame([("k", i, *map(float, p)) for i, p in enumerate(points)], "g string, alert_id int, a double, b double")
    assert [r.cluster for r in anomaly.agglomerative(g, ["a", "b"], "g").orderBy("alert_id").collect()] == [0, 0, 0, 1, 1, 2]
    p = anomaly.fused_probability(anomaly.isolation_scores(df, ["a", "b"], "label = 0", trees=5)).filter("label = 1").first()
    assert p.prediction == 1 and p.probability > 0.9


@pytest.mark.parametrize("part_rows", [3, 40, 50_000])
def test_components_in_parts_and_by_stars(spark, monkeypatch, part_rows):
    import random

    from ridgeline.operators import components as C

    monkeypatch.setattr(C, "PART_ROWS", part_rows)
    rng = random.Random(4)
    edges = [(f"n{rng.randrange(90)}", f"n{rng.randrange(90)}") for _ in range(70)] + [("n1", "n1"), ("hub", "n2"), ("hub", "n2")] + [(f"p{i:02}", f"p{i + 1:02}") for i in range(40)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in C.components(spark.createDataFrame(edges, "a string, b string").repartition(4)).collect()}
    assert got == {x: y for x, y in root.items() if x != y}
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_neighbourhood_meets_a_pair_once_and_sorts_out_no_pairs(spark):
    from ridgeline.operators import joins

    edges = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), ("b", "x"), ("b", "x"), ("c", None), ("d", "z"), ("f", "y")], "alert_id string, entity string")
    out = joins.neighbourhood(edges, spark.createDataFrame([("a",), ("a",), ("c",), ("e",)], "alert_id string"))
    assert sorted(map(tuple, out.collect())) == [("a", "a"), ("a", "b"), ("a", "f"), ("c", "c"), ("e", "e")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate [root#" in line and "alert_id#" in line.split("]")[0]]


def test_components_take_no_round_when_all_edges_lead_to_roots(spark, monkeypatch):
    from ridgeline.operators import components as C

    monkeypatch.setattr(C, "PART_ROWS", 10)
    monkeypatch.setattr(C, "_star", lambda *_: pytest.fail("a round without need"))
    edges = spark.range(1, 200).selectExpr("id % 7 - 10 as a", "id as b").repartition(4)
    assert {r.node: r.root for r in C.components(edges).collect()} == {i: i % 7 - 10 for i in range(1, 200)}


def test_parts_of_one_large_partition_are_bounded(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    from ridgeline.operators import components as C

    rng = np.random.default_rng(7)
    n = 1_000_000
    a, b = rng.integers(0, 3_000_000, n), rng.integers(0, 3_000_000, n)
    batches = [pa.RecordBatch.from_arrays([pa.array(np.maximum(a[i : i + 9_999], b[i : i + 9_999])), pa.array(np.minimum(a[i : i + 9_999], b[i : i + 9_999]))], ["src", "dst"]) for i in range(0, n, 9_999)]
    held, real = [], C.least_nodes
    monkeypatch.setattr(C, "least_nodes", lambda s, d: held.append(len(s)) or real(s, d))
    kept = list(C.reduce_parts(iter(batches), 50_000))
    assert held == [50_000] * 20 and len(kept) == 20
    # the links that are left have the components of all edges
    def classes(x, y):
        root = list(range(3_000_000))

        def top(i):
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        for i, j in zip(x.tolist(), y.tolist()):
            i, j = top(i), top(j)
            root[max(i, j)] = min(i, j)
        return np.array([top(i) for i in range(3_000_000)])

    x, y = (np.concatenate([k.column(i).to_numpy() for k in kept]) for i in (0, 1))
    assert (x > y).all() and (classes(a, b) == classes(x, y)).all()


def test_least_nodes_of_texts_and_of_long_chains():
    import pyarrow as pa

    from ridgeline.operators import components as C

    chain = [f"é{i:05}" for i in range(20_000)]
    node, least = C.least_nodes(pa.chunked_array([pa.array(chain[1:])]), pa.chunked_array([pa.array(chain[:-1])]))
    assert node.to_pylist() == chain[1:] and set(least.to_pylist()) == {chain[0]}
    one = pa.chunked_array([pa.array([3, 9, 4])]), pa.chunked_array([pa.array([2, 8, 3])])
    assert [x.to_pylist() for x in C.least_nodes(*one)] == [[3, 4, 9], [2, 2, 8]]


def test_neighbours_by_gap_buckets_equal_those_of_whole_entities(spark):
    rng, k, gap = random.Random(9), 3, 100
    data = [(i, None if rng.random() < 0.1 else dt.datetime(2026, 1, 1) + dt.timedelta(seconds=rng.choice([rng.randrange(3000), 100 * rng.randrange(30)])), rng.choice("xyz")) for i in range(240)]
    data += [(1000 + i, None, "bare") for i in range(5)] + [(2000 + i, dt.datetime(2026, 1, 1) + dt.timedelta(days=i), "bare") for i in range(4)]
    want = set()
    for e in {r[2] for r in data}:
        own = sorted((r for r in data if r[2] == e), key=lambda r: (r[1] is not None, r[1] or dt.datetime.min, r[0]))
        for i, (a, t, _) in enumerate(own):
            want |= {p for b, u, _ in own[i + 1 : i + 1 + k] if t is None or u is None or (u - t).total_seconds() <= gap for p in ((a, b), (b, a))}
    rows = spark.createDataFrame(data, "alert_id long, ts timestamp, entity string").withColumn("etype", F.lit("host"))
    assert {(r.a, r.b) for r in joins.temporal_neighbours(rows, gap, k).collect()} == want
    # no window holds an entity's whole time
    held = joins._with_next_heads(rows, gap, k).filter("_bucket is not null").groupBy("entity", "_bucket").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    assert all((r.hi - r.lo).total_seconds() < 2 * gap for r in held.collect())
