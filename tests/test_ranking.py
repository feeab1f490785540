"""Places and running sums in two passes, and band joins of busy keys, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from ridgeline.operators import evaluate, features, joins
from ridgeline.operators.ranking import number_rows, running_sums, shares
from ridgeline.plans import alert_queries as Q
from ridgeline.plans.learning_queries import CAUSAL_SQL  # noqa: F401


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_places_in_whole_tables_and_groups(spark, parts):
    rng = random.Random(parts)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, 1.5, 2.0, -3.0])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, g string, x double").repartition(7)
    want = sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
    got = number_rows(df, ["x", "id"], parts=parts)
    assert got.columns == ["id", "g", "x", "number"]
    assert [(r.id, r.number) for r in got.orderBy("number").collect()] == [(r[0], i + 1) for i, r in enumerate(want)]
    down = number_rows(df, [F.desc("x"), F.desc("id")], name="k", parts=parts).orderBy("k").collect()
    assert [r.id for r in down] == [r[0] for r in sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), -r[0]))]
    by = {(r.g, r.id): r.number for r in number_rows(df, ["id"], ["g"], parts=parts).collect()}
    assert by == {(g, i): k + 1 for g in ("a", "b", None) for k, i in enumerate(i for i, h, _ in rows if h == g)}


def test_running_sums_shares_and_empty_tables(spark):
    df = spark.createDataFrame([(i * 7 % 101, i, None if i % 5 == 0 else i) for i in range(101)], "k long, v long, w long").repartition(5)
    rows = running_sums(df, ["k"], {"sv": "v", "sw": "w"}, parts=4).orderBy("k").collect()
    sv = sw = 0
    for n, r in enumerate(rows):
        sv, sw = sv + r.v, sw + (r.w or 0)
        assert (r.number, r.sv, r.sw) == (n + 1, sv, sw)
    for n, k in ((101, 4), (3, 5), (10, 5), (7, 3)):
        got = [r.fold for r in shares(df.limit(n), ["k"], k, "fold").orderBy("k").collect()]
        size, more = divmod(n, k)
        assert got == [i for i in range(k) for _ in range(size + (i < more))]
    empty = df.limit(0)
    assert number_rows(empty, ["k"]).collect() == [] and running_sums(empty, ["k"], {"s": "v"}).collect() == [] and shares(empty, ["k"], 3, "f").collect() == []
    assert evaluate.roc_auc(empty.selectExpr("cast(k as double) as score", "cast(v as int) as label")).first().auc is None


def test_no_window_over_all_rows_is_left(spark):
    df = spark.range(200).selectExpr("id as alert_id", "cast(id % 7 as double) as score", "cast(id % 2 as int) as label", "id as ts")
    for out in (evaluate.roc_auc(df), evaluate.best_threshold(df), features.folds(df, ["ts"], 3), features.stratified_cap(df, "label", "alert_id", 50), features.split_rows(df, "label", "alert_id")):
        plan = plan_of(out)
        assert "SinglePartition" not in plan.split("Window")[1] if "Window" in plan else True
        assert not any("SinglePartition" in line and "Window" in below for line, below in zip(plan.split("\n")[1:], plan.split("\n")))


def busy(spark, n=6000, seed=2):
    """Alerts of which a third name one host, within a few hours."""
    rng = random.Random(seed)
    rows = [(i, f"host:{'busy' if i % 3 == 0 else rng.randrange(300)}", rng.randrange(0, 6 * 3600)) for i in range(n)]
    return spark.createDataFrame(rows, "alert_id long, entity string, s long").withColumn("ts", F.timestamp_seconds("s")), rows


@pytest.mark.parametrize("side", [50, 400, 100_000])
def test_band_pairs_equal_brute_force(spark, side):
    df, rows = busy(spark, 900)
    some = df.unionByName(spark.createDataFrame([(9_000, None, 5), (9_001, "host:1", None)], "alert_id long, entity string, s long").withColumn("ts", F.timestamp_seconds("s")))
    got = {(r.a, r.b) for r in joins.causal_edges(some, 1800, side=side).collect()}
    assert got == {(i, j) for i, e, s in rows for j, f, t in rows if e == f and 0 < t - s <= 1800}


def test_a_busy_key_is_spread_over_tasks(spark, monkeypatch):
    df, rows = busy(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        pairs = joins.band_pairs(df, "entity", "ts", "alert_id", 3600, side=100)
        work = sorted(r.n for r in pairs.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(work) == 16 and work[-1] <= 4 * work[8]


def test_causal_graph_is_the_union(spark):
    df, rows = busy(spark, 120)
    got = {(r.a, r.b) for r in joins.causal_graph(df, 600).collect()}
    assert got == {(i, j) for i, e, _ in rows for j, f, _ in rows if e == f and i != j}
    lone = spark.createDataFrame([(i, f"e{i}", i) for i in (5, 9, 30)], "alert_id long, entity string, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert {(r.a, r.b) for r in joins.causal_graph(lone).collect()} == {(5, 9), (9, 5), (9, 30), (30, 9)}


def test_cluster_numbers_of_more_than_four_digits(spark):
    from ridgeline.plans.discover import cluster_number

    assert [r.n for r in spark.createDataFrame([(7,), (1234,), (98765,)], "k long").select(cluster_number(F.col("k")).alias("n")).collect()] == ["0007", "1234", "98765"]
    assert Q.entities(spark.createDataFrame([(1, "u", "h", "h")], "alert_id long, user string, host string, target string")).count() == 2
