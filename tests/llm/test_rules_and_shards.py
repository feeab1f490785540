"""Ties between rules, and shards of tables with clashing names."""

import pytest
from pyspark.sql import functions as F

from ridgeline.llm.sharding import assign_shards, lookup_table, write_shards
from ridgeline.llm.url_filter import Rule, judge_urls, matched_rule


def test_of_equal_rules_the_first_listed_decides(spark):
    text, verdict = matched_rule(F.lit("a.com"), F.lit("/x"), [Rule("block", "a.com", "/"), Rule("allow", "a.com", "/"), Rule("allow", "com", "/")])
    assert tuple(spark.range(1).select(text, verdict).first()) == ("a.com/", "block")


def test_urls_repeated_rows_and_very_long_ones(spark):
    long = "http://b.net/es/" + "x" * 500_000
    pages = spark.createDataFrame([(1, "http://b.net/es/", None), (1, "http://b.net/es/", None), (2, long, "y" * 500_000)], "page_id long, url string, html string")
    assert [(r.page_id, r.rule, r.verdict, len(r.path)) for r in judge_urls(pages).orderBy("page_id").collect()] == [(1, "net/es/", "block", 4)] * 2 + [(2, "net/es/", "block", 500_004)]


def test_shards_of_a_table_with_clashing_names(spark, tmp_path):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit(9).alias("_slot"), F.lit("mine").alias("shard_name"), F.lit(1).alias("slot"), F.lit(2).alias("shard"))
    write_shards(docs, str(tmp_path / "s"), ["a", "b"], 11)
    back = spark.read.parquet(str(tmp_path / "s"))
    want = {r.doc_id: r.shard_name for r in assign_shards(docs, ["a", "b"], 11).collect()}
    assert {r.doc_id: r.shard_name for r in back.collect()} == want and set(want.values()) == {"a", "b"}
    assert [tuple(r) for r in back.select("_slot", "slot", "shard").distinct().collect()] == [(9, 1, 2)]


def test_a_shard_name_has_no_line_end():
    with pytest.raises(ValueError):
        lookup_table(["a", "b\nc"], 11)


def test_a_very_long_text_is_counted_whole(spark):
    docs = spark.createDataFrame([(1, "\u00e9" * 1_000_000), (None, "\u00e9"), (2, None)], "doc_id long, text string")
    assert sorted(r.n_bytes for r in assign_shards(docs, ["a"], 11).collect()) == [0, 2, 2_000_000]
