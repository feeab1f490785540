"""The queries of this package over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import centroid_clusters, decontaminate, exact_dedup, hard_negatives, jaccard_join, mixing, ogg, quality, sharding, token_counts, token_output, toxicity, url_filter

#: A document is rejected from this probability of the chain's last category on.
TOXIC = 0.5
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    names = list(toxicity.CATEGORIES)
    scored = toxicity.toxicity_scores(docs.select("doc_id", "text"), toxicity.train_by_language(docs, labels))
    parts = [F.col("toxicity")[i].alias(f"p_{n}") for i, n in enumerate(names)]
    return scored.select("doc_id", "toxicity").select("doc_id", *parts).withColumn("toxic", F.col(f"p_{names[-1]}") >= TOXIC)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"), jaccard_join.Rule(3, 90, 100))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), unnamed=True).drop("spans")


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_files(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    scored = quality.quality_scores(docs.select("doc_id", "text"), model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), ("lang", "source", "text"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"), SHARDS)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), rounds=200, settle=True)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"))


def op12_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    read = ogg.sound_features(ogg.sound_column(docs))
    return read.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "sound.*")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters.centroid_clusters(_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridgeline.llm import pipeline as stages

    return stages.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_toxicity, op2_ngram_jaccard_join, op3_benchmark_decontamination, op4_token_output, op5_source_mixing, op6_quality_classifier, op7_exact_dedup, op8_token_counts, op9_sharding, op10_url_filter, op11_hard_negatives, op12_media_columns, op13_centroid_clustering, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_ngram_jaccard_join": jaccard_join.sql(),
        "op3_benchmark_decontamination": decontaminate.SQL,
        "op5_source_mixing": mixing.SQL,
        "op7_exact_dedup": exact_dedup.SQL,
        "op11_hard_negatives": hard_negatives.SQL,
        "op13_centroid_clustering": centroid_clusters.SQL,
    }
