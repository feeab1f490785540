"""Answers of a model to many prompts, asked once each: the port that a hosted or offline provider plugs into (EXT-01)."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor, as_completed

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException
from pyspark.util import inheritable_thread_target

from ridgeline.operators.tables import delete, dropped_shuffles, materialize, release, scratch

SCHEMA = "request_key string, response string"


def request_key(prompt: str = "prompt"):
    """What a prompt is known by: equal prompts are one request, in this run and the next."""
    return F.sha2(F.col(prompt), 256)


def stored_answers(spark, store: str) -> DataFrame:
    """(request_key, response) of the result table at ``store``, empty before the first run."""
    try:
        return spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(store)
    except AnalysisException:
        return spark.createDataFrame([], SCHEMA)


def ask(requests: DataFrame, answer: Callable[[list[str]], list[str]], store: str, batch: int = 20, per_job: int = 10_000) -> DataFrame:
    """``requests`` with ``request_key`` and ``response`` of their ``prompt``.

    Prompts without an answer in the table at ``store`` are asked, each once, ``batch`` to a call of ``answer`` in tasks;
    some ``per_job`` of them make a job, which reads its own prompts only and whose answers are in the table, in a folder of
    their own, when it ends. As many jobs run at a time as there are cores; a run that breaks off loses the answers of those,
    and a rerun asks for those only. Null prompts are not asked and have no response.
    """
    spark = requests.sparkSession
    keyed = requests.withColumn("request_key", request_key())
    wanted = keyed.filter("prompt is not null").select("request_key", "prompt").dropDuplicates(["request_key"])
    missing = materialize(wanted.join(stored_answers(spark, store), "request_key", "left_anti"), "missing")

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            for i in range(0, len(p), batch):
                part = p.iloc[i : i + batch]
                got = answer(part["prompt"].tolist())
                if len(got) != len(part):
                    raise ValueError(f"{len(part)} prompts got {len(got)} answers")
                yield pd.DataFrame({"request_key": part["request_key"].to_numpy(), "response": got})

    jobs = -(-missing.count() // per_job)
    folder, run = scratch(spark, "requests"), uuid.uuid4().hex
    if jobs:
        with dropped_shuffles(spark):
            job = F.pmod(F.xxhash64("request_key"), F.lit(jobs)).cast("int")
            missing.withColumn("job", job).repartition("job").write.partitionBy("job").parquet(folder)

    def ask_job(i: int) -> None:
        mine = spark.read.schema("request_key string, prompt string").parquet(f"{folder}/job={i}")
        mine.mapInPandas(call, SCHEMA).write.parquet(f"{store.rstrip('/')}/{run}-{i}")

    present = sorted(r["job"] for r in spark.read.parquet(folder).select("job").distinct().collect()) if jobs else []
    with ThreadPoolExecutor(max(1, spark.sparkContext.defaultParallelism)) as pool:
        asked = [pool.submit(inheritable_thread_target(spark)(ask_job), i) for i in present]
        try:
            for a in as_completed(asked):
                a.result()
        except BaseException:
            pool.shutdown(cancel_futures=True)  # jobs that run end and keep their answers
            raise
    if jobs:
        delete(spark, folder)
    release(missing)
    # a task that was run twice, or two runs at a time, may have stored an answer twice
    known = stored_answers(spark, store).groupBy("request_key").agg(F.min("response").alias("response"))
    return keyed.join(known, "request_key", "left")


def offline(prompts: list[str]) -> list[str]:
    """Stands for a model: answers in prose with JSON inside, decided by the numbers that the prompt names."""
    out = []
    for p in prompts:
        n = {k: int(v) for k, v in re.findall(r"(\w+)=(\d+)", p)}
        if "alerts" in n:
            sure = n["severity"] >= 9 and n["alerts"] >= 3
            body = {"verdict": " True Positive " if sure else "benign", "confidence": str(min(n["alerts"], 12) / 10), "rationale": f" {n['alerts']} alerts ", "remediation_steps": ["isolate", " ", "reset", "watch", "report"]}
        else:
            body = {"is_incident" if n["alert"] % 2 else "incident_candidate": "YES" if n["severity"] >= 9 else "no"}
            if n["alert"] % 3 == 0:
                body["confidence"] = n["severity"] / 20
        out.append(f"Here is my answer: {json.dumps(body)} Done.")
    return out
