"""Synthetic alerts: attack chains among noise, reproducible from a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import constants as K

#: Weights of severities (fixed values), by profile and whether the alert belongs to an incident.
SEVERITY_WEIGHTS = {
    "easy": {True: (("High", 50), ("Critical", 30), ("Medium", 20)), False: (("Informational", 45), ("Low", 40), ("Medium", 15))},
    "hard": {True: (("Medium", 40), ("High", 30), ("Low", 20), ("Critical", 10)), False: (("Low", 40), ("Medium", 30), ("Informational", 20), ("High", 10))},
}
PROCESSES = ("powershell.exe", "cmd.exe", "rundll32.exe", "wmic.exe", "explorer.exe", "svchost.exe")


def _draw(seed: int, n: int, *keys) -> Column:
    """A number in 0..n-1 from a seeded hash."""
    return F.pmod(F.xxhash64(*[F.lit(k) if isinstance(k, (int, str)) else k for k in keys], F.lit(seed)), F.lit(n))


def _weighted(seed: int, weights, *keys) -> Column:
    at, out, upto = _draw(seed, sum(w for _, w in weights), *keys), None, 0
    for value, w in weights:
        upto += w
        out = F.when(at < upto, value) if out is None else out.when(at < upto, value)
    return out


def generate(spark: SparkSession, alerts: int = 2_000, incidents: int = 20, seed: int = 20260531, profile: str = "easy", hosts: int = 150, users: int = 100) -> DataFrame:
    """The eleven alert columns: ``incidents`` chains of 6 to 12 steps, the rest noise, with bursts of 2 to 4 among the noise of the hard profile.

    Rows come from ranges and seeded hashes, so any part can be made anywhere and the same seed gives the same rows (SRC-28, AUX-47).
    """
    if profile not in SEVERITY_WEIGHTS:
        raise ValueError(f"profile must be one of {sorted(SEVERITY_WEIGHTS)}")
    host = lambda *k: F.concat(F.lit("AID-"), _draw(seed, hosts, *k).cast("string"))
    user = lambda *k: F.concat(F.lit("USER-"), _draw(seed, users, *k).cast("string"))
    tactics = K.ATTACK_CHAINS[0]
    day = F.lit("2026-01-01 00:00:00").cast("timestamp")
    later = lambda s: F.timestamp_micros(F.unix_micros(day) + (s * 1_000_000).cast("long"))
    i = F.col("incident")
    n = (6 + _draw(seed, 7, "steps", i)).cast("int")
    steps = spark.range(incidents).select(F.col("id").alias("incident")).select("incident", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("step"))
    s = F.col("step")
    exfil = (s == F.col("n") - 1) & (_draw(seed, 10, "hop", i) < 3)
    chain = steps.select(
        F.concat(F.lit("i"), i.cast("string"), F.lit("-"), s.cast("string")).alias("key"),
        later(_draw(seed, 30 * 86_400, "start", i) + s * (420 + _draw(seed, 420, "gap", i, s))).alias("at"),
        host("path", i, s).alias("source_node"), F.when(exfil, host("out", i)).otherwise(host("path", i, s + 1)).alias("target_node"), user("who", i).alias("user"),
        F.element_at(F.array(*map(F.lit, tactics)), (F.least(s * len(tactics) / F.col("n").cast("double"), F.lit(len(tactics) - 1)).cast("int") + 1)).alias("tactic"),
        F.concat(F.lit("T1"), F.lpad(_draw(seed, 600, "tech", i, s).cast("string"), 3, "0")).alias("technique"), _weighted(seed, SEVERITY_WEIGHTS[profile][True], "sev", i, s).alias("severity"),
        F.lit("1").alias("is_incident"), F.concat(F.lit("INC-"), i.cast("string")).alias("incident_id"),
    )
    k = F.col("id")
    burst = F.when((_draw(seed, 100, "burst", F.floor(k / 3)) < 18) if profile == "hard" else F.lit(False), F.floor(k / 3)).otherwise(k)
    # noise fills what the chains leave of the wanted number
    noise = spark.range(max(0, alerts - chain.count())).select(
        F.concat(F.lit("n"), k.cast("string")).alias("key"), later(_draw(seed, 30 * 86_400, "noise", burst) + (k % 3) * 60).alias("at"), host("ns", burst).alias("source_node"), host("nt", k).alias("target_node"), user("nu", burst).alias("user"),
        F.element_at(F.array(*map(F.lit, tactics)), (_draw(seed, len(tactics), "nta", k) + 1).cast("int")).alias("tactic"), F.concat(F.lit("T1"), F.lpad(_draw(seed, 600, "nte", k).cast("string"), 3, "0")).alias("technique"),
        _weighted(seed, SEVERITY_WEIGHTS[profile][False], "nsev", k).alias("severity"), F.lit("0").alias("is_incident"), F.lit("").alias("incident_id"),
    )
    rows = chain.unionByName(noise)
    name = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "key").cast("binary")), 1, 8)
    process = F.element_at(F.array(*map(F.lit, PROCESSES)), (_draw(seed, len(PROCESSES), "proc", F.col("key")) + 1).cast("int"))
    return rows.select(name.alias("alert_id"), F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "source_node", "target_node", "user", "tactic", "technique", "severity", process.alias("process"), "is_incident", "incident_id")


def summarize(rows: DataFrame) -> DataFrame:
    """One row: alerts, incident alerts, incidents, severe shares of both classes (AGG-28, 29)."""
    inc, severe = F.col("is_incident") == "1", F.col("severity").isin("High", "Critical").cast("double")
    return rows.agg(F.count(F.lit(1)).alias("alerts"), F.count_if(inc).alias("incident_alerts"), F.countDistinct(F.when(inc, F.col("incident_id"))).alias("incidents"), F.coalesce(F.avg(F.when(inc, severe)), F.lit(0.0)).alias("incident_high_rate"), F.coalesce(F.avg(F.when(~inc, severe)), F.lit(0.0)).alias("noise_high_rate"))
