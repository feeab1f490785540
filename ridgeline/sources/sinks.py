"""Writers: alerts, reports, clusters, comparison tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import constants as K


def write_alert_csv(rows: DataFrame, path: str) -> None:
    """The eleven alert columns with a header (SNK-01)."""
    rows.select(*K.FALCON_COLUMNS).write.mode("overwrite").option("header", True).csv(path)


def write_clusters(members: DataFrame, path: str) -> None:
    """One JSON line a cluster: incident_id and its sorted alert_ids (SNK-04)."""
    grouped = members.groupBy(F.col("cluster").alias("incident_id")).agg(F.array_sort(F.collect_list("alert_id")).alias("alert_ids"))
    grouped.write.mode("overwrite").json(path)


def write_summary(rows: DataFrame, path: str) -> None:
    """CSV with a header (SNK-05)."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def report(rows: DataFrame, limit: int = 1_000) -> str:
    """A small result as sorted JSON (SNK-02); over ``limit`` rows is an error, reports are summaries."""
    return json.dumps([r.asDict(recursive=True) for r in _few(rows, limit)], sort_keys=True, default=str, indent=2)


def _few(rows: DataFrame, limit: int) -> list:
    """All rows of a summary; more than ``limit`` are an error, never cut."""
    found = rows.limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"a report has at most {limit} rows")
    return found


def _cell(value, digits: int) -> str:
    return "" if value is None else f"{value:.{digits}f}" if isinstance(value, float) else str(value)


def markdown(rows: DataFrame, digits: int = 4, limit: int = 1_000) -> str:
    """A small result as a Markdown table (SNK-03, 08)."""
    cells = [[_cell(v, digits).replace("|", "\\|").replace("\n", " ") for v in r] for r in _few(rows, limit)]
    lines = [rows.columns, ["---"] * len(rows.columns), *cells]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def latex(rows: DataFrame, digits: int = 4, limit: int = 1_000) -> str:
    """A small result as a LaTeX tabular (SNK-08)."""
    fix = lambda s: s.replace("_", "\\_").replace("&", "\\&").replace("%", "\\%")
    body = [" & ".join(fix(_cell(v, digits)) for v in r) + r" \\" for r in _few(rows, limit)]
    head = " & ".join(map(fix, rows.columns)) + r" \\"
    return "\n".join([r"\begin{tabular}{" + "l" * len(rows.columns) + "}", r"\hline", head, r"\hline", *body, r"\hline", r"\end{tabular}"])


def prompts(candidates: DataFrame, members: DataFrame, batch: int = 10) -> DataFrame:
    """(batch, prompt): candidates with their alerts as JSON, ``batch`` to a prompt (SNK-09, EXT-04, AUX-20)."""
    rows = members.groupBy("cluster").agg(F.to_json(F.array_sort(F.collect_list(F.struct("ts", "alert_id", "tactic", "severity")))).alias("alerts"))
    numbered = candidates.join(rows, "cluster").withColumn("batch", F.pmod(F.xxhash64("cluster"), F.greatest(F.lit(1), F.ceil(F.lit(candidates.count()) / batch))))
    return numbered.groupBy("batch").agg(F.concat_ws("\n", F.array_sort(F.collect_list(F.concat(F.col("cluster").cast("string"), F.lit(" "), "alerts")))).alias("prompt"))
