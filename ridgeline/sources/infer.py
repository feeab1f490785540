"""Which nested field plays which role, told from a few sampled records."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import constants as K


def leaves(value, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], object]]:
    """Paths and values of a record's leaves; of a list of objects only the first counts (SCH-02)."""
    for name, inner in value.items():
        here = (*path, name)
        if isinstance(inner, dict):
            yield from leaves(inner, here)
        elif isinstance(inner, list) and inner and isinstance(inner[0], dict):
            yield from leaves(inner[0], (*here, "0"))
        else:
            yield here, inner


def _plain(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def path_score(path: tuple[str, ...], names: tuple[str, ...]) -> int:
    """Points of a path for a role: the place of its leaf among the names, and what its parts speak for or against."""
    exact = next((100 - i for i, n in enumerate(names) if _plain(n) == _plain(path[-1])), 0)
    joined = ".".join(path).lower()
    traced = len(path) >= 3 and path[0] == "traces" and path[-1].lower() == "timestamp"
    return exact + 12 * sum(p in joined for p in K.FAVOURED_PARTS) - 25 * sum(p in joined for p in K.DISFAVOURED_PARTS) + 40 * traced


def infer_fields(records: DataFrame, column: str = "v", sample: int = 5) -> dict[str, str]:
    """Role -> VARIANT path, from the first few records; no id or no label is an error (SCH-01, 05).

    A role takes the path with most points, the shorter of equals; entities take only paths with text in some record.
    """
    texts = [r[0] for r in records.select(F.to_json(F.col(column))).limit(sample).collect()]
    parsed = [json.loads(t) for t in texts if t]
    seen: dict[tuple[str, ...], list] = {}
    for record in parsed:
        for path, value in leaves(record):
            seen.setdefault(path, []).append(value)
    out = {}
    for role, names in K.FIELD_NAMES.items():
        entity = role in K.RAW_ROLES
        paths = [p for p in seen if not entity or any(isinstance(v, str) and v.strip() for v in seen[p])]
        scored = [(path_score(p, names), p) for p in paths if not entity or any(_plain(n) == _plain(p[-1]) for n in names)]
        best = min((s for s in scored if s[0] > 0), key=lambda s: (-s[0], len(s[1])), default=None)
        if best:
            out[role] = "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in best[1])
    for role in ("alert_id", "label"):
        if role not in out:
            raise ValueError(f"no field looks like {role}")
    return out


def select_fields(records: DataFrame, fields: dict[str, str], column: str = "v") -> DataFrame:
    """The roles as text columns; tactic and technique fall back to the first MITRE block beside them (SCH-03, 04)."""
    get = lambda role: F.try_variant_get(column, fields[role], "string") if role in fields else F.lit(None).cast("string")
    return records.select(*[get(r).alias(r) for r in K.FIELD_NAMES])


def nested(column: str, path: str, type: str = "string") -> Column:
    """Value at a dotted path, whose numbers are places in lists."""
    return F.try_variant_get(column, "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in path.split(".")), type)
