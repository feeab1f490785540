"""Token counts of fields and sections, from one encoding of each whole document."""

from __future__ import annotations

import base64
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import claim, prepare

#: Splits text ahead of byte-pair merging, as the vocabulary was made with (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("start", "end", "majority")
_ENCODERS: dict[str, tuple[Callable, np.ndarray]] = {}


def encoder(path: str) -> tuple[Callable, np.ndarray]:
    """Encoding function of the rank file at ``path`` and the bytes of each token; kept by the worker."""
    claim("counts", _ENCODERS.clear)
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, i in ranks.items():
            sizes[i] = len(t)
        e = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        _ENCODERS[path] = (e.encode_ordinary, sizes)
    return _ENCODERS[path]


def allocate(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Joins token spans with sections; section i is [bounds[i], bounds[i + 1]). Returns each token's section and whether it crosses.

    A crossing token goes whole to the section of its first unit (``start``), of its last (``end``), or to the one that
    holds most of its units, the earliest of equals (``majority``).
    """
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends - 1, "right") - 1
    if rule == "end":
        return last, first != last
    if rule == "majority":
        first = first.copy()
        crossing = np.flatnonzero(first != last)
        for t in crossing:
            own = range(first[t], last[t] + 1)
            first[t] = max(own, key=lambda s: (min(ends[t], bounds[s + 1]) - max(starts[t], bounds[s]), -s))
        flags = np.zeros(len(first), bool)
        flags[crossing] = True
        return first, flags
    return first, first != last


def attribute(fields: Sequence[str | None], encode: Callable, sizes: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Encodes the fields, joined by a line end, as one text; its sections are lines, each with the line end that closes it.

    Returns the tokens of each section, the number of the field of each section, and the crossing tokens of each section.
    Spans count characters: a token that begins inside a character's bytes begins at that character.
    """
    text = "\n".join(f or "" for f in fields)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    at = np.cumsum((raw & 0xC0) != 0x80)  # characters begun up to each byte
    chars = int(at[-1]) if len(at) else 0
    line_ends = at[raw == 10]
    bounds = np.unique(np.concatenate(([0], line_ends, [chars])))
    field_starts = np.cumsum([0] + [len(f or "") + 1 for f in fields[:-1]])
    n = max(len(bounds) - 1, 0)
    owner = np.searchsorted(field_starts, bounds[:-1], "right") - 1
    ids = np.asarray(encode(text), np.int64)
    if not len(ids):
        return np.zeros(n, np.int64), owner, np.zeros(n, np.int64)
    stop = np.cumsum(sizes[ids])
    begin = np.concatenate(([0], stop[:-1]))
    section, crossing = allocate(at[begin] - 1, at[stop - 1], bounds, rule)
    return np.bincount(section, minlength=n), owner, np.bincount(section[crossing], minlength=n)


def section_tokens(docs: DataFrame, tokenizer: str, fields: Sequence[str] = ("text",), rule: str = "majority", id_col: str = "doc_id", detail: bool = False) -> DataFrame:
    """Tokens of every document by field and section.

    One row per row of ``docs``: doc_id, n_tokens, field_tokens (array in the order of ``fields``), n_sections,
    max_section_tokens, crossing_tokens; with ``detail`` also section_tokens (array). Each document, its fields joined by
    line ends, is encoded once and whole with the rank file ``tokenizer``; token spans are joined with the section
    intervals, and a token that crosses a boundary is counted once, by ``rule`` (see ``allocate``), so parts add up to the
    whole. A line end belongs to the line, and field, that it closes.

    Null fields count as empty; a document whose fields are all empty has only its joining line ends (none with a single
    field: then no sections, no tokens). Texts may have any length. Repeated rows count alike; empty tables give no rows;
    columns not named are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    prepare(docs.sparkSession)
    names = [f"f{i}" for i in range(len(fields))]
    types = "doc_id long, n_tokens long, field_tokens array<long>, n_sections long, max_section_tokens long, crossing_tokens long" + ", section_tokens array<long>" * detail
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int64())] * detail
    labels = [t.split()[0] for t in types.split(", ")]

    def count(batches):
        encode, sizes = encoder(tokenizer)
        for b in batches:
            rows = []
            for key, *parts in zip(b.column(0).to_pylist(), *(b.column(n).to_pylist() for n in names), strict=True):
                tokens, owner, crossing = attribute(parts, encode, sizes, rule)
                by_field = np.bincount(owner, tokens, len(parts)).astype(np.int64).tolist()
                row = [key, int(tokens.sum()), by_field, len(tokens), int(tokens.max()) if len(tokens) else 0, int(crossing.sum())]
                rows.append(row + [tokens.tolist()] * detail)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], labels)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), *[F.col(f).cast("string").alias(n) for f, n in zip(fields, names, strict=True)]).mapInArrow(count, types)
