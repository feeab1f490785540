"""What the operators of this package share: size-checked joins by id, byte-level text hashing."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.operators.tables import few

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of rows that a Python worker gets at a time (a longer row comes alone).
BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package when only the driver's path has it, and bounds what they get at a time in bytes.

    Sets ``spark.sql.execution.arrow.maxBytesPerBatch`` of the session; Spark's own default is 64 MB.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH", "")]))


def fold_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; null is empty. ``lower`` equals that on pure ASCII and is far faster."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, UPPER.lower()))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def by_ids(docs: DataFrame, ids: DataFrame, column: str, how: str) -> DataFrame:
    """Semi or anti join of ``docs`` on distinct ``ids``; the ids are broadcast only if a count shows that they are few."""
    return docs.join(F.broadcast(ids) if few(ids) else ids, column, how)


def with_document(labels: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of ``labels`` whose doc_id a document has; only ids shuffle. Samples are drawn from these, never from labels that nothing can use."""
    return labels.join(docs.select(F.col("doc_id").cast(labels.schema["doc_id"].dataType).alias("doc_id")), "doc_id", "left_semi")


# --- text as bytes ---------------------------------------------------------------------------------------------------
#: Random odd base of the word hash, its inverse modulo 2**64, and a random value for each byte.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_table(is_word) -> np.ndarray:
    """For each byte its lower-cased word byte, or 0 if ``is_word`` says that it separates words."""
    return np.array([b + 32 if 65 <= b <= 90 else b if is_word(b) else 0 for b in range(256)], np.uint8)


#: Words are runs without blanks: ``[^\x20\x09-\x0D]+`` (a zero byte counts as a word byte, kept as 255, which UTF-8 never has).
SPACED = byte_table(lambda b: b != 32 and not 9 <= b <= 13)
SPACED[0] = 255
#: Words are runs of digits, letters and all beyond ASCII: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing.
ALNUM = byte_table(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
_POWERS: dict[str, np.ndarray] = {}
_KEPT: dict[str, Callable[[], None]] = {}


def claim(name: str, forget: Callable[[], None]) -> None:
    """Called by a task whose operator keeps something in the worker: what other operators kept there is dropped, since a worker serves them one after another."""
    others = [k for k in _KEPT if k != name]
    for other in others:
        _KEPT.pop(other)()
    _KEPT[name] = forget
    if others:
        give_back()


def give_back() -> None:
    """Returns freed memory of this worker to the machine; allocators otherwise keep it for the operators to come."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # only some C libraries have it
        pass


def claim_hashes() -> None:
    claim("hashes", _POWERS.clear)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("up", BASE), ("down", INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"], _POWERS["down"]


def hash_words(data: np.ndarray, starts: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Splits texts that lie end to end in ``data`` (text i begins at ``starts[i]``; the last entry is the end) into words.

    Returns each word's 64-bit hash, first byte and end, and where each text's words begin (one entry more than texts).
    """
    none = np.zeros(0, np.int64)
    if not len(data):
        return none.astype(np.uint64), none, none, np.zeros(len(starts), np.int64)
    low = table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    word = low > 0
    before = np.concatenate(([False], word[:-1])) & ~edge[:-1]
    after = np.concatenate((word[1:], [False])) & ~edge[1:]
    first, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[low] * word * up[: len(data)], out=total[1:])
    hashes = mix((total[end] - total[first]) * down[first] + (end - first).astype(np.uint64))
    return hashes, first, end, np.searchsorted(first, starts)


def text_buffers(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column and where each text begins in them; null is empty."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a = (a if a.null_count == 0 else a.fill_null("")).cast(pa.large_string())
    _, offsets, data = a.buffers()
    starts = np.frombuffer(offsets, np.int64, len(a) + 1, a.offset * 8) if len(a) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def slices(starts: np.ndarray, size: int):
    """Cuts texts into runs of about ``size`` bytes; a longer text is a run of its own."""
    i = 0
    while i < len(starts) - 1:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + size, "right")) - 1)
        yield i, j
        i = j
