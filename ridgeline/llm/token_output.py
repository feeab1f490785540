"""Token ids as Parquet list columns in id order, readable by token or by metadata alone."""

from __future__ import annotations

import itertools
import json
import os
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import BYTE_VALUES, claim, mix, powers, prepare, slices, text_buffers
from ridgeline.operators.tables import scratch

#: The settings of a tokenizer whose ids of a text are those of its units in turn (fixed values, as its file has them).
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: What the last token of a unit ends with.
SUFFIX = "</w>"
#: Classes of bytes. A letter is A-Z, a-z or two bytes of which the first is 0xC3; MIXED begins any other character beyond ASCII.
BLANK, LETTER, DIGIT, SYMBOL, MIXED = range(5)
CLASSES = np.full(256, SYMBOL, np.uint8)
for _chars, _kind in ((b" \t\n\v\f\r", BLANK), (b"0123456789", DIGIT), (bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 192)) + b"\xc3", LETTER), (bytes(range(192, 195)) + bytes(range(196, 256)), MIXED)):
    CLASSES[list(_chars)] = _kind
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_ENCODERS: dict[tuple[str, int], TextEncoder] = {}


def made_of_units(settings: dict) -> bool:
    """Whether a tokenizer's file has the settings under which ``units`` may cut texts; any other tokenizer gets whole texts."""
    step = settings.get("pre_tokenizer") or {}
    steps = step.get("pretokenizers", [])
    return (
        (settings.get("normalizer") or {}).get("normalizers") == NORMALIZERS
        and len(steps) == 2
        and (steps[0].get("type"), steps[0].get("pattern"), steps[0].get("behavior"), steps[0].get("invert")) == ("Split", {"Regex": PATTERN}, "Removed", True)
        and (steps[1].get("type"), steps[1].get("add_prefix_space"), steps[1].get("use_regex")) == ("ByteLevel", False, False)
        and not any(settings.get(k) for k in ("post_processor", "truncation", "padding"))
        and (settings["model"].get("type"), settings["model"].get("end_of_word_suffix")) == ("BPE", SUFFIX)
        and not any(settings["model"].get(k) for k in ("dropout", "continuing_subword_prefix"))
        and all(t["content"].startswith("<|") and not re.search(r"\s", t["content"]) for t in settings.get("added_tokens", []))
    )


def units(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and hash of every unit of the texts that lie end to end in ``data``, and whether it is a whole piece.

    A piece between ASCII blanks is cut into runs of letters, runs of symbols and single digits, which is what the
    tokenizer's pattern matches there. A piece is one unit if it holds characters that lower-casing, composition or the
    pattern may treat otherwise (beyond Latin letters), an apostrophe before a letter, or what begins a special token.
    """
    n = len(data)
    kind = CLASSES[data]
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    solid = kind > 0
    head = solid.copy()
    head[1:] &= ~solid[:-1] | edge[1:n]
    odd = kind == MIXED
    a, b = data[:-1], data[1:]
    odd[:-1] |= ((a == 39) & (kind[1:] == LETTER)) | ((a == 60) & (b == 124)) | ((a == 0xC3) & ((b == 0x97) | (b == 0xB7)))
    where = np.flatnonzero(odd)
    whole = np.zeros(n, bool)
    if len(where):
        heads = np.flatnonzero(head)
        owner = np.unique(np.searchsorted(heads, where, "right") - 1)
        ends = np.flatnonzero(solid & np.concatenate((~solid[1:] | edge[1:n], [True])))[owner]
        steps = np.zeros(n + 1, np.int8)
        steps[heads[owner]] = 1
        steps[ends + 1] -= 1
        whole = np.cumsum(steps[:-1], dtype=np.int8) > 0
    turn = kind == DIGIT
    turn[1:] |= kind[1:] != kind[:-1]
    first = np.flatnonzero(head | (turn & solid & ~whole))
    begin = np.zeros(n + 1, bool)
    begin[first] = True
    end = np.flatnonzero(solid & (begin[1:] | np.concatenate((~solid[1:], [True])) | edge[1:])) + 1
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE_VALUES[np.where(whole, data, LOWER[data])] * up[:n], out=total[1:])
        return first, end, mix((total[end] - total[first]) * down[first] + (end - first).astype(np.uint64)), whole[first]


class UnitTable:
    """Ids of units by 64-bit hash, in an open-addressing table that is probed for many at once.

    Beyond ``limit`` units or 8 * ``limit`` ids only those met since the last clearing stay; were these over half, none.
    A unit takes some 60 bytes.
    """

    def __init__(self, limit: int):
        self.limit, self.bits = limit, max(4, (2 * limit - 1).bit_length())
        self.clear()

    def clear(self) -> None:
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.n, self.used = 0, 0
        self.keys, self.start, self.size, self.met = np.zeros(1024, np.uint64), np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, bool)
        self.ids = np.zeros(4096, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key's unit, -1 for those not there."""
        mask = np.uint64(len(self.slots) - 1)
        at = (keys >> np.uint64(20) & mask).astype(np.int64)
        out = self.slots[at]
        left = np.flatnonzero((out >= 0) & (self.keys[np.maximum(out, 0)] != keys))
        while len(left):
            at[left] = (at[left] + 1) & int(mask)
            out[left] = self.slots[at[left]]
            left = left[(out[left] >= 0) & (self.keys[np.maximum(out[left], 0)] != keys[left])]
        self.met[out[out >= 0]] = True
        return out

    def add(self, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Adds distinct keys that are not there."""
        n, used = self.n + len(keys), self.used + len(ids)
        for name, least in (("keys", n), ("start", n), ("size", n), ("met", n), ("ids", used)):
            old = getattr(self, name)
            if len(old) < least:
                setattr(self, name, np.concatenate((old, np.zeros(max(least, 2 * len(old)) - len(old), old.dtype))))
        self.keys[self.n : n], self.size[self.n : n], self.met[self.n : n] = keys, sizes, False
        self.start[self.n : n] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : used] = ids
        if 2 * n > len(self.slots):  # a run with more units than the limit
            self.bits = (4 * n - 1).bit_length()
            self.slots = np.full(1 << self.bits, -1, np.int32)
            self._place(np.arange(n, dtype=np.int32))
        else:
            self._place(np.arange(self.n, n, dtype=np.int32))
        self.n, self.used = n, used

    def _place(self, numbers: np.ndarray) -> None:
        mask = len(self.slots) - 1
        at = (self.keys[numbers] >> np.uint64(20) & np.uint64(mask)).astype(np.int64)
        while len(numbers):
            free = self.slots[at] < 0
            self.slots[at[free]] = numbers[free]  # of several for one slot the last stays
            lost = self.slots[at] != numbers
            numbers, at = numbers[lost], (at[lost] + 1) & mask

    def trim(self) -> None:
        if self.n <= self.limit and self.used <= 8 * self.limit:
            return
        stay = np.flatnonzero(self.met[: self.n])
        keys, sizes = self.keys[stay], self.size[stay]
        ids = self.gather(stay)
        self.bits = max(4, (2 * self.limit - 1).bit_length())
        self.clear()
        if len(keys) <= self.limit // 2 and len(ids) <= 4 * self.limit:
            self.add(keys, sizes, ids)

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of units, one after another."""
        sizes = self.size[numbers]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.start[numbers] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class TextEncoder:
    """Encodes texts with the tokenizers library.

    The library meets each distinct unit once while it is remembered, if the tokenizer's file shows that a text's ids are
    those of its units in turn (``made_of_units``); else it meets every whole text. Units of one kind need no composing and
    no pattern, so they are lower-cased and reach the library a hundred at a time, one word each of a text between blanks;
    the ids of a word end with one whose token has the suffix. Whole pieces reach the tokenizer as it is.
    """

    def __init__(self, path: str, limit: int):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.table = Tokenizer.from_file(path), UnitTable(limit)
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        self.by_unit = made_of_units(settings)
        if self.by_unit:
            vocabulary = settings["model"]["vocab"]
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for t, i in vocabulary.items() if t.endswith(SUFFIX)]] = True
            self.words = Tokenizer.from_file(path)
            self.words.normalizer = None
            self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def _texts(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for i in range(0, len(raw), 1000) for e in self.tokenizer.encode_batch_fast([r.decode() for r in raw[i : i + 1000]], add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return sizes, np.fromiter(itertools.chain.from_iterable(found), np.int32, int(sizes.sum()))

    def _words(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [b" ".join(raw[i : i + 100]).decode().lower() for i in range(0, len(raw), 100)]
        ids = np.concatenate([np.array(e.ids, np.int32) for e in self.words.encode_batch_fast(texts, add_special_tokens=False)] or [np.zeros(0, np.int32)])
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(raw):
            raise ValueError("the tokenizer ends words otherwise than its file says")
        return np.diff(ends, prepend=0), ids

    def encode(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text that lies in ``data`` from its start on, and the ids one after another."""
        raw = data.tobytes()
        if not self.by_unit:
            return self._texts([raw[i:j] for i, j in itertools.pairwise(starts.tolist())])
        if not len(data):
            return np.zeros(len(starts) - 1, np.int64), np.zeros(0, np.int32)
        table = self.table
        table.trim()
        first, end, keys, whole = units(data, starts)
        found = table.find(keys)
        gaps = np.flatnonzero(found < 0)
        if len(gaps):
            fresh, one = np.unique(keys[gaps], return_index=True)
            one = gaps[one]
            for some, ask in ((whole[one], self._texts), (~whole[one], self._words)):
                table.add(fresh[some], *ask([raw[i:j] for i, j in zip(first[one[some]].tolist(), end[one[some]].tolist(), strict=True)]))
            found[gaps] = table.find(keys[gaps])
        ends = np.concatenate(([0], np.cumsum(table.size[found])))
        return np.diff(ends[np.searchsorted(first, starts)]), table.gather(found)

    def encode_runs(self, data: np.ndarray, starts: np.ndarray, size: int = 1 << 18):
        """Runs of texts of about ``size`` bytes (from, to) with their ``encode``; a longer text is cut at blanks and put together again."""
        for i, j in slices(starts, size):
            a, b = int(starts[i]), int(starts[j])
            if b - a <= 2 * size or not self.by_unit:
                yield i, j, *self.encode(data[a:b], starts[i : j + 1] - a)
                continue
            parts = []
            while a < b:
                cut = min(a + size, b)
                while cut < b and CLASSES[data[cut]] != BLANK:
                    cut += 1
                parts.append(self.encode(data[a:cut], np.array([0, cut - a]))[1])
                a = cut
            ids = np.concatenate(parts)
            yield i, j, np.array([len(ids)], np.int64), ids


def encoder(path: str, limit: int) -> TextEncoder:
    claim("tokens", _ENCODERS.clear)
    if (path, limit) not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is the only one it has
        _ENCODERS[path, limit] = TextEncoder(path, limit)
    return _ENCODERS[path, limit]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, text_col: str = "text", id_col: str = "doc_id", row_group_mb: int = 16, page_rows: int = 1_000, remember: int = 400_000) -> None:
    """Writes ``docs`` to ``path`` in ascending id order: files shard=0, 1, ... of rows (doc_id, n_tokens, shard_start, tokens).

    Each whole text (null: empty) is encoded without special tokens and ended by ``end_id``. Ids are dictionary-encoded
    Parquet lists, two bytes or fewer before compression; the ascending integer columns are delta-encoded. Row groups
    hold ``row_group_mb``, pages ``page_rows`` rows, and page indexes let a reader fetch the tokens of an id range, or
    only the metadata columns. shard_start is the number of ids before a row in its shard.

    Texts are range-partitioned by id and sorted within their partition, which spills if it must; encoding follows, so
    the sample that finds the ranges doesn't encode. Rows with equal ids, and null ids, which come first, keep the order
    of their texts. A worker remembers the ids of up to
    ``remember`` units, some 60 bytes each. A very long text is encoded in parts and is one list. Ids must fit in 31 bits. An
    empty table writes no rows.
    """
    prepare(docs.sparkSession)
    # ranges take the text's hash as a second key, so many rows of one id don't meet in one task
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("shard_start", pa.int64()), ("tokens", pa.list_(pa.int32()))])

    def encode(batches):
        coder, before = encoder(tokenizer, remember), 0
        for b in batches:
            data, starts = text_buffers(b.column("text"))
            for i, j, sizes, ids in coder.encode_runs(data, starts):
                ends = np.cumsum(sizes + 1)
                flat = np.full(int(ends[-1]), end_id, np.int32)
                flat[np.arange(len(ids)) + np.repeat(np.arange(j - i), sizes)] = ids
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(sizes + 1), pa.array(before + ends - sizes - 1), lists], schema=schema)
                before += int(ends[-1])

    encoded = ordered.mapInArrow(encode, "doc_id long, n_tokens long, shard_start long, tokens array<int>").withColumn("shard", F.spark_partition_id())
    writer = encoded.write
    for key, value in {
        "parquet.block.size": row_group_mb << 20,
        "parquet.page.row.count.limit": page_rows,
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary#doc_id": "false",
        "parquet.enable.dictionary#n_tokens": "false",
        "parquet.enable.dictionary#shard_start": "false",
        "compression": "zstd",
    }.items():
        writer = writer.option(key, value)
    writer.parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, n_tokens, shard, start): read without the tokens. start is the number of ids of all documents before."""
    rows = spark.read.parquet(path).select("doc_id", "n_tokens", "shard", "shard_start")
    return rows.join(F.broadcast(_offsets(rows)), "shard").select("doc_id", "n_tokens", "shard", (F.col("offset") + F.col("shard_start")).alias("start"))


def _offsets(rows: DataFrame) -> DataFrame:
    """Ids in all shards before each: one row a shard, so few."""
    from pyspark.sql import Window

    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("offset"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, n_tokens, start, tokens) of files that ``write_tokens`` made; filters on doc_id reach the page index."""
    rows = spark.read.parquet(path)
    return rows.join(F.broadcast(_offsets(rows)), "shard").select("doc_id", "n_tokens", (F.col("offset") + F.col("shard_start")).alias("start"), "tokens")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files' tokens: the crc32 is over the ids as little-endian 32-bit integers."""
    prepare(spark)

    def digest(batches):
        for b in batches:
            lists = b.column("tokens")
            at = lists.offsets.to_numpy()
            flat = lists.values.to_numpy().astype("<u4")
            sums = [crc32(flat[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_tokens(spark, path).select("doc_id", "start", "tokens").mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, **settings) -> DataFrame:
    """Writes ``docs`` into a new folder in shared storage and reads the digests of every document back."""
    path = scratch(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, **settings)
    return token_digests(docs.sparkSession, path)
