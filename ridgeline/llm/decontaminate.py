"""Benchmark decontamination with an FM-index of each shard of the training texts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import ALNUM, claim_hashes, hash_words, prepare, slices, text_buffers
from ridgeline.operators.tables import materialize

#: Symbols of the indexed text: its own end, the end of a document, then the shard's words in order of their hashes.
LAST, END, FIRST = 0, 1, 2


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """All suffixes in order, by prefix doubling: each round sorts only suffixes that still equal another."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    bits = max(1, int(symbols - 1).bit_length())
    reach = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for j in range(reach):  # the first symbols packed in one number; past the end counts as the smallest symbol
        key <<= bits
        if j < n:
            key[: n - j] |= text[j:]
    order = np.argsort(key, kind="stable")
    head = np.empty(n, bool)
    head[0] = True
    head[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    del key
    while True:
        tail = np.concatenate((head[1:], [True]))
        open_ = np.flatnonzero(~(head & tail))
        if not len(open_) or reach >= 2 * n:
            return order
        suffixes = order[open_]
        after = suffixes + reach
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = rank[suffixes] * (n + 1) + second
        perm = np.argsort(by, kind="stable")
        suffixes, by = suffixes[perm], by[perm]
        order[open_] = suffixes
        start = np.concatenate(([True], by[1:] != by[:-1]))
        head[open_] |= start
        rank[suffixes] = np.maximum.accumulate(np.where(start, open_, 0))
        reach *= 2


class WaveletMatrix:
    """Ranks of any symbol in a sequence, a bit level at a time."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.bits - 1, -1, -1):
            bit = (seq >> level) & 1
            ones = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(seq) - int(ones[-1]))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))
        self.start = self._down(np.arange(symbols), np.zeros(symbols, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            r = ones[i]
            i = np.where((c >> (self.bits - 1 - level)) & 1, zeros + r, i - r)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c[k] occurs before position i[k]."""
        return self._down(c, i) - self.start[c]

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it occurs before."""
        c = np.zeros(len(i), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            r, bit = ones[i], ones[i + 1] - ones[i]
            c = (c << 1) | bit
            i = np.where(bit == 1, zeros + r, i - r)
        return c, i - self.start[c]


class FMIndex:
    """Backward search over the Burrows-Wheeler transform of a shard's symbols, which must end with ``LAST`` and have it nowhere else."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = 8):
        order = suffix_array(text, symbols)
        self.n, self.sample = len(text), sample
        self.wavelet = WaveletMatrix(text[order - 1].astype(np.int32), symbols)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))
        self.marked = order % sample == 0
        self.marked_before = np.concatenate(([0], np.cumsum(self.marked, dtype=np.int32)))
        self.positions = order[self.marked]

    def search(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end row of the suffixes that begin with each phrase (rows of symbols, right-aligned, of ``sizes``)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        width = phrases.shape[1]
        for j in range(width - 1, -1, -1):
            on = np.flatnonzero((sizes >= width - j) & (high > low))
            c = phrases[on, j]
            low[on] = self.before[c] + self.wavelet.rank(c, low[on])
            high[on] = self.before[c] + self.wavelet.rank(c, high[on])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes: each steps back through the text until it meets a sampled one."""
        out, at, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(at):
            hit = self.marked[rows]
            out[at[hit]] = self.positions[self.marked_before[rows[hit]]] + steps
            at, rows = at[~hit], rows[~hit]
            c, r = self.wavelet.access_rank(rows)
            rows = self.before[c] + r
            steps += 1
        return out


@dataclass(frozen=True)
class Phrases:
    """A block of test phrases: the word hashes of items end to end, where each item begins, and the items' ids."""

    words: np.ndarray
    starts: np.ndarray
    items: list[str | None]

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct windows of ``width`` consecutive words (rows of hashes, right-aligned), their sizes, and which items have each: the
        owners of window i are ``owners[at[i] : at[i + 1]]``. An item of fewer words, but not none, is one window."""
        size = np.diff(self.starts)
        n = np.where(size > 0, np.maximum(size - width + 1, 1), 0)
        item = np.repeat(np.arange(len(size)), n)
        begin = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n) + self.starts[item]
        long = np.minimum(size, width)[item]
        place = begin[:, None] + np.arange(width) - (width - long)[:, None]
        rows = np.where(np.arange(width) >= (width - long)[:, None], self.words[np.maximum(place, 0)], np.uint64(0))
        order = np.lexsort((item, *rows.T, long))
        rows, item, long = rows[order], item[order], long[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]).any(1) | (long[1:] != long[:-1])
        at = np.append(np.flatnonzero(new), len(rows))
        return rows[new], long[new], at, item


def phrase_blocks(items: list[tuple[str | None, np.ndarray]], width: int, block_items: int, block_words: int) -> list[Phrases]:
    """Cuts items into blocks of up to ``block_items`` items and about ``block_words`` words; a longer item goes on in the next block, ``width`` - 1 words back."""
    pieces = []
    for name, words in items:
        step = max(1, block_words)
        for i in range(0, max(1, len(words) - width + 1), step):
            pieces.append((name, words[i : i + step + width - 1]))
    blocks, held, n = [], [], 0
    for k, (name, words) in enumerate(pieces):
        held.append((name, words))
        n += len(words)
        if n >= block_words or len(held) == block_items or k == len(pieces) - 1:
            blocks.append(Phrases(np.concatenate([w for _, w in held]), np.cumsum([0, *(len(w) for _, w in held)]), [i for i, _ in held]))
            held, n = [], 0
    return blocks


def item_words(texts: list[str | None]) -> list[np.ndarray]:
    data, starts = text_buffers(pa.array(texts, pa.string()))
    hashes, _, _, at = hash_words(data, starts, ALNUM)
    return [hashes[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]


def scan_shard(data: np.ndarray, starts: np.ndarray, blocks, width: int, chunk: int = 1 << 20):
    """Indexes all words of one shard's texts and finds the phrases of all ``blocks`` in it.

    Returns for each text the number of words and its item ids, and for the shard the merged spans: arrays of the
    text's number, first and end word, first byte and end in the text.
    """
    words, first, end, at = hash_words(data, starts, ALNUM)
    docs = len(starts) - 1
    n_words = np.diff(at)
    found: list[set[str | None]] = [set() for _ in range(docs)]
    none = np.zeros(0, np.int64)
    if not len(words):
        return n_words, found, (none,) * 5
    vocabulary, symbol = np.unique(words, return_inverse=True)
    doc = np.repeat(np.arange(docs), n_words)
    slot = np.arange(len(words)) + doc  # each document ends with END
    text = np.full(len(words) + docs + 1, END, np.int64)
    text[-1] = LAST
    text[slot] = symbol + FIRST
    back = np.full(len(text), -1, np.int64)
    back[slot] = np.arange(len(words))
    index = FMIndex(text, len(vocabulary) + FIRST)
    edges = np.zeros(len(words) + 1, np.int64)
    for block, (windows, sizes, owner_at, owners) in blocks:
        place = np.minimum(np.searchsorted(vocabulary, windows), len(vocabulary) - 1)
        padding = np.arange(width) < (width - sizes)[:, None]
        known = np.flatnonzero(((vocabulary[place] == windows) | padding).all(1))  # a word that the shard lacks is nowhere in its index
        low, high = index.search((place[known] + FIRST).astype(np.int32), sizes[known])
        there, counts = np.flatnonzero(high > low), high - low
        counts = counts[there]
        ends = np.cumsum(counts)
        i = 0
        while i < len(there):  # a bounded number of occurrences at a time, though one window's all at once
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + chunk, "right")))
            which = np.repeat(there[i:j], counts[i:j])
            skip = np.repeat(ends[i:j] - counts[i:j], counts[i:j])
            base = ends[i - 1] if i else 0
            rows = low[which] + (np.arange(len(which)) + base - skip)
            word = back[index.locate(rows)]
            window = known[which]
            np.add.at(edges, word, 1)
            np.add.at(edges, word + sizes[window], -1)
            pairs = np.unique(doc[word] * len(sizes) + window)
            for d, w in zip((pairs // len(sizes)).tolist(), (pairs % len(sizes)).tolist(), strict=True):
                found[d].update(block.items[k] for k in owners[owner_at[w] : owner_at[w + 1]])
            i = j
    hit = np.cumsum(edges[:-1]) > 0
    new = hit & ~(np.concatenate(([False], hit[:-1])) & np.concatenate(([False], doc[1:] == doc[:-1])))
    last = hit & ~(np.concatenate((hit[1:], [False])) & np.concatenate((doc[1:] == doc[:-1], [False])))
    a, b = np.flatnonzero(new), np.flatnonzero(last)
    d = doc[a]
    return n_words, found, (d, a - at[d], b + 1 - at[d], first[a] - starts[d], end[b] - starts[d])


SPANS = "array<struct<first_word:int,end_word:int,first_byte:int,end_byte:int>>"
SPAN = pa.list_(pa.struct([(n, pa.int32()) for n in ("first_word", "end_word", "first_byte", "end_byte")]))


def _searchers(spark: SparkSession, benchmark: DataFrame, width: int, shard_bytes: int, block_items: int, block_words: int, part_bytes: int, unnamed: bool):
    """A function for tasks per part of the benchmark: of a column of texts, each run of rows (from, to) with what ``scan_shard`` finds in it."""
    prepare(spark)
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null" if unnamed else "item_id is not null and text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // part_bytes))

    def searcher(part: int):
        got = rows.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == part).toPandas().sort_values(["item_id", "text"])
        items = zip(got["item_id"].astype(object).where(got["item_id"].notna(), None), item_words(got["text"].tolist()), strict=True)
        blocks = [spark.sparkContext.broadcast(b) for b in phrase_blocks([i for i in items if len(i[1])], width, block_items, block_words)]
        ready: list = []

        def load():
            if len(blocks) == 1:  # kept for all shards of a task
                if not ready:
                    ready.append((blocks[0].value, blocks[0].value.windows(width)))
                yield from ready
                return
            for b in blocks:
                yield b.value, b.value.windows(width)
                del b._value

        def search(column):
            data, starts = text_buffers(column)
            for i, j in slices(starts, shard_bytes):
                yield i, j, *scan_shard(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i], load(), width)

        return search

    return parts, searcher


def _scanned(docs: DataFrame, search, keys: str) -> DataFrame:
    """(keys of ``docs``, n_words, items, spans) of every row of ``docs`` (keys, text)."""
    names = [n for n in docs.columns if n != "text"]

    def scan(batches):
        claim_hashes()
        for batch in batches:
            for i, j, n_words, found, (d, a, b, x, y) in search(batch.column("text")):
                at = np.concatenate(([0], np.cumsum(np.bincount(d, minlength=j - i))))
                spans = pa.StructArray.from_arrays([pa.array(v.astype(np.int32)) for v in (a, b, x, y)], fields=list(SPAN.value_type))
                items = pa.array([sorted(f - {None}) + [None] * (None in f) for f in found], pa.list_(pa.string()))  # those without an id: one null
                yield pa.RecordBatch.from_arrays([*(batch.column(n).slice(i, j - i) for n in names), pa.array(n_words.astype(np.int64)), items, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), spans)], [*names, "n_words", "items", "spans"])

    return docs.mapInArrow(scan, f"{keys}, n_words long, items array<string>, spans {SPANS}")


def _united(parts: list[DataFrame]) -> DataFrame:
    """What several parts of a benchmark found, by row: items united and spans merged."""
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p.filter("size(spans) > 0"))
    by_row = hits.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    # a span that begins within the last one, or where it ends, is drawn into it
    merged = """aggregate(spans, cast(array() as SPANS), (a, x) -> if(size(a) > 0 and element_at(a, -1).end_word >= x.first_word,
        concat(slice(a, 1, size(a) - 1), array(named_struct('first_word', element_at(a, -1).first_word, 'end_word', greatest(element_at(a, -1).end_word, x.end_word),
        'first_byte', element_at(a, -1).first_byte, 'end_byte', greatest(element_at(a, -1).end_byte, x.end_byte)))), concat(a, array(x))))"""
    return by_row.withColumn("spans", F.expr(merged.replace("SPANS", SPANS)))


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, shard_bytes: int = 1 << 20, block_items: int = 20_000, block_words: int = 200_000, part_bytes: int = 64 << 20, unnamed: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (merged, to be removed).

    Words are runs of digits, letters and all characters beyond ASCII, A-Z lower-cased. A phrase is ``width`` consecutive
    words of a benchmark item, or all words of a shorter item. Each task cuts its texts into shards of about
    ``shard_bytes`` (a longer text is a shard), numbers their words and builds the FM-index of all of them; every phrase is
    searched backwards in it, and occurrences are located from sampled suffixes. Words are told apart by 64-bit hashes.
    Nothing shuffles, and copies or passages that many documents share cost no more than other text.

    The benchmark is the query set: it is broadcast in blocks of ``block_items`` items or ``block_words`` words that a task loads one after another.
    One of over ``part_bytes`` is searched in parts, each by a pass of its own over the texts, whose results are united by
    row; a benchmark of any size is thus searched whole, in more time. Null and empty texts have no words and no hits; null
    texts and items without words match nothing; items that repeat count under each id. Items with a null id are left
    out, or with ``unnamed`` searched like others: they count as one item together, and ``items_sha256`` has no id of
    theirs. Without a benchmark nothing is contaminated. Repeated rows are treated alike; empty tables give no rows; other
    columns are not read.
    """
    parts, searcher = _searchers(docs.sparkSession, benchmark, width, shard_bytes, block_items, block_words, part_bytes, unnamed)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if parts == 1:
        found = _scanned(rows, searcher(0), "doc_id long")
    else:
        numbered = materialize(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "texts")
        found = _united([materialize(_scanned(numbered, searcher(k), "row long, doc_id long"), "part") for k in range(parts)])
    hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end_word - s.first_word)")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "spans")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, shard_bytes: int = 1 << 20, block_items: int = 20_000, block_words: int = 200_000, part_bytes: int = 64 << 20, unnamed: bool = False) -> DataFrame:
    """The rows of ``docs`` that ``find_contamination`` doesn't mark, with all their columns.

    Each row is decided by its own text where it lies, so null and repeated ids matter to nobody, and nothing shuffles. A
    benchmark of several parts drops rows part by part.
    """
    parts, searcher = _searchers(docs.sparkSession, benchmark, width, shard_bytes, block_items, block_words, part_bytes, unnamed)

    def without(rows: DataFrame, search) -> DataFrame:
        def keep(batches):
            claim_hashes()
            for batch in batches:
                for i, j, _, _, (d, *_) in search(batch.column("text")):
                    clean = np.ones(j - i, bool)
                    clean[d] = False
                    yield batch.slice(i, j - i).filter(pa.array(clean))

        return rows.mapInArrow(keep, docs.schema)

    for k in range(parts):
        docs = without(docs, searcher(k))
    return docs


SQL = r"""
WITH lower_docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
                 FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
                FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM lower_docs, sizes WHERE len(w) >= n)),
hits AS (SELECT d.doc_id, d.i, d.n, m.item_id FROM doc_windows d JOIN item_windows m ON d.n = m.n AND d.win = m.win),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(k.n_items, 0) AS n_items,
       sha256(coalesce(k.names, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM lower_docs d LEFT JOIN hit_words h ON d.doc_id = h.doc_id LEFT JOIN hit_items k ON d.doc_id = k.doc_id
"""
