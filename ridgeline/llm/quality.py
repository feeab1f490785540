"""Quality by nearest-neighbour voting among labelled documents in a latent-semantic space."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import SPACED, claim_hashes, hash_words, mix, prepare, slices, text_buffers, with_document

#: Kinds of characters whose triples are the terms of a text's shape: small letters and all beyond ASCII, capitals, digits, blanks, line ends, stops and quotes, marks, other symbols.
SHAPES = np.full(256, 7, np.uint8)
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)), b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:'\"()-", b"!?")):
    SHAPES[list(_chars)] = _i
#: Terms by family: triples of kinds, hashed triples of bytes, and how far back a word was met last (by powers of two; 0: never).
FAMILIES = (512, 1024, 24)
TERMS = sum(FAMILIES)
#: Steps of a coordinate. Products of such coordinates are summed without rounding in 32-bit floats, in any order.
STEPS = 2048


def term_matrix(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Square roots of the shares of each family's terms in whole texts that lie end to end in ``data``; a row a text."""
    docs = len(starts) - 1
    out = np.zeros((docs, TERMS), np.float32)
    at = 0
    if len(data) > 2:
        doc = np.repeat(np.arange(docs), np.diff(starts))[:-2]
        inside = np.arange(len(data) - 2) + 2 < starts[doc + 1]
        doc = doc[inside]
        k = SHAPES[data].astype(np.int64)
        b = data.astype(np.uint32)
        hashed = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)
        hashed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        for terms, n in (((k[:-2] * 8 + k[1:-1]) * 8 + k[2:], FAMILIES[0]), ((hashed >> np.uint32(22)).astype(np.int64), FAMILIES[1])):
            out[:, at : at + n] = np.bincount(doc * n + terms[inside], minlength=docs * n).reshape(docs, n)
            at += n
    at = FAMILIES[0] + FAMILIES[1]
    words, _, _, begin = hash_words(data, starts, SPACED)
    if len(words):
        doc = np.repeat(np.arange(docs), np.diff(begin))
        with np.errstate(over="ignore"):
            key = words ^ mix(doc.astype(np.uint64) + np.uint64(1))
        order = np.argsort(key, kind="stable")
        again = key[order[1:]] == key[order[:-1]]
        gap = np.zeros(len(words), np.int64)
        gap[order[1:][again]] = (order[1:] - order[:-1])[again]
        band = np.minimum(np.frexp(gap.astype(float))[1], FAMILIES[2] - 1)  # the number of bits
        out[:, at:] = np.bincount(doc * FAMILIES[2] + band, minlength=docs * FAMILIES[2]).reshape(docs, -1)
    at = 0
    for n in FAMILIES:
        part = out[:, at : at + n]
        np.sqrt(part / np.maximum(part.sum(1, keepdims=True), 1), out=part)
        at += n
    return out


def _runs(texts: Sequence[str | None] | pa.Array | pa.ChunkedArray, size: int = 1 << 18):
    """Terms of runs of about ``size`` bytes of texts."""
    data, starts = text_buffers(texts if isinstance(texts, pa.Array | pa.ChunkedArray) else pa.array(list(texts), pa.string()))
    for i, j in slices(starts, size):
        yield term_matrix(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i])


def _unit(a: np.ndarray) -> np.ndarray:
    return a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-9)


@dataclass(frozen=True)
class NeighbourModel:
    """Terms' weights, the latent axes, and the labelled unit vectors with their labels."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int
    power: int

    def place(self, x: np.ndarray) -> np.ndarray:
        """Rows of terms as unit vectors on the axes, in ``STEPS``; each row by itself, so that equal texts get equal vectors in any batch."""
        out = np.zeros((len(x), self.axes.shape[1]))
        for i, row in enumerate(x):
            v = (row * self.idf) @ self.axes
            out[i] = v / max(np.sqrt(float((v * v).sum())), 1e-9)
        return (np.round(out * STEPS) / STEPS).astype(np.float32)

    def project(self, texts: Sequence[str | None]) -> np.ndarray:
        return np.concatenate([self.place(x) for x in _runs(texts)] or [np.zeros((0, self.axes.shape[1]), np.float32)])

    def predict(self, texts: Sequence[str | None] | pa.Array, block: int = 256) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, weighted by a power of the cosine.

        Cosines with all labelled vectors are exact, ``block`` documents at a time; of equal cosines at the border the vectors
        that come first count. A document without terms, and one whose neighbours have no positive cosine, gets the share of
        label 1 among all.
        """
        n, k = len(self.labels), min(self.neighbours, len(self.labels))
        default = float(self.labels.mean()) if n else 0.5
        scores = []
        for x in _runs(texts):
            for i in range(0, len(x), block):
                if not k:
                    scores.append(np.full(len(x[i : i + block]), default))
                    continue
                cosine = np.round((self.place(x[i : i + block]) @ self.vectors.T) * np.float32(STEPS * STEPS)).astype(np.int64)
                ranked = -cosine * n + np.arange(n)  # no two are equal
                near = np.sort(np.partition(ranked, k - 1, axis=1)[:, :k], axis=1) % n
                w = np.maximum(np.take_along_axis(cosine, near, 1) / STEPS**2, 0) ** self.power
                total = w.sum(1)
                vote = (w * self.labels[near]).sum(1) / np.maximum(total, 1e-300)
                scores.append(np.where(total > 0, np.clip(vote, 0, 1), default))
        return np.concatenate(scores) if scores else np.zeros(0)


def fit_terms(x: np.ndarray, labels: Sequence[int], dims: int = 48, neighbours: int = 15, power: int = 8, rounds: int = 6) -> NeighbourModel:
    """Latent axes from rows of terms: the leading right singular vectors of the weighted rows, by subspace iteration from a fixed start."""
    y = np.asarray(labels, np.float64)
    idf = np.log((len(x) + 1) / ((x > 0).sum(0) + 1)) + 1
    a = _unit(x * idf)
    q = np.random.default_rng(0).standard_normal((TERMS, min(dims + 16, TERMS)))
    for _ in range(rounds if len(a) else 0):
        q = np.linalg.qr(a.T @ (a @ q))[0]
    axes = q @ np.linalg.svd(a @ q, full_matrices=False)[2].T if len(a) else q
    model = NeighbourModel(idf, np.ascontiguousarray(axes[:, :dims]), np.zeros((0, dims), np.float32), y, neighbours, power)
    return NeighbourModel(idf, model.axes, model.place(x), y, neighbours, power)


def fit(texts: Sequence[str | None], labels: Sequence[int], **settings) -> NeighbourModel:
    """``fit_terms`` of whole texts."""
    return fit_terms(np.concatenate([*_runs(texts), np.zeros((0, TERMS), np.float32)]), labels, **settings)


def held_out(ids):
    """Whether crc32 of the id as text, modulo 4, is 2; a null id is hashed as an empty text."""
    return F.crc32(F.coalesce(ids.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = 4_000, **settings) -> NeighbourModel:
    """Fits on a bounded sample of labelled documents that are not held out: of the rows of ``labels`` that have a document, the ``max_rows`` whose id hashes lowest.

    Whole texts become rows of terms where they lie; only those reach the driver, ``max_rows`` times 6 KB at most. Of
    documents that repeat an id one row counts, the least by its terms. Null labels and ids, and labels without a document,
    are skipped before the sample is drawn, so labels of other tables, however many, change nothing. Without a usable label
    the model has no voters, every score is 0.5, and a warning says so.
    """
    prepare(docs.sparkSession)
    usable = labels.select("doc_id", F.col(label_col).cast("int").alias("y")).filter("y is not null and doc_id is not null").filter(~held_out(F.col("doc_id")))
    picked = with_document(usable, docs).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_rows)

    def terms(batches):
        claim_hashes()
        for b in batches:
            rows = [row.tobytes() for x in _runs(b.column("text")) for row in x]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(rows, pa.binary())], ["doc_id", "y", "terms"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id").select("doc_id", "y", "text")
    got = rows.mapInArrow(terms, "doc_id long, y int, terms binary").groupBy("doc_id", "y").agg(F.min("terms").alias("terms")).toPandas().sort_values(["doc_id", "y"], kind="stable")
    if not len(got):
        warnings.warn("no label that is not held out has a document: all scores will be 0.5", stacklevel=2)
    x = np.frombuffer(b"".join(got["terms"]), np.float32).reshape(len(got), TERMS)
    return fit_terms(x, got["y"].tolist(), **settings)


def quality_scores(docs: DataFrame, model: NeighbourModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the column ``out``: the neighbours' vote for label 1, from the whole text alone.

    The model is broadcast: at most ``max_rows`` vectors of a few dozen numbers. Nothing shuffles. Null and empty texts
    get the share of label 1 among the voters. Equal texts score alike, whatever rows they are read with; an empty table
    stays empty; a column called ``out`` is replaced, all others stay. A very long text is in memory as a whole, with some
    forty times its bytes beside it.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        claim_hashes()
        return pd.Series(shared.value.predict(pa.array(texts, pa.string(), from_pandas=True)), index=texts.index)

    return docs.withColumn(out, score(F.col(text_col).cast("string")))
