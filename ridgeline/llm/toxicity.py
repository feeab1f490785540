"""Toxicity by a chain of linear classifiers over the words of whole texts."""

from __future__ import annotations

import re
import warnings
from collections.abc import Sequence
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import claim, prepare, with_document
from ridgeline.operators.tables import materialize, release

WORDS = re.compile(r"[^\W\d_]+|[^\w\s]{2,}")
#: Feature space of the hashed words and word beginnings.
BUCKETS = 1 << 20
#: Words remembered by a worker; then it forgets all and starts anew.
MEMO = 300_000


def word_features(word: str) -> tuple[int, int]:
    """Buckets of a word and of its first four characters, which spellings with varied endings share."""
    return crc32(word.encode()) % BUCKETS, crc32(b"^" + word[:4].encode()) % BUCKETS


def document_features(text: str | None, memo: dict[str, tuple[int, int]]) -> set[int]:
    """Distinct buckets of a whole text; null and empty texts have none."""
    found: set[int] = set()
    if text:
        for w in set(WORDS.findall(text.lower())):
            f = memo.get(w)
            if f is None:
                if len(memo) >= MEMO:
                    memo.clear()
                f = memo[w] = word_features(w)
            found.update(f)
    return found


@dataclass(frozen=True)
class ChainModel:
    """``weights[i]`` scores category i: selected features, then the probabilities of the categories before it, then the bias."""

    categories: tuple[str, ...]
    columns: dict[int, int]
    weights: tuple[np.ndarray, ...]

    def predict(self, texts: Sequence[str | None], memo: dict | None = None) -> np.ndarray:
        """Probabilities, a row a text and a column a category."""
        memo, n = {} if memo is None else memo, len(self.columns)
        rows, cols = [], []
        for i, t in enumerate(texts):
            hit = [c for c in map(self.columns.get, document_features(t, memo)) if c is not None]
            rows += [i] * len(hit)
            cols += hit
        r, c = np.array(rows, np.int64), np.array(cols, np.int64)
        out = np.zeros((len(texts), len(self.categories)))
        for k, w in enumerate(self.weights):
            z = np.bincount(r, w[c], len(texts)) + out[:, :k] @ w[n : n + k] + w[-1]
            out[:, k] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return out


def _fit_linear(r: np.ndarray, c: np.ndarray, extra: np.ndarray, y: np.ndarray, n: int, l2: float = 1e-3, steps: int = 150) -> np.ndarray:
    """Logistic regression on 0/1 features (r, c) and dense ``extra`` ones, by full-batch Adam from zero: the same weights each time."""
    w, m, v = (np.zeros(n + extra.shape[1] + 1) for _ in range(3))
    if y.min() == y.max():
        w[-1] = 8.0 if y[0] else -8.0
        return w
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    for t in range(1, steps + 1):
        z = np.bincount(r, w[c], len(y)) + extra @ w[n:-1] + w[-1]
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * balance
        d = np.concatenate([np.bincount(c, g[r], n), extra.T @ g, [g.sum()]])
        d[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * d, 0.99 * v + 0.01 * d * d
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def likelihood_gains(df: np.ndarray, with_pos: np.ndarray, n_docs: int, n_pos: int) -> np.ndarray:
    """What the presence of each feature tells about a category (log-likelihood ratio): found in ``df`` documents, ``with_pos`` of them positive."""
    gain = np.zeros(len(df))
    with np.errstate(divide="ignore", invalid="ignore"):
        for seen, total, row in ((with_pos, n_pos, df), (df - with_pos, n_docs - n_pos, df), (n_pos - with_pos, n_pos, n_docs - df), (n_docs - n_pos - df + with_pos, n_docs - n_pos, n_docs - df)):
            gain += np.nan_to_num(seen * np.log(seen * n_docs / (total * row)))
    return gain


def best_features(names: np.ndarray, gain: np.ndarray, per_category: int, least: float = 5) -> np.ndarray:
    """Places of the ``per_category`` features of the greatest gain over ``least``, the lesser name first of equals."""
    best = np.lexsort((names, -gain))[:per_category]
    return np.sort(best[gain[best] > least])


def fit_chain(features: Sequence[np.ndarray], labels: np.ndarray, categories: Sequence[str], fold: np.ndarray | None = None, folds: int = 3, per_category: int = 500) -> ChainModel:
    """Trains the chain on documents' buckets and 0/1 ``labels`` (a column a category).

    For every category the ``per_category`` features whose presence tells most about it (likelihood ratio) are used.
    The probabilities that later categories get as inputs while training are out-of-fold: each row's come from a model
    for which features were selected and weights fitted without the row, so later models learn how far to trust them.
    ``fold`` says which fold each document is in (default: in turn). Without documents the chain finds nothing: every
    category has the bias of one whose labels are all 0.
    """
    size = np.array([len(f) for f in features], np.int64)
    r = np.repeat(np.arange(len(features)), size)
    b = np.concatenate(features).astype(np.int64) if len(features) else np.zeros(0, np.int64)
    used, c = np.unique(b, return_inverse=True)
    n_docs = len(features)
    fold = np.arange(n_docs) % folds if fold is None else fold

    def part(k: int, train: np.ndarray, inputs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Selected features and weights of category k from the documents ``train``."""
        y, on = labels[train, k].astype(float), train[r]
        gain = likelihood_gains(np.bincount(c[on], minlength=len(used)).astype(float), np.bincount(c[on], labels[r[on], k], len(used)), len(y), y.sum())
        chosen = best_features(used, gain, per_category)
        place = np.full(len(used), -1)
        place[chosen] = np.arange(len(chosen))
        on &= place[c] >= 0
        return chosen, _fit_linear((np.cumsum(train) - 1)[r[on]], place[c[on]], inputs[train], y, len(chosen))

    def apply(chosen: np.ndarray, w: np.ndarray, inputs: np.ndarray) -> np.ndarray:
        each = np.zeros(len(used))
        each[chosen] = w[: len(chosen)]
        z = np.bincount(r, each[c], n_docs) + inputs @ w[len(chosen) : -1] + w[-1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    inputs, fitted = np.zeros((n_docs, 0)), []
    for k in range(labels.shape[1]):
        if not n_docs:
            fitted.append((np.zeros(0, np.int64), np.append(np.zeros(k), -8.0)))
            continue
        fitted.append(part(k, np.ones(n_docs, bool), inputs))
        out = np.full(n_docs, float(labels[:, k].mean()))
        for f in range(folds):
            train = fold != f
            if train.any() and not train.all():
                out = np.where(train, out, apply(*part(k, train, inputs), inputs))
        inputs = np.column_stack([inputs, out])
    order = np.unique(np.concatenate([chosen for chosen, _ in fitted])) if fitted else np.zeros(0, np.int64)
    weights = []
    for chosen, w in fitted:
        each = np.zeros(len(order))
        each[np.searchsorted(order, chosen)] = w[: len(chosen)]
        weights.append(np.concatenate((each, w[len(chosen) :])))
    return ChainModel(tuple(categories), {int(used[j]): i for i, j in enumerate(order)}, tuple(weights))


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], extra: Sequence[str] = (), max_rows: int = 5_000, folds: int = 3, per_category: int = 500) -> ChainModel:
    """Fits the chain on a bounded sample: of the rows of ``labels`` that have a document, the ``max_rows`` whose doc_id hashes lowest.

    ``categories`` are SQL conditions, in chain order, over the columns of ``labels`` and the columns ``extra`` of ``docs``,
    which are used for targets only. The sample is drawn from the labels and broadcast, so texts don't shuffle. Whole
    texts become sets of buckets, which are written to shared storage; each bucket's counts by fold and category are
    summed there, and only buckets that are among the best of an Arrow batch reach the driver: at most ``per_category`` for
    each category, training part and batch, and no more than there are buckets, whatever the texts' length. Of documents
    that repeat an id one row with the same targets counts. Null conditions count as 0; labels with a null id or without a
    document are skipped before the sample is drawn, so labels of other tables, however many, change nothing. Without a
    usable label the chain finds nothing toxic, and a warning says so.
    """
    prepare(docs.sparkSession)
    sample = with_document(labels.filter("doc_id is not null"), docs).orderBy(F.xxhash64("doc_id"), "doc_id", *[c for c in labels.columns if c != "doc_id"]).limit(max_rows)
    joined = docs.select("doc_id", "text", *extra).join(F.broadcast(sample), "doc_id")
    names = [f"y{i}" for i in range(len(categories))]
    picked = joined.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.coalesce(F.expr(c).cast("int"), F.lit(0)).alias(n) for n, c in zip(names, categories.values(), strict=True)])

    def features(batches):
        memo: dict = {}
        for b in batches:
            found = [np.sort(np.fromiter(document_features(t, memo), np.int32)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("doc_id", *names)] + [pa.array(found, pa.list_(pa.int32()))], ["doc_id", *names, "features"])

    shape = "doc_id long, " + ", ".join(f"{n} int" for n in names) + ", features array<int>"
    one = picked.mapInArrow(features, shape).groupBy("doc_id", *names).agg(F.min("features").alias("features"))
    table = materialize(one.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(folds)).cast("int")), "toxicity-sample")
    sums = [F.count_if(F.col("fold") == f).alias(f"n{f}") for f in range(folds)] + [F.count_if((F.col("fold") == f) & (F.col(n) == 1)).alias(f"{n}_{f}") for f in range(folds) for n in names]
    total = table.agg(*sums).first().asDict()

    def best(counts: dict[str, np.ndarray]) -> np.ndarray:
        """Places of the buckets that are among the best for any category and training part."""
        chosen = [np.zeros(0, np.int64)]
        for left_out in (None, *range(folds)):
            parts = [f for f in range(folds) if f != left_out]
            df, n_docs = (sum(x[f"n{f}"] for f in parts) for x in (counts, total))
            for n in names:
                with_pos, n_pos = (sum(x[f"{n}_{f}"] for f in parts) for x in (counts, total))
                chosen.append(best_features(counts["bucket"], likelihood_gains(df.astype(float), with_pos.astype(float), n_docs, n_pos), per_category))
        return np.unique(np.concatenate(chosen))

    def select(batches):
        for b in batches:
            yield b.take(pa.array(best({c: b.column(c).to_numpy() for c in b.schema.names})))

    counts = table.select("fold", *names, F.explode("features").alias("bucket")).groupBy("bucket").agg(*sums)
    found = counts.mapInArrow(select, counts.schema).toPandas().sort_values("bucket")
    wanted = found["bucket"].to_numpy(np.int32)
    wanted = wanted[best({c: found[c].to_numpy() for c in found.columns})]

    def restrict(batches):
        for b in batches:
            kept = [f[np.isin(f, wanted, assume_unique=True)] for f in (np.asarray(x, np.int32) for x in b.column("features").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("doc_id", *names)] + [pa.array(kept, pa.list_(pa.int32())), b.column("fold")], ["doc_id", *names, "features", "fold"])

    got = table.mapInArrow(restrict, f"{shape}, fold int").toPandas().sort_values(["doc_id", *names], kind="stable")
    release(table)
    if not len(got):
        warnings.warn("no label has a document: nothing will be toxic", stacklevel=2)
    return fit_chain([np.asarray(f, np.int32) for f in got["features"]], got[names].to_numpy(np.int64).reshape(len(got), len(names)), list(categories), got["fold"].to_numpy(np.int64), folds, per_category)


_MEMO: dict[str, tuple[int, int]] = {}


def toxicity_scores(docs: DataFrame, model: ChainModel, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with the array column ``out``: a probability for each category of the chain.

    Every whole text is scored where it lies; only the text goes to Python and nothing shuffles. Null and empty texts
    get the chain's biases. A very long text takes memory for its distinct words. A column called ``out`` is replaced;
    all others stay. Equal texts score alike, so ties and repeated rows need no order; an empty table stays empty.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def score(texts: pd.Series) -> pd.Series:
        claim("toxicity", _MEMO.clear)
        return pd.Series(list(shared.value.predict(texts.tolist(), _MEMO)), index=texts.index, dtype=object)

    return docs.withColumn(out, score(F.col(text_col)))


#: Categories of the label table. It has one column of toxicity, so the chain's early links are toxic in one language each and
#: the last, toxic at all, builds on them: a thin chain, since labels name no kinds of abuse. ``train`` takes any conditions.
LANGUAGES = ("en", "de", "es", "fr")


CATEGORIES = {f"toxic_{x}": f"toxic = 1 and lang = '{x}'" for x in LANGUAGES} | {"toxic": "toxic = 1"}


def train_by_language(docs: DataFrame, labels: DataFrame) -> ChainModel:
    """The chain of ``CATEGORIES`` from labels (doc_id, toxic); the language decides training targets, never a score."""
    return train(docs, labels.select("doc_id", "toxic").filter("toxic is not null"), CATEGORIES, ("lang",))
