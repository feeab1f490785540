"""Training of the toxicity chain: out-of-fold inputs, selection, and documents it never saw."""

import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import toxicity

SF = "/root/testdata/sf0.01"


def auc(score, y):
    order = np.argsort(score, kind="stable")
    _, place, n = np.unique(score[order], return_index=True, return_counts=True)
    rank = np.repeat(place + (n + 1) / 2, n)
    return (rank[y[order] == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (1 - y).sum())


def test_inputs_of_later_categories_know_nothing_of_noise(monkeypatch):
    seen, real = [], toxicity._fit_linear
    monkeypatch.setattr(toxicity, "_fit_linear", lambda r, c, extra, y, n, **kw: seen.append((extra, y)) or real(r, c, extra, y, n, **kw))
    values = []
    for seed in range(12):
        rng = np.random.default_rng(seed)
        feats = [np.sort(rng.choice(3000, 60, replace=False)) for _ in range(300)]
        y = rng.integers(0, 2, (300, 1))
        seen.clear()
        toxicity.fit_chain(feats, np.column_stack([y, y]), ("a", "b"))
        extra, target = next((e, t) for e, t in seen if e.shape[1] == 1 and len(e) == 300)
        values.append(auc(extra[:, 0], target.astype(int)))
    assert abs(np.mean(values) - 0.5) < 0.04


def test_train_equals_the_chain_of_all_features(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels, {"toxic": "toxic = 1"})
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    rows = sorted((r.doc_id, int(r.toxic == 1), r.fold) for r in labels.select("doc_id", "toxic", F.expr("cast(pmod(xxhash64(doc_id, 11), 3) as int)").alias("fold")).collect() if r.doc_id in text)
    feats = [np.sort(np.fromiter(toxicity.document_features(text[i], {}), np.int32)) for i, _, _ in rows]
    want = toxicity.fit_chain(feats, np.array([[y] for _, y, _ in rows]), ["toxic"], np.array([f for _, _, f in rows]))
    assert model.columns == want.columns and np.allclose(model.weights[0], want.weights[0])


def test_labels_of_other_tables_change_nothing(spark):
    docs = spark.createDataFrame([(i, "fine words here " + ("idiot fool " if i % 2 else "kind friend ") * 2 + f"n{i}", "en") for i in range(200)], "doc_id int, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    foreign = spark.range(1000, 200_000).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    alone, padded = (toxicity.train(docs, x, {"toxic": "toxic = 1"}, max_rows=150) for x in (labels, labels.unionByName(foreign)))
    assert alone.columns == padded.columns and len(alone.columns) > 0 and (alone.weights[0] == padded.weights[0]).all()
    with pytest.warns(UserWarning, match="nothing will be toxic"):
        assert toxicity.train(docs, foreign, {"toxic": "toxic = 1"}).columns == {}


def plain_chain(texts, labels, folds, texts_to_score, per_category=500):
    """The chain by plain loops: words by regular expression, likelihood ratios, logistic regression and out-of-fold inputs, one number at a time."""
    import math
    from zlib import crc32

    def buckets(t):
        words = re.findall(r"[^\W\d_]+|[^\w\s]{2,}", (t or "").lower())
        return {crc32(w.encode()) % (1 << 20) for w in words} | {crc32(b"^" + w[:4].encode()) % (1 << 20) for w in words}

    def ratio(n, a, b, c, d):
        cells = ((a, a + b, a + c), (b, a + b, b + d), (c, c + d, a + c), (d, c + d, b + d))
        return sum(x * math.log(x * n / (r * s)) for x, r, s in cells if x)

    def fit(rows, extra, y):
        n, pos = len(rows), sum(y)
        gains = {}
        for f in set().union(*rows):
            a = sum(f in r and t for r, t in zip(rows, y))
            b = sum(f in r and not t for r, t in zip(rows, y))
            gains[f] = ratio(n, a, b, pos - a, n - pos - b)
        chosen = sorted(f for f in sorted(gains, key=lambda f: (-gains[f], f))[:per_category] if gains[f] > 5)
        names = [*chosen, *range(-len(extra[0]), 0), "bias"]
        w = dict.fromkeys(names, 0.0)
        if pos in (0, n):
            w["bias"] = 8.0 if pos else -8.0
            return w
        m, v = dict(w), dict(w)
        for t in range(1, 151):
            d = dict.fromkeys(names, 0.0)
            for r, e, target in zip(rows, extra, y):
                g = (score(w, r, e) - target) * (0.5 / (pos / n) if target else 0.5 / (1 - pos / n)) / n
                for f in r & set(chosen):
                    d[f] += g
                for i, x in enumerate(e):
                    d[i - len(e)] += g * x
                d["bias"] += g
            for f in names:
                step = d[f] + (1e-3 * w[f] if f != "bias" else 0)
                m[f], v[f] = 0.9 * m[f] + 0.1 * step, 0.99 * v[f] + 0.01 * step * step
                w[f] -= 0.1 * (m[f] / (1 - 0.9**t)) / (math.sqrt(v[f] / (1 - 0.99**t)) + 1e-8)
        return w

    def score(w, r, e):
        z = w["bias"] + sum(w.get(f, 0.0) for f in r) + sum(w[i - len(e)] * x for i, x in enumerate(e))
        return 1 / (1 + math.exp(-z))

    rows, new = [buckets(t) for t in texts], [buckets(t) for t in texts_to_score]
    inputs, out = [[] for _ in rows], [[] for _ in new]
    for k in range(len(labels[0])):
        y = [row[k] for row in labels]
        whole = fit(rows, inputs, y)
        outside = {}
        for f in set(folds):
            part = [i for i, x in enumerate(folds) if x != f]
            w = fit([rows[i] for i in part], [inputs[i] for i in part], [y[i] for i in part])
            outside |= {i: score(w, rows[i], inputs[i]) for i, x in enumerate(folds) if x == f}
        for r, e in zip(new, out):
            e.append(score(whole, r, e))
        for i, e in enumerate(inputs):
            e.append(outside[i])
    return out


def test_chain_equals_plain_loops(spark):
    import random

    rng = random.Random(8)
    bad, good = ["idiot", "fool", "scum", "!!??"], ["kind", "fine", "river", "stone", "über"]
    texts = [" ".join(rng.choice(good + (bad if i % 3 == 0 else [])) for _ in range(rng.randrange(3, 14))) + (" idiot" if i % 3 == 0 else "") for i in range(90)]
    langs = ["en" if i % 2 else "de" for i in range(90)]
    docs = spark.createDataFrame([(i, t, langs[i]) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, {"en": "toxic = 1 and lang = 'en'", "toxic": "toxic = 1"}, ("lang",))
    new = [*texts[:20], None, "", "idiot " * 300, "nothing known", "FOOL, fool!!??"]
    got = [r.toxicity for r in toxicity.toxicity_scores(spark.createDataFrame([(i, t) for i, t in enumerate(new)], "doc_id long, text string"), model).orderBy("doc_id").collect()]
    folds = [r.f for r in spark.range(90).selectExpr("id", "cast(pmod(xxhash64(id, 11), 3) as int) as f").orderBy("id").collect()]
    want = plain_chain(texts, [[int(i % 3 == 0 and langs[i] == "en"), int(i % 3 == 0)] for i in range(90)], folds, new)
    assert np.abs(np.array(got) - np.array(want)).max() < 1e-6 and len(model.columns) > 3


def test_documents_it_never_saw():
    sf = "/root/testdata/sf0.1"
    text = dict(zip(*pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict().values()))
    rows = [(i, int(y or 0)) for i, y in zip(*pq.read_table(f"{sf}/labels.parquet", columns=["doc_id", "toxic"]).to_pydict().values()) if i in text]
    seen, new = rows[::2], rows[1::2]
    feats = [np.fromiter(toxicity.document_features(text[i], {}), np.int32) for i, _ in seen]
    y = np.array([[v, v] for _, v in seen])
    got = toxicity.fit_chain(feats, y, ("first", "toxic")).predict([text[i] for i, _ in new])[:, -1] >= 0.5
    want = np.array([v == 1 for _, v in new])
    assert got[want].mean() >= 0.95 and (~got[~want]).mean() >= 0.975  # half of 3,500 labels


@pytest.mark.parametrize("folds", [3])
def test_repeated_ids_long_texts_and_clashing_columns(spark, folds):
    docs = spark.createDataFrame([(i % 20, ("fine words " * 5 + ("idiot " if i % 2 else "")) * (4000 if i == 3 else 1), "x", 0.0) for i in range(200)] + [(None, "idiot", "x", 0.0), (5, None, "x", 0.0)], "doc_id long, text string, fold string, toxicity double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, {"toxic": "toxic = 1"}, folds=folds)
    rows = toxicity.toxicity_scores(docs, model)
    assert rows.columns == docs.columns and rows.count() == 202
    assert rows.select("text", F.element_at("toxicity", -1).alias("p")).distinct().groupBy("text").count().filter("count > 1").count() == 0
