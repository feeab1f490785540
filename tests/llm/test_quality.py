"""Votes of the quality classifier against exact arithmetic, ties, and held-out documents."""

import random
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest

from ridgeline.llm import quality


def some_texts(n, seed=4):
    rng = random.Random(seed)
    return [" ".join(rng.choice(["w", "Word", "x!!", "||", "12"]) + str(rng.randrange(40)) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    texts = some_texts(150)
    return quality.fit(texts + texts[:40], [i % 2 for i in range(190)], dims=8, neighbours=5)


def exact_vote(m, v):
    """The vote in whole numbers: cosines in steps, ties in order of the voters."""
    own = [int(x * quality.STEPS) for x in v]
    cos = [sum(a * int(b * quality.STEPS) for a, b in zip(own, w)) for w in m.vectors]
    near = sorted(range(len(cos)), key=lambda i: (-cos[i], i))[: m.neighbours]
    w = [Fraction(max(cos[i], 0)) ** m.power for i in near]
    return float(sum(x * int(m.labels[i]) for x, i in zip(w, near)) / sum(w)) if sum(w) else float(m.labels.mean())


def test_votes_equal_exact_arithmetic(model):
    texts = some_texts(80, 9) + some_texts(150)[:60] + [None, "", " ", "ab", "one"]
    want = [exact_vote(model, v) for v in model.project(texts)]
    assert np.abs(model.predict(texts) - want).max() < 1e-6


def test_equal_texts_score_alike_in_any_batch(model):
    texts = some_texts(150)[:50] * 2 + ["", None, "x y z"]
    whole = model.predict(texts)
    assert (whole[:50] == whole[50:100]).all()
    for block in (1, 7, 256):
        assert (model.predict(texts, block=block) == whole).all()
    assert [float(model.predict([t])[0]) for t in texts] == whole.tolist()


def test_terms_of_a_text_do_not_depend_on_its_neighbours():
    texts = ["a b a b", "", None, "é!", "ab", "one two one " * 50, "A|B 12\nx"]
    together = np.concatenate(list(quality._runs(texts)))
    for t, row in zip(texts, together):
        assert (next(iter(quality._runs([t]))) == row).all()
    gaps = together[0][-quality.FAMILIES[2] :] ** 2
    assert gaps[0] == pytest.approx(0.5) and gaps[2] == pytest.approx(0.5)  # a and b are new, then each two words back


def test_sample_is_bounded_and_repeated_ids_count_once(spark):
    docs = spark.createDataFrame([(i % 50, f"word {i}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(None, 1), (3, None)], "doc_id long, quality int")
    m = quality.train(docs, labels, max_rows=20)
    assert len(m.labels) == 20
    again = quality.train(docs.repartition(7), labels.repartition(3), max_rows=20)
    assert (m.vectors == again.vectors).all() and (m.labels == again.labels).all()
    none = quality.train(docs, labels.limit(0))
    assert quality.quality_scores(docs, none).filter("score != 0.5").count() == 0
    clash = docs.selectExpr("doc_id", "text", "1 as score", "2 as terms", "3 as y")
    assert quality.quality_scores(clash, m).columns == clash.columns


def test_labels_of_other_tables_change_nothing(spark):
    docs = spark.createDataFrame([(i, f"word {i} of {i % 7}") for i in range(300)], "doc_id int, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    foreign = spark.range(1000, 200_000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    alone, padded = (quality.train(docs, x, max_rows=100) for x in (labels, labels.unionByName(foreign)))
    assert len(alone.labels) == 100 and (alone.vectors == padded.vectors).all() and (alone.labels == padded.labels).all()
    with pytest.warns(UserWarning, match="0.5"):
        assert not len(quality.train(docs, foreign).labels)


def test_held_out_accuracy_on_all_labelled_documents():
    import zlib

    sf = "/root/testdata/sf0.1"
    docs = dict(zip(*pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict().values()))
    rows = [(i, q) for i, q in zip(*pq.read_table(f"{sf}/labels.parquet", columns=["doc_id", "quality"]).to_pydict().values()) if q is not None and i in docs]
    held = [(i, q) for i, q in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    seen = [(i, q) for i, q in rows if zlib.crc32(str(i).encode()) % 4 != 2][:2000]
    m = quality.fit([docs[i] for i, _ in seen], [q for _, q in seen])
    assert np.mean((m.predict([docs[i] for i, _ in held]) >= 0.7) == np.array([q for _, q in held])) >= 0.98
