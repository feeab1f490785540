"""Benchmarks in several blocks and parts, and windows, against one pass."""

import random

import numpy as np
import pytest

from ridgeline.llm import decontaminate as D


def words(rng, n, kinds=30):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(6)
    items = [(i, words(rng, rng.choice([2, 9, 10, 14, 60]), 200)) for i in range(30)] + [(None, words(rng, 12)), (99, None), (98, "!"), (3, words(rng, 11))]
    texts = [words(rng, 40, 200) for _ in range(30)] + [f"{words(rng, 3)} {rng.choice(items[:30])[1]} {rng.choice(items[:30])[1]} {words(rng, 2)}" for _ in range(40)] + [None, "", items[30][1]]
    ids = [i if i % 9 else None for i in range(len(texts))]
    docs = spark.createDataFrame(list(zip(ids, texts, texts)), "doc_id long, text string, spans string").repartition(3)
    return docs, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("unnamed", [False, True])
def test_parts_and_blocks_find_what_one_pass_finds(tables, unnamed):
    docs, bench = tables
    read = lambda **kw: sorted(map(repr, D.find_contamination(docs, bench, unnamed=unnamed, **kw).collect()))
    want = read()
    assert read(part_bytes=900, shard_bytes=300) == want
    assert read(block_words=15) == want and read(block_items=1, block_words=11, part_bytes=2000) == want
    kept = lambda **kw: sorted(map(repr, D.drop_contaminated(docs, bench, unnamed=unnamed, **kw).collect()))
    assert kept(part_bytes=700) == kept() and 0 < len(kept()) < docs.count()


def test_windows_are_distinct_and_know_their_owners():
    a, b, c = np.uint64([1, 2, 3, 4]), np.uint64([2, 3, 4]), np.uint64([7])
    (block,) = D.phrase_blocks([("a", a), ("b", b), ("c", c), ("a2", a)], 3, 10, 100)
    rows, sizes, at, owners = block.windows(3)
    got = {tuple(r[3 - n :].tolist()): {block.items[k] for k in owners[i:j]} for r, n, i, j in zip(rows, sizes, at, at[1:])}
    assert got == {(1, 2, 3): {"a", "a2"}, (2, 3, 4): {"a", "b", "a2"}, (7,): {"c"}}


def test_the_index_answers_phrases_of_no_benchmark():
    rng = np.random.default_rng(2)
    text = np.append(rng.integers(1, 40, 500), 0)
    index = D.FMIndex(text, 40)
    low, high = index.search(text[100:103][None].astype(np.int32), np.array([3]))
    assert 100 in index.locate(np.arange(low[0], high[0])).tolist()
