"""Token ids of the encoder against the library's own encoding of whole texts."""

import itertools
import json
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from ridgeline.llm import queries, token_output
from ridgeline.llm.common import text_buffers

WORD = queries.tokenizer_path("word_bpe_49k.json")


def encoded(coder, texts, size=1 << 18):
    data, starts = text_buffers(pa.array(texts, pa.string()))
    out = []
    for i, j, sizes, ids in coder.encode_runs(data, starts, size):
        ends = np.cumsum(sizes).tolist()
        out += [ids[b - n : b].tolist() for b, n in zip(ends, sizes.tolist())]
        assert len(sizes) == j - i
    return out


def whole(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]


def test_ids_of_every_document_equal_the_library():
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()
    assert encoded(token_output.TextEncoder(WORD, 400_000), texts) == whole(WORD, texts)


@pytest.mark.parametrize("limit,size", [(400_000, 1 << 18), (20, 300), (1, 1)])
def test_ids_of_random_strings_equal_the_library(limit, size):
    rng = random.Random(3)
    parts = ["don't", "IT'S", "x'", "'re", "l'été", "É", "ß", "é", "H̱", "İ", "ΑΣ", "汉字", "🙂", " ", " ", "\x1c", "\x85", "\x00", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "a<b", "12", "3.5", "--", "×", "a÷b", "ÿ", "Ǆ", "", " ", "\n", "\t", "\x0b", "w1", "Word", "ﬁ", "½", "²", "̀", "K", "'"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", "  "]) for _ in range(rng.randrange(30))) for _ in range(600)] + [None, "", "x" * 5000, "ab " * 3000, "é" * 400]
    coder = token_output.TextEncoder(WORD, limit)
    assert coder.by_unit
    assert encoded(coder, texts, size) == whole(WORD, texts)
    assert encoded(coder, texts, size) == whole(WORD, texts)


def test_other_tokenizers_get_whole_texts(tmp_path):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    texts = ["a b  c", "don't", None, "", "  é\n\n1"]
    coder = token_output.TextEncoder(path, 100)
    assert not coder.by_unit and encoded(coder, texts) == whole(path, texts)
    with open(WORD, encoding="utf-8") as f:
        settings = json.load(f)
    settings["normalizer"]["normalizers"] = settings["normalizer"]["normalizers"][:2]
    (tmp_path / "t.json").write_text(json.dumps(settings))
    assert not token_output.TextEncoder(str(tmp_path / "t.json"), 100).by_unit


def test_units_are_forgotten_beyond_the_limit():
    coder = token_output.TextEncoder(WORD, 50)
    for i in range(40):
        texts = [" ".join(f"{'abcdefghij'[i % 10]}{a}{b}" for a, b in itertools.product("klmnop", "qrstuv"))]
        assert encoded(coder, texts) == whole(WORD, texts)
        assert coder.table.n <= 50 + 100
