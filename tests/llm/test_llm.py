"""The training-data operators against brute force, round trips, held-out accuracy and odd inputs."""

import hashlib
import itertools
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import decontaminate, exact_dedup, jaccard_join, mixing, quality, queries, sharding, token_counts, token_output, toxicity, url_filter
from ridgeline.llm.common import SPACED, hash_words, text_buffers

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, set string, cell long, rep long, toxicity string, score double"


def frame(spark, texts, ids=None, sources=None):
    """Documents with columns whose names clash with those that operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", (sources or ["s"] * len(texts))[k], 0, "x", 1, 2, "y", 0.5) for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def odd_texts():
    rng = random.Random(5)
    base = prose(rng, 120)
    near = base.split()
    near[60] = "changed"
    return [base, base.upper(), " ".join(near), None, "", " \n\t ", "one", "One", "two words", base, prose(rng, 20_000), "é ß \x00 \x1c ok", "a\u00a0b a", base + " tail"]


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t))


# --- near duplicates -------------------------------------------------------------------------------------------------
def brute_components(texts, ids, words, num, den):
    sets = []
    for t in texts:
        w = spaced(t)
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and den * both >= num * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    groups = {}
    for i in range(len(texts)):
        groups.setdefault(find(i), []).append(ids[i])
    return {ids[i]: (len(sets[i]), min(groups[find(i)])) for i in range(len(texts))}


def families(seed, n_families=12, size=7, plain=60):
    rng = random.Random(seed)
    out = [prose(rng, rng.randrange(1, 200)) for _ in range(plain)]
    for _ in range(n_families):
        w = prose(rng, rng.randrange(8, 300)).split()
        for _ in range(size):
            v = list(w)
            for _ in range(rng.randrange(0, max(1, len(w) // 25) + 1)):
                v[rng.randrange(len(v))] = f"x{rng.randrange(50)}"
            out.append(" ".join(v))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("rule,capacity", [((3, 90, 100), 500_000), ((5, 8, 10), 500_000), ((3, 90, 100), 300), ((5, 8, 10), 200)])
def test_jaccard_components_equal_brute_force(spark, rule, capacity):
    texts = odd_texts() + families(rule[0] * 7 + capacity)
    want = brute_components(texts, list(range(len(texts))), *rule)
    got = jaccard_join.jaccard_components(frame(spark, texts).repartition(5), jaccard_join.Rule(*rule), capacity=capacity).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_jaccard_large_family_is_one_component(spark):
    rng = random.Random(2)
    w = prose(rng, 150).split()
    texts = []
    for _ in range(400):
        v = list(w)
        v[rng.randrange(len(v))] = f"y{rng.randrange(1000)}"
        texts.append(" ".join(v))
    got = jaccard_join.jaccard_components(frame(spark, texts), jaccard_join.Rule(3, 90, 100), capacity=3_000).collect()
    want = brute_components(texts, list(range(len(texts))), 3, 90, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_jaccard_null_ids_repeats_and_empty_tables(spark):
    docs = frame(spark, ["a b c d e f", "a b c d e f", "a b c d e f", "z"], [None, 7, 7, 3])
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, jaccard_join.Rule(3, 90, 100)).collect())
    assert got == [(False, 3, 1, 3), (False, 7, 4, 7), (False, 7, 4, 7), (True, 0, 4, None)]
    assert jaccard_join.jaccard_components(frame(spark, [])).count() == 0
    assert jaccard_join.jaccard_components(frame(spark, [None, ""])).count() == 2


@pytest.mark.parametrize("text", ["a", "a b", "a b c", "a b c d"])
def test_jaccard_tables_of_fewer_words_than_a_shingle(spark, text):
    got = jaccard_join.jaccard_components(frame(spark, [text, text.upper(), ""]), jaccard_join.Rule(5, 8, 10)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(0, 1, 0), (1, 1, 0), (2, 0, 2)]
    data, starts = text_buffers(pa.array([text, None]))
    assert [len(s) for s in jaccard_join.shingle_sets(data, starts, 5)] == [1, 0]


def test_slabs_cover_all_partners():
    for num, den in ((90, 100), (8, 10)):
        rule = jaccard_join.Rule(3, num, den)
        slabs = rule.slabs(3000)
        blocks = rule.blocks(slabs)
        for a in range(1, 1200):
            for b in range(a, a * den // num + 1):
                i, j = np.searchsorted(slabs, [a, b], "right") - 1
                assert j - i in (0, 1)
                # the greatest difference of linked sets of these sizes
                common = int(rule.overlap(np.array(a + b)))
                if common <= a:
                    assert a + b - 2 * common < blocks[j]


def test_word_hashes_split_as_the_pattern_does():
    import pyarrow as pa

    texts = odd_texts()
    data, starts = text_buffers(pa.array(texts, pa.string()))
    h, first, end, at = hash_words(data, starts, SPACED)
    words = [spaced(t) for t in texts]
    assert [j - i for i, j in zip(at[:-1], at[1:])] == [len(w) for w in words]
    by_word = {}
    for value, word in zip(h.tolist(), itertools.chain(*words)):
        assert by_word.setdefault(word, value) == value
    assert len(set(by_word.values())) == len(by_word)


# --- decontamination -------------------------------------------------------------------------------------------------
def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def brute_contamination(texts, items, width=10):
    windows = {}
    for key, t in items:
        w = alnum(t)
        if key is not None and w:
            for i in range(max(1, len(w) - width + 1)):
                windows.setdefault(tuple(w[i : i + width]), set()).add(str(key))
    out = []
    for t in texts:
        w, hit, found = alnum(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                own = windows.get(tuple(w[i : i + n]))
                if own:
                    hit.update(range(i, i + n))
                    found |= own
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("shard_bytes,block_items", [(6 << 20, 20_000), (700, 3)])
def test_contamination_equals_brute_force(spark, shard_bytes, block_items):
    rng = random.Random(9)
    items = [(i, prose(rng, rng.choice([3, 9, 10, 11, 30]), 40)) for i in range(25)] + [(90, None), (91, "!!"), (92, "w1 w2"), (None, "w1"), (93, "Été w1")]
    texts = odd_texts() + [prose(rng, 60, 40) for _ in range(50)]
    for i in range(40):
        t = items[i % 25][1]
        texts.append(f"{prose(rng, 5)}, {t.upper()}! {prose(rng, rng.randrange(9), 40)} {t}")
    texts += ["ÉTÉ w1 été w1", "été w1", "w1", "w1 w2 w1 w2"] + ["dup " + items[4][1]] * 30
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contamination(frame(spark, texts), bench, shard_bytes=shard_bytes, block_items=block_items).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got] == brute_contamination(texts, items)
    for r, t in zip(got, texts):
        raw = (t or "").encode()
        assert sum(s.end_word - s.first_word for s in r.spans) == r.n_hit
        for s in r.spans:  # the bytes of a span hold exactly its words
            assert alnum(raw[s.first_byte : s.end_byte].decode()) == alnum(t)[s.first_word : s.end_word]


def test_contamination_without_benchmark_or_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in decontaminate.find_contamination(frame(spark, ["a b", None]), none).collect()] == [False, False]
    assert decontaminate.find_contamination(frame(spark, []), none).count() == 0


def test_contamination_by_items_without_id_equals_the_sql(spark, tmp_path):
    import corpus_pipeline as P

    texts = ["has w1 in it", "w2 w3 and w1", "clean", None]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, "w1"), (None, "w3 and"), (4, "w2"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.op3_benchmark_decontamination(spark, str(tmp_path)).orderBy("doc_id").collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert [(r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got] == [(1, 1, sha(""), True), (4, 2, sha("4"), True), (0, 0, sha(""), False), (0, 0, sha(""), False)]
    assert sorted(r.doc_id for r in P.drop_contaminated(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()) == [2, 3]


def test_suffix_array_and_search():
    rng = np.random.default_rng(1)
    for n, symbols in ((1, 4), (50, 4), (3000, 6), (3000, 500)):
        t = rng.integers(1, symbols, n)
        t = np.concatenate((t, t[: n // 2], np.ones(n // 3, np.int64) * 2, [0]))
        order = decontaminate.suffix_array(t, symbols)
        if n <= 50:
            assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        index = decontaminate.FMIndex(t, symbols)
        for m in (m for m in (1, 2, 5) if m <= len(t)):
            p = np.stack([t[i : i + m] for i in rng.integers(0, max(1, len(t) - m + 1), 20)]).astype(np.int32)
            low, high = index.search(p, np.full(20, m))
            for q, a, b in zip(p, low, high):
                want = [i for i in range(len(t) - m + 1) if (t[i : i + m] == q).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


# --- exact duplicates ------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("bits", [16, 1])
def test_exact_dedup(spark, bits):
    texts = odd_texts() + ["hot"] * 50 + ["HOT"] * 3 + [f"t{i}" for i in range(300)]
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(frame(spark, texts), bits_per_row=bits).collect()}
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(lower(t), []).append(i)
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        g = groups[lower(t)]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(g), len(g), i == max(g))
        assert got[i].text_sha256 == hashlib.sha256(lower(t).encode()).hexdigest()


def test_exact_dedup_by_shuffled_filter_repeats_and_nulls(spark):
    docs = frame(spark, ["a", "A", "a", None, "", "b"], [5, 5, None, 1, 2, None])
    rows = exact_dedup.exact_dedup(docs, max_filter_bytes=0).collect()
    assert sum(r.kept for r in rows if r.keep_id == 5) == 1 and sum(r.keep_id == 5 for r in rows) == 3
    assert sorted((r.doc_id, r.kept) for r in rows if r.keep_id == 2) == [(1, False), (2, True)]
    assert [(r.keep_id, r.kept) for r in rows if r.doc_id is None and r.group_size == 1] == [(None, True)]
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


# --- mixing ----------------------------------------------------------------------------------------------------------
def water_fill(sizes, weights, cap):
    """The contract's loop: share by weight, stop at the cap, reshare the excess."""
    target, free, left = {}, dict(sizes), sum(sizes.values())
    while free:
        total = sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / total > cap * sizes[s]]
        if not over:
            return target | {s: left * weights[s] / total for s in free}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
            del free[s]
    return target


def test_mixing_meets_targets(spark):
    rng = random.Random(4)
    names = ["b", "a", "Z", "é", None, "tiny", "zero"]
    texts, sources = [], []
    for _ in range(3000):
        s = rng.choices(names, [30, 5, 3, 1, 2, 0.2, 0.0])[0]
        sources.append(s)
        texts.append(prose(rng, rng.randrange(1, 40)))
    texts += ["", None]
    sources += ["zero", "zero"]
    docs = frame(spark, texts, sources=sources)
    rows = mixing.mix_sources(docs).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in mixing.mix_sources(docs.repartition(7)).collect())
    by = {}
    for r in rows:
        assert r.taken <= 3 * r.size and r.taken == r.size * r.copies and r.size == len(spaced(texts[r.doc_id]))
        by.setdefault(sources[r.doc_id], []).append(r)
    order = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want = water_fill({s: sum(r.size for r in by[s]) for s in by}, weights, 3)
    for s, own in by.items():
        assert own[0].target == pytest.approx(want[s]) and own[0].source_size == sum(r.size for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= 40
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    copies = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert copies == {r.doc_id: r.copies for r in rows if r.copies}


def test_mixing_odd_tables(spark):
    assert mixing.mix_sources(frame(spark, [])).count() == 0
    rows = mixing.mix_sources(frame(spark, [None, "", "a b"], [None, 1, 1], [None, None, None])).collect()
    assert {r.source_size for r in rows} == {2} and sum(r.taken for r in rows) == 2


# --- sharding --------------------------------------------------------------------------------------------------------
def brute_table(names, size):
    prefs = [[(sharding._number(n, b"offset") + j * (sharding._number(n, b"skip") % (size - 1) + 1)) % size for j in range(size)] for n in names]
    table, at, left = [None] * size, [0] * len(names), size
    for i in itertools.cycle(range(len(names))):
        if not left:
            return table
        while table[prefs[i][at[i]]] is not None:
            at[i] += 1
        table[prefs[i][at[i]]] = i
        left -= 1


def test_lookup_table_is_fair_and_stable():
    names = [f"n{i}" for i in range(13)]
    t = sharding.lookup_table(names, 1009)
    assert t == brute_table(names, 1009)
    counts = np.bincount(t)
    assert counts.max() - counts.min() <= 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    kept = [a == b for a, b in zip(t, fewer) if a != 12]
    assert sum(kept) / len(kept) > 0.7
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 1000)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a", "a"], 7)


def test_sharding_places_every_row(spark, tmp_path):
    docs = frame(spark, [f"t{i}" for i in range(500)] + [None, None, "é"], list(range(500)) + [None, 3, 3])
    names = ["x", "y", "z"]
    table = sharding.lookup_table(names, 101)
    rows = sharding.assign_shards(docs, names, 101).collect()
    assert len(rows) == 503 and all(r.shard == table[r.slot] and r.shard_name == names[r.shard] for r in rows)
    assert len({r.slot for r in rows if r.doc_id == 3}) == 1
    assert sorted(r.n_bytes for r in rows if r.doc_id == 3) == [0, 2, 2]
    sharding.write_shards(docs, str(tmp_path / "out"), names, 101, files_per_shard=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 503
    assert {(r.doc_id, r.shard_name) for r in back.filter("doc_id is not null").collect()} == {(r.doc_id, r.shard_name) for r in rows if r.doc_id is not None}


# --- urls ------------------------------------------------------------------------------------------------------------
URLS = [
    ("http://ththre.example.com/fr/825?page=2", "ththre.example.com", "/fr/825", "com/", "allow"),
    ("https://WWW.Example.com/en/x#t", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
    ("https://a.example.com/en/1", "a.example.com", "/en/1", "example.com/en/", "block"),
    ("http://notexample.com/en/1", "notexample.com", "/en/1", "com/", "allow"),
    ("http://x.net/es/", "x.net", "/es/", "net/es/", "block"),
    ("http://x.net/es", "x.net", "/es", None, None),
    ("http://x.com", "x.com", "", None, None),
    ("x.com/en/", "", "", None, None),
    (None, "", "", None, None),
    ("a://b://c/fr/?q#f", "b:", "//c/fr/", None, None),
    ("http://net?x/fr/", "net", "", None, None),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u[0], None, "clash") for i, u in enumerate(URLS)], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in url_filter.judge_urls(pages).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    assert got[7].verdict == got[8].verdict == "allow"
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def brute_rank(edges, seeds, damping=0.85, rounds=20):
    hosts = sorted({h for e in edges for h in e[:2]} | set(seeds))
    r = {h: seeds.get(h, 0.0) for h in hosts}
    out = {h: sum(n for a, _, n in edges if a == h) for h in hosts}
    for _ in range(rounds):
        lost = sum(r[h] for h in hosts if not out[h])
        r = {h: (1 - damping) * seeds.get(h, 0.0) + damping * (sum(r[a] * n / out[a] for a, b, n in edges if b == h) + lost * seeds.get(h, 0.0)) for h in hosts}
    return r


def test_trust_and_distrust_spread(spark):
    html = lambda *hosts: "".join(f'<a HREF="http://{h}/x">l</a><a href="//{h}/y"><a href="/own">' for h in hosts)
    rows = [(1, "http://good.com/a", html("friend.org")), (2, "http://friend.org/", html("far.org")), (3, "http://far.org/", ""), (4, "http://farm.org/", html("bad.net", "good.com")), (5, "http://bad.net/es/1", html("good.com")), (6, "http://feeder.org/", html("farm.org"))]
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    edges = [("good.com", "friend.org", 2), ("friend.org", "far.org", 2), ("farm.org", "bad.net", 2), ("farm.org", "good.com", 2), ("bad.net", "good.com", 2), ("feeder.org", "farm.org", 2)]
    trust = brute_rank(edges, {"good.com": 1.0})
    distrust = brute_rank([(b, a, n) for a, b, n in edges], {"bad.net": 1.0})
    for r in got.values():
        assert r.trust == pytest.approx(trust[r.host], abs=1e-4) and r.distrust == pytest.approx(distrust[r.host], abs=1e-4)
    assert [got[i].verdict for i in (2, 3, 4, 6)] == ["allow", "allow", "block", "block"]


def test_trust_reaches_hosts_beyond_twenty_links(spark, monkeypatch):
    edges = spark.createDataFrame([("trust", f"h{i}", f"h{i + 1}", 1) for i in range(25)], "kind string, src string, dst string, links long")
    seeds = spark.createDataFrame([("trust", "h0", 1.0)], "kind string, host string, seed double")
    with pytest.raises(RuntimeError):
        url_filter.propagate(edges, seeds, rounds=3, settle=True)
    scores = {r.host: r.score for r in url_filter.propagate(edges, seeds, rounds=200, tolerance=1e-2, settle=True).collect()}
    want = brute_rank([(f"h{i}", f"h{i + 1}", 1) for i in range(25)], {"h0": 1.0}, rounds=300)
    assert len(scores) == 26 and all(scores[h] == pytest.approx(want[h], abs=1e-2) and scores[h] > 0 for h in want)
    taken = {}
    monkeypatch.setattr(url_filter, "judge_urls", lambda pages, **kw: taken.update(kw))
    queries.op10_url_filter(spark, SF)
    assert taken == {"rounds": 200, "settle": True}


# --- tokens ----------------------------------------------------------------------------------------------------------
def test_token_files_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    texts = odd_texts() + ["don't <|endoftext|> stop", "e\u0301 x\u2003y", "ΑΣ Σ", "\x1f a\x1cb", "🙂 ok"]
    ids = [5 * i + 3 for i in range(len(texts))][::-1]
    token_output.write_tokens(frame(spark, texts, ids).repartition(6), str(tmp_path / "t"), path)
    rows = token_output.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    want = sorted((i, plain.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in zip(ids, texts))
    assert [(r.doc_id, list(r.tokens)) for r in rows] == want
    assert [r.start for r in rows] == np.cumsum([0] + [len(t) for _, t in want])[:-1].tolist()
    digests = {r.doc_id: r for r in token_output.token_digests(spark, str(tmp_path / "t")).collect()}
    for i, t in want:
        assert digests[i].ids_crc32 == zlib.crc32(np.array(t, "<u4").tobytes()) and digests[i].n_tokens == len(t)
    meta = {r.doc_id: (r.start, r.n_tokens) for r in token_output.read_metadata(spark, str(tmp_path / "t")).collect()}
    assert meta == {r.doc_id: (r.start, r.n_tokens) for r in rows}


def test_token_files_layout(spark, tmp_path):
    import pyarrow.parquet as pq

    token_output.write_tokens(frame(spark, [prose(random.Random(i), 50) for i in range(3000)]).coalesce(1), str(tmp_path / "t"), queries.tokenizer_path("word_bpe_49k.json"), page_rows=200)
    for f in (tmp_path / "t").glob("*.parquet"):
        group = pq.ParquetFile(f).metadata.row_group(0)
        by = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
        tokens = next(c for p, c in by.items() if p.startswith("tokens"))
        assert any("DICTIONARY" in e for e in tokens.encodings) and tokens.has_offset_index
        assert "DELTA_BINARY_PACKED" in by["doc_id"].encodings and by["doc_id"].has_column_index


def test_token_files_repeats_nulls_and_empty(spark, tmp_path):
    path = queries.tokenizer_path("word_bpe_49k.json")
    rows = token_output.token_files(frame(spark, ["b", "a", None], [1, 1, None]), path).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in rows] == [(None, 0, 1), (1, 1, 2), (1, 3, 2)]
    assert token_output.token_files(frame(spark, []), path).count() == 0


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_section_tokens_equal_brute_force(spark, rule):
    path = queries.tokenizer_path("byte_bpe_50k.tiktoken")
    encode, sizes = token_counts.encoder(path)
    texts = odd_texts() + ["a\n\n\n\nb", "x\r\n\r\n\r\ny\n", "\n\n", "日本語\n日\n\n🙂🙂\n", "    \n\t\n  z"]
    got = {r.doc_id: r for r in section_tokens(spark, texts, path, rule).collect()}
    for i, t in enumerate(texts):
        doc = f"en\n{t or ''}"
        ids = encode(doc)
        raw = doc.encode()
        lines = re.findall(r"[^\n]*\n|[^\n]+$", doc)
        owner_of_char = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
        at, want, crossing = 0, np.zeros(owner_of_char.max() + 1, int), 0
        for k in ids:
            first, last = sum((b & 0xC0) != 0x80 for b in raw[: at + 1]) - 1, sum((b & 0xC0) != 0x80 for b in raw[: at + sizes[k]]) - 1
            span = owner_of_char[first : last + 1]
            crossing += span[0] != span[-1]
            want[span[0] if rule == "start" else span[-1] if rule == "end" else max(range(span[0], span[-1] + 1), key=lambda s: ((span == s).sum(), -s))] += 1
            at += sizes[k]
        r = got[i]
        assert list(r.section_tokens) == want.tolist() and r.crossing_tokens == crossing and r.n_tokens == len(ids) == sum(r.field_tokens)
    assert any(r.crossing_tokens for r in got.values())


def section_tokens(spark, texts, path, rule):
    return token_counts.section_tokens(frame(spark, texts), path, ("lang", "text"), rule, detail=True)


def test_section_tokens_of_nothing(spark):
    path = queries.tokenizer_path("byte_bpe_50k.tiktoken")
    rows = token_counts.section_tokens(frame(spark, [None, ""]), path).collect()
    assert [(r.n_tokens, r.n_sections, r.field_tokens) for r in rows] == [(0, 0, [0]), (0, 0, [0])]
    assert token_counts.section_tokens(frame(spark, []), path).count() == 0
    with pytest.raises(ValueError):
        token_counts.section_tokens(frame(spark, []), path, rule="none")


# --- classifiers -----------------------------------------------------------------------------------------------------
SF = "/root/testdata/sf0.01"


def test_quality_separates_held_out_documents(spark):
    rows = queries.op6_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) >= 0.95


def test_quality_cosines_are_exact_and_odd_texts_have_scores(spark):
    rng = random.Random(3)
    texts = [prose(rng, 50) if i % 2 else " ".join(f"W{rng.randrange(9)}!!" for _ in range(40)) for i in range(60)]
    m = quality.fit(texts, [i % 2 for i in range(60)], dims=8, neighbours=5)
    odd = odd_texts()
    v = m.project(odd).astype(float)
    s = v @ m.vectors.astype(float).T
    for i, p in enumerate(m.predict(odd, block=3)):
        if not np.abs(v[i]).sum():
            assert p == m.labels.mean()
            continue
        near = np.argsort(-s[i], kind="stable")[:5]
        w = np.maximum(s[i][near], 0) ** m.power
        assert abs(p - (w * m.labels[near]).sum() / w.sum()) < 1e-6
    got = quality.quality_scores(frame(spark, odd), m).collect()
    assert len(got) == len(odd) and all(0 <= r.score <= 1 for r in got)
    assert quality.quality_scores(frame(spark, []), m).count() == 0


def test_toxicity_chain_finds_planted_documents(spark):
    rng = random.Random(8)
    bad = ["idiot", "moron", "scum"]

    def doc(toxic):
        w = prose(rng, rng.randrange(20, 200)).split()
        for _ in range(3 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(bad) + rng.choice(["", ",", "."]))
        return " ".join(w)

    y = [i % 4 == 0 for i in range(400)]
    texts = [doc(t) for t in y]
    feats = [np.sort(np.fromiter(toxicity.document_features(t, {}), np.int64)) for t in texts]
    model = toxicity.fit_chain(feats, np.column_stack([y, y]).astype(int), ("mild", "toxic"))
    fresh = [i % 2 == 0 for i in range(100)]
    rows = toxicity.toxicity_scores(frame(spark, [doc(t) for t in fresh] + odd_texts()), model).orderBy("doc_id").collect()
    assert [r.toxicity[1] >= 0.5 for r in rows[:100]] == fresh
    assert len(rows) == 100 + len(odd_texts()) and all(len(r.toxicity) == 2 for r in rows)
    assert len(model.weights[1]) == len(model.weights[0]) + 1  # the second sees the first's probability


def test_toxicity_labels_of_one_kind_and_empty_tables(spark):
    docs, labels = frame(spark, ["a b", "c d"]), spark.createDataFrame([(0, 0), (1, None), (9, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, {"toxic": "toxic = 1"})
    assert toxicity.toxicity_scores(frame(spark, ["idiot"]), model).first().toxicity[0] < 0.5
    empty = toxicity.train(docs, labels.limit(0), {"toxic": "toxic = 1"})
    assert toxicity.toxicity_scores(frame(spark, []), empty).count() == 0


@pytest.mark.parametrize("labels", [[], [(0, None), (None, 1)], [(77, 1)]])
def test_toxicity_without_labelled_documents_drops_nothing(spark, tmp_path, labels):
    import corpus_pipeline as P

    docs = frame(spark, ["you idiot", "fine words", None, ""])
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.drop_toxic(spark, docs, str(tmp_path)).count() == 4
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.toxic for r in queries.op1_toxicity(spark, str(tmp_path)).collect()] == [False] * 4


def test_toxicity_on_labelled_documents(spark):
    rows = queries.op1_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert np.mean([r[6] == bool(r[-1]) for r in rows]) >= 0.97


# --- pipeline --------------------------------------------------------------------------------------------------------
def test_pipeline_stages_decide_and_keep_columns(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "token_output"]
    kept = docs
    for name, stage in P.STAGES[:4]:
        out = stage(spark, kept, SF)
        assert out.columns == docs.columns
        before, after = {r.doc_id: r.text for r in kept.collect()}, {r.doc_id: r.text for r in out.collect()}
        assert after.items() <= before.items() and 0 < len(after) < len(before)
        if name == "ngram_jaccard_join":
            ids = sorted(before)
            want = brute_components([before[i] for i in ids], ids, 5, 8, 10)
            assert set(after) == {i for i in ids if want[i][1] == i}
        if name == "benchmark_decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            ids = sorted(before)
            assert set(after) == {i for i, f in zip(ids, brute_contamination([before[i] for i in ids], items)) if not f[4]}
        kept = spark.createDataFrame(out.collect(), docs.schema)
    assert P.STAGES[4][1](spark, kept, SF).count() == kept.count()


def test_pipeline_stages_tell_rows_with_null_and_repeated_ids_apart(spark):
    import corpus_pipeline as P

    rng = random.Random(21)
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(alnum(r.text)) >= 10)
    copy, other, alone, leak = prose(rng, 60), prose(rng, 60), prose(rng, 60), f"{prose(rng, 20)} {item}"
    ids = [None, None, 5, 5, 5, 2, 2, None, None, 2]
    texts = [copy, copy + " end", other, other, alone, copy, leak, leak + " more", None, "a b"]
    docs = frame(spark, texts, ids).select("doc_id", "text", "lang", "source", "n_chars")
    out = P.drop_near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    kept = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert kept == sorted([(5, other), (5, alone), (2, copy), (2, leak), (None, None), (2, "a b")], key=str)
    clean = sorted(((r.doc_id, r.text) for r in P.drop_contaminated(spark, docs, SF).collect()), key=str)
    assert clean == sorted([(i, t) for i, t in zip(ids, texts) if not (t or "").startswith(leak)], key=str)


def test_near_duplicate_stage_copies_no_text_and_leaves_small_tables_only(spark, tmp_path):
    import corpus_pipeline as P

    texts = [f"w{i % 40} " * 3 + " ".join(f"x{i % 40}y{j}" for j in range(60)) + (" end" if i >= 40 else "") for i in range(60)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(path)
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) / "ridgeline"
    before = set(shared.glob("*")) if shared.exists() else set()
    out = P.drop_near_duplicates(spark, spark.read.parquet(path), SF)
    left = {p.name.rsplit("-", 1)[0] for p in set(shared.glob("*")) - before}
    assert left == {"near-copies"}  # neither a copy of the rows nor shingles
    assert sorted(r.doc_id for r in out.collect()) == list(range(40))
    twice = spark.read.parquet(path).withColumn("again", F.explode(F.array(F.lit(1), F.lit(2))))  # both rows have one place in a file
    assert sorted(r.doc_id for r in P.drop_near_duplicates(spark, twice, SF).collect()) == list(range(40))


def test_short_lived_tables_go_and_kept_ones_stay(spark):
    from ridgeline.operators import tables

    with tables.short_lived(spark) as outer:
        with tables.short_lived(spark) as keep:
            gone, kept = (tables.materialize(spark.range(n), "t") for n in (3, 5))
            keep(kept.filter("id > 0"))
            folder = gone.inputFiles()[0].removeprefix("file:").rpartition("/")[0]
        assert kept.count() == 5 and not Path(folder).exists()
        stays = outer(tables.materialize(spark.range(2), "t"))
        inner = kept.inputFiles()[0].removeprefix("file:").rpartition("/")[0]
    assert stays.count() == 2 and not Path(inner).exists()
