import hashlib
import random
import tracemalloc
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from fixtures import WORD, frame, hard_rows, sentence, shingles

import __spark_entry__ as driver
from tasteloom.llm import arrays, components, neardup, suffix_dedup, window_dedup
from tasteloom.llm.sketches import EMPTY, fast_sketches

SMALL = "/root/testdata/sf0.001"


def documents(folder):
    return duckdb.connect().execute(f"select doc_id, text from '{folder}/documents.parquet'").fetchall()


def without_windows(rows, size=50):
    """{(doc_id, text): (words, removed, kept text)} of substring dedup."""
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for j in range(len(w) - size + 1):
            if i is not None:
                key = tuple(w[j:j + size])
                first[key] = min(first.get(key, i), i)
    out = Counter()
    for (i, t), (_, w) in zip(rows, words):
        gone = [False] * len(w)
        for j in range(len(w) - size + 1):
            if i is not None and first[tuple(w[j:j + size])] < i:
                gone[j:j + size] = [True] * size
        out[i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)] += 1
    return out


def without_strings(rows, size=100):
    seen, out = {}, Counter()
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        raw = (t or "").encode()
        for j in range(len(raw) - size + 1):
            key = raw[j:j + size]
            seen[key] = min(seen.get(key, (i, j)), (i, j))
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for j in range(len(raw) - size + 1):
            if i is not None and seen[raw[j:j + size]] < (i, j):
                gone[j:j + size] = b"\1" * size
        runs = sum(1 for a, b in zip(b"\0" + bytes(gone), gone) if b and not a)
        out[i, len(raw), sum(gone), runs, bytes(x for x, g in zip(raw, gone) if not g)] += 1
    return out


def test_substring_dedup_hard_rows(hard):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in window_dedup.substring_dedup(hard).collect())
    assert got == without_windows(hard_rows())


def test_substring_dedup_query(spark):
    want = Counter((i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in without_windows(documents(SMALL)).elements())
    rows = driver.queries()["op10_substring_dedup"](spark, SMALL).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows) == want
    assert sum(r.n_removed for r in rows) > 0


def test_suffix_dedup_hard_rows(hard):
    rows = [r for r in hard_rows() if r[0] != 16]  # equal ids with different texts share their places
    for variants in (4096, 1):  # the second sends every open window by itself
        found = suffix_dedup.suffix_dedup(hard.where("doc_id is null or doc_id <> 16"), variants=variants)
        got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found.collect())
        assert got == without_strings(rows)


def test_suffix_dedup_query(spark):
    want = Counter((i, n, g, s, hashlib.sha256(k).hexdigest()) for i, n, g, s, k in without_strings(documents(SMALL)).elements())
    rows = driver.queries()["op6_suffix_array_dedup"](spark, SMALL).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == want


def test_suffix_order_sorts_like_bytes():
    random_ = np.random.default_rng(3)
    data = random_.integers(97, 99, 3000, dtype=np.uint8)
    starts = np.arange(2900)
    group = np.sort(random_.integers(0, 5, 2900))
    order = suffix_dedup.suffix_order(data, starts, group, 100)
    keys = [(group[k], data[k:k + 100].tobytes(), k) for k in range(2900)]
    assert [keys[k] for k in order] == sorted(keys)


def test_shared_prefix_by_binary_search():
    data = np.frombuffer(b"abcabcabdabc" + b"x" * 20, dtype=np.uint8)
    sums = arrays.prefix_sums(arrays.BYTE_CODE[data])
    assert list(suffix_dedup.common_prefix(sums, np.array([0, 0, 3]), np.array([3, 6, 6]), 10)) == [5, 2, 2]


def test_runs_cover_every_window_once_and_meet(monkeypatch):
    random_ = np.random.default_rng(1)
    units = arrays.mixed(random_.integers(0, 3, 5000).astype(np.uint64))
    first = np.array([0, 10, 10, 3000, 5000])
    whole = arrays.anchored_runs(units, first, 50, 8)
    places = [(i, p) for i, s, n in zip(whole["item"], whole["start"], whole["n"]) for p in range(s, s + n)]
    assert sorted(places) == [(i, p) for i in (2, 3) for p in range((2990, 2000)[i - 2] - 49)]
    monkeypatch.setattr(arrays, "SLICE", 700)  # long items are cut
    cut = arrays.anchored_runs(units, first, 50, 8)

    def anchors(found):
        return {(i, p): (a, s + o - p) for i, s, n, o, a in zip(*(found[k] for k in ("item", "start", "n", "offset", "anchor")))
                for p in range(s, s + n)}
    assert anchors(cut) == anchors(whole)


def test_word_codes_of_cut_texts(monkeypatch):
    text = (" ".join(f"w{k}" for k in range(3000)) + "x" * 500).encode()
    data, offsets = np.frombuffer(text * 2, dtype=np.uint8), np.array([0, len(text), len(text), 2 * len(text)])
    whole = arrays.word_codes(data, offsets)
    monkeypatch.setattr(arrays, "SLICE", 256)
    cut = arrays.word_codes(data, offsets)
    assert (whole[0] == cut[0]).all() and list(whole[1]) == list(cut[1]) == [0, 3000, 3000, 6000]


def test_pipeline_stage_keeps_columns_and_untouched_texts(hard):
    kept = window_dedup.without_repeats(hard)
    assert kept.schema.names == hard.schema.names
    texts = {r.doc_id: r.text for r in kept.where("doc_id is not null").collect()}
    before = dict(hard_rows())
    assert texts[3] == before[3] and texts[11] == before[11] and texts[1] is None
    assert 12 not in texts and 13 not in texts  # every word of theirs is in document 11


def groups(rows):
    sets = defaultdict(list)
    for i, t in rows:
        if i is not None:
            sets[i].append(shingles(t))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(s and t and 100 * len(s & t) >= 75 * len(s | t) for s in sets[a] for t in sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: find(i) for i in ids}


def test_near_dedup_hard_rows(hard):
    want = groups(hard_rows())
    sizes = Counter((i, len(shingles(t))) for i, t in hard_rows())
    rows = neardup.near_duplicates(hard).collect()
    assert Counter((r.doc_id, r.n_shingles) for r in rows) == sizes
    assert all(r.component_id == want.get(r.doc_id) and r.kept == (r.doc_id is None or r.component_id == r.doc_id) for r in rows)
    assert {r.component_id for r in rows if r.doc_id in range(100, 112)} == {100}
    assert neardup.without_near_duplicates(hard).schema.names == hard.schema.names


def test_near_dedup_query(spark):
    rows = documents(SMALL)
    want = groups(rows)
    got = driver.queries()["op2_minhash_near_dedup"](spark, SMALL).collect()
    assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(rows)
    assert any(i != c for i, c in want.items())


def test_near_dedup_compares_within_mixed_buckets(spark):
    """Chains whose ends are not alike, and groups that only touch outside the smallest member."""
    r = random.Random(9)
    base = sentence(r, 300).split()
    rows = []
    for k in range(30):
        own = base[:]
        own[:k * 9] = sentence(r, k * 9).split()
        rows.append((k * 3 % 31, " ".join(own)))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert got == groups(rows)


def test_sketches_estimate_similarity_and_fill():
    values = arrays.mixed(np.arange(4000, dtype=np.uint64))
    for size in (1, 3, 40, 2000):
        a, b = values[:size], np.concatenate([values[:size * 3 // 4], values[2000:2000 + size - size * 3 // 4]])
        pair = fast_sketches(np.repeat([0, 2], [size, size]), np.concatenate([a, b]), 3, 120)
        assert (pair[[0, 2]] != EMPTY).all() and (pair[1] == EMPTY).all()
        true = len(set(a) & set(b)) / len(set(a) | set(b))
        assert abs((pair[0] == pair[2]).mean() - true) < 0.2


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    r = random.Random(seed)
    links = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 440)]
    found = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    root = {n: n for e in links for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    linked = {n for a, b in links if a != b for n in (a, b)}
    assert {(r.node, r.component) for r in found} == {(n, find(n)) for n in linked}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_tables(empty):
    assert window_dedup.substring_dedup(empty).count() == 0
    assert suffix_dedup.suffix_dedup(empty).count() == 0
    assert neardup.near_duplicates(empty).count() == 0
    assert window_dedup.without_repeats(empty).count() == 0


def peak_mb(mapper, batch):
    """MB that a mapper holds at once, beside what it has yielded."""
    list(mapper(iter([batch.slice(0, 1)])))  # tables that are kept
    tracemalloc.start()
    try:
        for _ in mapper(iter([batch])):
            pass
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_memory_follows_neither_the_batch_nor_the_group():
    rng = np.random.default_rng(5)
    anchor, count = bytes(range(97, 113)), 3000
    around = rng.integers(32, 127, (count, 168), dtype=np.uint8)
    pieces = [a[:84].tobytes() + anchor + a[84:].tobytes() for a in around]
    numbers = [pa.array(np.full(count, n, np.int64)) for n in (7, 0, 85, 84)]
    group = pa.RecordBatch.from_arrays([numbers[0], pa.array(np.arange(count)), *numbers[1:], pa.array(np.zeros(count, bool)),
                                        pa.array(pieces, pa.binary())], schema=suffix_dedup._SEGMENT_SCHEMA)
    assert peak_mb(suffix_dedup._sorted_groups(100), group) < 60

    texts = pa.array(["".join(map(chr, rng.integers(32, 127, 1 << 15))) for _ in range(128)])
    places = np.tile(((np.arange(700, dtype=np.int64) * 42 << 10) | 41) << 10 | 42, 128)
    run = pa.StructArray.from_arrays([pa.array(np.arange(len(places))), pa.array(places), pa.array(np.full(len(places), 2))],
                                     ["anchor", "place", "variants"])
    lists = pa.ListArray.from_arrays(pa.array(np.arange(129, dtype=np.int32) * 700), run)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(128)), texts, lists], names=["doc_id", "text", "runs"])
    assert peak_mb(suffix_dedup._segments(100, 4096), batch) < 10
