import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from fixtures import frame, hard_rows

import __spark_entry__ as driver
from tasteloom.llm import variants
from tasteloom.llm.queries import SQL

RUN = re.compile("[a-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    """Exactly one inserted, deleted or replaced code point, by trying all of them."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1:] == short for k in range(len(long)))


def counted(rows):
    n = Counter()
    for i, text in rows:
        for run in RUN.findall((text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def brute(rows):
    n = counted(rows)
    forms, out = {}, {}
    for w in n:
        close = sorted((x for x in n if near(w, x)), key=lambda x: (-n[x], x))
        forms[w] = close[0] if close and n[close[0]] >= 2 * n[w] else None
        out[w] = len(close)
    def root(w):
        return w if forms[w] is None else root(forms[w])
    return {(w, forms[w], root(w), n[w], out[w], n.get(forms[w])) for w in n}


def spelled(seed, documents):
    """Words with slips, some of them very long, some as frequent as all others together."""
    r = random.Random(seed)
    stems = ["".join(r.choice("abcdeé×ÿ") for _ in range(r.randint(4, 9))) for _ in range(25)] + ["x" * 3000, "y" * 5, "house"]
    def slip(w):
        at = r.randrange(len(w) + 1)
        return r.choice([w, w, w, w[:at] + w[at + 1:], w[:at] + r.choice("abé") + w[at:], w[:at] + r.choice("abé") + w[at + 1:]])
    return [(r.choice([None, k, 7]), r.choice([" ", ",", "1\n"]).join(r.choice([slip, str.upper, str])(r.choice(stems + ["house"] * 20))
                                                                      for _ in range(r.randint(0, 60)))) for k in range(documents)]


@pytest.mark.parametrize("limit", [variants.NODE_WORDS, 3])
def test_against_all_pairs(spark, limit, monkeypatch):
    monkeypatch.setattr(variants, "NODE_WORDS", limit)  # 3: the whole trie is dealt out
    monkeypatch.setattr(variants, "PAIRS", 50)
    chain = " ".join(["marble"] * 20 + ["marbles"] * 8 + ["marblest"] * 3)
    rows = spelled(3, 150) + hard_rows() + [(900, chain)]
    got = [tuple(r) for r in variants.spelling_variants(frame(spark, rows)).collect()]
    want = brute(rows)
    assert len(got) == len(want) and set(got) == want
    assert any(r[1] and r[1] != r[2] for r in want) and any(len(r[0]) > 2000 for r in want)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = {tuple(r) for r in driver.queries()["op11_spelling_variants"](spark, folder).collect()}
    table = duckdb.connect()
    table.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    assert rows == set(table.execute(SQL["op11_spelling_variants"]).fetchall())
    assert rows == brute(table.execute("select doc_id, text from documents").fetchall())


def test_vocabulary_is_the_same_with_few_words_in_memory(spark, monkeypatch):
    rows = spelled(5, 60)
    monkeypatch.setattr(variants, "COUNTED_WORDS", 10)
    assert dict(tuple(r) for r in variants.vocabulary(frame(spark, rows)).collect()) == counted(rows)


def test_empty_table_and_table_without_words(spark, empty):
    assert variants.spelling_variants(empty).count() == 0
    assert variants.spelling_variants(frame(spark, [(1, None), (2, ""), (3, "ab 12")])).count() == 0


def test_every_way_to_a_node_is_taken_once():
    ways = [(tuple(c), s, d) for c, s, d in variants.visits(3)]
    assert len(ways) == len(set(w[0] for w in ways)) == 11


def test_paths_and_missing_letters():
    found = variants.paths(["abcde", "ÿ×é", "a" * 70])
    assert found[:, 0].tolist() == [5, 3, 70] and (found[:, 1:].sum(axis=1) == found[:, 0]).all()
    assert variants.without_one("héllo".encode(), 6) == "hllo".encode() and variants.without_one(b"a", 97) == b""


def test_roots_of_a_long_chain(spark):
    links = [(f"w{k}", f"w{k + 1}") for k in range(37)]
    found = variants.roots_of(spark.createDataFrame(links, "word string, form string")).collect()
    assert {tuple(r) for r in found} == {(w, "w37") for w, _ in links}


def test_trie_visits_the_same_words_as_a_scan():
    r = random.Random(9)
    words = sorted({"".join(r.choice("abcz") for _ in range(6)) for _ in range(400)})
    trie = variants.Trie(words, 0)
    got = {(words[a], trie.words[b]) for a, b in ((x, y) for part in trie.near(words, 1, 1) for x, y in zip(*part))}
    # From the path that comes first to the other one, or, with equal paths, from the smaller word.
    assert {frozenset(p) for p in got} == {frozenset((a, b)) for a in words for b in words if near(a, b)}
    assert len(got) == len({frozenset(p) for p in got}) and isinstance(trie.leaves, np.ndarray)
