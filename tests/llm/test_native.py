import hashlib
import itertools
import math
import re
import zlib

import duckdb
import xxhash
from fixtures import WORD, frame, hard_rows, sentence
from pyspark.sql import functions as F

import __spark_entry__ as driver
from tasteloom.llm import decontaminate, fingerprints, shards

SMALL = "/root/testdata/sf0.001"
PYTHON = re.compile("Python|Pandas|Arrow")


def documents(folder, table="documents", columns="doc_id, text"):
    return duckdb.connect().execute(f"select {columns} from '{folder}/{table}.parquet' order by 1").fetchall()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def signed(value):
    return value - (1 << 64) if value >= 1 << 63 else value


def sketch(text):
    """Chained 64-bit xxHash of the word hashes, as Spark's xxhash64 is defined."""
    codes = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in WORD.findall(text)]
    out = set()
    places = [0] * 4 + codes + [0] * 4
    for j in range(len(codes) + 4 if codes else 0):
        value = 42
        for code in places[j:j + 5]:
            value = xxhash.xxh64(code.to_bytes(8, "little"), seed=value).intdigest()
        out.add(signed(value))
    return sorted(h for h in out if h < 0)


def likeness(text, other):
    a, b = sketch(text), sketch(other)
    if text == other:
        return 1.0
    return len(set(a) & set(b)) / min(len(a), len(b)) if a and b else 0.0


def brute_fingerprints(rows):
    named = sorted(((i, t or "") for i, t in rows if i is not None), key=lambda r: (r[0], r[1]))
    out = []
    for k, (i, t) in enumerate(named):
        following = named[(k + 1) % len(named)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + following[:half]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), sketch(t), sketch(edited),
                    likeness(t, edited), likeness(t, following)))
    return out


def as_list(fingerprint):
    return [signed(int(fingerprint[k:k + 16], 16)) for k in range(0, len(fingerprint), 16)]


def test_fingerprint_query(spark):
    df = driver.queries()["op1_document_fingerprints"](spark, SMALL)
    rows = sorted(df.collect(), key=lambda r: r.doc_id)
    got = [(r.doc_id, r.n_chars, r.edited_sha256, as_list(r.fingerprint), as_list(r.edited_fingerprint), r.near_edited, r.near_next)
           for r in rows]
    assert got == brute_fingerprints(documents(SMALL))
    assert not PYTHON.search(plan(df))
    assert sum(r.near_edited for r in rows) > 10 * sum(r.near_next for r in rows)


def test_fingerprints_of_hard_rows(hard):
    found = fingerprints.fingerprints(hard).where("doc_id is not null").collect()
    got = sorted((r.doc_id, r.n_chars, hashlib.sha256(r.edited_text.encode()).hexdigest(), r.sketch, r.edited_sketch,
                  r.near_edited, r.near_next) for r in found)
    assert got == sorted(brute_fingerprints(hard_rows()))
    nameless = fingerprints.fingerprints(hard).where("doc_id is null").collect()
    assert len(nameless) == 2 and all(r.near_next is None for r in nameless)


def test_next_rows_across_buckets(spark):
    ids = [k * k for k in range(300)] + [10 ** 12]
    rows = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    for size in (3, 50, 1000):
        found = {r.doc_id: r.following.doc_id for r in fingerprints.with_next(rows, size).collect()}
        assert found == dict(zip(ids, ids[1:] + ids[:1]))
    assert fingerprints.with_next(rows.limit(1)).first().following.doc_id == 0


def test_sketches_merge_and_contain(spark):
    text = " ".join(f"w{k}" for k in range(4000))
    part = " ".join(f"w{k}" for k in range(1000, 1400))
    both = spark.createDataFrame([(text, part, " ".join(f"v{k}" for k in range(400)))], "a string, b string, c string").select(
        *[fingerprints.sketch(F.col(c)).alias(c) for c in "abc"])
    row = both.select(fingerprints.containment(F.col("a"), F.col("b")).alias("ab"),
                      fingerprints.containment(F.col("b"), F.col("c")).alias("bc"),
                      fingerprints.containment(fingerprints.merge(F.col("b"), F.col("c")), F.col("c")).alias("bcc"),
                      F.size("a").alias("n")).first()
    # All but the shingles that hold a blank.
    assert 0.95 < row.ab < 1 and (row.bc, row.bcc) == (0.0, 1.0) and 1800 < row.n < 2200


def test_short_texts_have_fingerprints(spark):
    """Different short texts are never alike because nothing is known of them."""
    rows = [(k, f"w{k} v{k}") for k in range(300)]
    found = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(not r.sketch for r in found) < 15 and {r.near_next for r in found} == {0.0}
    documents_ = [r for r in brute_fingerprints(documents("/root/testdata/sf0.01")) if r[1]]
    assert sum(not r[3] for r in documents_) <= 2


def test_shards_query(spark):
    df = driver.queries()["op5_hilbert_sharding"](spark, SMALL)
    assert not PYTHON.search(plan(df))
    rows = df.collect()
    texts = dict(documents(SMALL))
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
    counts = {}
    for r in rows:
        counts.setdefault(r.shard, []).append(r.slot)
    assert set(counts) == set(range(24)) and all(sorted(v) == list(range(len(v))) for v in counts.values())
    assert max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    order = [r.curve for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)


def test_shards_prune_in_every_dimension(spark):
    """Ranges per shard are smaller than under a sort by one column."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    placed = shards.hilbert_shards(docs).join(docs.select("doc_id", "source", "n_chars"), "doc_id")
    width = placed.groupBy("shard").agg(F.countDistinct("source").alias("s"), F.expr("max(n_chars) - min(n_chars)").alias("n"))
    row = width.agg(F.avg("s"), F.expr("percentile(n, 0.5)")).first()
    every = docs.agg(F.countDistinct("source"), F.expr("max(n_chars) - min(n_chars)")).first()
    assert row[0] < every[0] * 0.7 and row[1] < every[1] * 0.5


def test_hilbert_index_steps_to_neighbours(spark):
    for count, bits in ((2, 4), (3, 3), (1, 5), (4, 2)):
        axes = [(F.floor(F.col("id") / (1 << (bits * k))) % (1 << bits)).alias(f"a{k}") for k in range(count)]
        rows = spark.range(1 << (bits * count)).select(*axes).select(
            "*", shards.hilbert_index([F.col(f"a{k}") for k in range(count)], bits).alias("h")).collect()
        place = {r.h: tuple(r)[:count] for r in rows}
        assert sorted(place) == list(range(1 << (bits * count)))
        assert all(sum(abs(x - y) for x, y in zip(place[h], place[h + 1])) == 1 for h in range(len(place) - 1))


def test_shards_of_hard_rows(hard, empty):
    rows = shards.hilbert_shards(hard).collect()
    assert len(rows) == len(hard_rows())
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    sizes = [len(slots.get(k, ())) for k in range(24)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert shards.hilbert_shards(empty).count() == 0


def test_written_shards(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    shards.write_shards(docs, shards.hilbert_shards(docs, 4), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 4


TOKEN = re.compile(r"[^\W_]+")


def overlaps(docs, items, window=16, agreement=0.8):
    """Every alignment, seeds or not."""
    found = set()
    for (i, t), (item, b) in itertools.product(docs, items):
        doc, own = TOKEN.findall((t or "").lower()), TOKEN.findall((b or "").lower())
        size = min(window, len(own))
        if size < 5:
            continue
        for shift in range(-len(own), len(doc)):
            same = [0 <= j + shift < len(doc) and doc[j + shift] == c for j, c in enumerate(own)]
            if any(sum(same[s:s + size]) >= math.ceil(agreement * size) for s in range(len(own) - size + 1)):
                found.add((i, item))
    return found


def test_decontamination_query(spark):
    df = driver.queries()["op4_benchmark_decontamination"](spark, SMALL)
    assert not PYTHON.search(plan(df))
    got = {(r.doc_id, r.item_id) for r in df.collect()}
    assert got == overlaps(documents(SMALL), documents(SMALL, "benchmark", "item_id, text")) and got


def planted(spark):
    import random
    r = random.Random(2)
    items = [(k, sentence(r, 24 + k)) for k in range(6)] + [(6, sentence(r, 7)), (7, "two words"), (8, None), (None, sentence(r, 20))]
    words = items[2][1].split()
    swapped = [w if k % 6 != 3 else "swapped" for k, w in enumerate(words)]
    docs = [(1, sentence(r, 40) + "\n" + items[0][1].upper() + "! " + sentence(r, 5)), (2, sentence(r, 80)),
            (3, sentence(r, 10) + " " + " ".join(swapped)), (4, " ".join(words[5:])), (5, " ".join(words[:9]) + " " + sentence(r, 30)),
            (6, items[6][1]), (7, "two words"), (8, None), (9, ""), (None, items[1][1]), (1, sentence(r, 30)),
            (10, " ".join([items[3][1]] * 400))]
    return docs, items


def test_decontamination_finds_substituted_passages(spark):
    docs, items = planted(spark)
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("codes", F.lit("z")).withColumn("seed", F.lit(1))
    want = overlaps(docs, items)
    assert {1, 3, 4, 6, 10, None} == {d for d, _ in want}
    for words in (250_000, 60):  # in one block and in several
        found = decontaminate.contaminated(frame(spark, docs), table, block_words=words).collect()
        assert {(r.doc_id, r.item_id) for r in found} == want and len(found) == len(want)
    start = {(r.doc_id, r.item_id): (r.start, r.matched, r.n_words) for r in found}
    assert start[4, 2][0] == -5 and start[3, 2][:2] == (10, sum(k % 6 != 3 for k in range(26)))
    kept = decontaminate.decontaminated(frame(spark, docs), table)
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [2, 5, 7, 8, 9]


def test_every_pattern_of_replaced_words_is_found(spark):
    """Items of 5 to 20 words, in all ways to replace a fifth of the words of an overlap; also at the ends of a document."""
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in [*range(5, 17), 20]]
    docs, want = [], set()
    for n, text in items:
        size = min(n, 16)
        for gone in itertools.combinations(range(size), size - math.ceil(0.8 * size)):
            words = ["new" if k in gone else w for k, w in enumerate(text.split()) if k < size]
            want.add((len(docs), n))
            docs.append((len(docs), " ".join(words if len(docs) % 2 else ["some", *words, "more"])))
    for n, text in items:  # cut off instead of replaced
        for cut in (text.split()[:math.ceil(0.8 * min(n, 16))], text.split()[-math.ceil(0.8 * min(n, 16)):]):
            want.add((len(docs), n))
            docs.append((len(docs), " ".join(cut)))
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                                       spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and len(found) == len(want)


def test_decontamination_of_empty_tables(spark, hard, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(hard, none).count() == 0
    assert decontaminate.contaminated(empty, spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")).count() == 0
    assert fingerprints.fingerprints(empty).count() == 0
