"""Near-duplicate detection: fast similarity sketches, banding, exact verification.

Texts with equal shingle sets are one class, represented by the smallest doc_id. The sketch of each
class is cut into bands; classes that share a band are candidates. Within such a bucket everything is
first compared with the smallest class, which links the copies of a group without comparing them with
each other. Only between classes of a bucket that are then still in different components, all pairs
are compared. Every link is confirmed on the full shingle sets.

The second step needs no list of all pairs. With b the class that x and y were compared with, the
difference of x and y is the symmetric difference of their differences to b. Where x is not alike
enough to b, a y that is alike enough to x must share a computable number of difference elements with
it (`_prefixes`), so one of the first few in any fixed order: only pairs with such an element in
common are confirmed, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tasteloom.llm import arrays
from tasteloom.llm.components import components
from tasteloom.llm.inputs import sized, without_ids
from tasteloom.llm.repeats import keyed
from tasteloom.llm.sketches import fast_sketches
from tasteloom.session import write_once

WORDS = 5
PERCENT = 75
# 30 bands of 4: two sets at the bound share a band with probability 1 - 1e-5, more alike ones nearly always.
SIZE, ROWS = 120, 4

_SUMMARY_DDL = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"
_STAR_DDL = "hub long, rep long, linked boolean, n_hub long, n long, delta long, open_part array<long>, any_part array<long>"


def _sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    codes, first = arrays.word_codes(*arrays.flat(texts), lower=True)
    return arrays.shingles(codes, first, WORDS)


def summaries(docs: DataFrame) -> DataFrame:
    """Per document: size and hash of its shingle set, and the band keys of its sketch."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                count = batch.num_rows
                items, hashes = _sets(batch.column("text"))
                sizes = np.bincount(items, minlength=count)
                sums = []
                for seed in (1001, 1002):
                    total = np.zeros(len(items) + 1, dtype=np.uint64)
                    np.cumsum(arrays.seeded(hashes, seed), out=total[1:])
                    ends = np.cumsum(sizes)
                    sums.append((total[ends] - total[ends - sizes]).view(np.int64))
                sketch = fast_sketches(items, hashes, count, SIZE)
                keys = np.zeros((count, SIZE // ROWS), dtype=np.uint64)
                for row in range(ROWS):
                    keys = arrays.mixed(keys * np.uint64(5) + sketch[:, row::ROWS])
                keys = arrays.seeded(keys + np.arange(SIZE // ROWS, dtype=np.uint64), 7)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(sizes.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]),
                     pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), SIZE // ROWS)
                     .cast(pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_a", "set_b", "bands"])
    return docs.mapInArrow(task, _SUMMARY_DDL)


def _paired_sets(batch: pa.RecordBatch, a: str, b: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, set of a, set of b, mask of the elements of b that a has) of the rows of a batch."""
    for low in range(0, batch.num_rows, 256):
        part = batch.slice(low, 256)
        left, right = (part.column(c).to_numpy() for c in (a, b))
        texts = pa.chunked_array([part.column(f"text_{a}"), part.column(f"text_{b}")]).combine_chunks().dictionary_encode()
        items, hashes = _sets(texts.dictionary)
        edge = np.searchsorted(items, np.arange(len(texts.dictionary) + 1))
        which = texts.indices.to_numpy()
        for x, y, k, m in zip(left, right, which, which[len(left):]):
            one, two = hashes[edge[k]:edge[k + 1]], hashes[edge[m]:edge[m + 1]]
            yield int(x), int(y), one, two, one[np.minimum(np.searchsorted(one, two), len(one) - 1)] == two


def _alike(common: int, one: int, two: int) -> bool:
    return 100 * common >= PERCENT * (one + two - common)


def _prefixes(hub: np.ndarray, own: np.ndarray, shared: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(size of the difference, its first elements if `own` is not linked, and in any case).

    With d(x, y) the size of the symmetric difference, x and y are linked when d <= (|x| + |y|) / 7 (for
    75 %), and the differences of x and y to the hub share s = (d(x, hub) + d(y, hub) - d(x, y)) / 2
    elements. A link of x, itself not linked to the hub, hence needs s >= d(x, hub) - |x| / 3, and
    from y's side s >= (d(y, hub) + (|hub| - |y|) / 7) / 2. Two sets of sizes p and q that share s
    elements share one among the first p - s + 1 and q - s + 1 in any common order; elements outside
    the hub, which tend to be rare, come first.
    """
    outside = own[~shared]
    missing = hub[~np.isin(hub, own, assume_unique=True)]
    delta = np.concatenate([outside, missing])
    size = len(delta)
    least_open = max(1, size - len(own) // 3)
    least_any = max(1, -(-(7 * size + len(hub) - len(own)) // 14))
    return size, delta[:max(0, size - least_open + 1)], delta[:max(0, size - least_any + 1)]


def _compared(stars: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (hub, rep), whether they are linked, and the prefixes of their difference."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for hub, rep, one, two, shared in _paired_sets(batch, "hub", "rep"):
                linked = _alike(int(shared.sum()), len(one), len(two))
                delta, open_part, any_part = _prefixes(one, two, shared)
                rows.append((hub, rep, linked, len(one), len(two), delta, [] if linked else open_part.view(np.int64),
                             any_part.view(np.int64)))
            columns = list(zip(*rows)) if rows else [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.list_(pa.int64())] * 2]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             names=[f.split()[0] for f in _STAR_DDL.split(", ")])
    return _with_texts(stars, texts, "hub", "rep").mapInArrow(task, _STAR_DDL)


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are alike enough."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([_alike(int(shared.sum()), len(one), len(two))
                             for _, _, one, two, shared in _paired_sets(batch, "a", "b")], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])
    return _with_texts(pairs, texts, "a", "b").mapInArrow(task, "a long, b long")


def _with_texts(pairs: DataFrame, texts: DataFrame, a: str, b: str) -> DataFrame:
    for column in (b, a):
        pairs = pairs.join(texts.select(F.col("doc_id").alias(column), F.col("text").alias(f"text_{column}")), column)
    return pairs.select(a, b, f"text_{a}", f"text_{b}")


def _open_pairs(compared: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs of classes with the same hub, in different components so far, that may be linked."""
    place = found.withColumnsRenamed({"node": "rep", "component": "own"})
    at_hub = found.withColumnsRenamed({"node": "hub", "component": "hubs"})
    placed = (compared.join(place, "rep", "left").join(at_hub, "hub", "left")
              .withColumns({"own": F.coalesce("own", "rep"), "hubs": F.coalesce("hubs", "hub")}))
    placed = write_once(placed.withColumn("open", ~F.col("linked") & (F.col("own") != F.col("hubs"))), "placed")
    kept = ["rep", "own", "n", "delta"]
    left = placed.where("open").select("hub", F.posexplode("open_part").alias("at_a", "e"), *[F.col(c).alias(f"{c}_a") for c in kept])
    some = placed.where("open").select("hub").distinct()
    right = placed.join(some, "hub", "left_semi").select("hub", F.posexplode("any_part").alias("at_b", "e"),
                                                         *[F.col(c).alias(f"{c}_b") for c in kept])
    # At the first element in common, no more can follow than the shorter rest; `_prefixes` says how
    # many a link needs.
    rest = F.least(F.col("delta_a") - F.col("at_a"), F.col("delta_b") - F.col("at_b"))
    possible = ((F.col("own_a") != F.col("own_b")) & (F.col("rep_a") != F.col("rep_b"))
                & (100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b"))
                & (14 * rest + F.col("n_a") + F.col("n_b") >= 7 * (F.col("delta_a") + F.col("delta_b"))))
    return left.join(right, ["hub", "e"]).where(possible).select(
        F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of `docs` (doc_id, text).

    A text is lower-cased (A-Z), its words are `[^\\x20\\x09-\\x0D]+`, its set the distinct runs of five
    words; with fewer words all of them are one run. Documents are linked when 100 * intersection >=
    75 * union; a component is named by its smallest doc_id, which is the one kept.

    Null texts and texts without words have an empty set and are linked with nothing, not even each
    other. Rows with a null doc_id get a null component and are kept. Rows that repeat a doc_id are one
    node of the graph, with the links of all their texts. No rows in, no rows out. Other columns are
    not looked at.
    """
    texts = keyed(docs)
    every = write_once(summaries(texts), "summaries")
    named = every.where("n_shingles > 0")
    same = ["n_shingles", "set_a", "set_b"]
    classes = named.groupBy(*same).agg(F.min("doc_id").alias("rep"))
    members = write_once(named.select("doc_id", *same).join(classes, same).select("doc_id", "rep"), "members")
    reps = members.select("rep").distinct().withColumnRenamed("rep", "doc_id")
    rows = write_once(named.join(reps, "doc_id", "left_semi").select(
        F.explode("bands").alias("key"), F.col("doc_id").alias("rep")), "bands")
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = write_once(rows.join(sizes, "key"), "buckets")
    # The text a group was copied from shares more buckets with the others than they do among each
    # other, so comparing with it links copies that are not alike enough themselves.
    weights = shared.groupBy("rep").agg(F.sum("size").alias("weight"))
    weighed = shared.join(weights, "rep")
    hubs = weighed.groupBy("key").agg(F.max(F.struct("weight", (-F.col("rep")).alias("back"))).alias("hub"))
    shared = write_once(shared.join(hubs, "key").select("rep", (-F.col("hub.back")).alias("hub")).distinct(), "buckets")
    wanted = write_once(shared.select(F.col("rep").alias("doc_id")).distinct(), "wanted")
    needed = write_once(texts.join(sized(wanted), "doc_id", "left_semi"), "candidates")
    stars = shared.where("rep <> hub").select("hub", "rep").distinct()
    compared = write_once(_compared(stars, needed), "compared")
    links = compared.where("linked").select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    more = write_once(_linked(_open_pairs(compared, components(links)), needed), "links")
    final = components(links.unionByName(more))
    named_ids = members.join(final.withColumnRenamed("node", "rep"), "rep", "left").select(
        "doc_id", F.coalesce("component", "rep").alias("component"))
    per_id = named_ids.groupBy("doc_id").agg(F.min("component").alias("component"))
    found = every.select("doc_id", "n_shingles").join(per_id, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    found = found.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    nameless = docs.select(F.col("doc_id").cast("long"), F.col("text")).where("doc_id is null")
    return found.unionByName(summaries(nameless).select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """`docs` without the documents `near_duplicates` does not keep; all columns stay as they are."""
    gone = near_duplicates(docs).where("not kept").select("doc_id")
    return without_ids(docs, gone)
