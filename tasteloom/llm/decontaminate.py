"""Benchmark decontamination with spaced seeds.

A fixed mask laid over consecutive words picks some of them and ignores the others, so a hash of the
picked words still agrees when an ignored word was replaced. Hashes of every position of every
document and benchmark item are joined; around each hit the two texts are compared word by word on
the same alignment. Only DataFrame functions are used; document texts are neither shuffled nor read
twice.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F

from tasteloom.llm.fingerprints import let
from tasteloom.llm.inputs import without_ids

# 1: the word counts, 0: it is ignored. Enumeration of all patterns of replaced words shows that each
# set hits every overlap of WINDOW and AGREEMENT, in items of as many words as stated.
MASKS = ("111011", "110100011")
LONG_WORDS = 11
SHORT_MASKS = ("1111", "11011", "11101", "10111")  # for shorter items
SHORT_WORDS = 5  # of the shortest item that is looked for
WINDOW = 16  # words of an overlap, or the whole item where it is shorter
AGREEMENT = 0.8  # of the words of an overlap
# Words of all items in one broadcast: some 30 MB of seeds. A larger benchmark is searched in blocks.
BLOCK_WORDS = 250_000


def word_codes(text: Column) -> Column:
    """A hash for each run of letters and digits of the lower-cased text."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def seeds(codes: Column, masks: tuple[str, ...]) -> Column:
    """The hashes of all positions of the first mask, then those of the second, and so on. Each has as
    many as the shortest one; null where it does not fit."""
    shortest = min(map(len, masks))

    def under(c: Column, number: int, mask: str) -> Column:
        used = [o for o, use in enumerate(mask) if use == "1"]

        def at(i: Column) -> Column:
            seed = F.xxhash64(F.lit(number), *[F.get(c, i + o) for o in used])
            return seed if len(mask) == shortest else F.when(i + len(mask) <= F.size(c), seed)
        return F.transform(F.sequence(F.lit(0), F.size(c) - shortest), at)

    def of(c: Column) -> Column:
        return F.when(F.size(c) >= shortest, F.concat(*[under(c, k, m) for k, m in enumerate(masks)]))
    return let(codes, of)


def _placed(rows: DataFrame, masks: tuple[str, ...], place: str) -> DataFrame:
    """Each row with each of its seeds: `seed` and its position."""
    count = F.size("codes") - min(map(len, masks)) + 1
    return (rows.where(count > 0).select("*", F.posexplode(seeds(F.col("codes"), masks)).alias("_at", "seed"))
            .withColumn(place, (F.col("_at") % count).cast("int")).drop("_at"))


def _hits(docs: DataFrame, items: DataFrame, masks: tuple[str, ...], window: int, agreement: float) -> DataFrame:
    """(doc_id, item_id, matched, n_words, start) of the alignments that agree well enough. `items` is
    one block, so its size is bounded."""
    index = _placed(items, masks, "item_at").select("seed", "item_id", "item_at")
    found = (_placed(docs, masks, "doc_at").join(F.broadcast(index), "seed")
             .join(F.broadcast(items.withColumnRenamed("codes", "item_codes")), "item_id"))
    shift = F.col("doc_at") - F.col("item_at")
    same = F.transform("item_codes", lambda c, j: F.when(
        (j + shift >= 0) & (F.get("codes", j + shift) == c), 1).otherwise(0))
    size = F.least(F.lit(window), F.size("item_codes"))
    least = F.ceil(size * agreement)
    # Overlaps of `size` words that contain the seed's first words and lie inside the item.
    begins = F.sequence(F.greatest(F.lit(0), F.col("item_at") + min(map(len, masks)) - size),
                        F.least(F.col("item_at"), F.size("item_codes") - size))
    best = let(same, lambda s: F.when(F.aggregate(s, F.lit(0), lambda a, x: a + x) >= least, F.array_max(
        F.transform(begins, lambda b: F.aggregate(F.slice(s, b + 1, size), F.lit(0), lambda a, x: a + x)))))
    return (found.where(best >= least)
            .select("doc_id", "item_id", F.aggregate(same, F.lit(0), lambda a, x: a + x).cast("long").alias("matched"),
                    F.size("item_codes").cast("long").alias("n_words"), shift.cast("long").alias("start")))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, agreement: float = AGREEMENT,
                 block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, matched, n_words, start): a row per document and benchmark item (item_id, text)
    that overlap.

    They overlap when `window` consecutive words of the item, or all of them where it has fewer, agree
    with the document's words on one alignment in at least `agreement` of the places. With
    other values than the defaults, only overlaps with a seed inside are found. Words are runs of letters and digits in lower case. `matched` counts the equal words over
    the whole item on the best alignment, `start` is the document's word at which the item would begin
    (negative when its beginning is cut off).

    Null and empty texts, and items of fewer than SHORT_WORDS words, overlap with nothing. Rows
    that repeat an id count as one document or item. Null ids are reported as null. Either table empty:
    no rows. Other columns are not looked at.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_codes(F.col("text")).alias("codes"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), word_codes(F.col("text")).alias("codes"))
    total = items.agg(F.sum(F.size("codes")).alias("n")).first()["n"] or 0
    blocks = -(-total // block_words)
    parts = []
    for block in range(max(1, blocks)):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else items
        parts.append(_hits(rows, own.where(F.size("codes") >= LONG_WORDS), MASKS, window, agreement))
        short = own.where((F.size("codes") < LONG_WORDS) & (F.size("codes") >= SHORT_WORDS))
        if not short.isEmpty():
            parts.append(_hits(rows, short, SHORT_MASKS, window, agreement))
    best = F.max(F.struct("matched", (-F.col("start")).alias("back"), "n_words"))
    return (functools.reduce(DataFrame.unionByName, parts).groupBy("doc_id", "item_id").agg(best.alias("b"))
            .select("doc_id", "item_id", "b.matched", "b.n_words", (-F.col("b.back")).alias("start")))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the documents that overlap with a benchmark item; all columns stay as they are.
    Rows with a null doc_id cannot be named and are left alone."""
    return without_ids(docs, contaminated(docs, benchmark).select("doc_id"))
