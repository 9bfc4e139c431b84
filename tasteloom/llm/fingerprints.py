"""Document fingerprints: every shingle hash below a fixed fraction of the hash range.

Two such sketches can be merged by a union and compared whatever the sizes of the documents: the share
of the smaller sketch that the larger one has estimates how much of the smaller text is contained.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

WORDS = 5  # of a shingle
FRACTION = 1 / 2  # of all shingle hashes that are kept
ROWS_PER_BUCKET = 2_000  # whole texts, so these are tens of megabytes
MAX_BUCKETS = 100_000
COARSE = 128


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once; a lambda over a long array would compute it per element."""
    return F.transform(F.array(value), body)[0]


def sketch(text: Column, words: int = WORDS, fraction: float = FRACTION) -> Column:
    """Sorted distinct shingle hashes of the text below `fraction` of the hash range.

    Words are `[^\\x20\\x09-\\x0D]+`. A shingle is `words` places in a row of which one at least is a word:
    blanks before the first and after the last word count as places, so even one word has as many shingles
    as a shingle has places. A text without words has none. 64-bit hashes are signed, so the range starts
    at -2^63.
    """
    limit = int(-(1 << 63) + fraction * (1 << 64)) if fraction < 1 else (1 << 63) - 1
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    blanks = F.array_repeat(F.lit(0).cast("long"), words - 1)
    codes = F.concat(blanks, F.transform(parts, lambda w: F.xxhash64(w)), blanks)
    hashes = let(codes, lambda c: F.when(F.size(c) > 2 * (words - 1), F.transform(
        F.sequence(F.lit(0), F.size(c) - words),
        lambda i: F.xxhash64(*[F.get(c, i + k) for k in range(words)]))).otherwise(
            F.array().cast("array<bigint>")))
    return F.sort_array(F.array_distinct(F.filter(hashes, lambda h: h < F.lit(limit))))


def as_text(hashes: Column) -> Column:
    """The sketch as 16 hexadecimal digits per hash."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller sketch that the other one has; 0 if one is empty, which says nothing."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)


def likeness(text: Column, own: Column, other_text: Column, other: Column) -> Column:
    """`containment` of the sketches of two texts, and 1 for equal texts also where they are empty."""
    return F.when(text == other_text, F.lit(1.0)).otherwise(containment(own, other))


def merge(a: Column, b: Column) -> Column:
    """Sketch of both documents together."""
    return F.sort_array(F.array_union(a, b))


def _bucket(docs: DataFrame, rows_per_bucket: int) -> Column:
    """Number of a document's bucket, which grows with the id: at most COARSE quantiles of the id
    column, and equal widths between two of them."""
    size = docs.select(F.count("doc_id").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    count = min(MAX_BUCKETS, max(1, -(-size["n"] // rows_per_bucket)))
    if count == 1:
        return F.lit(0).cast("long")
    coarse = min(count, COARSE)
    inner = docs.select(F.percentile_approx("doc_id", [k / coarse for k in range(1, coarse)], 20 * coarse)).first()[0] or []
    bounds = sorted({size["low"], *inner}) + [size["high"] + 1]
    fine = -(-count // coarse)
    spans = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"))
                      for k, (a, b) in enumerate(zip(bounds, bounds[1:]))])
    mine = F.filter(spans, lambda s: (s["a"] <= F.col("doc_id")) & (F.col("doc_id") < s["b"]))
    return let(F.get(mine, 0), lambda s: s["k"] * fine + F.floor(
        (F.col("doc_id") - s["a"]) / (s["b"] - s["a"]) * fine).cast("long"))


def with_next(docs: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """`docs` (doc_id and others) with `following`, the row with the next larger doc_id as a struct;
    after the last comes the first.

    Rows are ordered within buckets of consecutive ids, so no task sees all of them. The first row of
    a bucket is also sent, as a guest, to the one before; the table of these has a row per bucket, at
    most MAX_BUCKETS.
    """
    placed = docs.withColumn("_bucket", _bucket(docs.select("doc_id"), rows_per_bucket))
    ring = Window.orderBy("_bucket")
    firsts = placed.groupBy("_bucket").agg(F.min("doc_id").alias("doc_id"))
    back = firsts.select("doc_id", F.coalesce(F.lag("_bucket").over(ring), F.max("_bucket").over(
        ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_back"))
    places = F.array(F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("guest")),
                     F.struct(F.col("_back").alias("b"), F.lit(True).alias("guest")))
    sent = (placed.join(F.broadcast(back), "doc_id", "left")
            .withColumn("_place", F.explode(F.filter(places, lambda p: p["b"].isNotNull()))))
    order = Window.partitionBy("_place.b").orderBy("_place.guest", "doc_id", *[c for c in docs.columns if c != "doc_id"])
    return (sent.withColumn("following", F.lead(F.struct(*docs.columns)).over(order))
            .where(~F.col("_place.guest")).select(*docs.columns, "following"))


def edited(text: Column, following: Column) -> Column:
    """The text with its last floor(n/2) code points replaced by the first as many of `following`."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, text, edited_text, sketch, edited_sketch, near_edited, near_next) for every row
    of `docs` (doc_id, text).

    The edited text is `edited(text, text of the next larger doc_id)`, after the last the first; alone,
    a document is its own next. `near_*` is the `likeness` of the row and the other text.

    Null or empty texts count as empty: no words, an empty sketch, like other empty texts (1) and nothing
    else (0). A text of very few words can have an empty sketch too: each of its shingles, WORDS at least, is
    kept with probability FRACTION. Rows that repeat a doc_id follow each other in the order of their texts.
    Rows with a null doc_id have no next document: nothing replaces their second half, and `near_next` is
    null. No rows in, no rows out. Columns besides doc_id and text are not looked at.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    named = with_next(rows.where("doc_id is not null"))
    nameless = rows.where("doc_id is null")
    both = named.unionByName(nameless.withColumn("following", F.lit(None).cast(named.schema["following"].dataType)))
    # Sketches are made after the shuffle, which moves texts only.
    changed = both.withColumn("edited_text", edited(F.col("text"), F.coalesce("following.text", F.lit(""))))
    changed = (changed.withColumn("sketch", sketch(F.col("text"))).withColumn("edited_sketch", sketch(F.col("edited_text")))
               .withColumn("next_sketch", sketch(F.col("following.text"))))
    text, own = F.col("text"), F.col("sketch")
    return changed.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), "text", "edited_text", "sketch", "edited_sketch",
        likeness(text, own, F.col("edited_text"), F.col("edited_sketch")).alias("near_edited"),
        F.when(F.col("following").isNotNull(), likeness(text, own, F.col("following.text"), F.col("next_sketch"))).alias("near_next"))
