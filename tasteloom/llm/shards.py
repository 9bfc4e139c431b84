"""Sharding along a Hilbert curve through several metadata dimensions.

Every dimension is quantised into cells of about equal row counts, the Hilbert index of a row's cell
orders the rows, and the order is cut into runs. Neighbours on the curve are close in all dimensions,
so each file covers small ranges of each of them and a reader can skip files by any. Only DataFrame
functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from tasteloom.operators.order import number_rows

DIMENSIONS = ("lang", "source", "n_chars")
SHARDS = 24
BITS = 6  # 64 cells per dimension
KEY_BYTES = 7  # of a text value behind the column's common prefix that decide its cell


def _numeric_keys(docs: DataFrame, dimensions: Sequence[str]) -> list[Column]:
    """Each dimension as a number in the same order. Texts: the bytes behind the common prefix of all
    values, which is that of the smallest and the largest one."""
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    texts = [d for d in dimensions if isinstance(kinds[d], StringType)]
    row = docs.select(*[f(F.col(d)).alias(f"{n}{k}") for k, d in enumerate(texts)
                        for n, f in (("low", F.min), ("high", F.max))]).first() if texts else None
    keys = []
    for d in dimensions:
        if d not in texts:
            keys.append(F.col(d).cast("double"))
            continue
        low, high = ((row[f"{n}{texts.index(d)}"] or "").encode() for n in ("low", "high"))
        shared = 0
        while shared < min(len(low), len(high)) and low[shared] == high[shared]:
            shared += 1
        part = F.hex(F.substring(F.col(d).cast("binary"), shared + 1, KEY_BYTES))
        keys.append(F.conv(F.rpad(part, 2 * KEY_BYTES, "0"), 16, 10).cast("double"))
    return keys


def cells(docs: DataFrame, dimensions: Sequence[str], bits: int) -> list[Column]:
    """The cell 0 .. 2^bits - 1 of each dimension: the number of its quantiles at or below the value.
    Nulls lie in the first cell."""
    keys = _numeric_keys(docs, dimensions)
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    row = docs.select(*[F.percentile_approx(k, shares, 100 << bits).alias(f"q{i}") for i, k in enumerate(keys)]).first()
    found = []
    for i, key in enumerate(keys):
        bounds = sorted(set(row[f"q{i}"] or []))
        inside = F.filter(F.array(*[F.lit(float(b)) for b in bounds]).cast("array<double>"), lambda b: b <= key)
        found.append(F.coalesce(F.when(key.isNotNull(), F.size(inside)), F.lit(0)).cast("long"))
    return found


def hilbert_index(axes: Sequence[Column], bits: int) -> Column:
    """Index along the Hilbert curve of the cell with these coordinates.

    The coordinates are turned level by level from the largest cube down, Gray coded, and their bits
    interleaved.
    """
    count = len(axes)
    start = F.array(*[a.cast("long") for a in axes])
    steps = F.array(*[F.struct(F.lit(1 << level).cast("long").alias("q"), F.lit(axis).alias("axis"))
                      for level in range(bits - 1, 0, -1) for axis in range(count)])

    def turn(state: Column, step: Column) -> Column:
        first, own, below = state[0], F.get(state, step["axis"]), step["q"] - 1
        inside = own.bitwiseAND(step["q"]) != 0
        swap = first.bitwiseXOR(own).bitwiseAND(below)
        return F.transform(state, lambda x, k: F.when(
            k == 0, F.when(inside, first.bitwiseXOR(below)).otherwise(first.bitwiseXOR(swap))).when(
            (k == step["axis"]) & ~inside, own.bitwiseXOR(swap)).otherwise(x))

    turned = F.aggregate(steps, start, turn) if bits > 1 else start
    gray = F.transform(turned, lambda _, k: F.aggregate(F.slice(turned, F.lit(1), k + 1), F.lit(0).cast("long"),
                                                        lambda a, x: a.bitwiseXOR(x)))
    levels = F.array(*[F.lit(1 << level).cast("long") for level in range(bits - 1, -1, -1)])

    def flips(values: Column) -> Column:
        return F.aggregate(levels, F.lit(0).cast("long"), lambda a, q: F.when(
            (q > 1) & (F.get(values, F.lit(count - 1)).bitwiseAND(q) != 0), a.bitwiseXOR(q - 1)).otherwise(a))

    def interleave(values: Column) -> Column:
        return F.aggregate(levels, F.lit(0).cast("long"), lambda a, q: F.aggregate(
            values, a, lambda b, x: b * 2 + F.when(x.bitwiseAND(q) != 0, 1).otherwise(0)))

    def once(value: Column, body) -> Column:
        return F.transform(F.array(value), body)[0]
    flipped = once(gray, lambda g: once(flips(g), lambda t: F.transform(g, lambda x: x.bitwiseXOR(t))))
    return once(flipped, interleave)


def hilbert_shards(docs: DataFrame, shards: int = SHARDS, dimensions: Sequence[str] = DIMENSIONS,
                   bits: int = BITS) -> DataFrame:
    """(doc_id, size, text_crc32, curve, shard, slot) for every row of `docs`.

    Rows are ordered by Hilbert index, then doc_id and text, and cut into `shards` runs whose row counts
    differ by one at most (law `rows`); `slot` counts from 0 inside a shard. `size` is the UTF-8 length
    of the text plus 8.

    A null text has no bytes; null dimension values lie in the first cell; equal rows stay neighbours
    and may fall on two sides of a cut; a null doc_id comes first in its cell. With fewer rows than
    shards, the last shards are empty; no rows in, no rows out. Other columns are not looked at.
    """
    axes = cells(docs, dimensions, bits)
    placed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        hilbert_index(axes, bits).alias("curve"))
    ranked = number_rows(placed, ["curve", "doc_id", "text_crc32", "size"], "rank")
    each, extra = divmod(ranked.count(), shards)
    border = extra * (each + 1)  # ranks below it lie in the shards with one row more
    shard = F.when(F.col("rank") < border, F.floor(F.col("rank") / (each + 1))).otherwise(
        extra + F.floor((F.col("rank") - border) / max(each, 1)))
    begin = F.when(F.col("shard") < extra, F.col("shard") * (each + 1)).otherwise(
        border + (F.col("shard") - extra) * each)
    return (ranked.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("rank") - begin).cast("long"))
            .drop("rank"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Write `docs` as Parquet in one folder per shard, rows in curve order, so file statistics prune."""
    (docs.join(placed.select("doc_id", "shard", "slot"), "doc_id")
     .repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
