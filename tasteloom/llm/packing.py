"""Harmonic packing of token sequences.

Lengths fall into classes of reciprocal capacity: the pieces of class k fill one k-th of a sequence, and
every sequence of a class holds k of them. Documents may be cut, so each is cut into the largest
pieces C, C/2, C/3 ... that fit what is left of it, and a piece of a class fills its share exactly but
for rounding. Workers fill the sequences of a class independently; what is left over from each, less
than one sequence, is filled class by class, and the rest of that, less than one sequence per class,
by first fit.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tasteloom.llm.arrays import give_back
from tasteloom.llm.tokens import encoder
from tasteloom.session import write_once

CAPACITY = 4096
SMALL = 64  # pieces up to this length are not cut again
PIECES_PER_WORKER = 1_000_000

_PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


@functools.cache
def rest_lengths(rest: int, capacity: int, small: int) -> tuple[int, ...]:
    """Lengths of the pieces of less than one sequence."""
    found = []
    while rest > small:
        share = capacity // (rest + 1) + 1  # the smallest k with a k-th of the capacity at most `rest`
        found.append(capacity // share)
        rest -= found[-1]
    return (*found, rest) if rest else tuple(found)


def piece_lengths(total: int, capacity: int = CAPACITY, small: int = SMALL) -> list[int]:
    """Lengths of the pieces of a document of `total` ids, in order."""
    return [capacity] * (total // capacity) + list(rest_lengths(total % capacity, capacity, small))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, small: int = SMALL,
           keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]) of every piece of every document."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, _kind = encoder(tokenizer)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                rows: list[tuple] = []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encode(part.column("text").to_pylist())):
                    wide = np.frombuffer(ids, dtype=_kind).astype("<u4")
                    start = 0
                    for length in piece_lengths(len(wide), capacity, small):
                        own = wide[start:start + length].tobytes()
                        rows.append((doc_id, start, length, zlib.crc32(own), len(wide), own if keep_ids else None))
                        start += length
                columns = list(zip(*rows)) if rows else [()] * 6
                arrays = [pa.array(c, pa.int64()) for c in columns[:5]]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if keep_ids:
                    arrays, names = [*arrays, pa.array(columns[5], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)
        give_back()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(
        task, _PIECES_DDL + (", ids binary" if keep_ids else ""))


def _first_fit(capacity: int):
    """Place the last pieces; there are fewer of them than k for each class k, whatever the input."""
    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start", "row"], ascending=[False, True, True, True],
                                  ignore_index=True)
        room = np.zeros(0, dtype=np.int64)
        bins, offsets = [], []
        for length in group["length"]:
            fits = np.flatnonzero(room >= length)
            if not len(fits):
                room = np.append(room, capacity)
                fits = [len(room) - 1]
            bins.append(int(fits[0]))
            offsets.append(int(capacity - room[fits[0]]))
            room[fits[0]] -= length
        return pd.DataFrame({"row": group["row"], "bin": bins, "offset": offsets}).astype("int64")
    return place


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, small: int = SMALL, keep_ids: bool = False,
         pieces_per_worker: int = PIECES_PER_WORKER) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) for every piece.

    A document's ids end with the end id; its pieces cover them in order. Sequences hold at most
    `capacity` ids, `offset` counts from 0 without gaps, sequence ids are dense from 0.

    Null and empty texts are a piece of one id. Rows with a null doc_id, and rows that repeat one, are
    documents of their own. No rows in, no rows out. Other columns are not looked at.
    """
    cut = write_once(pieces(docs, tokenizer, capacity, small, keep_ids), "pieces")
    # At most capacity / small + small lengths, so a row per class is small.
    classes = cut.groupBy("length").agg(F.ceil(F.count(F.lit(1)) / pieces_per_worker).cast("int").alias("workers"))
    fits = F.floor(F.lit(capacity) / F.col("length"))
    order = ["doc_id", "start", "ids_crc32", "doc_tokens"]

    def number(df: DataFrame, by: list[str]) -> DataFrame:
        group = Window.partitionBy(*by)
        return (df.withColumn("at", F.row_number().over(group.orderBy(*order)) - 1)
                .withColumn("whole", F.floor(F.count(F.lit(1)).over(group) / fits) * fits))

    one = write_once(number(cut.join(F.broadcast(classes), "length")
                            .withColumn("worker", F.pmod(F.xxhash64("doc_id", "start"), F.col("workers"))),
                            ["length", "worker"]), "packed")
    filled = one.where("at < whole").withColumn("level", F.lit(0))
    two = write_once(number(one.where("at >= whole").drop("at", "whole").withColumn("worker", F.lit(0).cast("long")),
                            ["length"]).withColumn("row", F.monotonically_increasing_id()), "packed")
    merged = two.where("at < whole").withColumn("level", F.lit(1)).drop("row")
    last = two.where("at >= whole").withColumn("level", F.lit(2))
    fitted = last.groupBy("level").applyInPandas(_first_fit(capacity), "row long, bin long, offset long")
    last = last.join(fitted, "row").drop("row")
    last = last.withColumn("length_class", F.lit(0).cast("long"))
    regular = (filled.unionByName(merged).withColumn("length_class", F.col("length"))
               .withColumn("bin", F.floor(F.col("at") / fits)).withColumn("offset", (F.col("at") % fits) * F.col("length")))
    every = regular.unionByName(last.select(*regular.columns))
    keys = ["level", "length_class", "worker"]
    # One row per class and worker.
    begin = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    bases = (every.groupBy(*keys).agg((F.max("bin") + 1).alias("bins"))
             .withColumn("base", F.coalesce(F.sum("bins").over(begin), F.lit(0))).drop("bins"))
    return every.join(F.broadcast(bases), keys).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("bin")).cast("long").alias("sequence_id"),
        F.col("offset").cast("long").alias("offset"), *(["ids"] if keep_ids else []))


def assemble(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, n_tokens, ids) with the ids of each sequence of `pack(keep_ids=True)` as 32-bit
    integers, zero-padded to `capacity` unless their number is a power of two."""
    joined = packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    exact = F.pmod(F.log2("n_tokens"), F.lit(1.0)) == 0

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [b"".join(p["ids"] for p in parts) for parts in batch.column("parts").to_pylist()]
            full = batch.column("exact").to_pylist()
            padded = [i if e else i.ljust(4 * capacity, b"\0") for i, e in zip(ids, full)]
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), batch.column("n_tokens"),
                                              pa.array(padded, pa.binary())], names=["sequence_id", "n_tokens", "ids"])
    return joined.withColumn("exact", exact).select("sequence_id", "n_tokens", "parts", "exact").mapInArrow(
        task, "sequence_id long, n_tokens long, ids binary")
