"""Windows of text that occur more than once, found without shuffling a row per window.

Every window is assigned to its anchor, the smallest k-gram in it; consecutive windows with the same
anchor form a run (`arrays.anchored_runs`). One short row per run is shuffled. Where whole runs are
equal, all their windows are decided at once; only the runs of anchors that occur with different
surroundings are looked at window by window.

Skew: equal runs (or windows) of one Arrow batch are reduced to the first of them before the shuffle,
so a passage that a third of all documents share arrives once per batch. Groups are read as sorted
streams, never collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tasteloom.llm import arrays
from tasteloom.session import write_once

# A run has at most as many windows as a window has k-grams, and the anchor lies in its first window.
# Both numbers stay below 2^10, so they share one long with the start, which sorts first.
FIELD = 10
FIELD_MAX = (1 << FIELD) - 1
ROWS = 256  # texts whose units are in memory at a time
TEXT_BYTES = 1 << 19  # of these texts; a longer one comes alone
# Anchors with more surroundings than this are compared window by window instead of as a group.
VARIANTS = 4096

RUN_SCHEMA = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("doc_id", pa.int64()),
                        ("place", pa.int64()), ("spare", pa.bool_())])
RUN_DDL = "anchor long, content long, doc_id long, place long, spare boolean"


def keyed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, text) alone, so other columns can have any names; rows without an id left out."""
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).where(
        "doc_id is not null")


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch with a column `text` in pieces of at most ROWS texts and TEXT_BYTES bytes."""
    lengths = pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False)
    for low, high in arrays.slices(np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]), TEXT_BYTES):
        for at in range(low, high, ROWS):
            yield batch.slice(at, min(ROWS, high - at))


def earlier_copies(keys: list[np.ndarray], doc_ids: np.ndarray, places: np.ndarray, by_place: bool) -> np.ndarray:
    """Mask of the rows that an earlier row of this batch with equal keys makes superfluous: one of a
    smaller document or, with `by_place`, also one of the same document."""
    order = np.lexsort((places, doc_ids, *keys[::-1]))
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    group = np.cumsum(new) - 1
    heads = order[np.flatnonzero(new)]
    spare = np.zeros(len(order), dtype=bool)
    spare[order] = doc_ids[order] > doc_ids[heads][group]
    if by_place:
        spare[order] |= places[order] > places[heads][group]
    return spare


def runs(docs: DataFrame, units: Callable, window: int, gram: int, by_place: bool) -> DataFrame:
    """A row per run of windows of `docs` (doc_id, text). `units(data, offsets)` gives the codes of a
    batch and the first one of each document."""
    if window > FIELD_MAX:
        raise ValueError(f"a window has at most {FIELD_MAX} units")

    def found_in(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        parts, low = [], 0
        for piece in slices(batch):
            codes, first = units(*arrays.flat(piece.column("text")))
            parts.append(arrays.anchored_runs(codes, first, window, gram))
            parts[-1]["item"] += low
            low += piece.num_rows
        found = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        doc_ids = ids[found["item"]]
        places = (((found["start"] << FIELD) | found["offset"]) << FIELD) | found["n"]
        spare = earlier_copies([found["anchor"], found["content"]], doc_ids, places, by_place)
        # Superfluous rows are only passed on; a key of their own keeps them out of any group.
        anchor = np.where(spare, arrays.mixed(arrays.mixed(doc_ids.astype(np.uint64)) + places.astype(np.uint64)),
                          found["anchor"])
        return pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(found["content"].view(np.int64)),
                                           pa.array(doc_ids), pa.array(places), pa.array(spare)], schema=RUN_SCHEMA)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield found_in(batch)
            arrays.give_back()
    return docs.mapInArrow(task, RUN_DDL)


def decided(found: DataFrame, by_place: bool) -> DataFrame:
    """(anchor, doc_id, place, removed, variants) of the runs that matter, written once.

    `removed`: an earlier document (or place) has the whole run. The other rows are the first
    occurrences of their run whose anchor has `variants` > 1 different runs; some of their windows
    may occur earlier in another of these.
    """
    same = Window.partitionBy("anchor", "content").orderBy("doc_id", "place")
    first = (F.rank().over(same) == 1) if by_place else (F.col("doc_id") == F.first("doc_id").over(same))
    ranked = (found.repartition("anchor")
              .withColumn("_new", F.when(F.row_number().over(same) == 1, 1).otherwise(0))
              .withColumn("removed", F.col("spare") | ~first)
              .withColumn("variants", F.sum("_new").over(Window.partitionBy("anchor"))))
    return write_once(ranked.where(F.col("removed") | (F.col("variants") > 1))
                      .select("anchor", "doc_id", "place", "removed", "variants"), "runs")


def open_runs(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, text, runs): the documents that have runs to be looked at window by window."""
    wanted = found.where(~F.col("removed")).groupBy("doc_id").agg(
        F.collect_list(F.struct("anchor", "place", "variants")).alias("runs"))
    return docs.join(wanted, "doc_id")


def span_table(found: DataFrame, more: DataFrame) -> DataFrame:
    """(doc_id, spans): per document the (start, n windows) to remove; bounded by its length."""
    spans = found.where("removed").select(
        "doc_id", F.shiftright("place", 2 * FIELD).alias("start"), F.col("place").bitwiseAND(F.lit(FIELD_MAX)).alias("n"))
    return spans.unionByName(more.select("doc_id", "start", "n")).groupBy("doc_id").agg(
        F.collect_list(F.struct("start", "n")).alias("spans"))


def span_arrays(column: pa.Array, row: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, numbers) of one row of `spans`."""
    if not column[row].is_valid:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    values = column[row].values
    return values.field("start").to_numpy(), values.field("n").to_numpy()


def run_lists(column: pa.Array) -> tuple[np.ndarray, ...]:
    """(row, anchor, start, n, offset, variants) of all entries of a `runs` column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy())
    entries = column.flatten()
    places = entries.field("place").to_numpy()
    return (rows, entries.field("anchor").to_numpy(), places >> (2 * FIELD), places & FIELD_MAX,
            (places >> FIELD) & FIELD_MAX, entries.field("variants").to_numpy())
