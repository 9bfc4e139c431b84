"""Substring deduplication: Rabin-Karp hashes of every window of words, repeated ones removed.

Rabin-Karp hashes of all windows are taken in the tasks. Windows are decided in runs (`repeats`);
those whose run is not repeated as a whole are counted one by one in Spark. Repeated windows of a
document are merged into maximal intervals, and the words in them go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tasteloom.llm import arrays, repeats

WINDOW = 50
GRAM = 8  # words of an anchor

_WINDOW_SCHEMA = pa.schema([("anchor", pa.int64()), ("window", pa.int64()), ("doc_id", pa.int64()),
                            ("start", pa.int64()), ("spare", pa.bool_())])


def _units(data, offsets):
    return arrays.word_codes(data, offsets)


def _windows(width: int):
    """Rows of single windows of the listed runs."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            codes, first = arrays.word_codes(*arrays.flat(batch.column("text")))
            rows, anchors, starts, counts, _, _ = repeats.run_lists(batch.column("runs"))
            steps = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            rows, anchors, places = np.repeat(rows, counts), np.repeat(anchors, counts), np.repeat(starts, counts) + steps
            hashes = np.zeros(len(rows), dtype=np.uint64)
            for low, high in arrays.slices(first):
                mine = (rows >= low) & (rows < high)
                if mine.any():
                    sums = arrays.prefix_sums(codes[first[low]:first[high]])
                    at = first[rows[mine]] - first[low] + places[mine]
                    hashes[mine] = arrays.mixed(arrays.span_hash(sums, at, at + width))
            spare = repeats.earlier_copies([anchors, hashes], ids[rows], places, False)
            anchors = np.where(spare, arrays.mixed(hashes + places.astype(np.uint64)).view(np.int64), anchors)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchors), pa.array(hashes.view(np.int64)), pa.array(ids[rows]), pa.array(places),
                 pa.array(spare)], schema=_WINDOW_SCHEMA)
        arrays.give_back()
    return task


def _kept(raw: bytes, spans: pa.Array, row: int, width: int) -> tuple[bytes, int, int, int]:
    """(remaining words joined by a space, words, removed words, removed intervals) of one text."""
    starts, ends, _ = arrays.word_places(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]))
    begin, count = repeats.span_arrays(spans, row)
    gone = arrays.covered(begin, count + width - 1, len(starts))
    heads = int((gone[1:] & ~gone[:-1]).sum()) + int(gone[:1].sum())
    kept = b" ".join([raw[a:b] for a, b in zip(starts[~gone].tolist(), ends[~gone].tolist())])
    return kept, len(starts), int(gone.sum()), heads


def _cut(width: int):
    """Whole texts without the words in the given spans."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = arrays.flat(batch.column("text"))
            found = [_kept(data[offsets[row]:offsets[row + 1]].tobytes(), batch.column("spans"), row, width)
                     for row in range(batch.num_rows)]
            kept, words, gone, runs = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(runs, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "n_spans", "kept_text"])
        arrays.give_back()
    return task


def repeated_spans(texts: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, spans) of the documents that lose words; a span is (start, n) consecutive windows."""
    found = repeats.decided(repeats.runs(texts, _units, window, gram, by_place=False), by_place=False)
    singles = repeats.open_runs(texts, found).mapInArrow(
        _windows(window), "anchor long, window long, doc_id long, start long, spare boolean")
    same = Window.partitionBy("anchor", "window").orderBy("doc_id")
    repeated = (singles.withColumn("_first", F.first("doc_id").over(same))
                .where(F.col("spare") | (F.col("doc_id") > F.col("_first")))
                .select("doc_id", "start", F.lit(1).cast("long").alias("n")))
    return repeats.span_table(found, repeated)


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """`docs` with the repeated words out of `text`, and `n_chars` (where there is one) to match.

    Documents that lose nothing keep their text as it is, white space included; the others get
    `kept_text` of `substring_dedup`. A document that loses every word goes. Other columns, whatever
    their names, are left alone. Nulls, short texts and repeated ids are treated as there.
    """
    spans = repeated_spans(repeats.keyed(docs), window, gram)
    text = docs.schema.names.index("text")
    number = docs.schema.names.index("n_chars") if "n_chars" in docs.columns else None
    # Positional names, so that no column of the input can clash with these.
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    names = plain.columns
    key = names[docs.schema.names.index("doc_id")]
    joined = plain.join(spans.select(F.col("doc_id").alias("span_id"), "spans"), F.col(key).cast("long") == F.col("span_id"),
                        "left").drop("span_id")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, texts = batch.column("spans"), batch.column(f"c{text}")
            changed = {}
            for row in np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False)):
                changed[int(row)] = _kept(texts[int(row)].as_buffer().to_pybytes(), spans, int(row), window)[0].decode()
            keep = pa.array([changed.get(row) != "" for row in range(batch.num_rows)])
            columns = list(batch.columns[:-1])
            if changed:
                columns[text] = pa.array([changed.get(row, texts[row].as_py()) for row in range(batch.num_rows)], pa.string())
                if number is not None:
                    columns[number] = pa.array([len(changed[row]) if row in changed else columns[number][row].as_py()
                                                for row in range(batch.num_rows)], columns[number].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(keep)
    return joined.mapInArrow(task, plain.schema).toDF(*docs.columns)


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, n_spans, kept_text) for every row of `docs` (doc_id, text).

    Words are `[^\\x20\\x09-\\x0D]+`. A word goes when a window of `window` words that covers it also
    starts in a document with a smaller doc_id; windows are judged on the input. Repeats inside one
    document stay. `kept_text` has the remaining words joined by a space; `n_spans` counts the
    maximal removed intervals.

    Null or empty texts: no words, empty `kept_text`. Texts shorter than a window lose nothing. Rows
    with a null doc_id have no place in the order and are kept whole. Rows that repeat a doc_id lose
    nothing to each other, and each the spans found in any of them. No input rows: no output rows.
    """
    texts = repeats.keyed(docs)
    spans = repeated_spans(texts, window, gram)
    nameless = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is null").withColumn(
        "spans", F.lit(None).cast("array<struct<start:bigint,n:bigint>>"))
    return texts.join(spans, "doc_id", "left").unionByName(nameless).mapInArrow(
        _cut(window), "doc_id long, n_words long, n_removed long, n_spans long, kept_text string")
