"""Token ids as Arrow IPC files of equal-length sequences.

The ids of all documents, in ascending doc_id order, form one stream. A range of documents becomes one
file: record batches with the columns `ids` and `mask`, both fixed-size lists of `length` values, the
last sequence padded and masked. All batches but the last hold the same number of sequences, so the
place of any sequence follows from its number, and a memory-mapped file gives it without a copy. A
second Arrow file beside it lists the documents (doc_id, start in the file, n_tokens).
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tasteloom.llm import arrays
from tasteloom.llm.tokens import encoder
from tasteloom.session import write_once

LENGTH = 2048  # ids of a sequence
SEQUENCES = 128  # of a record batch
ROWS = 256  # texts encoded at a time

_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
_MANIFEST = pa.schema([("part", pa.int64()), ("ids_path", pa.string()), ("docs_path", pa.string()),
                       ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
_MANIFEST_DDL = "part long, ids_path string, docs_path string, n_docs long, n_tokens long"


def _schema(kind: np.dtype, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])


class _Writer:
    """Appends ids to one file of sequences."""

    def __init__(self, sink, kind: np.dtype, length: int, sequences: int):
        self.schema, self.length, self.size = _schema(kind, length), length, length * sequences
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.kind, self.open, self.total = kind, b"", 0

    def append(self, ids: bytes) -> None:
        self.total += len(ids) // self.kind.itemsize
        self.open += ids
        step = self.size * self.kind.itemsize
        whole = len(self.open) // step * step
        for at in range(0, whole, step):
            self._write(np.frombuffer(self.open, self.kind, self.size, at), self.size)
        self.open = self.open[whole:]

    def _write(self, ids: np.ndarray, real: int) -> None:
        padded = np.zeros(-(-len(ids) // self.length) * self.length, dtype=self.kind)
        padded[:len(ids)] = ids
        mask = np.arange(len(padded)) < real
        self.writer.write_batch(pa.RecordBatch.from_arrays(
            [pa.FixedSizeListArray.from_arrays(pa.array(padded), self.length),
             pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))

    def close(self) -> None:
        if self.open:
            ids = np.frombuffer(self.open, self.kind)
            self._write(ids, len(ids))
        self.writer.close()


class TokenFile:
    """Random access to the ids of one file; local files are memory-mapped."""

    def __init__(self, path: str):
        store, place = pyarrow.fs.FileSystem.from_uri(path)
        local = isinstance(store, pyarrow.fs.LocalFileSystem)
        self.reader = pa.ipc.open_file(pa.memory_map(place) if local else store.open_input_file(place))
        self.length = self.reader.schema.field("ids").type.list_size
        self.batch = (-1, None, None)
        self.rows = self._load(0)[0].shape[0] // self.length if self.reader.num_record_batches else 0

    def _load(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        if self.batch[0] != number:
            batch = self.reader.get_batch(number)
            self.batch = (number, batch.column("ids").flatten().to_numpy(),
                          batch.column("mask").flatten().to_numpy(zero_copy_only=False))
        return self.batch[1], self.batch[2]

    def sequence(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of one sequence of the file."""
        ids, mask = self._load(number // self.rows)
        at = number % self.rows * self.length
        return ids[at:at + self.length], mask[at:at + self.length]

    def span(self, start: int, count: int) -> np.ndarray:
        """`count` ids of the stream from `start` on; masked places would be an error."""
        parts, size = [], self.rows * self.length
        while count:
            ids, mask = self._load(start // size)
            at = start % size
            part = ids[at:at + count]
            if not mask[at:at + len(part)].all():
                raise ValueError("a document reaches into the padding")
            parts.append(part)
            start, count = start + len(part), count - len(part)
        return np.concatenate(parts) if len(parts) != 1 else parts[0]


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, length: int = LENGTH,
                      sequences: int = SEQUENCES) -> DataFrame:
    """Write the ids of `docs` (doc_id, text) below `folder`, which all executors share, and return the
    manifest (part, ids_path, docs_path, n_docs, n_tokens, start): one row per file, in stream order.

    Ids come from the tokenizer file, an end id follows each document. Null and empty texts have the
    end id alone. Null ids come first; documents with the same id follow each other in the order of
    their texts. An empty table has an empty manifest. Other columns are not looked at.

    A repeated or speculative task writes files of its own; only those of the attempts that the
    manifest lists count. `folder` may be any location that pyarrow opens (local or shared mounts,
    hdfs, s3, gs).
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, kind = encoder(tokenizer)
        part = TaskContext.get().partitionId()
        writer = index = None
        # A few texts at a time: their words are Python strings for a moment.
        for batch in (b.slice(low, ROWS) for b in batches for low in range(0, b.num_rows, ROWS)):
            if writer is None:
                store, place = pyarrow.fs.FileSystem.from_uri(folder)
                store.create_dir(place, recursive=True)
                name = f"part-{part:06d}-{uuid.uuid4().hex}"
                sinks = [store.open_output_stream(f"{place}/{name}.{end}.arrow") for end in ("ids", "docs")]
                writer, index = _Writer(sinks[0], kind, length, sequences), pa.ipc.new_file(sinks[1], _DOCS)
                count = 0
            ids = encode(batch.column("text").to_pylist())
            sizes = np.array([len(i) // kind.itemsize for i in ids])
            index.write_batch(pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(writer.total + np.cumsum(sizes) - sizes), pa.array(sizes)], schema=_DOCS))
            writer.append(b"".join(ids))
            count += batch.num_rows
        if writer is not None:
            writer.close()
            index.close()
            for sink in sinks:
                sink.close()
            arrays.give_back()
            yield pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([f"{folder}/{name}.ids.arrow"]), pa.array([f"{folder}/{name}.docs.arrow"]),
                 pa.array([count]), pa.array([writer.total])], schema=_MANIFEST)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    written = write_once(rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
                         .mapInArrow(task, _MANIFEST_DDL), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return written.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def read_token_files(manifest: DataFrame, checksums: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files; `start` counts all ids before.
    With `checksums`, `ids_crc32` of the ids as 32-bit integers comes in place of the ids themselves."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file = TokenFile(row["ids_path"])
                store, place = pyarrow.fs.FileSystem.from_uri(row["docs_path"])
                index = pa.ipc.open_file(store.open_input_file(place))
                for number in range(index.num_record_batches):
                    part = index.get_batch(number)
                    starts, sizes = part.column("start").to_numpy(), part.column("n_tokens").to_numpy()
                    ids = (file.span(int(s), int(n)).astype("<u4") for s, n in zip(starts, sizes))
                    last = (pa.array([zlib.crc32(i) for i in ids], pa.int64()) if checksums
                            else pa.array([i.tobytes() for i in ids], pa.binary()))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), pa.array(starts + row["start"]), pa.array(sizes), last], names=names)
        arrays.give_back()
    names = ["doc_id", "start", "n_tokens", "ids_crc32" if checksums else "ids"]
    # A task per file; the manifest itself is tiny.
    files = max(1, manifest.count())
    return manifest.repartition(files, "part").mapInArrow(
        task, f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if checksums else 'ids binary'}")
