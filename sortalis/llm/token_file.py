"""Token ids of a corpus as Arrow files whose rows are sequences of one length.

Method: the ids of all documents, in ascending doc_id order, form one stream.  Each task writes its
range of the stream as an Arrow stream-file (IPC file format) whose record batches hold two
fixed-size lists, ``ids`` and ``mask``; a second Arrow file indexes the documents in it.  A reader maps
the files; any sequence is a slice of the mapped values, with nothing copied or decoded.  The last
sequence of a file is filled with zeros that the mask marks.

Tasks are ranges of doc_id and then of the text's first characters, so that a doc_id which many rows share
is spread; rows that agree in both stay in one task, which streams them.

Defined cases: a null or empty text is the end id alone; rows without doc_id come first; rows that
share a doc_id follow one another in the order of their texts; an empty table gives no part and no
row; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortalis.llm.encoder import encoder
from sortalis.llm.textcols import slices
from sortalis.sources.shared import mappable, new_folder, write_file

SEQUENCE_LENGTH = 2048
ROWS = 256  # sequences in a record batch
TIE = 32  # characters of the text by which rows of one doc_id are dealt to tasks
PARTS_SCHEMA = "path string, first_doc_id long, n_docs long, n_ids long, n_sequences long, first_text string"
DOCS_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long, sequence long, sequence_offset int"


class _Writer:
    """Cuts a stream of ids into record batches of full sequences."""

    def __init__(self, out, dtype: np.dtype, length: int):
        self.length, self.dtype = length, np.dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.writer = pa.ipc.new_file(out, self.schema)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.total += len(ids)
        if self.n_waiting >= (step := self.length * ROWS):
            flat = np.concatenate(self.waiting)
            for at in range(0, len(flat) - step + 1, step):
                self._batch(flat[at : at + step], step)
            self.waiting = [flat[len(flat) // step * step :]]
            self.n_waiting = len(self.waiting[0])

    def _batch(self, flat: np.ndarray, valid: int) -> None:
        mask = pa.array(np.arange(len(flat)) < valid)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(flat), self.length), pa.FixedSizeListArray.from_arrays(mask, self.length)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.n_waiting:
            flat = np.concatenate(self.waiting)
            self._batch(np.append(flat, np.zeros(-len(flat) % self.length, self.dtype)), len(flat))
        self.writer.close()


class TokenFile:
    """Random access to a written part, over a memory map."""

    def __init__(self, uri: str):
        self.reader = pa.ipc.open_file(pa.memory_map(mappable(uri)))
        self.length = self.reader.schema.field("ids").type.list_size

    def _flat(self, batch: int) -> np.ndarray:
        return self.reader.get_batch(batch).column(0).values.to_numpy(zero_copy_only=True)

    def sequence(self, index: int) -> np.ndarray:
        """The ids of a sequence, a view of the mapped file."""
        return self._flat(index // ROWS)[index % ROWS * self.length : (index % ROWS + 1) * self.length]

    def mask(self, index: int) -> pa.BooleanArray:
        """Which ids of a sequence are of the stream; a view of the mapped file."""
        return self.reader.get_batch(index // ROWS).column(1)[index % ROWS].values

    def span(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop of the part's stream; a view if they lie in one record batch."""
        step = self.length * ROWS
        parts = [self._flat(b)[max(0, start - b * step) : stop - b * step] for b in range(start // step, max(start, stop - 1) // step + 1)] if stop > start else []
        return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint16), *parts])


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None, length: int = SEQUENCE_LENGTH, end_id: int = 2) -> list[tuple]:
    """Writes the files; returns (path, first_doc_id, n_docs, n_ids, n_sequences, first_text) of each part in stream order, one for each task."""
    folder = folder or new_folder(docs.sparkSession, "tokens")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, path = encoder(tokenizer_path), f"{folder}/part-{uuid.uuid4().hex}"
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        ids_of: list[int | None] = []
        sizes: list[int] = []
        head = first.column("text")[0].as_py()

        def write(out) -> None:
            writer, end, batch = _Writer(out, coder.dtype, length), np.array([end_id], coder.dtype), first
            while batch is not None:
                for part in slices(batch, "text"):
                    ids, at = coder.encode_column(part.column("text"))
                    writer.add(np.insert(ids, at[1:], end))
                    ids_of.extend(part.column("doc_id").to_pylist())
                    sizes.extend((np.diff(at) + 1).tolist())
                batch = next(batches, None)
            writer.close()

        write_file(f"{path}.arrow", write)
        index = pa.table({"doc_id": pa.array(ids_of, pa.int64()), "n_tokens": pa.array(sizes, pa.int64())})

        def write_index(out) -> None:
            with pa.ipc.new_file(out, index.schema) as writer:
                writer.write_table(index)

        write_file(f"{path}.index.arrow", write_index)
        yield pa.RecordBatch.from_pydict({"path": [path], "first_doc_id": pa.array(ids_of[:1], pa.int64()), "n_docs": [len(ids_of)], "n_ids": [sum(sizes)], "n_sequences": [-(-sum(sizes) // length)], "first_text": pa.array([head and head[:TIE]], pa.string())})

    ordered = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").repartitionByRange(F.col("doc_id").asc_nulls_first(), F.substring("text", 1, TIE).asc_nulls_first())
    parts = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(task, PARTS_SCHEMA).collect()
    return sorted((tuple(p) for p in parts), key=lambda p: (p[1] is not None, p[1] or 0, p[5] is not None, (p[5] or "").encode()))


def read_token_files(spark: SparkSession, parts: list[tuple]) -> DataFrame:
    """One row for each document, from the files alone; the base of a part is the sum of the parts before it."""
    bases = np.cumsum([0] + [p[3] for p in parts]).tolist()
    sequences = np.cumsum([0] + [p[4] for p in parts]).tolist()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                file = TokenFile(f"{part['path']}.arrow")
                index = pa.ipc.open_file(pa.memory_map(mappable(f"{part['path']}.index.arrow"))).read_all()
                sizes = index.column("n_tokens").to_numpy()
                ends = np.cumsum(sizes)
                starts = ends - sizes
                crcs = [zlib.crc32(file.span(a, b).astype("<u4").tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        index.column("doc_id").combine_chunks(),
                        pa.array(starts + part["base"]),
                        pa.array(sizes),
                        pa.array(crcs, pa.int64()),
                        pa.array(starts // file.length + part["sequences"]),
                        pa.array((starts % file.length).astype(np.int32)),
                    ],
                    names=[c.split()[0] for c in DOCS_SCHEMA.split(", ")],
                )

    rows = [(p[0], b, s) for p, b, s in zip(parts, bases, sequences, strict=False)]
    return spark.createDataFrame(rows, "path string, base long, sequences long").mapInArrow(task, DOCS_SCHEMA)
