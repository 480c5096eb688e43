"""Token-id output: whole texts as ids in range-coded segments, in ascending document order.

``encoded`` deals documents out by ranges of doc_id, encodes each range in order and cuts it into
segments of whole documents. A row of its result is one segment in the format of ``id_coder``: ids in
coded blocks, and in the same bytes, with a checksum, its documents (ids and lengths) and how many ids
its range has before it. Rows are written as a Parquet table in the shared folder: Spark commits it
task by task, so a lost executor costs only its own tasks. ``decoded`` reads segments back from their
bytes alone and checks lengths against end ids. A segment's place in the whole is the sum of the ids
of all ranges before its own, one number for each range.

Defined results: null and empty texts hold just the end id; rows with equal doc_id follow one
another by text; null doc_id comes first; a text of any length stays in one segment; extra columns
are ignored; an empty table gives no segments.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import slices, stored
from tidemark.llm.id_coder import BrokenBlock, decode_segment, encode_segment, own_bytes
from tidemark.llm.tokens import TEXT_BYTES, encoder, tokenizer_path

SEGMENT_IDS = 8_000_000
_SEGMENT = "part int, segment int, n_ids long, bytes binary"


def _packed(start: int, doc_ids: list, lengths: list[int]) -> bytes:
    """The documents of a segment: the ids before it, then doc_ids, whether they are given, and lengths."""
    columns = [[start, len(doc_ids)], [i or 0 for i in doc_ids], [int(i is not None) for i in doc_ids], lengths]
    return zlib.compress(np.array([x for c in columns for x in c], "<i8").tobytes(), 6)


def _unpacked(own: bytes) -> tuple[int, list, np.ndarray]:
    start, k, *_ = x = np.frombuffer(zlib.decompress(own), "<i8")
    ids, given, lengths = x[2 : 2 + k], x[2 + k : 2 + 2 * k], x[2 + 2 * k :]
    return int(start), [int(i) if g else None for i, g in zip(ids, given)], lengths


def encoded(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end: int = 2, spaced: bool = False, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Segments of about ``segment_ids`` ids of the texts of ``docs``; see the module's text."""
    path = tokenizer_path(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment, start = TaskContext.get().partitionId(), 0, 0
        doc_ids: list = []
        held: list[np.ndarray] = []
        lengths: list[int] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal segment, start, size
            ids = np.concatenate(held) if held else np.empty(0, np.uint32)
            row = {"part": [part], "segment": [segment], "n_ids": [len(ids)], "bytes": [encode_segment(ids, own=_packed(start, doc_ids, lengths))]}
            segment, start, size = segment + 1, start + len(ids), 0
            for x in (doc_ids, held, lengths):
                x.clear()
            return pa.RecordBatch.from_pydict(row, schema=_ARROW)

        for batch in slices(batches, "text", TEXT_BYTES):
            ids, begins = encoder(path, spaced).encode(batch.column("text"), end)
            doc_ids += batch.column("doc_id").to_pylist()
            lengths += np.diff(begins).tolist()
            held.append(ids)
            size += len(ids)
            if size >= segment_ids:
                yield flush()
        if doc_ids:
            yield flush()

    # about as many ranges as the shuffle has partitions; AQE joins neighbours that turn out small
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, _SEGMENT)


_ARROW = pa.schema(
    [("part", pa.int32()), ("segment", pa.int32()), ("n_ids", pa.int64()), ("bytes", pa.binary())]
)


def decoded(segments: DataFrame, end: int = 2) -> DataFrame:
    """doc_id, part, start (within the part), n_tokens and ids_crc32 of every document, from the
    segments' bytes alone; a broken segment, or a document without its end id, raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("bytes").to_pylist()):
                start, doc_ids, lengths = _unpacked(own_bytes(data))
                ids = decode_segment(data).astype("<u4")
                ends = np.cumsum(lengths)
                if len(ids) != (ends[-1] if len(ends) else 0) or (ids[ends - 1] != end).any():
                    raise BrokenBlock("documents do not end where the segment says")
                crcs = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends, lengths)]
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": doc_ids, "part": [part] * len(ends), "start": start + ends - lengths, "n_tokens": lengths, "ids_crc32": crcs},
                    schema=pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]),
                )

    return segments.select("part", "bytes").mapInArrow(run, "doc_id long, part int, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame) -> DataFrame:
    """Write the segments of ``docs``, read them back and place every document in the whole."""
    segments = stored(encoded(docs), "token-ids")
    # one row for each range: a small table, whatever the number of documents
    sums = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    placed = decoded(segments).join(F.broadcast(before), "part")
    return placed.select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
