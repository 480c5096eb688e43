"""Lexical retrieval packing: windows filled with documents that share rare terms with a seed.

1. Texts become token ids once, stored as a table with a locality key (a min-hash of id pairs).
2. Document frequencies of all ids over all documents: a table bounded by the vocabulary.
3. Rows are dealt out by ranges of (lead, key, doc_id). The lead is the id with the largest BM25
   weight in the document among those that another document has too, so documents of a subject come
   together, and copies and near copies next to each other, whatever the size of their group. Each
   range is cut into shards of bounded size. A shard has an inverted index with BM25 weights. A seed
   document opens a window and asks the index with all its terms; its unused neighbours, best first,
   fill the window greedily; when none fits whole, the best one is cut and opens the next window.
4. What is left at the end of a shard goes on into the next; at the end of a range the last window
   is cut at powers of two, which need no padding.

With an ``order`` (doc_id, position), ranges, shards and seeds follow it instead of the lead and key: a
shard is a stretch of that order, so sequence ids keep the shares of a mixture from shard to shard, and
neighbours come from the seed's own stretch. Documents without a position come first.

Defined results: null and empty texts hold just the end id; every id of every row is in exactly one
piece; rows with equal doc_id are packed like others; extra columns are ignored; an empty table
gives no pieces. Memory in a task is bounded by a shard and the longest document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import mix64, slices, stored
from tidemark.llm.tokens import TEXT_BYTES, encoder, tokenizer_path

WINDOW = 2048
SHARD_IDS = 3_000_000
SHARD_DOCS = 4096
#: Ids are kept in 16 bits.
MOST_IDS = 1 << 16
K1, B = 1.2, 0.75
_U = np.uint64

_TOKENS = "doc_id long, key long, n long, ids binary"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PIECES_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in _PIECES.split(", ")])


def tokenized(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end: int = 1, spaced: bool = True) -> DataFrame:
    """doc_id, locality key, number of ids and ids (little-endian 16-bit) of each document."""
    path = tokenizer_path(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", TEXT_BYTES):
            ids, begins = encoder(path, spaced).encode(batch.column("text"), end)
            with np.errstate(over="ignore"):
                pair = mix64(ids.astype(np.uint64) * _U(1 << 20) + np.r_[ids[1:], 0].astype(np.uint64))
            key = np.minimum.reduceat(pair, begins[:-1]) >> _U(1)
            if len(ids) and ids.max() >= MOST_IDS:
                raise ValueError(f"{tokenizer} has ids beyond {MOST_IDS}")
            raw = ids.astype("<u2")
            columns = {"doc_id": batch.column("doc_id"), "key": key.astype(np.int64), "n": np.diff(begins), "ids": [raw[a:b].tobytes() for a, b in zip(begins, begins[1:])]}
            fields = [("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())]
            yield pa.RecordBatch.from_pydict(columns, schema=pa.schema(fields))

    return docs.select("doc_id", "text").mapInArrow(run, _TOKENS)


def document_frequencies(tokens: DataFrame) -> dict[int, int]:
    """In how many documents each id occurs; as many entries as the vocabulary has ids at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(MOST_IDS, np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                total[np.unique(np.frombuffer(ids.as_buffer(), "<u2"))] += 1
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": seen.astype(np.int32), "df": total[seen]}, schema=pa.schema([("id", pa.int32()), ("df", pa.int64())]))

    table = tokens.select("ids").mapInArrow(run, "id int, df long").groupBy("id").agg(F.sum("df").alias("df"))
    return {r["id"]: r["df"] for r in table.collect()}


def _weights(docs: list[np.ndarray], idf: np.ndarray, mean: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ids of each document, by document: its place, the id, the id's BM25 weight in it."""
    size = np.array([len(d) for d in docs], np.int64)
    wide = np.uint32 if len(docs) <= MOST_IDS else np.uint64
    key, tf = np.unique(np.repeat(np.arange(len(docs), dtype=wide) * wide(MOST_IDS), size) + np.concatenate(docs).astype(wide), return_counts=True)
    owner, t = (key // wide(MOST_IDS)).astype(np.int32), (key % wide(MOST_IDS)).astype(np.uint16)
    return owner, t, idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[owner] / mean))


class _Shard:
    """The inverted index of one shard: postings sorted by term, with BM25 weights."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        owner, terms, weight = _weights(docs, idf, mean)
        self.query = np.split(terms, np.searchsorted(owner, np.arange(1, len(docs))))
        order = np.argsort(terms, kind="stable")
        self.owner, self.weight = owner[order].astype(np.intp), weight[order]
        self.size = np.array([len(d) for d in docs], np.int64)
        self.begin = np.searchsorted(terms[order], np.arange(MOST_IDS + 1))
        self.free = np.ones(len(docs), bool)

    def neighbours(self, seed: int) -> np.ndarray:
        """Unused documents that share a term with the seed, best first."""
        spans = [slice(self.begin[t], self.begin[t + 1]) for t in self.query[seed]]
        if not spans:
            return np.empty(0, np.int64)
        score = np.bincount(np.concatenate([self.owner[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), len(self.free))
        found = np.flatnonzero((score > 0) & self.free)
        return found[np.argsort(-score[found], kind="stable")]


class _Packer:
    """Fills windows; one for each range of documents."""

    def __init__(self, first_sequence: int, window: int) -> None:
        self.window, self.sequence, self.room = window, first_sequence, window
        self.open: list[tuple] = []  # the pieces of the window that is being filled: doc_id, ids, start, end
        self.rows: list[tuple] = []

    def put(self, doc_id, ids: np.ndarray, start: int = 0) -> int:
        """Place as much of a document as the window has room for; where the rest begins."""
        end = min(len(ids), start + self.room)
        self.open.append((doc_id, ids, start, end))
        self.room -= end - start
        if not self.room:
            self.close(self.open)
            self.open, self.room = [], self.window
        return end

    def close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, ids, a, b in pieces:
            self.rows.append((doc_id, a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes()), len(ids), self.sequence, at))
            at += b - a
        self.sequence += 1

    def shard(self, doc_ids: list, docs: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        index = _Shard(docs, idf, mean)
        for seed in range(len(docs)):
            if not index.free[seed]:
                continue
            index.free[seed] = False
            self.fill(index, doc_ids, docs, seed)

    def fill(self, index: _Shard, doc_ids: list, docs: list[np.ndarray], seed: int) -> None:
        at = self.put(doc_ids[seed], docs[seed])
        while at < len(docs[seed]):
            at = self.put(doc_ids[seed], docs[seed], at)
        if self.room == self.window:
            return
        cut, found, at = -1, index.neighbours(seed), 0
        size = index.size[found]
        while at < len(found):
            fits = np.flatnonzero(size[at:] <= self.room)
            if cut < 0 and not (len(fits) and fits[0] == 0):
                cut = found[at]
            if not len(fits):
                break
            at += int(fits[0]) + 1
            d = found[at - 1]
            index.free[d] = False
            self.put(doc_ids[d], docs[d])
            if self.room == self.window:
                return
        if cut >= 0:  # the best one that does not fit is cut here and seeds the next window
            index.free[cut] = False
            at = self.put(doc_ids[cut], docs[cut])
            while at < len(docs[cut]):
                at = self.put(doc_ids[cut], docs[cut], at)

    def finish(self) -> None:
        """Cut the last window at powers of two."""
        stream, left = list(self.open), self.window - self.room
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            pieces = []
            while size:
                doc_id, ids, a, b = stream.pop(0)
                n = min(size, b - a)
                pieces.append((doc_id, ids, a, a + n))
                size -= n
                if a + n < b:
                    stream.insert(0, (doc_id, ids, a + n, b))
            self.close(pieces)
        self.open, self.room = [], self.window

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=_PIECES_ARROW)


def packed(docs: DataFrame, window: int = WINDOW, order: DataFrame | None = None) -> DataFrame:
    """The pieces of all sequences over all rows of ``docs``; with an ``order`` (doc_id, position) in that order."""
    tokens = stored(tokenized(docs), "packing-ids")
    df = document_frequencies(tokens)
    stats = tokens.agg(F.count("*").alias("docs"), F.sum("n").alias("ids")).first()
    count, mean = stats["docs"], max(1.0, (stats["ids"] or 0) / max(1, stats["docs"]))
    idf = np.zeros(MOST_IDS, np.float32)
    for i, n in df.items():
        idf[i] = np.log(1 + (count - n + 0.5) / (n + 0.5))
    shard_ids, shard_docs = SHARD_IDS, SHARD_DOCS
    shared = np.array([df.get(i, 0) > 1 for i in range(MOST_IDS)])

    def led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            leads = np.full(batch.num_rows, -1, np.int32)
            owner, t, w = _weights([np.frombuffer(raw.as_buffer(), "<u2") for raw in batch.column("ids")], idf, mean)
            known = shared[t]
            owner, t, w = owner[known], t[known], w[known]
            if len(t):
                begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                best = np.flatnonzero(w == np.repeat(np.maximum.reduceat(w, begin), np.diff(np.r_[begin, len(w)])))
                first = best[np.r_[True, owner[best][1:] != owner[best][:-1]]]
                leads[owner[first]] = t[first]
            yield batch.append_column("lead", pa.array(leads, pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(TaskContext.get().partitionId() << 40, window)
        doc_ids: list = []
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                doc_ids.append(doc_id)
                held.append(np.frombuffer(ids.as_py(), "<u2"))
                size += len(held[-1])
                if size >= shard_ids or len(held) >= shard_docs:
                    packer.shard(doc_ids, held, idf, mean)
                    doc_ids, held, size = [], [], 0
                    if packer.rows:
                        yield packer.batch()
        if held:
            packer.shard(doc_ids, held, idf, mean)
        packer.finish()
        if packer.rows:
            yield packer.batch()

    if order is not None:
        first = order.groupBy(F.col("doc_id").alias("of")).agg(F.min("position").alias("position"))
        placed = tokens.select("doc_id", "ids").join(first, F.col("doc_id").eqNullSafe(F.col("of")), "left")
        dealt = placed.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id", "ids")
    else:
        rows = tokens.select("doc_id", "key", "ids").mapInArrow(led, "doc_id long, key long, ids binary, lead int")
        dealt = rows.repartitionByRange("lead", "key", "doc_id").sortWithinPartitions("lead", "key", "doc_id", "ids")
    return dealt.select("doc_id", "ids").mapInArrow(run, _PIECES)
