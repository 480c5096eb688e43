"""A Katz back-off model of word n-grams with Good-Turing discounts, kept in partitioned tables.

A text's tokens are its words and an end; its history is padded with starts. With r the count of an
n-gram (h, w) in the training texts, c(h) the sum of r over w, and r* the discounted count,

    P(w | h) = r* / c(h)             if the n-gram occurs,
             = a(h) P(w | h')        if it does not and h occurs (h' is h without its oldest token),
             = P(w | h')             if h does not occur;
    P(w)     = c* / N                for known tokens; unknown ones share what the discounts leave.

a(h) is what the discounts leave in h over the mass that P(. | h') has outside h's followers: exact
sums, so each distribution adds up to one. Counts to ``MOST`` are discounted by Good-Turing, larger
ones by 1/2. ``order`` is the longest n-gram.

Tables. For each order a table of n-grams and their counts, and for orders above one a table of
histories with c(h) and a(h). Both are keyed by 64-bit hashes and split into ranges of them, parts of about
``PART_KEYS`` keys, whatever the tokens, so no part grows with a frequent word or history.

How it runs. Texts become chunks of token indices, a table that is bucketed by chunk, so that answers
come to where its chunks are read and chunks are never shuffled. A chunk sends the distinct keys it needs,
with their training counts, sorted and packed, to the parts they belong to; a part sums what it gets,
stores its table and answers each chunk with values in the order of the keys it sent. One of the
chunks that sent an n-gram is told to account for it when histories are summed. A chunk gets a(h) only
of histories that it has before an n-gram without a count; of others it needs no more than c(h). Messages
hold keys and values only, so they grow with the distinct n-grams of the chunks, never with documents
times parts. A chunk then evaluates each of its tokens recursively from the answers. A fitted model answers
for other texts in the same way from its stored tables (``KatzModel.scored``).

Defined results: null and empty texts hold just the end; rows that share a doc_id are scored each
(and learnt from each); the text of a null doc_id is "None" when texts are held out; without training
texts every probability is one; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import mix64, shared_folder, slices, stored, word_hashes

ORDER = 2
MOST = 5
CHUNK_TOKENS = 1_000_000
PART_KEYS = 1_000_000
_U = np.uint64
START, END = _U(0x5354415254), _U(0x454E44)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 7 == 2


def discounted(counts_of_counts: np.ndarray) -> np.ndarray:
    """c* for counts 0 to MOST (0 first), from how many things have each count 1 to MOST + 1.

    Katz's ratios; a count that has no usable ratio is discounted by 1/2, as are larger ones.
    """
    n = np.r_[0, counts_of_counts].astype(float)
    out = np.arange(MOST + 1) - 0.5
    out[0] = 0.0
    if n[1] > 0:
        top = (MOST + 1) * n[MOST + 1] / n[1]
        for r in range(1, MOST + 1):
            if n[r] > 0 and top < 1:
                x = r * (((r + 1) * n[r + 1] / n[r]) / r - top) / (1 - top)
                if 0 < x < r:
                    out[r] = x
    return out


def star(counts: np.ndarray, table: np.ndarray) -> np.ndarray:
    return np.where(counts > MOST, counts - 0.5, table[np.minimum(counts, MOST)])


_TYPES = ("<u8", "<i8", "<i4", "<f8", "|u1")


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays in planes of bytes, compressed; unsigned 64-bit ones, the sorted keys, by differences."""
    head, parts = [len(arrays)], []
    for a in arrays:
        kind = next(i for i, t in enumerate(_TYPES) if a.dtype == np.dtype(t))
        head += [len(a), kind]
        if kind == 0 and len(a):
            a = np.diff(a, prepend=_U(0))
        parts.append(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join([np.array(head, "<i8").tobytes(), *parts]))


def _unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    k = int(np.frombuffer(raw, "<i8", 1)[0])
    head = np.frombuffer(raw, "<i8", 2 * k, 8).reshape(k, 2)
    out, at = [], 8 + 16 * k
    for n, kind in head.tolist():
        t = np.dtype(_TYPES[kind])
        planes = np.frombuffer(raw, np.uint8, n * t.itemsize, at).reshape(t.itemsize, n)
        a = np.ascontiguousarray(planes.T).reshape(-1).view(t)
        out.append(np.cumsum(a, dtype=_U) if kind == 0 else a)
        at += n * t.itemsize
    return out


_ROWS = "kind string, place long, part long, data binary"
_SCHEMA = pa.schema([("kind", pa.string()), ("place", pa.int64()), ("part", pa.int64()), ("data", pa.binary())])


def _row(kind: str, place: int, part: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([place], pa.int64()), pa.array([part], pa.int64()), pa.array([data], pa.binary())], schema=_SCHEMA)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(batch.column(c)[i].as_py() for c in ("kind", "place", "part", "data"))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[str, int, bytes]]]]:
    """Rows sorted by place, as (place, its kinds, parts and data)."""
    now, held = None, []
    for kind, place, part, data in _rows(batches):
        if place != now and held:
            yield now, held
            held = []
        now = place
        held.append((kind, part, data))
    if held:
        yield now, held


def _by_place(rows: DataFrame) -> DataFrame:
    return rows.select("kind", "place", "part", "data").repartition("place").sortWithinPartitions("place", "kind", "part")


def chunked(docs: DataFrame) -> DataFrame:
    """The texts as rows of about ``CHUNK_TOKENS`` tokens: doc ids, lengths, distinct tokens, indices into them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        tokens: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        size, chunk = 0, TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            nonlocal size, chunk
            types, at, count = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
            # frequent ones first, so that most indices are small; in the order of hashes where about as frequent
            order = np.argsort(-np.frexp(count)[1], kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            types, at = types[order], place[at]
            given = np.array([i is not None for i in ids], np.uint8)
            row = _row("chunk", chunk, 0, _pack(np.array([i or 0 for i in ids], np.int64), given, np.concatenate(lengths).astype(np.int32), types, at.astype(np.int32)))
            for x in (ids, tokens, lengths):
                x.clear()
            size, chunk = 0, chunk + 1
            return row

        for batch in slices(batches, "text"):
            words, begins = word_hashes(batch.column("text"))
            tokens.append(np.insert(words, begins[1:], END))
            lengths.append(np.diff(begins) + 1)
            ids += batch.column("doc_id").to_pylist()
            size += len(tokens[-1])
            if size >= CHUNK_TOKENS:
                yield flush()
        if ids:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, _ROWS)


class _Chunk:
    """The tokens of a chunk and the keys of its n-grams and histories."""

    def __init__(self, data: bytes) -> None:
        ids, given, self.lengths, self.types, self.at = _unpack(data)
        self.ids = [int(i) if g else None for i, g in zip(ids, given)]
        self.held = np.array([held_out(i) for i in self.ids], bool)
        self.begins = np.r_[0, np.cumsum(self.lengths)].astype(np.int64)
        self.learnt = np.repeat(~self.held, self.lengths)

    def histories(self, order: int) -> np.ndarray:
        """The key of the ``order`` - 1 tokens before each token."""
        tokens = self.types[self.at]
        place = np.arange(len(tokens)) - np.repeat(self.begins[:-1], self.lengths)
        key = np.full(len(tokens), order, np.uint64)
        with np.errstate(over="ignore"):
            for back in range(order - 1, 0, -1):
                key = mix64(key * _U(3) + np.where(place >= back, np.roll(tokens, back), START))
        return key

    def grams(self, order: int) -> np.ndarray:
        """The key of each token's n-gram; the token itself for order 1."""
        tokens = self.types[self.at]
        if order == 1:
            return tokens
        with np.errstate(over="ignore"):
            return mix64(self.histories(order) * _U(5) + tokens)

    def keys(self, kind: str, order: int) -> np.ndarray:
        return self.grams(order) if kind == "gram" else self.histories(order)


def _dealt(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, where each part's begin, and each key's place among them.

    A part is a range of the hashes: in a message that has a part's keys alone, they lie closer than in all of the key space.
    """
    distinct, at = np.unique(keys, return_inverse=True)
    least = np.array([-(-(p << 64) // parts) for p in range(parts)], np.uint64)
    return distinct, np.r_[np.searchsorted(distinct, least), len(distinct)], at


def _sent(kind: str, chunk: int, keys: np.ndarray, cuts: np.ndarray, *values: np.ndarray) -> Iterator[pa.RecordBatch]:
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        s = slice(cuts[p], cuts[p + 1])
        yield _row(kind, p, chunk, _pack(keys[s], *[v[s] for v in values]))


def _summed(batches: Iterator[pa.RecordBatch], table, reply) -> Iterator[pa.RecordBatch]:
    """One part at a time: sums of each key's values over all chunks. ``table`` makes the stored rows
    from keys and sums, ``reply`` a chunk's answer from the sums at its keys, whether it is the first to have them, and the last of its own values."""
    for part, held in _grouped(batches):
        chunks = [c for _, c, _ in held]
        packs = [_unpack(d) for _, _, d in held]
        sizes = np.cumsum([len(p[0]) for p in packs])
        keys = np.concatenate([p[0] for p in packs])
        values = [np.concatenate(v) for v in list(zip(*packs))[1:]]
        own = values[-1]
        values = [v.astype(np.int64) if v.dtype.kind == "i" else v for v in values]
        del packs, held
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        new = np.r_[True, ordered[1:] != ordered[:-1]]
        begin = np.flatnonzero(new)
        sums = [np.add.reduceat(v[order], begin) for v in values]
        yield from table(part, ordered[begin], sums)
        at = np.empty(len(order), np.int64)
        at[order] = np.cumsum(new) - 1
        first = np.zeros(len(order), bool)
        first[order[begin]] = True
        for c, a, b in zip(chunks, [0, *sizes], sizes):
            yield _row("answer", c, part, _pack(*reply([s[at[a:b]] for s in sums], first[a:b], own[a:b])))


@dataclass
class KatzModel:
    """Where the tables are, how many parts they have, and the numbers that all evaluations share."""

    order: int
    parts: int
    total: int = 0
    known: int = 0
    stars: dict[int, np.ndarray] = field(default_factory=dict)
    unknown: float = 1.0
    tables: dict[tuple[str, int], DataFrame] = field(default_factory=dict)

    def probabilities(self, chunk: _Chunk, answers: dict[tuple[str, int], list[np.ndarray]], order: int) -> tuple[np.ndarray, np.ndarray]:
        """P of each token by n-grams up to ``order``, and each token's own count."""
        at = {key: _dealt(chunk.keys(*key), self.parts)[2] for key in answers}
        count = answers["gram", 1][0][at["gram", 1]].astype(np.int64)
        p = np.where(count > 0, star(count, self.stars[1]) / max(self.total, 1), self.unknown)
        for k in range(2, order + 1):
            r = answers["gram", k][0][at["gram", k]].astype(np.int64)
            c, a = (x[at["history", k]] for x in answers["history", k])
            p = np.where(r > 0, star(r, self.stars[k]) / np.maximum(c, 1), np.where(c > 0, a, 1.0) * p)
        return p, count

    def finished(self, chunks: DataFrame, answers: dict[tuple[str, int], DataFrame]) -> DataFrame:
        model, width = self._plain(), np.log10(self.total + self.known + 1)

        def run(_: int, chunk: _Chunk, got: dict[tuple[str, int], list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            p, count = model.probabilities(chunk, got, model.order)
            row = np.repeat(np.arange(len(chunk.ids)), chunk.lengths)
            add = lambda w: np.bincount(row, w, len(chunk.ids))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, f.type) for x, f in zip((chunk.ids, chunk.held, chunk.lengths.astype(np.int64), add(count > 0).astype(np.int64), np.full(len(chunk.ids), model.total), add(np.log10(count + 1.0) - width), add(np.log10(p))), _OUT)],
                schema=_OUT,
            )

        return _answered(chunks, answers, run, _OUT, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

    def scored(self, docs: DataFrame) -> DataFrame:
        """The scores of any texts, from the stored tables; columns as of the module's ``scored``."""
        chunks = _bucketed(chunked(docs), "katz-chunks")
        answers = {}
        for (kind, k), table in self.tables.items():
            parts = self.parts

            def ask(batches: Iterator[pa.RecordBatch], kind: str = kind, k: int = k) -> Iterator[pa.RecordBatch]:
                for _, chunk, _, data in _rows(batches):
                    keys, cuts, _ = _dealt(_Chunk(data).keys(kind, k), parts)
                    yield from _sent("z", chunk, keys, cuts)

            def tell(batches: Iterator[pa.RecordBatch], width: int = 1 if kind == "gram" else 2) -> Iterator[pa.RecordBatch]:
                now, keys, values = None, np.empty(0, _U), [np.zeros(0)] * width
                for kind, part, chunk, data in _rows(batches):
                    if part != now:
                        now, keys, values = part, np.empty(0, _U), [np.zeros(0)] * width
                    if kind == "table":
                        keys, *values = _unpack(data)
                        continue
                    (asked,) = _unpack(data)
                    at = np.minimum(np.searchsorted(keys, asked), max(0, len(keys) - 1))
                    there = keys[at] == asked if len(keys) else np.zeros(len(asked), bool)
                    yield _row("answer", chunk, part, _pack(*[np.where(there, v[at] if len(keys) else 0, 0).astype(np.float64) for v in values]))

            asks = chunks.mapInArrow(ask, _ROWS)
            answers[kind, k] = stored(_by_place(table.unionByName(asks)).mapInArrow(tell, _ROWS), f"katz-{kind}-{k}-told")
        return self.finished(chunks, answers)

    def _plain(self) -> "KatzModel":
        """Without tables, for tasks."""
        return KatzModel(self.order, self.parts, self.total, self.known, self.stars, self.unknown)


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _bucketed(rows: DataFrame, label: str) -> DataFrame:
    """Stored like ``stored``, as a table bucketed by place: rows that meet its rows by place come to them."""
    spark = rows.sparkSession
    path = shared_folder(spark, label)
    name = path.rpartition("/")[2].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.bucketBy(buckets, "place").option("path", path).saveAsTable(name, format="parquet")
    return spark.table(name)


def _named(answers: dict[tuple[str, int], DataFrame]) -> DataFrame:
    """All answers, of kinds "gram 1", "history 2" and so on."""
    kinds = [rows.select(F.lit(f"{kind} {k}").alias("kind"), "place", "part", "data") for (kind, k), rows in answers.items()]
    return reduce(DataFrame.unionByName, kinds)


def _together(chunks: DataFrame, answers: dict[tuple[str, int], DataFrame]) -> DataFrame:
    """Chunks and their answers as rows of one table."""
    return chunks.unionByName(_named(answers))


def _answered(chunks: DataFrame, answers: dict[tuple[str, int], DataFrame], run, arrow: pa.Schema, schema: str) -> DataFrame:
    """The rows that ``run`` makes of each chunk's place, the chunk and its answers; only answers move."""

    def beside(chunk: pa.Table, told: pa.Table) -> pa.Table:
        held = sorted((kind, part, data) for t in (chunk, told) for kind, part, data in zip(*(t.column(c).to_pylist() for c in ("kind", "part", "data"))))
        return pa.Table.from_batches(list(run(chunk.column("place")[0].as_py(), *_opened(held))), schema=arrow)

    return chunks.groupBy("place").cogroup(_named(answers).groupBy("place")).applyInArrow(beside, schema)


def _opened(held: list[tuple[str, int, bytes]]) -> tuple[_Chunk, dict[tuple[str, int], list[np.ndarray]]]:
    """A chunk and, by kind and order, the values of its keys in the order of ``_dealt``."""
    got: dict[tuple[str, int], list] = {}
    chunk = _Chunk(next(d for kind, _, d in held if kind == "chunk"))
    for kind, _, d in held:  # sorted by part
        if kind != "chunk":
            name, k = kind.split()
            got.setdefault((name, int(k)), []).append(_unpack(d))
    return chunk, {key: [np.concatenate(x) for x in zip(*packs)] for key, packs in got.items()}


def _written(rows: DataFrame, label: str) -> DataFrame:
    """Stored by kind: tables, answers and counts each in a folder of their own."""
    path = shared_folder(rows.sparkSession, label)
    rows.write.partitionBy("kind").parquet(path)
    return rows.sparkSession.read.schema("place long, part long, data binary, kind string").parquet(path)


def _counted(chunks: DataFrame, k: int, parts: int) -> DataFrame:
    """The n-gram table of order ``k``, the answers to all chunks, and how many n-grams have each small count."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, place, _, data in _rows(batches):
            chunk = _Chunk(data)
            keys, cuts, at = _dealt(chunk.grams(k), parts)
            yield from _sent("keys", place, keys, cuts, np.bincount(at, chunk.learnt, len(keys)).astype(np.int32))

    def table(part: int, keys: np.ndarray, sums: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        r = sums[0]
        yield _row("table", part, 0, _pack(keys[r > 0], r[r > 0]))
        counts = np.bincount(np.minimum(r, MOST + 2), minlength=MOST + 3)[1:]
        for i, n in enumerate([*counts, r.sum()]):
            yield _row("counts", i, int(n), b"")

    def reply(sums: list[np.ndarray], first: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, ...]:
        return sums[0], first.astype(np.uint8)

    return _written(_by_place(chunks.mapInArrow(send, _ROWS)).mapInArrow(lambda b: _summed(b, table, reply), _ROWS), f"katz-grams-{k}")


def _histories(chunks: DataFrame, answers: dict[tuple[str, int], DataFrame], model: KatzModel, k: int) -> DataFrame:
    """The history table of order ``k`` and the answers to all chunks."""
    plain = model._plain()

    def send(place: int, chunk: _Chunk, got: dict[tuple[str, int], list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        r, first = got.pop(("gram", k))
        lower = plain.probabilities(chunk, got, k - 1)[0]
        grams, _, gram = _dealt(chunk.grams(k), plain.parts)
        keys, cuts, at = _dealt(chunk.histories(k), plain.parts)
        where = np.empty(len(grams), np.int64)
        where[gram] = np.arange(len(gram))  # a token that ends each n-gram
        asks = np.bincount(at, r[gram] == 0, len(keys)) > 0
        mine = np.flatnonzero((first > 0) & (r > 0))
        r, token = r[mine].astype(np.int64), where[mine]
        add = lambda w: np.bincount(at[token], w, len(keys))
        yield from _sent("keys", place, keys, cuts, add(r).astype(np.int64), add(star(r, plain.stars[k])), add(lower[token]), asks.astype(np.uint8))

    def table(part: int, keys: np.ndarray, sums: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        count, mass, lower, _ = sums
        weight = np.where(count > 0, (1 - mass / np.maximum(count, 1)) / np.maximum(1 - lower, 1e-300), 1.0)
        sums[:] = [count, weight]
        yield _row("table", part, 0, _pack(keys[count > 0], count[count > 0], weight[count > 0]))

    def reply(sums: list[np.ndarray], first: np.ndarray, asks: np.ndarray) -> tuple[np.ndarray, ...]:
        return sums[0], np.where(asks > 0, sums[1], 0.0)

    rows = _answered(chunks, answers, send, _SCHEMA, _ROWS)
    return _written(_by_place(rows).mapInArrow(lambda b: _summed(b, table, reply), _ROWS), f"katz-histories-{k}")


def _kind(rows: DataFrame, kind: str) -> DataFrame:
    return rows.where(F.col("kind") == kind).select("kind", "place", "part", "data")


def _fitted(docs: DataFrame, order: int) -> tuple[KatzModel, DataFrame, dict[tuple[str, int], DataFrame]]:
    """The model, the chunks of ``docs``, and what the tables answer to them."""
    chunks = _bucketed(chunked(docs), "katz-chunks")
    tokens = chunks.select(F.sum(F.octet_length("data"))).first()[0] or 0  # an n-gram in some two bytes of a chunk
    model = KatzModel(order, max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), tokens // (2 * PART_KEYS)))
    answers: dict[tuple[str, int], DataFrame] = {}
    for k in range(1, order + 1):
        rows = _counted(chunks, k, model.parts)
        counts = np.zeros(MOST + 3, np.int64)
        for r in _kind(rows, "counts").groupBy("place").agg(F.sum("part").alias("n")).collect():
            counts[r["place"]] = r["n"]
        model.stars[k] = discounted(counts[: MOST + 1])
        if k == 1:
            model.total, model.known = int(counts[-1]), int(counts[:-1].sum())
            small = np.arange(1, MOST + 1)
            rest = (counts[:MOST] * (small - model.stars[1][1:])).sum() + 0.5 * counts[MOST:-1].sum()
            model.unknown = rest / model.total if model.total else 1.0
        model.tables["gram", k], answers["gram", k] = _kind(rows, "table"), _kind(rows, "answer")
        if k > 1:
            rows = _histories(chunks, answers, model, k)
            model.tables["history", k], answers["history", k] = _kind(rows, "table"), _kind(rows, "answer")
    return model, chunks, answers


def fitted(docs: DataFrame, order: int = ORDER) -> KatzModel:
    """A model learnt from the rows of ``docs`` that are not held out."""
    return _fitted(docs, order)[0]


def scored(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``.

    The parts that make the tables also answer for the texts, which saves asking twice.
    """
    model, chunks, answers = _fitted(docs, order)
    return model.finished(chunks, answers)
