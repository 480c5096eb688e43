"""Helpers shared by the corpus operators: shared folders, Arrow slices, hashed words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: ASCII white space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_BYTES = b" \t\n\x0b\x0c\r"
#: The same as a Java regular expression class body.
SPACE_CLASS = r" \t\n\x0B\f\r"

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which every executor can reach.

    Only where that setting is absent and the session runs in one process, as in tests, a temporary
    folder is taken; on a cluster its absence is an error, for executors would not see each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back: a cut of the lineage
    that survives the loss of any executor."""
    spark = df.sparkSession
    path = shared_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``max_bytes`` in each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on an array of unsigned 64-bit integers."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x = x * _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_BYTES)] = True


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            inverse = pow(_BASE, -1, 1 << 64)
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.r_[_U(1), np.full(n - 1, _BASE, np.uint64)], dtype=np.uint64)
                self.down = np.cumprod(np.r_[_U(1), np.full(n - 1, inverse, np.uint64)], dtype=np.uint64)
        return self.up, self.down


_POWERS = _Powers()
_SEGMENT = 1 << 20


def _segment_words(raw: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word starts and hashes of one piece of bytes; ``bound`` marks where documents begin."""
    word = ~_IS_SPACE[raw]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | bound[1:]
    last[:-1] &= ~word[1:] | bound[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _POWERS.get(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
    value = (total[ends] - total[starts]) * down[starts]
    return starts, mix64(value + (ends - starts).astype(np.uint64) * _U(_BASE))


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and the index at which each text's words begin.

    Words are runs of bytes other than ASCII white space; A-Z are lower-cased on demand. Null counts
    as empty. The second array has one entry more than there are texts.
    """
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not len(texts):
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    if lower:
        raw = _LOWER[raw]
    bound = np.zeros(len(raw) + 1, bool)
    bound[offsets] = True
    starts, hashes, at = [], [], 0
    with np.errstate(over="ignore"):
        while at < len(raw):
            end = min(len(raw), at + _SEGMENT)
            while end < len(raw):  # cut where a word cannot go on
                gap = np.flatnonzero(_IS_SPACE[raw[end : end + 65536]] | bound[end : end + 65536][: len(raw[end : end + 65536])])
                if len(gap):
                    end += int(gap[0])
                    break
                end = min(len(raw), end + 65536)
            s, h = _segment_words(raw[at:end], bound[at:end])
            starts.append(s + at)
            hashes.append(h)
            at = end
    if not starts:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets, "left").astype(np.int64)


def shingle_hashes(words: np.ndarray, begins: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``k``-word shingles of each text, in order, and where each text's begin.

    A text with fewer than ``k`` words, but one at least, has its whole sequence as its one shingle.
    """
    count = np.diff(begins)
    n = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    out_begins = np.r_[0, np.cumsum(n)].astype(np.int64)
    out = np.empty(out_begins[-1], np.uint64)
    with np.errstate(over="ignore"):
        factor = mix64(np.arange(1, k + 1, dtype=np.uint64) * _U(_BASE)) | _U(1)
        long = np.flatnonzero(count >= k)
        if len(long):
            at = np.repeat(begins[long] - np.r_[0, np.cumsum(n[long])[:-1]], n[long]) + np.arange(n[long].sum())
            to = np.repeat(out_begins[long] - np.r_[0, np.cumsum(n[long])[:-1]], n[long]) + np.arange(n[long].sum())
            total = np.zeros(len(at), np.uint64)
            for j in range(k):
                total += words[at + j] * factor[j]
            out[to] = mix64(total + _U(k))
        for m in range(1, k):
            short = np.flatnonzero(count == m)
            if len(short):
                total = np.zeros(len(short), np.uint64)
                for j in range(m):
                    total += words[begins[short] + j] * factor[j]
                out[out_begins[short]] = mix64(total + _U(m))
    return out, out_begins
