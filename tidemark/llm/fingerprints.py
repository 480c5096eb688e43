"""Bottom-k sketches of word-shingle hashes.

A sketch holds the ``k`` smallest distinct hashes of a text's five-word shingles (all of them, if
there are fewer). Sketches of parts merge into that of the whole; they estimate resemblance,
containment and the number of distinct shingles. ``edited_likeness`` compares each document with an
edited version of itself and with its successor in doc_id order.

Defined results: null text is empty, and an empty sketch is alike to another empty one (1.0) and to
nothing else (0.0); a text of fewer than five words has its whole sequence as its one shingle;
equal texts have equal sketches; rows with equal doc_id follow one another by text; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import shingle_hashes, slices, word_hashes

K = 256
SHINGLE = 5


def sketch(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The ``k`` smallest distinct values, in order."""
    if len(hashes) > 8 * k:  # most values are out of reach: sort the small ones only, if they suffice
        bound = np.partition(hashes, 4 * k)[4 * k]
        low = np.unique(hashes[hashes <= bound])
        if len(low) >= k:
            return low[:k]
    return np.unique(hashes)[:k]


def merged(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; exact when both sets have fewer than ``k`` members together."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merged(a, b, k)
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum() / len(union))


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the first set's members that the second has."""
    if not len(a):
        return 1.0
    r = resemblance(a, b, k)
    return min(1.0, r * distinct(merged(a, b, k), k) / max(1.0, distinct(a, k)))


def to_text(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), "<u8")


def sketches(texts: pa.Array, k: int = K) -> list[np.ndarray]:
    """The sketch of each text."""
    words, begins = word_hashes(texts)
    h, at = shingle_hashes(words, begins, SHINGLE)
    return [sketch(h[a:b], k) for a, b in zip(at, at[1:])]


def merged_by(docs: DataFrame, key: str, k: int = K) -> DataFrame:
    """One sketch for each value of ``key`` over all its texts: key, fingerprint, n_distinct.

    Texts are sketched and merged within each task first, so a hot key moves one sketch a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in slices(batches, "text"):
            for name, s in zip(batch.column(key).to_pylist(), sketches(batch.column("text"), k)):
                held[name] = merged(held[name], s, k) if name in held else s
            if len(held) > 50_000:
                yield from out(held)
                held = {}
        yield from out(held)

    def out(held: dict) -> Iterator[pa.RecordBatch]:
        if held:
            rows = [(name, h.astype(np.uint64).view(np.int64).tolist()) for name, h in held.items()]
            yield pa.RecordBatch.from_pydict({key: [r[0] for r in rows], "h": [r[1] for r in rows]}, schema=pa.schema([(key, kind), ("h", pa.list_(pa.int64()))]))

    from pyspark.sql.pandas.types import to_arrow_type

    field = docs.schema[key]
    kind = to_arrow_type(field.dataType)
    parts = docs.select(key, "text").mapInArrow(run, f"`{key}` {field.dataType.simpleString()}, h array<bigint>")
    # the sign bit is turned so that signed order is that of the hashes
    values = parts.select(key, F.explode_outer("h").alias("h")).select(key, F.col("h").bitwiseXOR(F.lit(-(1 << 63))).alias("h")).distinct()
    low = values.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.col("h").asc_nulls_last()))).where(F.col("r") <= k)
    whole = low.groupBy(key).agg(F.sort_array(F.collect_list("h")).alias("h"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [(np.array(h, np.int64).view(np.uint64) ^ np.uint64(1 << 63)) for h in batch.column("h").to_pylist()]
            yield pa.RecordBatch.from_pydict({key: batch.column(key), "fingerprint": [to_text(x) for x in s], "n_distinct": [distinct(x, k) for x in s]}, schema=pa.schema([(key, kind), ("fingerprint", pa.string()), ("n_distinct", pa.float64())]))

    return whole.mapInArrow(finish, f"`{key}` {field.dataType.simpleString()}, fingerprint string, n_distinct double")


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_distinct double"
_OUT_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_distinct", pa.float64())]
)


def _place(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are not above the value: first among every m-th, then between two of those."""
    if not cuts:
        return F.lit(0)
    m = max(1, int(len(cuts) ** 0.5))
    array = lambda xs: F.array(*[F.lit(x) for x in xs])
    reached = lambda xs: F.size(F.filter(xs, lambda x: x <= value))
    coarse = reached(array(cuts[::m]))
    fine = F.get(F.array(*[array(cuts[i : i + m]) for i in range(0, len(cuts), m)]), coarse - 1)
    return F.when(value.isNull() | (coarse == 0), F.lit(0)).otherwise((coarse - 1) * m + reached(fine)).cast("int")


def edited_likeness(docs: DataFrame, rows_per_range: int = 4000, k: int = K) -> DataFrame:
    """Each document against its edited text and against the next document.

    Documents are dealt out by explicit ranges of doc_id. The first document of each range also goes,
    marked, to the end of the range before it (the very first one to the last range), so every task
    finds each document's successor beside it and no text moves more than once.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], _OUT)
    wanted = min(10_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // rows_per_range))
    cuts = sorted(set(rows.approxQuantile("doc_id", [i / wanted for i in range(1, wanted)], 1 / (4 * wanted)))) if wanted > 1 else []
    ranged = rows.withColumn("range", _place(F.col("doc_id"), [int(x) for x in cuts]))
    firsts = {r["range"]: r["first"] for r in ranged.groupBy("range").agg(F.min(F.struct("doc_id")).alias("first")).collect()}
    order = sorted(firsts)
    before = {firsts[r]["doc_id"]: order[i - 1] for i, r in enumerate(order)}  # the first id goes to the last range
    heads_of = rows.where(F.col("doc_id").isin([d for d in before if d is not None]) | (F.col("doc_id").isNull() if None in before else F.lit(False)))
    heads = heads_of.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))  # of equal ids the first by text
    spots = spark.createDataFrame([(d, r) for d, r in before.items()], "head long, range int")
    heads = heads.join(F.broadcast(spots), F.col("doc_id").eqNullSafe(F.col("head"))).select("doc_id", "text", "range", F.lit(1).alias("head"))
    both = ranged.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "range", F.lit(0).alias("head")).unionByName(heads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in slices(batches, "text"):
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            done = compare(table)
            if done is not None:
                yield done
            rest = table.slice(table.num_rows - 1)

    def compare(table: pa.Table) -> pa.RecordBatch | None:
        head = table.column("head").to_numpy()
        which = np.flatnonzero(head[:-1] == 0)  # each with the row below it
        if not len(which):
            return None
        texts, ids = table.column("text").to_pylist(), table.column("doc_id").to_pylist()
        edited = []
        for i in which:
            t, half = texts[i], len(texts[i]) // 2
            edited.append(t[: len(t) - half] + texts[i + 1][:half])
        own, new = sketches(table.column("text").combine_chunks(), k), sketches(pa.array(edited, pa.large_string()), k)
        out = {
            "doc_id": [ids[i] for i in which],
            "n_chars": [len(texts[i]) for i in which],
            "edited_sha256": [hashlib.sha256(e.encode()).hexdigest() for e in edited],
            "fingerprint": [to_text(own[i]) for i in which],
            "edited_fingerprint": [to_text(e) for e in new],
            "near_edited": [resemblance(own[i], e, k) for i, e in zip(which, new)],
            "near_next": [resemblance(own[i], own[i + 1], k) for i in which],
            "n_distinct": [distinct(own[i], k) for i in which],
        }
        return pa.RecordBatch.from_pydict(out, schema=_OUT_ARROW)

    dealt = both.repartitionByRange(len(order), "range").sortWithinPartitions(F.col("range"), F.col("head"), F.col("doc_id").asc_nulls_first(), F.col("text"))
    return dealt.mapInArrow(run, _OUT)
