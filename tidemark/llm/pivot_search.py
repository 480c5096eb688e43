"""Exact search for the largest inner products, with candidates ruled out by a table of distances to pivots.

Components become integers, floor(64 x). For vectors q and x the inner product is
(|q|^2 + |x|^2 - d(q, x)^2) / 2, and by the triangle inequality d(q, x) is at least
|d(q, p) - d(x, p)| for every pivot p: the largest of these bounds, from a table of distances worked
out once, caps the score. Candidates are taken in the order of their caps until no cap reaches a
query's k-th best score; ties count as reaching it, so the result is exact.

Vectors lie in blocks of bounded size, neighbours by nearest pivot and distance to it, each block
with the range of its distances to every pivot; queries lie in larger blocks of the same kind. Where
the ranges of two blocks show that no query can reach its k-th best, the vectors do not move at all.
Each query begins with the k-th best of the block in which it lies itself.

Defined results: vectors that are null, or hold null or non-finite components (also after scaling),
take no part; an empty vector is one of zeros, and a shorter one counts as filled up with zeros; a
null id is no query and comes last among ties; rows with one id are rows of their own (each is asked,
and each may be found, a query's own row alone being left out); scores beyond 64 bits become the
nearest long; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored

SCALE = 64
#: Pivots, and the vectors among which they are chosen (those with the smallest hashes): fitted parameters of
#: the table; every vector is in it.
PIVOTS = 32
PIVOT_SAMPLE = 2048
#: Vectors of a block, queries of a query block.
BLOCK = 2048
QUERY_BLOCK = 8192
#: Blocks of vectors that meet one copy of a block of queries, at least.
LANE_BLOCKS = 4
#: Cells of a matrix of scores at a time.
_CELLS = 1 << 21
_LAST = np.iinfo(np.int64).max


def integers(vectors: list, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors take part, and those as whole numbers in doubles, filled up with zeros."""
    rows, good = [], np.zeros(len(vectors), bool)
    for i, v in enumerate(vectors):
        if v is None or any(x is None for x in v):
            continue
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(scale * np.asarray(v, np.float64))
        if np.isfinite(x).all():
            good[i] = True
            rows.append(x)
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return good, out


def _widened(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] == width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices of whole numbers, as longs."""
    width = max(a.shape[1], b.shape[1])
    a, b = _widened(a, width), _widened(b, width)
    if not width or not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    reach = np.abs(a).max() * np.abs(b).max() * width
    if reach < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if reach < 1 << 53:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m.tolist()], object).reshape(m.shape)
    return np.clip(whole(a) @ whole(b).T, np.iinfo(np.int64).min, _LAST).astype(np.int64)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots, in doubles; infinite where they overflow."""
    width = max(x.shape[1], pivots.shape[1])
    x, pivots = _widened(x, width), _widened(pivots, width)
    with np.errstate(over="ignore", invalid="ignore"):
        both = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None]
        d = both - 2 * (x @ pivots.T)
        i, j = np.nonzero(~(d > 1e-3 * both))  # where the sum cancels, the difference itself
        d[i, j] = ((x[i] - pivots[j]) ** 2).sum(1)
        return np.nan_to_num(np.sqrt(np.maximum(d, 0)), nan=np.inf, posinf=np.inf)


def chosen_pivots(x: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Rows far from one another: each next one is the farthest from those chosen."""
    if not len(x):
        return np.zeros((1, 0))
    picked = [int((x * x).sum(1).argmax())]
    near = distances(x, x[picked])[:, 0]
    while len(picked) < count and near.max() > 0:
        picked.append(int(near.argmax()))
        near = np.minimum(near, distances(x, x[picked[-1:]])[:, 0])
    return x[picked]


def caps(q_norm: np.ndarray, x_norm: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """What scores cannot exceed, from squared norms and a lower bound of distances; rounded upwards."""
    with np.errstate(over="ignore", invalid="ignore"):
        total = q_norm + x_norm
        cap = (total - gap * gap) / 2 + total * 1e-12 + 1
    return np.where(np.isnan(cap), np.inf, cap)


class Block:
    """Vectors with their row numbers, ids, squared norms and distances to the pivots; ``best`` has the k-th
    best scores known of each (queries only)."""

    def __init__(self, row, ids, known, x, norm, far, best=None) -> None:
        self.row, self.id, self.known, self.x, self.norm, self.far = row, ids, known, x, norm, far
        self.best = np.full(len(row), -np.inf) if best is None else best

    def take(self, at: np.ndarray) -> Block:
        return Block(*(getattr(self, n)[at] for n in ("row", "id", "known", "x", "norm", "far", "best")))

    @staticmethod
    def joined(blocks: list[Block]) -> Block:
        width = max(b.x.shape[1] for b in blocks)
        return Block(*(np.concatenate([_widened(b.x, width) if n == "x" else getattr(b, n) for b in blocks]) for n in ("row", "id", "known", "x", "norm", "far", "best")))

    def to_bytes(self) -> bytes:
        small = not self.x.size or np.abs(self.x).max() < 1 << 15
        head = np.array([len(self.row), self.x.shape[1], self.far.shape[1], small], "<i8")
        parts = (head, self.row.astype("<i8"), self.id.astype("<i8"), self.known.astype("u1"), self.norm.astype("<f8"), self.best.astype("<f8"), self.far.astype("<f8"), self.x.astype("<i2" if small else "<f8"))
        return b"".join(p.tobytes() for p in parts)

    @staticmethod
    def from_bytes(data: bytes) -> Block:
        n, width, pivots, small = (int(v) for v in np.frombuffer(data, "<i8", 4))
        at, out = 32, []
        for kind, count in (("<i8", n), ("<i8", n), ("u1", n), ("<f8", n), ("<f8", n), ("<f8", n * pivots), ("<i2" if small else "<f8", n * width)):
            out.append(np.frombuffer(data, kind, count, at))
            at += out[-1].nbytes
        row, ids, known, norm, best, far, x = out
        return Block(row, ids, known.astype(bool), x.reshape(n, width).astype(np.float64), norm, far.reshape(n, pivots), best)


def _ranked(query: np.ndarray, score: np.ndarray, ids: np.ndarray, known: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's ``k`` best, by score, known ids before null ones, then the smaller id."""
    order = np.lexsort((ids, ~known, -score, query))
    q = query[order]
    first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.empty(0, bool)
    begin = np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    return order[np.arange(len(q)) - begin < k]


class Search:
    """The best ``k`` of each query of a block so far; candidates come block by block."""

    def __init__(self, queries: Block, k: int) -> None:
        self.q, self.k, self.best = queries, k, queries.best.copy()
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = self.seen = 0

    def offer(self, x: Block) -> None:
        """Candidates in the order of their caps, until no query's cap reaches its k-th best score."""
        step = max(1, _CELLS // max(1, len(x.row)))
        for a in range(0, len(self.q.row), step):
            self._offer(slice(a, min(len(self.q.row), a + step)), x)

    def _offer(self, part: slice, x: Block) -> None:
        q = self.q
        gap = np.zeros((part.stop - part.start, len(x.row)), np.float32)
        far_q, far_x = q.far[part].astype(np.float32), x.far.astype(np.float32)
        step = np.empty_like(gap)
        for j in range(far_q.shape[1]):
            np.subtract(far_q[:, j, None], far_x[None, :, j], out=step)
            np.abs(step, out=step)
            np.fmax(gap, step, out=gap)
        with np.errstate(over="ignore", invalid="ignore"):
            off = 4e-7 * (far_q.max(initial=0) + far_x.max(initial=0))  # single precision, rounded down
            gap = np.nan_to_num(np.maximum(gap - off, 0), nan=0.0, posinf=0.0)
        cap = caps(q.norm[part, None], x.norm[None], gap.astype(np.float64))
        alive = cap >= self.best[part, None]
        if not alive.any():
            return
        top = np.where(alive, cap, -np.inf).max(0)  # of a candidate over the queries that it may still serve
        order = np.argsort(-top, kind="stable")
        order = order[top[order] > -np.inf]
        width = max(self.k, 256)
        for b in range(0, len(order), width):
            at = order[b : b + width]
            rows = np.flatnonzero((cap[:, at] >= self.best[part, None]).any(1))
            if not len(rows):
                if not (top[at[0]] >= self.best[part].min()):
                    break
                continue
            score = products(q.x[part][rows], x.x[at])
            self.seen += score.size
            r, c = np.nonzero((score >= self.best[part][rows, None]) & (q.row[part][rows, None] != x.row[None, at]))
            self.held.append((rows[r] + part.start, score[r, c], x.id[at[c]], x.known[at[c]]))
            self.size += len(r)
            if self.size > max(100_000, 4 * self.k * len(q.row)):
                self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        """Keep each query's best and raise its k-th."""
        if not self.held:
            return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, bool))
        whole = tuple(np.concatenate(p) for p in zip(*self.held))
        whole = tuple(p[_ranked(*whole, self.k)] for p in whole)
        last = np.flatnonzero(np.bincount(whole[0], minlength=len(self.q.row)) >= self.k)
        ends = np.searchsorted(whole[0], last, "right") - 1
        self.best[last] = np.maximum(self.best[last], whole[1][ends])
        self.held, self.size = [whole], len(whole[0])
        return whole


_VECTORS = "row long, cell int, far double, data binary"
_BLOCKS = "block long, asks boolean, cell int, low array<double>, high array<double>, norm double, best double, data binary"
_FOUND = "query_row long, query_id long, vec_id long, score long"
_arrow = lambda **kinds: pa.schema(list(kinds.items()))
_FOUND_ARROW = _arrow(query_row=pa.int64(), query_id=pa.int64(), vec_id=pa.int64(), score=pa.int64())
_BLOCKS_ARROW = _arrow(block=pa.int64(), asks=pa.bool_(), cell=pa.int32(), low=pa.list_(pa.float64()), high=pa.list_(pa.float64()), norm=pa.float64(), best=pa.float64(), data=pa.binary())


def _row(b: Block, cell: int, asks: bool) -> dict:
    """A block by its first row number, with the ranges of its distances."""
    return {"block": int(b.row.min()), "asks": asks, "cell": cell, "low": b.far.min(0).tolist(), "high": b.far.max(0).tolist(), "norm": float(b.norm.max()), "best": float(b.best.min()), "data": b.to_bytes()}


def pivots_of(vectors: DataFrame, count: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> np.ndarray:
    """Pivots from the ``sample`` vectors (vec_id, embedding) of the smallest hashes: a bounded sample."""
    some = vectors.where("embedding IS NOT NULL").select("embedding", F.xxhash64("vec_id", "embedding").alias("h")).orderBy("h").limit(sample)
    return chosen_pivots(integers([r["embedding"] for r in some.collect()])[1], count)


def table_of(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """One row for each vector that takes part: row number, nearest pivot, distance to it, and the vector
    with its id and all its distances. Row numbers hold only once it is written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, x = integers(batch.column("embedding").to_pylist())
            at = np.flatnonzero(good)
            far = distances(x, pivots)
            ids = batch.column("vec_id").take(pa.array(at))
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            values = ids.fill_null(_LAST).to_numpy(zero_copy_only=False)
            rows = batch.column("row").to_numpy()[at]
            with np.errstate(over="ignore"):
                norm = (x * x).sum(1)
            cell = far.argmin(1) if len(x) else np.empty(0, np.int64)
            one = Block(rows, values, known, x, norm, far)
            data = [one.take(np.array([i])).to_bytes() for i in range(len(at))]
            columns = {"row": rows, "cell": cell.astype(np.int32), "far": far[np.arange(len(at)), cell], "data": data}
            yield pa.RecordBatch.from_pydict(columns, schema=_arrow(row=pa.int64(), cell=pa.int32(), far=pa.float64(), data=pa.binary()))

    numbered = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return numbered.mapInArrow(run, _VECTORS)


def blocks_of(table: DataFrame, size: int, every: int, k: int) -> DataFrame:
    """Blocks of neighbouring vectors, cut at ``size`` in the order of pivot and distance; and each row whose id is
    divisible by ``every`` as a block of its own that asks, with the k-th best score within its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        cells: list[int] = []
        for batch in batches:
            for cell, data in zip(batch.column("cell").to_pylist(), batch.column("data").to_pylist()):
                held.append(data)
                cells.append(cell)
                if len(held) == size:
                    yield close(held, cells)
                    held, cells = [], []
        if held:
            yield close(held, cells)

    def close(held: list[bytes], cells: list[int]) -> pa.RecordBatch:
        block = Block.joined([Block.from_bytes(x) for x in held])
        rows = [_row(block, cells[0], False)]
        at = np.flatnonzero(block.known & (block.id % every == 0))
        if len(at):
            search = Search(block.take(at), k)
            search.offer(block)
            search.settle()
            search.q.best = search.best
            rows += [_row(search.q.take(np.array([i])), cells[a], True) for i, a in enumerate(at)]
        return pa.RecordBatch.from_pylist(rows, schema=_BLOCKS_ARROW)

    dealt = table.repartitionByRange("cell", "far", "row").sortWithinPartitions("cell", "far", "row")
    return dealt.select("cell", "data").mapInArrow(run, _BLOCKS)


def query_blocks(asking: DataFrame, size: int) -> DataFrame:
    """Rows that ask in blocks of about ``size``, by nearest pivot: a large cell is dealt out over several blocks,
    small ones share one. Only the number of each cell's queries is brought together: as many as pivots."""
    counts = {r["cell"]: r["count"] for r in asking.groupBy("cell").count().collect()}
    first, number, at, filled = [], [], 0, 0
    for cell in range(max(counts, default=0) + 1):
        n = counts.get(cell, 0)
        if filled and filled + n > size:
            at, filled = at + 1, 0
        parts = max(1, -(-n // size))
        first.append(at)
        number.append(parts)
        at, filled = (at + parts, 0) if parts > 1 else (at, filled + n)
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cell") + 1)
    dealt = asking.withColumn("g", of(first) + F.pmod(F.xxhash64("block"), of(number)).cast("int"))
    joined = dealt.groupBy("g").agg(F.collect_list("data").alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, parts in zip(batch.column("g").to_pylist(), batch.column("parts")):
                row = _row(Block.joined([Block.from_bytes(x) for x in parts.as_py()]), 0, True)
                yield pa.RecordBatch.from_pylist([row | {"block": g}], schema=_BLOCKS_ARROW)

    return joined.mapInArrow(run, _BLOCKS).withColumnRenamed("block", "g")


def reach(asked: str = "q", block: str = "b") -> F.Column:
    """The cap of the scores between a block of queries and a block of vectors, from their ranges of distances;
    null ranges or sums that overflow cap nothing."""
    gaps = F.zip_with(F.arrays_zip(f"{asked}.low", f"{asked}.high"), F.arrays_zip(f"{block}.low", f"{block}.high"), lambda x, y: F.greatest(y["low"] - x["high"], x["low"] - y["high"], F.lit(0.0)))
    gap = F.greatest(F.array_max(gaps) - F.lit(1e-9) * (F.array_max(f"{asked}.high") + F.array_max(f"{block}.high")), F.lit(0.0))
    total = F.col(f"{asked}.norm") + F.col(f"{block}.norm")
    cap = (total - gap * gap) / 2 + total * 1e-12 + 1
    return F.when(F.isnan(cap) | cap.isNull(), F.lit(float("inf"))).otherwise(cap)


def top_products(vectors: DataFrame, every: int = 20, k: int = 20, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: of each row whose vec_id is divisible by ``every``, the ``k`` rows with the
    largest inner products of whole-number vectors, ties to the smaller vec_id.

    Vectors move once to their blocks, then only to the query blocks that they may serve; a task holds
    one block of queries and one block of vectors at a time and gives at most ``k`` rows for each query.
    """
    table = stored(table_of(vectors, pivots_of(vectors, pivots)), "pivot-table")
    both = stored(blocks_of(table, block, every, k), "vector-blocks")
    blocks = both.where(~F.col("asks"))
    asked = stored(query_blocks(both.where("asks"), QUERY_BLOCK), "query-blocks")
    groups = asked.agg(F.max("g")).first()[0]
    if groups is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # the stated queries against all rows, in blocks: the ranges of every two blocks meet, then what passes
    ranges = blocks.select("block", "low", "high", "norm", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups).cast("long"))).alias("g"))
    met = ranges.alias("b").join(asked.select("g", "low", "high", "norm", "best").alias("q"), "g")
    # a lane takes some blocks of vectors, for each of which its block of queries need not come again
    spread = max(1, min(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks.count() // LANE_BLOCKS))
    lane = F.pmod(F.xxhash64("block"), F.lit(spread)).cast("int").alias("lane")
    pairs = stored(met.where(F.col("q.best") <= reach()).select("g", "block", reach().alias("cap"), lane), "block-pairs")
    served = pairs.join(blocks.select("block", "data"), "block").select("g", "lane", F.lit(1).alias("kind"), "cap", "data")
    heads = pairs.select("g", "lane").distinct().join(asked.select("g", "data"), "g").select("g", "lane", F.lit(0).alias("kind"), F.lit(0.0).alias("cap"), "data")
    dealt = heads.unionByName(served).repartition("g", "lane").sortWithinPartitions("g", "lane", "kind", F.col("cap").desc())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search: Search | None = None
        for batch in batches:
            for kind, cap, data in zip(batch.column("kind").to_pylist(), batch.column("cap").to_pylist(), batch.column("data").to_pylist()):
                if kind == 0:
                    yield from found(search)
                    search = Search(Block.from_bytes(data), k)
                elif cap >= search.best.min():
                    search.offer(Block.from_bytes(data))
                    search.settle()
        yield from found(search)

    def found(search: Search | None) -> Iterator[pa.RecordBatch]:
        if search is not None:
            q, score, ids, known = search.settle()
            if len(q):
                yield pa.RecordBatch.from_pydict({"query_row": search.q.row[q], "query_id": search.q.id[q], "vec_id": pa.array(ids, pa.int64(), mask=~known), "score": score}, schema=_FOUND_ARROW)

    parts = dealt.select("kind", "cap", "data").mapInArrow(run, _FOUND)
    w = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return parts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.k, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.k <> c.k WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY rank <= 20
"""
