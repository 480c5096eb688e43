"""Exact Jaccard join of word shingle sets by a size-aware heavy-light search.

Words a shingle and percent are parameters of ``components`` and ``deduplicated``, 4 and 85 by default.

1. Equal sets are one node, named by a digest of the set. All else is done for nodes.
2. Sets are ordered by (count, hash): shingles that are frequent in the prefixes of all documents, at
   most ``MAX_FREQUENT`` of them, come last, the most frequent at the very end. Two sets that link
   share their l smallest common shingles within both l-prefixes of n - ceil(percent n / 100) + l
   members, whatever the order.
3. Light sets (few shingles) enumerate the two-member subsets of their 2-prefix; heavy sets stand in
   inverted lists under each member of their 1-prefix. The boundary is where the expected cost is
   least: subsets against list entries and their comparisons.
4. Before that, stars: sets that share one of their first ``MARKS`` shingles are compared with one of
   them. That joins large groups of near copies with a row or two each, and the lists are then
   searched only for links between different components. Lists with the same two extreme members, as
   the shingles of one group have, are one cell.
5. Cells of up to ``SHORT`` entries send on all pairs. Larger ones are cut into blocks of about
   ``BLOCK`` sets: those outside the cell's largest component meet each other and the blocks of that
   component, every two blocks in a task of their own. A task compares parity bitmaps, whose Hamming
   distance never exceeds the size of the symmetric difference, and sends on one pair for each two
   components that it can surely join. Of pairs too close to the limit to tell it sends on the sets,
   once each: they meet again as whole sets, and one pair for each two components that link is sent on.
   No step makes more rows than its blocks have sets.
6. Pairs found by bitmaps are checked exactly on the full sets. Should a pair that looked sure fail, the
   cells are searched once more with the components found so far, and all that may link meets as whole sets.

No candidate is dropped for the length of its list. Defined results: null and empty texts have no
shingles and no links, and are their own component; rows that share a doc_id count as linked, each
with its own number of shingles; a null doc_id is never a component's name unless nothing else is
in it; texts of any length are whole; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import mix64, shingle_hashes, slices, stored, word_hashes
from tidemark.llm.components import connected_components

SHINGLE = 4
PERCENT = 85
MARKS = 6
#: A shingle is frequent from this many prefixes on, and more where there would be more than MAX_FREQUENT.
FREQUENT = 64
MAX_FREQUENT = 100_000
#: Sets above this size are always heavy: their two-member subsets outnumber any list.
LIGHT_MOST = 200
#: What a comparison of two bitmaps costs, counted in rows of an index.
COMPARISON = 0.02
SHORT = 8
BLOCK = 1024
#: Widest bitmap in bits: that of a block of very long sets still fits a task.
MOST_BITS = 1 << 16
#: Members that the whole sets of one side have in a task, unless a single set has more.
MEMBERS = 2_000_000
_FILTER_BITS = 1 << 20
_U = np.uint64
_I64, _BIN = pa.int64(), pa.binary()


def overlap_needed(n: int, percent: int = PERCENT) -> int:
    """How many of its ``n`` shingles a set shares at least with any set it links with."""
    return -(-percent * n // 100)


def prefix_length(n: int, l: int, percent: int = PERCENT) -> int:
    return min(n, n - overlap_needed(n, percent) + l)


def _sets(texts: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    words, begins = word_hashes(texts)
    h, at = shingle_hashes(words, begins, shingle)
    for a, b in zip(at, at[1:]):
        yield np.unique(h[a:b])


def _node(s: np.ndarray) -> int | None:
    """The name of a set, the same for equal sets; null for the empty one."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None


def _mapped(docs: DataFrame, make: Callable[[object, np.ndarray], tuple | None], schema: str, arrow: pa.Schema, shingle: int) -> DataFrame:
    """Rows made from each document's id and set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [r for r in map(make, batch.column("doc_id").to_pylist(), _sets(batch.column("text"), shingle)) if r is not None]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _signed(x: np.ndarray) -> list[int]:
    return x.view(np.int64).tolist()


def measured(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, set size, node (null if the set is empty) and the set's 1-prefix in hash order."""

    def make(doc_id, s: np.ndarray) -> tuple:
        return doc_id, len(s), _node(s), _signed(s[: prefix_length(len(s), 1, percent)])

    return _mapped(docs, make, "doc_id long, n long, node long, prefix array<long>", pa.schema([("doc_id", _I64), ("n", _I64), ("node", _I64), ("prefix", pa.list_(_I64))]), shingle)


def light_boundary(sizes: dict[int, int], mean_list: float, percent: int = PERCENT) -> int:
    """The largest light size: least total of subset rows and list rows; ``sizes``: sets of each size up to LIGHT_MOST."""
    pairs = lambda n: prefix_length(n, 2, percent) * (prefix_length(n, 2, percent) - 1) / 2
    lists = lambda n: prefix_length(n, 1, percent) * (1 + COMPARISON * mean_list)
    cost = lambda b: sum(c * pairs(n) for n, c in sizes.items() if n * percent <= b * 100) + sum(c * lists(n) for n, c in sizes.items() if n > b)
    return min(range(LIGHT_MOST + 1), key=lambda b: (cost(b), b))


def signatures(docs: DataFrame, frequent: np.ndarray, rank: np.ndarray, light: int, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, node, size, parity bitmap, first shingles and index keys of every non-empty set.

    ``frequent``: the frequent shingles, sorted; ``rank``: their counts, in the same order.
    """

    def make(doc_id, s: np.ndarray) -> tuple | None:
        n = len(s)
        if not n:
            return None
        order = s
        if len(frequent):
            at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
            order = s[np.argsort(np.where(frequent[at] == s, rank[at], 0), kind="stable")]
        keys = []
        if n * percent <= light * 100 and n > 1:
            p = order[: prefix_length(n, 2, percent)]
            i, j = np.triu_indices(len(p), 1)
            x, y = np.minimum(p[i], p[j]), np.maximum(p[i], p[j])
            with np.errstate(over="ignore"):
                keys.append(mix64(x * _U(3) + mix64(y)))
        if n > light:
            keys.append(order[: prefix_length(n, 1, percent)])
        bits = min(MOST_BITS, 1 << max(6, int(4 * n - 1).bit_length()))
        parity = (np.bincount((mix64(s) & _U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
        return doc_id, _node(s), n, np.packbits(parity, bitorder="little").tobytes(), _signed(order[:MARKS]), _signed(np.concatenate(keys)) if keys else []

    arrow = pa.schema([("doc_id", _I64), ("node", _I64), ("n", _I64), ("bitmap", _BIN), ("marks", pa.list_(_I64)), ("keys", pa.list_(_I64))])
    return _mapped(docs, make, "doc_id long, node long, n long, bitmap binary, marks array<long>, keys array<long>", arrow, shingle)


def _within(total: np.ndarray, apart: np.ndarray, percent: int) -> np.ndarray:
    """100 |A & B| >= percent |A | B| with |A ^ B| = apart and |A| + |B| = total."""
    return 100 * (total - apart) >= percent * (total + apart)


def _bitmap_links(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose bitmaps allow a link. Needs columns a, b, n_a, n_b, bm_a, bm_b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = np.zeros(batch.num_rows, np.int64)
            for i, (x, y) in enumerate(zip(batch.column("bm_a"), batch.column("bm_b"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                while len(x) > len(y):
                    x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                while len(y) > len(x):
                    y = y[: len(y) // 2] ^ y[len(y) // 2 :]
                apart[i] = np.bitwise_count(x ^ y).sum()
            total = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            yield batch.select(["a", "b"]).filter(pa.array(_within(total, apart, percent)))

    return pairs.select("a", "b", "n_a", "n_b", "bm_a", "bm_b").mapInArrow(run, "a long, b long")


def _side(sig: DataFrame, c: str) -> DataFrame:
    return sig.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bitmap").alias(f"bm_{c}"))


def _id_filter(ids: DataFrame) -> Column:
    """Whether a doc_id may be among ``ids``: a bit set over hashes, of fixed size, in one literal."""
    slot = lambda c: F.pmod(F.xxhash64(F.coalesce(c, F.lit(0))), F.lit(_FILTER_BITS))
    bit = F.expr("shiftleft(1, cast(slot % 8 as int))")
    rows = ids.select(slot("id").alias("slot")).select(F.floor(F.col("slot") / 8).cast("int").alias("place"), bit.alias("bit")).groupBy("place").agg(F.bit_or("bit").alias("bits")).collect()
    out = bytearray(_FILTER_BITS // 8)
    for r in rows:
        out[r["place"]] = r["bits"]
    here = slot("doc_id")
    byte = F.conv(F.hex(F.substring(F.lit(out), F.floor(here / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (here % 8).cast("int") + 1)) != 0


def whole_sets(docs: DataFrame, sig: DataFrame, ids: DataFrame, label: str, shingle: int = SHINGLE) -> DataFrame:
    """node and members of the sets that ``ids`` (node, distinct) names: a stored table."""
    names = stored(sig.select("node", "doc_id").join(ids, "node", "left_semi"), f"{label}-names")
    some = docs.select("doc_id", "text").where(_id_filter(names.select(F.col("doc_id").alias("id"))))
    sets = _mapped(some, lambda i, s: (_node(s), s.tobytes()) if len(s) else None, "node long, members binary", pa.schema([("node", _I64), ("members", _BIN)]), shingle)
    return stored(sets.join(names.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), f"{label}-sets")


def verified(docs: DataFrame, sig: DataFrame, likely: DataFrame, label: str, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of the stored table ``likely`` that do link."""
    sets = whole_sets(docs, sig, likely.select(F.explode(F.array("a", "b")).alias("node")).distinct(), label, shingle)
    side = lambda c: sets.select(F.col("node").alias(c), F.col("members").alias(f"s_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("s_a"), batch.column("s_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = likely.join(side("a"), "a").join(side("b"), "b").select("a", "b", "s_a", "s_b")
    return stored(joined.mapInArrow(run, "a long, b long"), f"{label}-links")


def star_pairs(sig: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Each set with the first of those that share one of its first shingles."""
    marked = sig.select("node", "n", F.explode("marks").alias("mark"))
    first = marked.groupBy("mark").agg(F.min(F.struct("node", "n")).alias("c"), F.count("*").alias("sets")).where("sets > 1")
    n, m = F.col("n"), F.col("c.n")
    pairs = marked.join(first, "mark").where((F.col("node") != F.col("c.node")) & (100 * F.least(n, m) >= percent * F.greatest(n, m)))
    return pairs.select(F.col("node").alias("a"), F.col("c.node").alias("b")).distinct()


def short_pairs(cells: DataFrame, percent: int = PERCENT) -> DataFrame:
    """All pairs of different components and fitting sizes in cells of at most ``SHORT`` rows: cell, node, n, component."""
    near = SHORT - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            columns = np.stack([batch.column(c).to_numpy() for c in ("cell", "node", "n", "component")])
            old = 0 if rest is None else rest.shape[1]
            rows = columns if rest is None else np.concatenate([rest, columns], 1)
            cell, node, n, comp = rows
            out = []
            for d in range(1, min(near, rows.shape[1] - 1) + 1):
                x, y = slice(None, -d), slice(d, None)
                ok = (cell[x] == cell[y]) & (comp[x] != comp[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
                ok[: max(0, old - d)] = False  # both were in the last batch
                out.append(np.stack([node[x][ok], node[y][ok]]))
            rest = rows[:, -near:]
            if out and (pairs := np.sort(np.concatenate(out, 1), 0)).shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    dealt = cells.repartition("cell").sortWithinPartitions("cell")
    return dealt.select("cell", "node", "n", "component").mapInArrow(run, "a long, b long").distinct()


class _Block:
    """Sets of one block by the width of their bitmaps, each in the order of size."""

    def __init__(self, rows: list[tuple]) -> None:
        self.node, self.n, self.comp = (np.array(x, np.int64) for x in list(zip(*rows))[:3])
        width = np.array([len(r[3]) for r in rows])
        self.of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for w in np.unique(width).tolist():
            at = np.flatnonzero(width == w)
            at = at[np.argsort(self.n[at], kind="stable")]
            self.of[w] = (at, np.frombuffer(b"".join(rows[i][3] for i in at), np.uint64).reshape(len(at), -1))


def _close(x: _Block, y: _Block, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in x and y of sets of different components whose sizes and bitmaps allow a link, and
    whether they surely link, but for what bitmaps lose by chance."""
    for w, (own, maps) in x.of.items():
        for v in (w // 2, w, 2 * w):  # sizes that fit are less than twice apart
            if v not in y.of:
                continue
            other, theirs = y.of[v]
            a, b = maps, theirs
            if v > w:
                b = b[:, : b.shape[1] // 2] ^ b[:, b.shape[1] // 2 :]
            elif v < w:
                a = a[:, : a.shape[1] // 2] ^ a[:, a.shape[1] // 2 :]
            n, m = x.n[own], y.n[other]
            low, high = np.searchsorted(100 * m, percent * n, "left"), np.searchsorted(percent * m, 100 * n, "right")
            step = max(1, 2_000_000 // max(1, len(m) * a.shape[1]))
            for at in range(0, len(n), step):
                end = min(len(n), at + step)
                c, d = int(low[at:end].min()), int(high[at:end].max())
                if c >= d:
                    continue
                apart = np.bitwise_count(a[at:end, None, :] ^ b[None, c:d, :]).sum(-1, dtype=np.int64)
                total = n[at:end, None] + m[None, c:d]
                i, j = np.nonzero(_within(total, apart, percent) & (x.comp[own[at:end], None] != y.comp[None, other[c:d]]))
                if len(i):
                    lost = 6 + 8 * apart[i, j] ** 2 // (64 * a.shape[1])  # many times what chance takes
                    yield own[at + i], other[c + j], _within(total[i, j], apart[i, j] + lost, percent)


def _joined(label: np.ndarray, mine: int, others: np.ndarray) -> np.ndarray:
    """Joins components in ``label`` with the one called ``mine``; the first of ``others`` that names each new one."""
    roots, first = np.unique(others, return_index=True)
    new = roots != mine
    if new.any():
        label[np.isin(label, roots[new])] = mine
    return first[new]


def _joining(x: _Block, y: _Block, percent: int, every: bool) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Pairs of nodes, for each two components one that surely links them, unless others do already. For x and y,
    the places of the sets that may link with what is still apart, and their components by then. ``every``: no pair is sure."""
    names, at = np.unique(np.concatenate([x.comp, y.comp]), return_inverse=True)
    own, other = at[: len(x.comp)], at[len(x.comp) :]
    label = np.arange(len(names))
    out, unsure = [], []
    for i, j, sure in _close(x, y, percent):
        if every:
            sure = np.zeros(len(i), bool)
        unsure.append((i[~sure], j[~sure]))
        i, j = i[sure], j[sure]
        cut = np.r_[0, np.flatnonzero(np.diff(i)) + 1, len(i)] if len(i) else np.zeros(1, np.int64)
        for a, b in zip(cut, cut[1:]):
            k = a + _joined(label, label[own[i[a]]], label[other[j[a:b]]])
            out.append(np.stack([x.node[i[k]], y.node[j[k]]], 1))
    left: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)]]
    for i, j in unsure:
        apart = label[own[i]] != label[other[j]]
        left[0].append(np.unique(i[apart]))
        left[1].append(np.unique(j[apart]))
    places = [np.unique(np.concatenate(p)) for p in left]
    open_sets = [(p, names[label[of[p]]]) for p, of in zip(places, (own, other))]
    return np.concatenate(out) if out else np.empty((0, 2), np.int64), open_sets


_FOUND = "cell long, i int, j int, part long, side int, node long, component long, b long"
_FOUND_ARROW = pa.schema([(c.split()[0], {"long": _I64, "int": pa.int32()}[c.split()[1]]) for c in _FOUND.split(", ")])
#: The side of a row that is a sure pair (node, b).
_PAIR = -1


def _rows_of(key: tuple, x: _Block, y: _Block, percent: int, every: bool) -> Iterator[pa.RecordBatch]:
    """What two blocks send on: sure pairs, and sets that are to meet as a whole, in parts of at most ``MEMBERS``."""

    def row(part: int, side: int, node: np.ndarray, component: np.ndarray, b: np.ndarray | None = None) -> pa.RecordBatch:
        n = len(node)
        columns = [*(np.full(n, k) for k in (*key, part, side)), node, component, np.zeros(n, np.int64) if b is None else b]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND_ARROW)], schema=_FOUND_ARROW)

    pairs, ((mine, name), (theirs, their_name)) = _joining(x, y, percent, every)
    if len(pairs):
        yield row(0, _PAIR, pairs.min(1), np.zeros(len(pairs), np.int64), pairs.max(1))
    if not len(mine):
        return
    alone = x is y
    if alone:
        mine, first = np.unique(np.r_[mine, theirs], return_index=True)
        name = np.r_[name, their_name][first]
        theirs, their_name = mine, name
    u, v = np.cumsum(x.n[mine]) // MEMBERS, np.cumsum(y.n[theirs]) // MEMBERS
    for part, (p, q) in enumerate((p, q) for p in np.unique(u) for q in np.unique(v) if not alone or p <= q):
        yield row(part, 0, x.node[mine[u == p]], name[u == p])
        if not alone or p < q:
            yield row(part, 1, y.node[theirs[v == q]], their_name[v == q])


def block_pairs(cells: DataFrame, percent: int = PERCENT, every: bool = False) -> DataFrame:
    """What bitmaps find: sure pairs (node, b) on side -1, and sets for ``exact_pairs``. cells: cell, i, j, side (0 or 1), node,
    n, component, bitmap; rows of one (cell, i, j), at most about twice ``BLOCK``, meet in one task: side 0 with side 1,
    or with itself where there is no side 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [])

        def flush() -> Iterator[pa.RecordBatch]:
            if held[0] and (held[1] or len(held[0]) > 1):
                x = _Block(held[0])
                yield from _rows_of(now, x, _Block(held[1]) if held[1] else x, percent, every)

        for batch in batches:
            for cell, i, j, side, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (cell, i, j) != now:
                    yield from flush()
                    now, held = (cell, i, j), ([], [])
                held[side].append(row)
        yield from flush()

    dealt = cells.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    return dealt.select("cell", "i", "j", "side", "node", "n", "component", "bitmap").mapInArrow(run, _FOUND)


def _linking(x: list[tuple], y: list[tuple], percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of nodes that link, one for each two components that do: x and y hold node, component and members."""
    _, at = np.unique([r[1] for r in (*x, *y)], return_inverse=True)
    own, other, label = at[: len(x)], at[len(x) :], np.arange(len(at))
    sets = [np.frombuffer(r[2], np.uint64) for r in (*x, *y)]
    size = np.array([len(m) for m in sets])
    n, m = size[: len(x)], size[len(x) :]
    distinct, place = np.unique(np.concatenate(sets), return_inverse=True)
    places = np.split(place, np.cumsum(size)[:-1])
    here = np.zeros(len(distinct), bool)
    for i in range(len(x)):
        j = np.flatnonzero((label[other] != label[own[i]]) & (100 * np.minimum(n[i], m) >= percent * np.maximum(n[i], m)))
        if not len(j):
            continue
        here[places[i]] = True
        both = np.add.reduceat(here[np.concatenate([places[len(x) + k] for k in j])], np.r_[0, np.cumsum(m[j])[:-1]], dtype=np.int64)
        here[places[i]] = False
        j = j[100 * both >= percent * (n[i] + m[j] - both)]
        if len(j):
            for k in j[_joined(label, label[own[i]], label[other[j]])].tolist():
                yield x[i][0], y[k][0]


def exact_pairs(found: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) among the sets of ``block_pairs``' rows, from whole sets: enough to join all that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [])

        def flush() -> Iterator[pa.RecordBatch]:
            if pairs := [*_linking(held[0], held[1] or held[0], percent)] if held[0] else []:
                p = np.array(pairs, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(p.min(1)), pa.array(p.max(1))], names=["a", "b"])

        for batch in batches:
            for *key, side, node, component, members in zip(*(c.to_pylist() for c in batch.columns)):
                if key != now:
                    yield from flush()
                    now, held = key, ([], [])
                held[side].append((node, component, members))
        yield from flush()

    key = ("cell", "i", "j", "part")
    dealt = found.where(F.col("side") != _PAIR).join(sets, "node").repartition(*key).sortWithinPartitions(*key)
    return dealt.select(*key, "side", "node", "component", "members").mapInArrow(run, "a long, b long").distinct()


def blocks(cells: DataFrame) -> DataFrame:
    """cell, i, j, side, node, n, component of all rows of large cells: each row in every block pair that needs it.

    cells: cell, size (an upper bound of its rows), node, n, component.
    """
    one = cells.where(F.col("size") <= BLOCK).select("cell", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "node", "n", "component")
    large = cells.where(F.col("size") > BLOCK)
    counts = large.groupBy("cell", "component").agg(F.count("*").alias("c"))
    tops = counts.groupBy("cell").agg(F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("c"))
    cut = lambda c: F.greatest(F.lit(1), F.ceil(c / BLOCK)).cast("int")
    tops = stored(tops.select("cell", F.col("top.component").alias("main"), cut(F.col("c") - F.col("top.c")).alias("others"), cut(F.col("top.c")).alias("mains")), "join-tops")
    known = large.join(tops, "cell").withColumn("is_main", F.col("component") == F.col("main"))
    place = F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))).cast("int")
    known = known.withColumn("place", place)
    # blocks 0 to others - 1 hold the sets outside the main component, those from there on the main component
    meet = lambda low, high, make: F.when(low <= high, F.transform(F.sequence(low, high), make)).otherwise(F.array().cast("array<struct<i:int,j:int,side:int>>"))
    row = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    p, others, mains = F.col("place"), F.col("others"), F.col("mains")
    zero = F.lit(0)
    of_main = meet(zero, others - 1, lambda k: row(k, others + p, 1))
    of_other = F.concat(meet(p, others + mains - 1, lambda k: row(p, k, 0)), meet(zero, p - 1, lambda k: row(k, p, 1)))
    many = known.withColumn("at", F.explode(F.when(F.col("is_main"), of_main).otherwise(of_other)))
    return one.unionByName(many.select("cell", "at.i", "at.j", "at.side", "node", "n", "component"))


def candidate_cells(sig: DataFrame, near: DataFrame) -> DataFrame:
    """cell, size (an upper bound), node, n, component of all entries of lists with several components."""
    known = sig.select("node", "n", "keys").join(near, "node", "left")
    entries = known.select("node", "n", F.coalesce("component", "node").alias("component"), F.explode("keys").alias("key"))
    lists = entries.groupBy("key").agg(F.count("*").alias("c"), F.min("component").alias("low"), F.max("component").alias("high"), F.min(F.xxhash64("node")).alias("one"), F.max(F.xxhash64("node")).alias("other"))
    lists = stored(lists.where("c > 1 AND low <> high").select("key", "c", F.xxhash64("one", "other").alias("cell")), "join-lists")
    sizes = stored(lists.groupBy("cell").agg(F.sum("c").alias("size")), "join-sizes")
    cells = entries.join(lists.select("key", "cell"), "key").select("cell", "node", "n", "component").distinct()
    return cells.join(sizes, "cell")


def list_links(docs: DataFrame, sig: DataFrame, near: DataFrame, label: str, shingle: int, percent: int, every: bool = False) -> tuple[DataFrame, bool]:
    """Links between different components, enough to join all that link; whether more may be left to find."""
    cells = stored(candidate_cells(sig, near), f"{label}-cells")
    pairs = short_pairs(cells.where(F.col("size") <= SHORT), percent)
    short = _bitmap_links(pairs.join(_side(sig, "a"), "a").join(_side(sig, "b"), "b"), percent).distinct()
    found = block_pairs(blocks(cells.where(F.col("size") > SHORT)).join(sig.select("node", "bitmap").dropDuplicates(["node"]), "node"), percent, every)
    found = stored(found, f"{label}-found")
    sure = found.where(F.col("side") == _PAIR).select(F.col("node").alias("a"), "b").distinct()
    likely = stored(short.unionByName(sure).distinct(), f"{label}-likely")
    links = verified(docs, sig, likely, label, shingle, percent)
    failed = sure.join(links, ["a", "b"], "left_anti")
    more = not every and not failed.isEmpty()
    some = found.where(F.col("side") != _PAIR)
    if not some.isEmpty():
        sets = whole_sets(docs, sig, some.select("node").distinct(), f"{label}-open", shingle)
        links = links.unionByName(stored(exact_pairs(found, sets, percent), f"{label}-exact"))
    return links, more


def _relabelled(links: DataFrame, near: DataFrame) -> DataFrame:
    """``links`` between components instead of nodes."""
    for c in ("a", "b"):
        links = links.join(near.select(F.col("node").alias(c), F.col("component").alias(f"to_{c}")), c, "left").withColumn(c, F.coalesce(f"to_{c}", c)).drop(f"to_{c}")
    return links.select("a", "b")


def _composed(near: DataFrame, far: DataFrame, label: str) -> DataFrame:
    """Components of nodes where ``far`` joins components of ``near``."""
    mid = near.select("node", F.col("component").alias("mid")).unionByName(far.select("node", F.col("node").alias("mid"))).dropDuplicates(["node", "mid"])
    out = mid.join(far.select(F.col("node").alias("mid"), "component"), "mid", "left").select("node", F.coalesce("component", "mid").alias("component"))
    return stored(out.distinct(), label)


def components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``.

    ``shingle``: words a shingle; ``percent``: the least Jaccard similarity of a link, above 50.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent is above 50 and at most 100")
    rows = stored(measured(docs, shingle, percent), "join-rows")
    heads = stored(rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("c")), "join-heads")
    copies = rows.select("node", "doc_id").join(heads.where("c > 1"), "node").where(~F.col("doc_id").eqNullSafe(F.col("first"))).select("node", "doc_id").distinct()
    shared = rows.where("doc_id IS NOT NULL AND node IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("doc_id", "a")

    counts = rows.select(F.explode("prefix").alias("key")).groupBy("key").agg(F.count("*").alias("c"))
    stats = stored(counts.where("c > 1"), "join-counts")  # keys of one document tell nothing
    total = stats.agg(F.sum("c"), F.sum(F.col("c") * F.col("c"))).first()
    least = max(FREQUENT, (total[0] or 0) // MAX_FREQUENT + 1)
    often = sorted((np.int64(r["key"]).view(np.uint64), r["c"]) for r in stats.where(F.col("c") >= least).collect())
    frequent, rank = np.array([k for k, _ in often], np.uint64), np.array([c for _, c in often], np.int64)
    usual = stats.where(F.col("c") < least).agg(F.sum("c"), F.sum(F.col("c") * F.col("c"))).first()
    sizes = {r["n"]: r["c"] for r in rows.where(F.col("n") <= LIGHT_MOST).groupBy("n").agg(F.count("*").alias("c")).collect()}
    light = light_boundary(sizes, (usual[1] or 0) / max(1, usual[0] or 0), percent)

    whole = signatures(docs, frequent, rank, light, shingle, percent)
    match = (F.col("node") == F.col("of_node")) & F.col("doc_id").eqNullSafe(F.col("of_doc"))
    sig = stored(whole.join(copies.select(F.col("node").alias("of_node"), F.col("doc_id").alias("of_doc")), match, "left_anti"), "join-signatures")
    stars = star_pairs(sig, percent)
    likely = stored(_bitmap_links(stars.join(_side(sig, "a"), "a").join(_side(sig, "b"), "b"), percent).distinct(), "star-likely")
    links = verified(docs, sig, likely, "star", shingle, percent)
    one_document = rows.where("node IS NOT NULL").join(shared, "doc_id").select("a", F.col("node").alias("b")).where("a <> b")
    near = connected_components(links.unionByName(one_document), "star-components")
    more = True
    for every in (False, True):
        if more:
            links, more = list_links(docs, sig, near, f"list-{every}".lower(), shingle, percent, every)
            near = _composed(near, connected_components(_relabelled(links, near), "list-components"), "join-components")
    first = near.join(heads, "node").groupBy("component").agg(F.min("first").alias("least"))
    named = near.join(first, "component").select("node", "least")
    names = heads.join(named, "node", "left").select("node", F.coalesce("least", "first").alias("component_id"))
    out = rows.select("doc_id", "n", "node").join(names, "node", "left")
    # a document whose rows are an empty and another text belongs where the other one does
    mixed = rows.groupBy("doc_id").agg(F.max("node").alias("some"), F.max(F.col("node").isNull()).alias("bare")).where("bare AND some IS NOT NULL AND doc_id IS NOT NULL").join(names.withColumnRenamed("node", "some"), "some").select("doc_id", F.col("component_id").alias("of_rest"))
    return out.join(mixed, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "of_rest", "doc_id").alias("component_id"))


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that are the first of their component, with their own columns only.

    Rows with the first row's doc_id stay with it; rows without a doc_id stay if nothing else is in their component.
    """
    gone = components(docs, shingle, percent).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
