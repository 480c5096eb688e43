"""Connected components of an edge table in rounds of one sort each way, with the lineage cut after each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

_LINKS = "a long, b long, moved boolean"
#: Edges that a task takes on; smaller graphs are spread over this many tasks all the same.
TASK_EDGES, LEAST_TASKS = 2_000_000, 16


def _with_least(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows sorted by (a, b), and the least b of each row's a: only the last a and its least b are carried on."""
    last = least = None
    for batch in batches:
        a, b, moved = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "moved"))
        if not len(a):
            continue
        new = np.r_[last is None or a[0] != last, a[1:] != a[:-1]]
        first = np.maximum.accumulate(np.where(new, np.arange(len(a)), -1))
        m = np.where(first >= 0, b[np.maximum(first, 0)], 0 if least is None else least)
        last, least = a[-1], m[-1]
        yield a, b, moved, m


def _rows(a: np.ndarray, b: np.ndarray, moved: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(moved)], names=["a", "b", "moved"])


def _large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours above a node go to the least of the node and its neighbours."""
    for a, b, moved, m in _with_least(batches):
        up, to = b > a, np.minimum(a, m)
        yield _rows(b[up], to[up], (moved | (to != a))[up])


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A node and the neighbours below it go to the least of those."""
    for a, b, moved, m in _with_least(batches):
        yield _rows(np.where(b == m, a, b), m, moved | (b != m))


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b): component is the smallest node reached.

    Alternating large-star and small-star rounds: each node links its neighbours to its smallest
    neighbour. Rounds grow with the logarithm of a component's size; a round is two exchanges, rows
    never become more, and a node's neighbours pass through a task one batch at a time. The round that
    moves nothing is the last.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = stored(links.withColumn("moved", F.lit(False)), label)
    rows = links.count()
    # the ranges of a sorted exchange may be read one after the other, since no node is in two of them
    sorted_by_node = lambda t: t.repartition("a").sortWithinPartitions("a", "b").coalesce(max(LEAST_TASKS, rows // TASK_EDGES))
    going = rows > 0
    while going:
        plain = links.select("a", "b", F.lit(False).alias("moved"))
        both = plain.unionByName(plain.select(F.col("b").alias("a"), F.col("a").alias("b"), "moved"))
        links = stored(sorted_by_node(sorted_by_node(both).mapInArrow(_large, _LINKS)).mapInArrow(_small, _LINKS), label)
        going = not links.where("moved").isEmpty()
    tops = links.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops).distinct()
