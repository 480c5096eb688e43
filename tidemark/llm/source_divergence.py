"""Audit of how the sources of a language differ in their words.

Arrow kernels count the terms of whole texts inside ``mapInArrow`` (``ascii_lower``,
``split_pattern_regex``, ``dictionary_encode``, hash ``group_by``); one shuffle by language and term
merges the partial counts. Terms that enough documents of their language hold are written as columnar
shards; each shard compares all sources of its language over its terms, with integers alone, and
sums over shards give the divergences.

Defined results: null text, lang and source count as empty strings; rows with one doc_id are
documents of their own (doc_id is not read); ties go to the smaller item in UTF-8 order; a group
without terms takes part with counts of zero; a language without kept terms has divergences of zero;
extra columns are ignored; an empty table gives an empty result. Counts are exact as long as a
group has fewer than nine quadrillion terms (an error beyond).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import slices, stored

#: What separates terms: ASCII but letters. Only A-Z are lower-cased.
GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
LEAST_DOCS = 10
TOP = 10
#: Terms of one shard: what a task compares at a time, whatever the size of the corpus.
SHARD_TERMS = 8192
#: Partial counts that a task holds before it sends them on.
HELD = 400_000
#: Cells of a dense block of terms by groups.
CELLS = 1 << 20

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def partial_counts(batch: pa.RecordBatch) -> pa.Table:
    """Occurrences and documents by (lang, source, term) of a batch of lang, source and text."""
    texts = pc.ascii_lower(pc.fill_null(batch.column("text"), ""))
    lists = pc.split_pattern_regex(texts, GAP)
    terms, row = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.greater(pc.binary_length(terms), 0)
    words = terms.filter(real).dictionary_encode()
    group = pa.table({"lang": pc.fill_null(batch.column("lang"), ""), "source": pc.fill_null(batch.column("source"), "")})
    keys = pc.binary_join_element_wise(pc.cast(pc.binary_length(group["lang"]), pa.string()), group["lang"], group["source"], ":").combine_chunks().dictionary_encode()
    by_row = pa.table({"row": row.filter(real), "term": words.indices}).group_by(["row", "term"], use_threads=False).aggregate([([], "count_all")])
    by_row = by_row.append_column("key", keys.indices.take(by_row["row"]))
    sums = by_row.group_by(["key", "term"], use_threads=False).aggregate([("count_all", "sum"), ([], "count_all")])
    first = pc.index_in(pa.array(range(len(keys.dictionary)), pa.int32()), keys.indices)  # a row of each key
    where = first.take(sums["key"].combine_chunks())
    columns = [group["lang"].take(where), group["source"].take(where), words.dictionary.take(sums["term"]), sums["count_all_sum"], sums["count_all"]]
    return pa.table([pc.cast(c, f.type) for c, f in zip(columns, _COUNTS)], schema=_COUNTS)


def merged(tables: list[pa.Table]) -> pa.Table:
    """Partial counts added up."""
    g = pa.concat_tables(tables).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return g.rename_columns({"n_sum": "n", "docs_sum": "docs"}).select(_COUNTS.names).cast(_COUNTS)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, docs, by): documents of the language that hold the term, and its occurrences by source.

    Rows of one source are added up within each task first, so a hot source or word moves one row a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, fresh, size = None, [], 0
        for batch in slices(batches, "text", 1 << 21):
            fresh.append(partial_counts(batch))
            size += fresh[-1].num_rows
            if size >= HELD:
                whole, fresh, size = merged([*([whole] if whole else []), *fresh]), [], 0
                if whole.num_rows >= HELD:
                    yield from whole.to_batches(1 << 16)
                    whole = None
        rest = [*([whole] if whole else []), *fresh]
        if rest:
            yield from merged(rest).to_batches(1 << 16)

    counts = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    dealt = counts.repartition("lang", "term")  # the two groupings below need no other exchange
    by_source = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("by"))


def scaled(count: np.ndarray, total: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """1 + floor(scale * count / total) in 64-bit integers, by long division in steps of a thousand; count <= total, scale a power of it."""
    if len(total) and int(total.max()) >= (1 << 63) // 1000:
        raise OverflowError("a group has too many terms")
    rest, out = np.broadcast_arrays(count, total)[0].copy(), np.int64(0)
    while scale > 1:
        whole, rest = np.divmod(rest * 1000, total)
        out, scale = out * 1000 + whole, scale // 1000
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); the square stays below 2^63 for p, q up to SCALE + 1."""
    return (p - q) ** 2 // (p + q)


_PARTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
_PARTS_SQL = "lang string, source string, part string, item string, value long"


def _best(value: np.ndarray, terms: list[bytes], k: int) -> np.ndarray:
    """Places of the ``k`` largest values, ties by the terms' bytes (``terms`` are in order)."""
    if len(value) > k:
        kth = np.partition(value, len(value) - k)[len(value) - k]
        at = np.flatnonzero(value >= kth)
    else:
        at = np.arange(len(value))
    return at[np.lexsort((at, -value[at]))][:k]


def compared(lang: str, terms: list[str], by: list[list[dict]], sources: list[str], totals: np.ndarray, kept: int, top: int = TOP) -> pa.Table:
    """What one shard adds: divergence of every two sources over its terms, and each source's ``top`` terms."""
    order = sorted(range(len(terms)), key=lambda i: terms[i].encode())
    place = {s: i for i, s in enumerate(sources)}
    n, pairs = len(sources), np.zeros((len(sources), len(sources)), np.int64)
    below = totals + 2 * kept
    best: list[list[tuple[int, bytes, str]]] = [[] for _ in sources]
    step = max(1, CELLS // n)
    for a in range(0, len(order), step):
        names = [terms[i] for i in order[a : a + step]]
        count = np.zeros((n, len(names)), np.int64)
        for j, i in enumerate(order[a : a + step]):
            for x in by[i]:
                count[place[x["source"]], j] = x["n"]
        p = scaled(count + 2, below[:, None])
        q = scaled(count.sum(0) + 2, np.array([totals.sum() + 2 * kept]))
        for i in range(n):
            pairs[i, i + 1 :] += divergence(p[i], p[i + 1 :]).sum(1)
            at = np.flatnonzero((count[i] > 0) & (p[i] > q))
            value = divergence(p[i, at], q[at])
            new = [(-int(value[b]), names[at[b]].encode(), names[at[b]]) for b in _best(value, names, top)]
            best[i] = sorted(best[i] + new)[:top]
    pairs += pairs.T
    one, other = np.nonzero(~np.eye(n, dtype=bool))
    names = pa.array(sources, pa.string())
    rows = [(s, t, -v) for s, ts in zip(sources, best) for v, _, t in ts]
    k = len(one)
    return pa.table(
        [
            pa.array([lang] * (k + len(rows)), pa.string()),
            pa.concat_arrays([names.take(pa.array(one)), pa.array([r[0] for r in rows], pa.string())]),
            pa.array(["pair"] * k + ["term"] * len(rows), pa.string()),
            pa.concat_arrays([names.take(pa.array(other)), pa.array([r[1] for r in rows], pa.string())]),
            pa.array(np.r_[pairs[one, other], np.array([r[2] for r in rows], np.int64)], pa.int64()),
        ],
        schema=_PARTS,
    )


def divergences(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: each source against each other one of its language
    (``pair``), and the terms by which it exceeds its language most (``term``, up to ``top``).

    A shard holds about ``shard_terms`` terms of a language with their counts by source, and every
    shard has the totals of its language's sources beside it: tasks stay as large as they are.
    """
    groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    kept = stored(term_counts(docs).where(F.col("docs") >= least_docs), "term-counts")
    size = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    totals = kept.select("lang", F.explode("by").alias("x")).groupBy("lang", "x.source").agg(F.sum("x.n").alias("total"))
    sources = groups.join(totals, ["lang", "source"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total")))).alias("sources"))
    shards = lambda: F.greatest(F.lit(1), F.ceil(F.col("kept") / shard_terms)).cast("int")
    langs = stored(sources.join(size, "lang", "left").fillna(0, ["kept"]), "language-totals")
    heads = langs.withColumn("shard", F.explode(F.sequence(F.lit(0), shards() - 1)))
    terms = kept.join(langs.select("lang", shards().alias("shards")), "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"), "term", "by")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        head = right.to_pylist()[0]
        names, total = [x["source"] for x in head["sources"]], np.array([x["total"] for x in head["sources"]], np.int64)
        return compared(head["lang"], left["term"].to_pylist(), left["by"].to_pylist(), names, total, head["kept"], top)

    parts = terms.groupBy("lang", "shard").cogroup(heads.groupBy("lang", "shard")).applyInArrow(compare, _PARTS_SQL)
    sums = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    w = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    return sums.withColumn("rank", F.row_number().over(w)).where((F.col("part") == "pair") | (F.col("rank") <= top))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
     t AS (SELECT k, lang, source, unnest(words) AS term FROM d),
     kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
     v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
     c AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
     g AS (SELECT lang, source, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL) USING (lang, source)),
     p AS (SELECT g.lang, g.source, kept.term, coalesce(c.c, 0) AS c, CAST(1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 2)) // (g.n + 2 * v.v) AS BIGINT) AS p
           FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
     q AS (SELECT kept.lang, kept.term, CAST(1 + (1000000000::HUGEINT * (x.c + 2)) // (y.n + 2 * v.v) AS BIGINT) AS q
           FROM kept JOIN v USING (lang) JOIN (SELECT lang, term, sum(c) AS c FROM c GROUP BY ALL) x USING (lang, term) JOIN (SELECT lang, sum(n) AS n FROM g GROUP BY lang) y USING (lang)),
     pairs AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
     f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
     r AS (SELECT lang, source, 'pair' AS part, item, CAST(coalesce(f, 0) AS BIGINT) AS value FROM pairs LEFT JOIN f USING (lang, source, item)
           UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r
QUALIFY part = 'pair' OR rank <= 10
"""
