"""Divergence audit, fill-in-middle and pivot search against plain counterparts, on odd rows too."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import fill_in_middle, html_extraction, pivot_search, source_divergence
from tidemark.llm.common import read_table

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " \n\t ", "<P>x", "é", "Ünï çödé 漢字 a<b", "x" * 70_000, "word " * 30_000, "a1b2c3" * 2_000, "same same", "same same", "tail\n", "😀 smile 😀\x00nul", "a" * 900 + "." * 900 + "b c " * 400]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(20_000 + i, t, None if i % 4 == 0 else "en", None if i % 3 else "src0") for i, t in enumerate(ODD)]
    rows += [(None, "no id <S at> all", "xx", "only"), (None, "", "xx", "other"), (20_001, "twice", "en", "src0")]
    extra = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    some = read_table(spark, SF, "documents").select("doc_id", "text", "lang", "source")
    return some.unionByName(extra).withColumns({"n": F.lit("clash"), "value": F.lit(1), "row": F.lit(2)}).repartition(3).cache()


def _plain_divergences(rows, least, top):
    count, held = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    groups = sorted({(r.lang or "", r.source or "") for r in rows})
    for r in rows:
        words = TERM.findall((r.text or "").translate(LOWER))
        count[r.lang or "", r.source or ""].update(words)
        held[r.lang or ""].update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in held[lang].items() if n >= least]
        own = [g for g in groups if g[0] == lang]
        n = {g: sum(count[g][t] for t in kept) for g in own}
        p = {g: {t: 1 + 10**9 * (count[g][t] + 2) // (n[g] + 2 * len(kept)) for t in kept} for g in own}
        q = {t: 1 + 10**9 * (sum(count[g][t] for g in own) + 2) // (sum(n.values()) + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for g in own:
            pairs = [(-sum(f(p[g][t], p[h][t]) for t in kept), h[1]) for h in own if h != g]
            terms = [(-f(p[g][t], q[t]), t) for t in kept if count[g][t] > 0 and p[g][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (x[0], x[1].encode()))[: None if part == "pair" else top]
                out += [(*g, part, item, -v, i + 1) for i, (v, item) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("shard_terms", [8192, 7])
def test_divergences(docs, shard_terms):
    got = source_divergence.divergences(docs, least_docs=10, shard_terms=shard_terms)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == _plain_divergences(docs.collect(), 10, 10)


def test_divergences_of_nothing_and_of_a_hot_source(spark, docs):
    assert source_divergence.divergences(docs.limit(0)).count() == 0
    rng = random.Random(5)
    rows = [("en", f"s{min(3, rng.randrange(12))}", " ".join(f"w{chr(97 + rng.randrange(26))}" for _ in range(rng.randrange(30)))) for _ in range(900)]
    hot = spark.createDataFrame(rows, "lang string, source string, text string").repartition(7)
    assert sorted(map(tuple, source_divergence.divergences(hot, least_docs=2).collect())) == _plain_divergences(hot.collect(), 2, 10)


def test_partial_counts_leave_a_task_when_many(docs, monkeypatch):
    want = sorted(map(str, source_divergence.term_counts(docs).select("lang", "term", "docs", F.array_sort("by")).collect()))
    monkeypatch.setattr(source_divergence, "HELD", 50)
    assert sorted(map(str, source_divergence.term_counts(docs).select("lang", "term", "docs", F.array_sort("by")).collect())) == want


def test_scaled_shares_are_exact():
    rng = random.Random(1)
    total = np.array([rng.randrange(1, 9 * 10**15) for _ in range(2000)], np.int64)
    count = np.array([rng.randrange(int(t) + 1) for t in total], np.int64)
    assert source_divergence.scaled(count, total).tolist() == [1 + 10**9 * int(c) // int(t) for c, t in zip(count, total)]
    with pytest.raises(OverflowError):
        source_divergence.scaled(np.array([1]), np.array([10**16]))


def _tokens(text):
    return re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)


def test_rank_index_is_exact_and_bounded(docs):
    for error in (0, 3, fill_in_middle.ERROR, 5000):
        for r in docs.collect()[-60:]:
            words = _tokens(r.text or "")
            want = np.r_[0, np.cumsum([len(w) for w in words])].astype(np.int64)
            (offsets,) = fill_in_middle.boundaries(__import__("pyarrow").array([r.text or ""]))
            assert offsets.tolist() == want.tolist()
            index = fill_in_middle.RankIndex.fit(offsets, error)
            back = fill_in_middle.RankIndex.from_bytes(index.to_bytes())
            ranks = np.arange(len(words) + 1)
            assert back.at(ranks).tolist() == want.tolist() and back.tokens == len(words)
            assert np.abs(back.predict(ranks) - want).max() <= error + 1


def test_even_text_needs_one_segment():
    assert len(fill_in_middle.RankIndex.fit(np.arange(100_000) * 3).rank) == 1


def test_fill_in_middle(docs, spark):
    rows = docs.collect()
    want = collections.Counter()
    for r in rows:
        text = r.text or ""
        words = _tokens(text)
        h = hashlib.sha256(f"1:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
        a, b = sorted((h1 % (len(words) + 1), h2 % (len(words) + 1)))
        p, m, s = "".join(words[:a]), "".join(words[a:b]), "".join(words[b:])
        form = "plain" if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
        out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want[r.doc_id, len(words), form, *((None, None) if form == "plain" else (len(p), len(m))), sha(out), sha(text)] += 1
        assert fill_in_middle.restored(out, form) == text
    assert collections.Counter(map(tuple, fill_in_middle.digests(docs).collect())) == want
    assert {k[2] for k in want} == {"plain", "psm", "spm"}
    made = fill_in_middle.transformed(docs)
    assert made.columns[: len(docs.columns)] == docs.columns and made.count() == len(rows)
    assert fill_in_middle.digests(docs.limit(0)).count() == 0 and fill_in_middle.rank_index(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fill_in_middle.transformed(docs.withColumn("fim_n", F.lit(1)))
    index = {r.doc_id: fill_in_middle.RankIndex.from_bytes(r.ranks) for r in fill_in_middle.rank_index(docs.where("doc_id < 20000")).collect()}
    assert all(index[r.doc_id].tokens == len(_tokens(r.text or "")) for r in rows if r.doc_id is not None and r.doc_id < 20_000)


def _plain_top(rows, every, k):
    good = []
    for r in rows:
        v = r.embedding
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((r.vec_id, [math.floor(64 * x) for x in v]))
    out = collections.Counter()
    for i, (q, a) in enumerate(good):
        if q is not None and q % every == 0:
            found = sorted(((-sum(x * y for x, y in zip(a, b)), c is None, c or 0) for j, (c, b) in enumerate(good) if j != i))[:k]
            out[q, tuple((rank + 1, None if none else c, -s) for rank, (s, none, c) in enumerate(found))] += 1
    return out


def _got(df):
    rows = collections.defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        rows[r.query_id].append((r.rank, r.vec_id, r.score))
    return rows


def _as_map(plain):
    assert max(plain.values()) == 1
    return {q: list(found) for q, found in plain}


@pytest.mark.parametrize("block", [2048, 16])
def test_pivot_search(spark, block):
    v = read_table(spark, SF, "embeddings")
    hot = v.where("vec_id = 7").select(F.explode(F.sequence(F.lit(9_001).cast("long"), F.lit(9_060).cast("long"))).alias("vec_id"), "embedding", "label")
    odd = spark.createDataFrame([(8000, None, 1), (8020, [], 2), (8040, [None, 1.0], 3), (8060, [float("nan")], 3), (8080, [float("inf"), 0.0], 3), (8100, [0.5, -0.25], 4), (None, [3.0] * 64, 5), (None, [3.0] * 64, 5), (8120, [0.0] * 64, 0)], "vec_id long, embedding array<float>, label int")
    both = v.unionByName(hot).unionByName(odd).withColumns({"row": F.lit("clash"), "data": F.lit("clash"), "cell": F.lit(0)}).repartition(3).cache()
    got = pivot_search.top_products(both, block=block)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert _got(got) == _as_map(_plain_top(both.collect(), 20, 20))


def test_pivot_search_rows_with_one_id_few_rows_and_none(spark):
    v = spark.createDataFrame([(20, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.5, 0.5])], "vec_id long, embedding array<double>")
    got = collections.Counter((r.query_id, r.rank, r.vec_id, r.score) for r in pivot_search.top_products(v).collect())
    assert got == {(20, 1, 20, 4096): 2, (20, 2, 3, 2048): 2}
    assert pivot_search.top_products(v.limit(0)).count() == 0 and pivot_search.top_products(v.where("vec_id = 3")).count() == 0
    assert pivot_search.top_products(v.where("vec_id = 20").limit(1)).count() == 0


def test_pivot_search_prunes_blocks_and_holds_large_values(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8)) * 1e4
    rows = [(i, (centres[i % 6] + rng.normal(size=8)).tolist()) for i in range(600)] + [(1000 + 20 * i, (rng.normal(size=8) * 10.0 ** (3 * i)).tolist()) for i in range(4)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").cache()
    low, high = -(1 << 63), (1 << 63) - 1
    want = {q: [(r, c, min(max(s, low), high)) for r, c, s in found] for q, found in _as_map(_plain_top(v.where("vec_id < 1000").collect(), 20, 20)).items()}
    assert _got(pivot_search.top_products(v.where("vec_id < 1000"), block=32)) == want
    assert _got(pivot_search.top_products(v, block=32)) == _as_map(_plain_top(v.collect(), 20, 20))
    x = pivot_search.integers([r[1] for r in rows[:600]])[1]
    pivots = pivot_search.chosen_pivots(x, 8)
    far, norm = pivot_search.distances(x, pivots), (x * x).sum(1)
    whole = pivot_search.Block(np.arange(600), np.arange(600), np.ones(600, bool), x, norm, far)
    search = pivot_search.Search(whole.take(np.arange(0, 600, 20)), 20)
    search.offer(whole)
    search.settle()
    again = pivot_search.Search(whole.take(np.arange(0, 600, 20)), 20)
    again.best = search.best
    again.offer(whole)
    assert again.seen < search.q.row.size * 600 / 2  # most candidates are never multiplied


def test_caps_are_never_below_the_scores():
    rng = np.random.default_rng(2)
    for scale in (1.0, 64.0, 1e6, 1e12):
        x = np.floor(rng.normal(size=(200, 16)) * scale)
        far = pivot_search.distances(x, pivot_search.chosen_pivots(x, 12))
        gap = np.abs(far[:, None] - far[None]).max(2) * (1 - 1e-9)
        norm = (x * x).sum(1)
        assert (pivot_search.caps(norm[:, None], norm[None], gap) >= x @ x.T).all()


def test_main_text_of_short_and_bare_pages_and_lists_of_links(spark):
    """Pages that are their text and nothing else, hand-written; what is only menus or forms stays empty."""
    prose = "The river rose for three days, and the village moved its boats to the square. Nobody slept much."
    links = [f"The {w} of the valley" for w in "mill bridge church school market tower garden harbour orchard library station archive".split()]
    listed = "".join(f'<li><a href="/{i}">{t}</a></li>' for i, t in enumerate(links))
    pages = {
        1: ("<p>Tiny</p>", "Tiny"),
        2: ("<html><body><p>Tiny</p></body></html>", "Tiny"),
        3: ("plain words, without any tag &amp; more", "plain words, without any tag & more"),
        4: (f"<article><h1>Places to see</h1><p>{prose}</p><p>{prose}</p><ul>{listed}</ul><p>{prose}</p></article>", "\n\n".join(["Places to see", prose, prose, *links, prose])),
        5: ("<nav><a href='/'>Home</a><a href='/x'>More</a></nav>", ""),
        6: ("<form><label>Name</label><input><button>Send</button></form><script>x = 1</script>", ""),
        7: (f"<nav><ul>{listed}</ul></nav><article><p>{prose}</p></article><footer>&copy; 2024 Village press</footer>", prose),
        8: ("<html><head><title>t</title></head><body><h1>Notice</h1><p>Closed on Monday.</p></body></html>", "Notice\n\nClosed on Monday."),
    }
    df = spark.createDataFrame([(k, "u", h) for k, (h, _) in pages.items()], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extraction.extracted(df, html_extraction.fit(read_table(spark, SF, "pages"))).collect()}
    assert got == {k: t for k, (_, t) in pages.items()}
