"""The corpus operators against brute force on small fixtures, with nulls, empty, tied and repeated rows."""

import collections
import hashlib
import html
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import components, fingerprints, html_extraction, id_coder, katz, license_scan, ngram_join, packing, quality_rules, source_mixing, token_output, warc
from tidemark.llm.common import read_table, stored
from tidemark.llm.tokens import Encoder, tokenizer_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    """Documents of the smallest tables and hand-made ones, with a clashing extra column."""
    rng = random.Random(3)
    base = " ".join(rng.choice("abcdefgh") + str(rng.randrange(400)) for _ in range(120))
    words = base.split()
    near = [" ".join(words[:k] + [f"x{k}"] + words[k + 1 :]) for k in (5, 60, 110)]
    made = [None, "", " \n\t ", "one", "One two", base, base, *near, base.upper(), "a b c d e f g\n" * 9, "x" * 5000, "The same line here.\nThe same line here.\nAnother one."]
    extra = spark.createDataFrame([(10_000 + i, t, "en", None if i % 3 else "src0", 7) for i, t in enumerate(made)], "doc_id long, text string, lang string, source string, n_chars long")
    some = read_table(spark, SF, "documents").limit(120)
    return some.unionByName(extra).withColumn("n", F.lit("clash")).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def test_quality_measures_and_decisions(docs, empty):
    got = {r.doc_id: r for r in quality_rules.judged(docs).collect()}
    for k, t in texts(docs).items():
        w = WORD.findall(t)
        seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        twice = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(twice)), k
        failed = len(w) < 20 or 100 * len(twice) > 30 * len(w)
        assert r.base_failed == failed and not (failed and r.kept)
    kept = quality_rules.filtered(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if r.kept}
    assert quality_rules.judged(empty).count() == 0


def _plain_em(votes, rounds=40, prior=0.8):
    """Naive Bayes with two classes and three outcomes a rule, by plain arrays."""
    n, k = votes.shape
    one_hot = np.stack([votes == v for v in (-1, 0, 1)], 2).astype(float)
    good, bad = np.tile(quality_rules.START_GOOD, (k, 1)), np.tile(quality_rules.START_BAD, (k, 1))
    weigh = lambda: 1 / (1 + np.exp(-(np.log(prior / (1 - prior)) + (one_hot * (np.log(good) - np.log(bad))).sum((1, 2)))))
    for _ in range(rounds):
        p = weigh()
        good, bad = ((one_hot * w[:, None, None]).sum(0) + 1 for w in (p, 1 - p))
        good, bad = good / good.sum(1, keepdims=True), bad / bad.sum(1, keepdims=True)
        prior = (p.sum() + 1) / (n + 2)
    return prior, good, bad, weigh()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_quality_model_equals_plain_em(spark, sf):
    d = read_table(spark, f"/root/testdata/{sf}", "documents")
    m = quality_rules.measured(d)
    model = quality_rules.fit(m)
    rows = m.select("doc_id", quality_rules.votes().alias("v"), "_q_base_failed").collect()
    used = [r for r in rows if not r["_q_base_failed"]]
    prior, good, bad, p = _plain_em(np.array([r.v for r in used]))
    assert model.prior == pytest.approx(prior) and np.allclose(model.on_good, good) and np.allclose(model.on_bad, bad)
    want = {r.doc_id: (x, bool(x >= 0.5)) for r, x in zip(used, p)}
    for r in quality_rules.judged(d).collect():
        if not r.base_failed:
            assert (r.quality, r.kept) == (pytest.approx(want[r.doc_id][0], abs=1e-9), want[r.doc_id][1])
    # nothing pins an estimate: each rule's numbers follow what was seen of it
    assert len({round(a, 6) for a, _ in model.accuracies()}) > 3


def test_quality_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    j = quality_rules.judged(read_table(spark, sf, "documents")).where(~F.col("base_failed")).drop("quality").join(read_table(spark, sf, "labels"), "doc_id")
    n = {(r.quality, r.kept): r["count"] for r in j.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) == 0 and n.get((0, True), 0) <= 0.1 * (n.get((0, True), 0) + n[0, False])


@pytest.mark.parametrize("short", [2, 8])
def test_jaccard_join_equals_all_pairs(docs, empty, short, monkeypatch):
    monkeypatch.setattr(ngram_join, "SHORT", short)
    got = {r.doc_id: r for r in ngram_join.components(docs).collect()}
    sets = {}
    for k, t in texts(docs).items():
        w = WORD.findall(t.translate(LOWER))
        sets[k] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} - {()}
    up = {k: k for k in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == {k: (len(s), top(k)) for k, s in sets.items()}
    left = ngram_join.deduplicated(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {top(k) for k in sets}
    assert ngram_join.components(empty).count() == 0


def test_jaccard_join_of_a_split_group_and_shared_ids(spark, monkeypatch):
    """A large group around the limit, its cells cut into many blocks; rows that share a doc_id; null ids and repeats."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "SHORT", 2)
    monkeypatch.setattr(ngram_join, "FREQUENT", 8)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(90)]
    rows = []
    for i in range(160):
        w = base.copy()
        for _ in range(rng.choice((0, 1, 1, 2, 3))):
            w[rng.randrange(90)] = f"e{rng.randrange(10**6)}"
        rows.append((1000 + i, " ".join(w)))
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "xyz")
    rows += [(1, a), (5, a), (5, b), (3, b), (5, b), (None, c), (8, c), (None, "alone in the world of all words"), (9, ""), (9, a)]
    got = ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = [(k, frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3))) for k, w in ((k, t.split()) for k, t in rows)]
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (k, x) in enumerate(sets):
        for j, (m, y) in enumerate(sets[:i]):
            if (k is not None and k == m) or (x and y and 100 * len(x & y) >= 85 * len(x | y)):
                up[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (k, _) in enumerate(sets):
        if k is not None:
            least[top(i)] = min(k, least.get(top(i), k))
    want = sorted((repr(k), len(x), repr(least.get(top(i)))) for i, (k, x) in enumerate(sets))
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in got) == want


@pytest.mark.parametrize("members", [2000, 2_000_000])
def test_jaccard_join_sends_no_pairs_of_sets_near_the_limit(spark, members, monkeypatch):
    """Sets whose pairs all lie just below the limit: each is sent on once, not each pair; links among them are found."""
    monkeypatch.setattr(ngram_join, "MEMBERS", members)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(80):  # 197 shingles; four of them differ for each changed word, and four changed words are one too many
        w = base.copy()
        for at in (10 + 2 * i, 199 - 10 - i) if i % 10 else (10 + 2 * i,):
            w[at] = f"e{i}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    none = np.empty(0, np.uint64)
    sig = ngram_join.signatures(docs, none, none, 0).cache()
    cells = sig.select(F.lit(1).cast("long").alias("cell"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "node", "n", F.col("node").alias("component"), "bitmap")
    found = ngram_join.block_pairs(cells).cache()
    if members > 100_000:
        assert 0 < found.count() <= len(rows)
    pairs = {(r.a, r.b) for r in ngram_join.exact_pairs(found, ngram_join.whole_sets(docs, sig, sig.select("node"), "test")).collect()} | {(r.node, r.b) for r in found.where("side = -1").collect()}
    names = {r.node: r.doc_id for r in sig.collect()}
    sets = {k: {tuple(w[i : i + 4]) for i in range(len(w) - 3)} for k, w in ((k, t.split()) for k, t in rows)}
    link = lambda a, b: 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    pairs = {(names[a], names[b]) for a, b in pairs}
    assert all(link(a, b) for a, b in pairs)
    joined = lambda some: {r.node: r.component for r in components.connected_components(spark.createDataFrame(sorted(some), "a long, b long")).collect()}
    assert joined(pairs) == joined({(a, b) for a in sets for b in sets if a < b and link(a, b)})


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(e).collect()}
    assert got == {**{i: 0 for i in range(201)}, 400: 400, 500: 400}


def test_packing_covers_every_id_once(docs, empty):
    e = Encoder(tokenizer_path("byte_bpe_50k.json"), True)
    ids = {k: np.array(e.tokenizer.encode(t, add_special_tokens=False).ids + [1], "<u4") for k, t in texts(docs).items()}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.packed(docs).collect():
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))

    def gapless(spans):
        at = 0
        for a, n in sorted(spans):
            assert a == at and n > 0
            at += n
        return at

    assert {k: gapless(v) for k, v in pieces.items()} == {k: len(v) for k, v in ids.items()}
    sizes = [gapless(v) for v in sequences.values()]
    assert max(sizes) <= 2048 and all(n == 2048 or n & (n - 1) == 0 for n in sizes)
    assert packing.packed(empty).count() == 0


def test_packing_neighbours_equal_brute_force_bm25():
    rng = np.random.default_rng(2)
    docs = [rng.zipf(1.3, n) % 500 for n in (1, 3, 40, 40, 90, 200, 7, 7, 1000, 60, 0)]
    docs += [docs[4].copy(), np.r_[docs[5][:150], docs[3]]]
    docs = [d.astype("<u2") for d in docs]
    df = np.zeros(1 << 16)
    for d in docs:
        df[np.unique(d)] += 1
    idf = np.where(df > 0, np.log(1 + (len(docs) - df + 0.5) / (df + 0.5)), 0)
    mean = np.mean([len(d) for d in docs])
    shard = packing._Shard(docs, idf, mean)
    shard.free[[2, 9]] = False
    for seed, q in enumerate(docs):
        score = {}
        for i, d in enumerate(docs):
            tf = collections.Counter(d.tolist())
            s = sum(idf[t] * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in set(q.tolist()) if tf[t])
            if s > 0 and shard.free[i]:
                score[i] = s
        got = shard.neighbours(seed).tolist()
        assert set(got) == set(score) and all(score[a] >= score[b] - 1e-9 for a, b in zip(got, got[1:]))


def test_packing_weighs_many_documents_at_once():
    rng = np.random.default_rng(4)
    docs = [(rng.zipf(1.3, n) % 65_536).astype("<u2") for n in (5, 1, 300, 0, 40, 2000)]
    idf = rng.random(1 << 16).astype(np.float32)
    owner, t, w = packing._weights(docs, idf, 90.0)
    for i, d in enumerate(docs):
        ids, tf = np.unique(d, return_counts=True)
        assert (t[owner == i] == ids).all() and np.allclose(w[owner == i], idf[ids] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / 90.0)))
    shard = packing._Shard(docs, idf, 90.0)
    assert [q.tolist() for q in shard.query] == [np.unique(d).tolist() for d in docs]


def test_token_output_round_trip(docs, empty):
    e = Encoder(tokenizer_path("word_bpe_49k.json"), False)
    got, at = {r.doc_id: r for r in token_output.round_trip(docs).collect()}, 0
    for k, t in sorted(texts(docs).items()):
        ids = np.array(e.tokenizer.encode(t, add_special_tokens=False).ids + [2], "<u4")
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_output.round_trip(empty).count() == 0
    odd = docs.sparkSession.createDataFrame([(None, "b c"), (None, None), (3, "x"), (3, "a"), (2, "word " * 30_000)], "doc_id long, text string")
    rows = sorted(token_output.round_trip(odd).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, None, 2, 3, 3] and [r.n_tokens for r in rows][0] == 1
    assert [r.start for r in rows] == np.r_[0, np.cumsum([r.n_tokens for r in rows])][:-1].tolist()
    segments = token_output.encoded(odd).collect()
    cut = docs.sparkSession.createDataFrame([(r.part, bytearray(r.bytes[:60]) + bytearray([r.bytes[60] ^ 1]) + bytearray(r.bytes[61:])) for r in segments], "part int, bytes binary")
    with pytest.raises(Exception, match="BrokenBlock|checksum|Error"):
        token_output.decoded(cut).collect()


@pytest.mark.parametrize("n", [0, 1, 2047, 2048, 2049, 30_000])
def test_id_coder(n):
    rng = np.random.default_rng(n)
    x = np.concatenate([rng.zipf(1.4, n) % 49_408, np.full(min(n, 500), 7)])
    data = id_coder.encode_segment(x, own=b"of the writer")
    assert (id_coder.decode_segment(data) == x).all() and id_coder.own_bytes(data) == b"of the writer"
    last = -(-len(x) // 2048) - 1
    for which in ([0], [last], [0, last]):
        if n:
            blocks = id_coder.decode_blocks(data, sorted(set(which)))
            assert all((b == x[i * 2048 : (i + 1) * 2048]).all() for b, i in zip(blocks, sorted(set(which)), strict=True))
    if n > 2048:
        broken = bytearray(data)
        broken[-40] ^= 255
        with pytest.raises(id_coder.BrokenBlock):
            id_coder.decode_segment(bytes(broken))
        assert (id_coder.decode_blocks(bytes(broken), [0])[0] == x[:2048]).all()  # another block's damage is not its own
        broken = bytearray(data)
        broken[40] ^= 255
        with pytest.raises(id_coder.BrokenBlock):
            id_coder.own_bytes(bytes(broken))


def test_id_coder_adapts_to_a_block():
    """Ids that are rare in the segment and common in a block cost less than the segment's entropy says."""
    rng = np.random.default_rng(1)
    x = np.concatenate([1000 + 40 * i + rng.integers(0, 40, 2048) for i in range(64)])
    share = np.bincount(x) / len(x)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    data = id_coder.encode_segment(x)
    assert (id_coder.decode_segment(data) == x).all() and 8 * len(data) / len(x) < 0.65 * entropy


@pytest.mark.parametrize("file, spaced", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_cached_units_give_the_tokenizers_ids(file, spaced):
    e = Encoder(tokenizer_path(file), spaced)
    odd = ["", " a  b\n c ", "it's  ok", "x ́y 12 3", "<|endoftext|> hi", "tail \n", "\x1ca b\x1c c", "♥ a ♥", "À́ b", "a b c d"]
    for _ in range(2):
        ids, begins = e.encode(odd)
        for i, t in enumerate(odd):
            assert ids[begins[i] : begins[i + 1]].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, t
        e._forget()


def test_fingerprints_estimate_likeness(docs, empty):
    rows = {r.doc_id: r for r in fingerprints.edited_likeness(docs, rows_per_range=20).collect()}
    t = texts(docs)
    ids = sorted(t)

    def shingles(x):
        w = WORD.findall(x.translate(LOWER))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    def likeness(a, b):
        return len(a & b) / len(a | b) if a or b else 1.0

    for i, k in enumerate(ids):
        nxt, half = t[ids[(i + 1) % len(ids)]], len(t[k]) // 2
        edited = t[k][: len(t[k]) - half] + nxt[:half]
        r = rows[k]
        assert r.n_chars == len(t[k]) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - likeness(shingles(t[k]), shingles(edited))) < 0.13 and abs(r.near_next - likeness(shingles(t[k]), shingles(nxt))) < 0.13
    by_text = collections.defaultdict(set)
    for k, r in rows.items():
        by_text[t[k]].add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert fingerprints.edited_likeness(empty).count() == 0
    whole = fingerprints.merged_by(docs.withColumn("all", F.lit("x")), "all").first()
    assert whole.fingerprint == fingerprints.to_text(fingerprints.sketch(np.unique(np.concatenate([fingerprints.sketch(x) for x in map(fingerprints.from_text, (r.fingerprint for r in rows.values()))]))))


def test_mixing_stays_within_a_block(spark, docs, empty):
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 6, "hot").when(F.col("id") % 10 < 9, "b").alias("source"), F.lit("t").alias("text"))
    target = {"hot": 0.5, "b": 0.3, None: 0.2}
    rows = sorted(source_mixing.schedule(d, target, block_rows=1, slots=10, shard_rows=100).collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(3000)) and len({r.doc_id for r in rows}) == 3000
    seen = collections.Counter()
    for i, r in enumerate(rows[:1400]):  # until the first source runs out
        seen[r.source] += 1
        assert all(abs(seen[s] - (i + 1) * w) < 1 for s, w in target.items())
    m = source_mixing.mixed(docs)
    assert m.columns == docs.columns and sorted(r.doc_id for r in m.collect()) == sorted(texts(docs))
    assert source_mixing.schedule(empty).count() == 0 and source_mixing.mixed(empty).count() == 0


@pytest.mark.parametrize("order", [2, 3])
def test_katz_scores_and_normalisation(docs, empty, order, monkeypatch):
    monkeypatch.setattr(katz, "CHUNK_TOKENS", 5000)
    more = docs.sparkSession.createDataFrame([(None, "one two one two", "clash")] + [(20_000 + i, "one two three", "clash") for i in range(9)], "doc_id long, text string, n string")
    docs = docs.select("doc_id", "text", "n").unionByName(more)
    model = katz.fitted(docs, order)
    got = {r.doc_id: r for r in katz.scored(docs, order).collect()}
    again = {r.doc_id: r for r in model.scored(docs).collect()}
    tokens = {k: [*WORD.findall(t.translate(LOWER)), "</s> "] for k, t in texts(docs).items()}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in tokens}
    grams = lambda t, n: zip(*[["<s> "] * (n - 1 - i) + t[: len(t) - (n - 1 - i)] for i in range(n)])
    counts = {n: collections.Counter() for n in range(1, order + 1)}
    for k, t in tokens.items():
        for n, c in counts.items():
            if not held[k]:
                c.update(grams(t, n))
    total, known = sum(counts[1].values()), len(counts[1])
    tables = {n: katz.discounted(np.array([sum(v == i for v in c.values()) for i in range(1, katz.MOST + 2)])) for n, c in counts.items()}
    star = lambda n, t: n - 0.5 if n > katz.MOST else t[n]
    unknown = 1 - sum(star(v, tables[1]) for v in counts[1].values()) / total
    seen, mass, lower = collections.Counter(), collections.Counter(), collections.Counter()

    def p(gram):
        n, h = len(gram), gram[:-1]
        if n == 1:
            return star(counts[1][gram], tables[1]) / total if counts[1][gram] else unknown
        if counts[n][gram]:
            return star(counts[n][gram], tables[n]) / seen[h]
        return (1 - mass[h] / seen[h]) / (1 - lower[h]) * p(gram[1:]) if seen[h] else p(gram[1:])

    for n in range(2, order + 1):
        for gram, r in counts[n].items():
            seen[gram[:-1]] += r
            mass[gram[:-1]] += star(r, tables[n])
            lower[gram[:-1]] += p(gram[1:])
    for h in [x for x in seen if len(x) == order - 1][:5]:
        assert sum(p((*h, *w)) for w in counts[1]) + p((*h, "never seen")) == pytest.approx(1)
    for k, t in tokens.items():
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(t), sum(counts[1][w,] > 0 for w in t), total)
        assert r.base_score == pytest.approx(sum(np.log10((counts[1][w,] + 1) / (total + known + 1)) for w in t))
        assert r.score == pytest.approx(sum(np.log10(p(g)) for g in grams(t, order)))
        assert (again[k].score, again[k].n_known) == (pytest.approx(r.score), r.n_known)
    assert katz.scored(empty).count() == 0 and katz.scored(docs.where("doc_id is null").withColumn("text", F.lit(None).cast("string"))).count() == 1


def test_katz_messages_do_not_grow_with_parts(docs, spark, monkeypatch):
    """Twice the parts cut the same keys and answers into more messages, and add none."""
    monkeypatch.setattr(katz, "CHUNK_TOKENS", 5000)
    chunks = katz.stored(katz.chunked(docs), "test-chunks")
    sent = []
    for parts in (4, 8):
        rows = katz._kind(katz._counted(chunks, 2, parts), "answer").collect()
        sent.append(sum(len(katz._unpack(r.data)[0]) for r in rows))
    assert sent[0] == sent[1]


def test_katz_weights_go_only_where_an_ngram_is_unseen(docs, monkeypatch):
    monkeypatch.setattr(katz, "CHUNK_TOKENS", 5000)
    model, chunks, answers = katz._fitted(docs, 2)
    held = collections.defaultdict(list)
    for r in katz._together(chunks, answers).collect():
        held[r.place].append((r.kind, r.part, r.data))
    for rows in held.values():
        chunk, got = katz._opened(sorted(rows))
        unseen = got["gram", 2][0][katz._dealt(chunk.grams(2), model.parts)[2]] == 0
        asked = set(katz._dealt(chunk.histories(2), model.parts)[2][unseen].tolist())
        weight = got["history", 2][1]
        assert len(asked) < len(weight) and set(np.flatnonzero(weight).tolist()) <= asked


@pytest.fixture(scope="module")
def license_model(spark):
    return license_scan.fit(read_table(spark, "/root/testdata/sf0.01", "documents"))


def test_license_lines_are_found(spark, docs, empty, license_model):
    d = read_table(spark, "/root/testdata/sf0.01", "documents")
    found = {(r.doc_id, r.family) for r in license_scan.scanned(d, license_model).collect()}
    wanted = {"Licensed under the Apache License, Version 2.0.": "apache-2.0", "Released under the MIT License.": "mit", "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0", "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0", "All rights reserved.": "proprietary"}
    expected = {(r.doc_id, wanted[x]) for r in d.collect() for x in (r.text or "").split("\n") if x in wanted}
    assert found == expected and license_scan.scanned(empty, license_model).count() == 0 and license_scan.scanned(docs, license_model).count() >= 0


#: Notices as files have them, wrapped and inside other text.
_NOTICES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software",
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:",
    "gpl-3.0": "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n    the Free Software Foundation, either version 3 of the License, or\n    (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
    "apache-2.0": "// you may not use this file except in compliance with the License.\n// You may obtain a copy of the License at\n//\n//     http://www.apache.org/licenses/LICENSE-2.0",
}


def test_license_notices_as_files_have_them(spark, license_model):
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(2, 9))) for _ in range(n))
    rows, want = [], set()
    for i, (family, notice) in enumerate(_NOTICES.items()):
        for k, text in enumerate((notice, f"{prose(30)}\n\n{notice}\n\n{prose(30)}", f"{prose(90)} {notice} {prose(90)}", f"# SPDX-License-Identifier: {dict(mit='MIT', bsd='BSD-3-Clause', isc='ISC').get(family, 'GPL-3.0-only' if family == 'gpl-3.0' else 'Apache-2.0')}\nint main;")):
            rows.append((100 * i + k, text))
            want.add((100 * i + k, family))
    rows += [(None, "Licensed under the MIT license."), (7000, "This software is distributed under the MIT License, as is."), (7001, "Licensed under the MIT license.\n" * 3), (7001, "Licensed under the MIT license.\n" * 3)]
    clean = [None, "", "\n\n", prose(4000), "He lost his license under the bridge, and the software was of no use to the public.", "The rights of all are reserved for the brave and free.", "mit license granted permission the copy of any charge free software obtaining person", "You can use this work in any form that you like. The source is the general public."]
    rows += [(8000 + i, t) for i, t in enumerate(clean)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit("clash"))
    found = license_scan.scanned(df, license_model).collect()
    got = {(r.doc_id, r.family) for r in found}
    assert want <= got and {(None, "mit"), (7000, "mit"), (7001, "mit")} <= got
    assert sum(r.doc_id == 7001 for r in found) == 2 and not [x for x in got if (x[0] or 0) >= 8000]
    assert not {(k, f) for k, f in got if k is not None and k < 1000 and (k, f) not in want}
    assert next(r.line for r in found if r.doc_id == 1) == 2


#: Notices of close relatives, as files have them; None: no family of the scan.
_RELATIVES = (
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version."),
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published\nby the Free Software Foundation, either version 3 of the License"),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or\nmodify it under the terms of the GNU General Public License\nas published by the Free Software Foundation; either version 2\nof the License, or (at your option) any later version."),
    ("apache-1.1", "The Apache Software License, Version 1.1\n\nCopyright (c) 2000 The Apache Software Foundation.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"),
    ("apache-1.1", "/* ====\n * The Apache Software License, Version 1.1\n *\n * Copyright (c) 2000 The Apache Software Foundation.  All rights\n * reserved.\n *\n * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:"),
    ("cc-by-nc-sa-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("epl-2.0", "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("boost-1.0", "Distributed under the Boost Software License, Version 1.0.\n(See accompanying file LICENSE_1_0.txt)"),
    ("eupl-1.2", "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL"),
    ("zlib", "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file"),
    ("mit", "MIT License\n\nCopyright (c) 2020 Somebody"),
    ("mit", "MIT License"),
    ("mit", "Name: thing\nVersion: 2.1\nLicense: MIT\nAuthor: somebody"),
    (None, "The hotel had all rooms reserved and the rights of guests were posted."),
    (None, "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."),
    (None, "This file is part of the Qt toolkit and may be distributed under the terms of the Q Public License version 1.0."),
    (None, "Licensed under the Apache License, Version 1.0"),
    (None, "The contents of this file are subject to the Netscape Public License Version 1.1"),
    (None, "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Library General Public\nLicense as published by the Free Software Foundation; either\nversion 2 of the License"),
    (None, "You may use this software under the terms of the license that the public library of the city keeps, version 2 or 3 of the form, if you like."),
    (None, "She got a license from MIT and the copy was free of charge to any person."),
    (None, "All rooms have a general right to be reserved by the public. License plates of all cars are registered under the act of 1934."),
    (None, "He put the MIT license on the wall and left it there"),
)


def test_license_relatives_are_told_apart_and_others_are_unknown(spark, license_model):
    # each notice alone, and far inside a long paragraph of words that no notice has
    inside = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam " * 9
    rows = [(i, t) for i, (_, t) in enumerate(_RELATIVES)] + [(1000 + i, f"{inside}\n{t}\n{inside}") for i, (_, t) in enumerate(_RELATIVES)]
    found = license_scan.scanned(spark.createDataFrame(rows, "doc_id long, text string"), license_model).collect()
    got = {i: {r.family for r in found if r.doc_id == i} - {"proprietary"} for i, _ in rows}  # "All rights reserved" is a finding of its own
    want = {i + at: {f} if f else set() for at in (0, 1000) for i, (f, _) in enumerate(_RELATIVES)}
    assert {i: x for i, x in got.items() if x != want[i]} == {}


def test_license_numbers_and_names_of_a_template_are_needed():
    assert license_scan.needed_pairs("licensed under cc by nc sa 4 0") == {"cc by", "by nc", "nc sa", "sa 4", "4 0"}
    for ts in license_scan.TEMPLATES.values():
        for t in ts:
            assert license_scan.needed_pairs(t) <= license_scan._pairs(t)


def test_license_windows_without_a_key_pair_are_never_confirmed():
    keys = license_scan.key_pairs(0.7)
    for ts in license_scan.TEMPLATES.values():
        for t in ts:
            own, need = license_scan._pairs(t), license_scan.needed_pairs(t)
            without = own - keys  # the most that a window without a key has of this template
            assert not need <= without or len(without) < 0.7 * len(own)
    for ts in license_scan.TITLES.values():
        assert all(license_scan._pairs(t) & keys for t in ts)


def test_license_windows_passed_over_change_no_result(spark, license_model):
    d = read_table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    d = d.unionByName(spark.createDataFrame([(10**9 + i, t) for i, (_, t) in enumerate(_RELATIVES)], "doc_id long, text string"))
    short, every = (license_scan.windows_of(d, n).withColumn("terms", license_scan._terms()) for n in (license_scan.needed_words(), 0))
    columns = lambda w: license_scan._confirmed_windows(w, license_model, license_scan.OVERLAP).select("doc_id", "paragraph", "at", "family", "overlap")
    assert sorted(map(tuple, columns(short).collect())) == sorted(map(tuple, columns(every).collect())) != []


def test_license_words_needed_are_a_lower_bound():
    need = license_scan.needed_words()
    assert need >= 1
    for ts in license_scan.TEMPLATES.values():
        for t in ts:
            own = set(t.split())
            assert len(own & set(license_scan.TELLING)) - (len(own) - -(-7 * len(own) // 10)) >= need


@pytest.fixture(scope="module")
def text_model(spark):
    return html_extraction.fit(read_table(spark, SF, "pages"))


def _plain_article(page):
    """The blocks of the only article of a synthetic page, by regular expressions alone."""
    inner = re.search(r"<article>(.*?)</article>", page or "", re.S)
    blocks = re.split(r"</?(?:h1|p)>", inner[1].replace("<br>", " ")) if inner else []
    return "\n\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in blocks) if x)


def test_main_text(spark, text_model):
    pages = read_table(spark, SF, "pages")
    long = "".join(f"<p>It was the {i}th of the days, and so they went on.</p>" for i in range(20_000))
    odd = [(-1, None, None), (-2, "u", ""), (-3, "u", "<p"), (-4, "u", "x < y &amp; z"), (-5, "u", "<main><h1>Title</h1><p>Some   text,\nthat goes on and on. Yes.</p></main><aside>Buy now</aside><div class='comments'><p>I liked it. Great.</p></div>"), (None, "u", "<p>"), (-6, "u", f"<nav><a href=x>Home</a></nav><article>{long}</article>")]
    both = pages.unionByName(spark.createDataFrame([*odd, *odd[:2]], "page_id long, url string, html string")).withColumn("text", F.lit("clash"))
    rows = html_extraction.extracted(both, text_model).collect()
    got = {r.page_id: r for r in rows}
    assert len(rows) == both.count() and got[-1].text == "" and got[-2].n_chars == 0
    assert got[-5].text == "Title\n\nSome text, that goes on and on. Yes."
    assert got[-6].text.count("\n\n") == 19_999 and "Home" not in got[-6].text
    for r in pages.collect():
        assert (got[r.page_id].text, got[r.page_id].n_chars) == (want := _plain_article(r.html), len(want)), r.page_id
    assert html_extraction.extracted(pages.limit(0), text_model).count() == 0


def test_main_text_on_held_out_plans(text_model):
    """Pages of other plans, with attribute words of their kind and with none that training has seen."""

    def texts_of(page):
        nodes, rows = html_extraction.features(html_extraction.parse(page), text_model.evidence)
        return html_extraction.decode(nodes, text_model.score(np.array(rows))), "\n\n".join(x.text for x in nodes if x.tag == "#text" and x.label)

    words = [f"{a}{b}" for a in ("vor", "lim", "sta", "ert") for b in ("an", "o", "ing", "u", "es")]
    for telling, least in ((0.6, 0.93), (0.0, 0.9)):
        precision, recall, pages = 0.0, 0.0, html_extraction.training_pages(words, 200, seed=99, telling=telling)
        for page in pages:
            got, want = (collections.Counter(t.split()) for t in texts_of(page))
            both = sum((got & want).values())
            precision += both / max(1, sum(got.values())) / len(pages)
            recall += both / max(1, sum(want.values())) / len(pages)
        assert precision > least and recall > least, (telling, precision, recall)


def test_main_text_does_not_follow_names_alone(text_model):
    body = "<p>Then the others came along and it was good to see them, after all.</p>" * 9

    def text_of(page):
        nodes, rows = html_extraction.features(html_extraction.parse(page), text_model.evidence)
        return html_extraction.decode(nodes, text_model.score(np.array(rows)))

    assert text_of(f"<nav><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></nav><div class='blog-share-post'>{body}</div><footer>&copy; site</footer>").count("others came along") == 9
    assert text_of(f"<article><h1 class='header'>A heading of it</h1>{body}</article>").startswith("A heading of it")
    said = text_of(f"<div class='zzmenue'><a href=a>Start</a> <a href=b>Themen</a> <a href=c>Kontakt</a></div><div class='inhalt'>{body}</div><div class='kommentare'><div><b>Hans</b><p>Das finde ich gut.</p><a href=r>Antworten</a></div><div><b>Eva</b><p>Ich auch. Danke.</p><a href=r>Antworten</a></div></div>")
    assert "Start" not in said and "Hans" not in said and said.count("others came along") == 9


@pytest.mark.parametrize("sent, opened", [(1_000_000, 1000), (0, 0)])
def test_archives_and_index(spark, sent, opened, monkeypatch):
    monkeypatch.setattr(warc, "MOST_SENT", sent)
    monkeypatch.setattr(warc, "MOST_OPENED", opened)
    html = "<p>" + "long enough to be shared " * 9
    rows = [(5, "http://b.example.com/x?q=1", html), (3, "https://B.example.com:80/x", html), (9, None, html), (1, "http://a.org", "short"), (2, "http://a.org/", "short"), (4, "http://a.org/n", None), (7, "http://c.net/w", "WARC/1.0\r\n\r\nContent-Length: 3\r\n\r\n\xe9"), (11, "http://d.net/", "a very long page " * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("clash"))
    path, index = warc.archived(pages)
    got = {r.page_id: r for r in warc.read_back(spark, path, index).collect()}
    for k, _, h in rows:
        data = (h or "").encode()
        kind = "revisit" if k in (5, 9) else "response"
        assert (got[k].payload_bytes, got[k].payload_digest, got[k].record_type, got[k].refers_to) == (len(data), hashlib.sha256(data).hexdigest(), kind, 3 if kind == "revisit" else None)
        assert kind == "revisit" or got[k].payload == (h or "")
    assert {r.page_id for r in warc.lookup(spark, path, index, ["http://b.example.com/x", "http://nowhere.io/"]).collect()} == {3}
    assert {r.page_id for r in warc.lookup(spark, path, index, ["http://a.org/"]).collect()} == {1, 2}
    assert warc.lookup(spark, path, index, ["http://nowhere.io/"]).count() == 0 and warc.lookup(spark, path, index, []).count() == 0
    path, index = warc.archived(pages.limit(0))
    assert warc.read_back(spark, path, index).count() == 0


def test_records_are_read_back_through_the_directory(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "PAGE_BLOCKS", 2)
    rows = [(i, f"http://a{i % 7}.org/{i // 2}", f"text {i}") for i in range(200)] + [(900 + i, "http://same.org/", f"copy {i}") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = warc.write_archives(pages)
    index = warc.write_index(warc.captures(spark, path), 8)
    assert sorted(r.page_id for r in warc.read_back(spark, path, index, pages).collect()) == sorted(r[0] for r in rows)
    some = pages.where("page_id % 9 = 4 OR page_id = 905")
    urls = {r.url for r in some.collect()}
    assert sorted(r.page_id for r in warc.read_back(spark, path, index, some).collect()) == sorted(i for i, u, _ in rows if u in urls)
    # what the directory does not name is not found, though its block is there
    directory, blocks = spark.read.parquet(f"{index}/directory"), spark.read.parquet(f"{index}/blocks")
    less = f"{tmp_path}/less"
    directory.where("page = 0").write.parquet(f"{less}/directory")
    blocks.write.parquet(f"{less}/blocks")
    named = blocks.where("block < 2").agg(F.sum("lines")).first()[0]
    assert 0 < warc.read_back(spark, path, less, pages).count() == named < len(rows)


def test_archives_with_spills_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 16)
    monkeypatch.setattr(warc, "PAGE_BLOCKS", 3)
    pages = read_table(spark, "/root/testdata/sf0.01", "pages").select("page_id", "url", "html")
    odd = spark.createDataFrame([(None, None, None)] * 3 + [(None, "u", "x" * 200)] * 2 + [(900_000, "u", "x" * 200)] * 2 + [(900_001, "v", "x" * 200)], "page_id long, url string, html string")
    pages = pages.unionByName(odd)
    conf, key = spark.sparkContext._jsc.sc().conf(), "spark.shuffle.spill.numElementsForceSpillThreshold"
    conf.set(key, "20")
    try:
        path = warc.write_archives(pages, archive_bytes=50_000)
        index = warc.write_index(warc.captures(spark, path), 16)
        got = warc.read_back(spark, path, index).collect()
    finally:
        conf.remove(key)
    assert len(got) == pages.count()
    whole = {r.page_id: r.html or "" for r in pages.collect() if r.page_id is not None and r.page_id < 900_000}
    assert all(r.payload in (None, whole[r.page_id]) for r in got if r.page_id in whole)
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got if r.page_id not in whole) == sorted([(0, "response", None)] * 3 + [(0, "revisit", 900_000)] * 2 + [(900_000, "response", None)] * 2 + [(900_001, "revisit", 900_000)])
    some = pages.where("page_id % 40 = 3").collect()
    urls = {r.url for r in some}
    found = {r.page_id for r in warc.lookup(spark, path, index, sorted(urls)).collect()}
    assert {r.page_id for r in some} <= found


def test_pipeline_stages_follow_each_other(spark):
    import corpus_pipeline

    docs = read_table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
        docs = out
    n = sum(r.length for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect())
    e = Encoder(tokenizer_path("byte_bpe_50k.json"), True)
    assert n == sum(len(e.tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())


def test_pipeline_sequences_follow_the_mixture(spark, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(packing, "SHARD_DOCS", 50)
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(40)), "en", "few" if i % 17 == 0 else "many", 0) for i in range(1700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    def packed():
        pieces = sorted(corpus_pipeline.packing_stage(spark, docs, SF).collect(), key=lambda r: (r.sequence_id, r.offset))
        return list(dict.fromkeys(r.doc_id for r in pieces))

    spark.conf.unset(corpus_pipeline.MIXTURE)
    without = packed()
    assert sorted(r.doc_id for r in corpus_pipeline.mixing_stage(spark, docs, SF).collect()) == list(range(1700))
    order = packed()
    spark.conf.unset(corpus_pipeline.MIXTURE)
    assert len(order) == len(without) == 1700 and order != without
    # weights by the square roots of 100 and 1,600 rows: one in five, until the 100 are used up
    few = 0
    for i, k in enumerate(order[:400]):
        few += k % 17 == 0
        assert abs(few - (i + 1) / 5) <= source_mixing.BLOCK_ROWS + 50 / 5


def test_pipeline_on_odd_rows_and_none(spark, docs):
    """Nulls, repeated rows, a long text, clashing columns; an empty table."""
    import corpus_pipeline

    long = " ".join(f"w{i % 9973}q" for i in range(120_000))
    odd = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame([(None, "no id at all " * 30, None, None, None), (77_000, long, "en", "src0", 1), (77_000, long, "en", "src0", 1)], "doc_id long, text string, lang string, source string, n_chars long"))
    odd = odd.withColumns({"position": F.lit("clash"), "ids": F.lit("clash"), "n": F.lit(0)})
    for rows in (odd, odd.limit(0)):
        spark.conf.unset(corpus_pipeline.MIXTURE)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, SF)
            assert out.columns == odd.columns
            rows = stored(out, "stage")
        pieces = corpus_pipeline.packing_stage(spark, rows, SF).collect()
        got = collections.Counter()
        for r in pieces:
            got[r.doc_id] += r.length
        e = Encoder(tokenizer_path("byte_bpe_50k.json"), True)
        want = collections.Counter()
        for r in rows.collect():
            want[r.doc_id] += len(e.tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1
        assert got == want
    spark.conf.unset(corpus_pipeline.MIXTURE)


def test_pipeline_join_takes_five_words_and_four_fifths(spark):
    import corpus_pipeline

    rng = random.Random(7)
    rows, wanted = [], set()

    def linked(x, y):
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (x, y))
        return 100 * len(x & y) >= 80 * len(x | y)

    for i, cut in enumerate((3, 4, 5, 6, 7, 8, 9)):  # Jaccard from 0.85 to 0.76 by five words
        one = [f"d{i}w{rng.randrange(10**6)}" for _ in range(100)]
        two = one[:40] + [f"other{i}x{j}" for j in range(cut)] + one[40 + cut :]
        rows += [(2 * i, " ".join(one), "en", "s", 0), (2 * i + 1, " ".join(two), "en", "s", 0)]
        wanted |= {2 * i} if linked(one, two) else {2 * i, 2 * i + 1}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert 7 not in wanted and 13 in wanted  # six words replaced are a near copy, nine are not
    assert {r.doc_id for r in corpus_pipeline.join_stage(spark, docs, SF).collect()} == wanted
    assert 7 in {r.doc_id for r in ngram_join.deduplicated(docs).collect()}


@pytest.mark.parametrize("file, spaced", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_new_words_share_the_pieces_of_known_ones(file, spaced):
    """Marks beside a word, and case where the tokenizer has none, send nothing more to the tokenizer."""
    e, rng = Encoder(tokenizer_path(file), spaced), random.Random(4)
    e.encode(["zugblat Éaiçou , . ( zugblat.\nZugblat Éaiçou, x"])
    known = len(e.piece)
    e.encode(["zugblat, Éaiçou.\nZugblat ,zugblat x,Éaiçou"])
    assert len(e.piece) - known <= (3 if spaced else 0)  # words without the space before them
    signs = "aAbBzéÉßÿÀ019',.-<|>\n\n\t_~sStTrElLdvm$€ªº×µ\r\x0b\x1c\u0107\u0130\u0301  "
    odd = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    odd += [" ".join(rng.choice(["it's", "IT'S", "we'Re", "x.\nY", "don''t", "a\n\nb", "(Ça", "12th", "'", "''s", "a\tb", "--'ll"]) for _ in range(20)) for _ in range(300)]
    for end in (None, 1):
        ids, begins = e.encode(odd, end)
        for i, t in enumerate(odd):
            assert ids[begins[i] : begins[i + 1]].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids + [end] * (end is not None), t
        e._forget()


def test_katz_chunks_are_never_shuffled(docs, monkeypatch):
    """Answers come to the buckets of the chunks: one exchange, of answers alone, and one chunk a row."""
    monkeypatch.setattr(katz, "CHUNK_TOKENS", 5000)
    model, chunks, answers = katz._fitted(docs, 2)
    plan = model.finished(chunks, answers)._jdf.queryExecution().executedPlan().toString()
    left, right = plan[plan.index("FlatMapCoGroupsInArrow") :].split("Exchange", 1)
    assert "katz_chunks" in left and "katz_chunks" not in right and "Exchange" not in right


def test_id_coder_models_learn_at_stops_alone(monkeypatch):
    """Writing and reading, the models take in a block's ids at its stops, not id by id."""
    calls, learn = [], id_coder._Model.learn
    monkeypatch.setattr(id_coder._Model, "learn", lambda self, ids: (calls.append(len(ids)), learn(self, ids)) and None)
    x = np.random.default_rng(2).zipf(1.3, 40_000) % 49_408
    assert (id_coder.decode_segment(id_coder.encode_segment(x)) == x).all()
    assert sum(calls) == 2 * id_coder.BLOCK and len(calls) == 2 * (len(id_coder._stops(id_coder.BLOCK)) - 1) < 50


@pytest.mark.parametrize("file, spaced", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_words_of_known_pieces_stay_in_no_cache(file, spaced):
    """A worker keeps pieces alone: as many words as there are between the same pieces take no memory of their own."""
    import tracemalloc

    e, rng = Encoder(tokenizer_path(file), spaced), random.Random(5)
    part = ["zug", "1", ".", "blat", "-", "27", "Éa", "'s", ",", "ü"]
    texts = [" ".join("".join(rng.choices(part, k=9)) for _ in range(200)) for _ in range(500)]
    e.encode(texts[:5])
    tracemalloc.start()
    held = tracemalloc.get_traced_memory()[0]
    ids, begins = e.encode(texts)
    got = [ids[begins[i] : begins[i + 1]].tolist() for i in (0, 250, 499)]
    del ids, begins
    grown = tracemalloc.get_traced_memory()[0] - held
    tracemalloc.stop()
    assert got == [e.tokenizer.encode(texts[i], add_special_tokens=False).ids for i in (0, 250, 499)] and grown < 5 << 20


def test_fallback_finds_the_ids_of_all_places():
    """Places that one id has for itself, those several share, and ids that do not occur."""
    counts = np.random.default_rng(3).zipf(1.2, 30_000).clip(0, 10**6) * (np.arange(30_000) % 3 > 0)
    width, begin, _ = id_coder._base_table(counts)
    places = np.r_[0, (1 << 24) - 1, np.random.default_rng(4).integers(0, 1 << 24, 50_000), begin[:-1][width > 0], (begin[1:] - 1)[width > 0]]
    got = id_coder._Fallback(begin, len(counts)).find(places)
    assert (got == np.minimum(np.searchsorted(begin, places, "right") - 1, len(counts) - 1)).all()
