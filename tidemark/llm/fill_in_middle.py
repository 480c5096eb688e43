"""Fill-in-the-middle documents cut by a learned rank index.

A text's tokens are runs of ASCII letters and single other characters. A ``RankIndex`` maps a token's
rank to its offset (in code points): straight segments are fitted to all boundary offsets so that
none is off by more than ``error``; the residual of every boundary is kept as one small integer, so a
predicted offset is corrected to the exact one without a look at the text. The index of a text is
built once and answers any number of cuts.

Defined results: null text is empty, and an empty text stays as it is; a null doc_id is drawn for as
the empty string; rows with one doc_id are cut by the same draws; equal rows give equal results; a
text of any length is one row and is cut whole; extra columns are kept by ``transformed`` (its own
are named by ``prefix``, so none clashes); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices

MARKS = ("<P>", "<S>", "<M>")
#: Of a hundred documents that can be cut, those that are; of a hundred cut, those that begin with the suffix.
CUT_PERCENT = 90
SPM_PERCENT = 20
#: Most that a segment may be off, so that residuals fit one byte.
ERROR = 100
#: Boundaries that the search for a segment's end looks at first, at least; else twice as many as the last segment holds.
_LOOK = 32

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def boundaries(texts: pa.Array) -> list[np.ndarray]:
    """Of each text (not null), the offsets in code points at which its tokens begin, and its length."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    letter, point = _LETTER[raw], (raw & 0xC0) != 0x80
    begin = point.copy()
    begin[1:] &= ~(letter[1:] & letter[:-1])
    begin[offsets[:-1][offsets[:-1] < len(raw)]] = True
    at = np.flatnonzero(begin)
    plain = bool(point.all())
    before = np.empty(0, np.int64) if plain else np.r_[0, np.cumsum(point)]
    cut = np.searchsorted(at, offsets)
    out = []
    for i, (a, b) in enumerate(zip(offsets, offsets[1:])):
        own = np.r_[at[cut[i] : cut[i + 1]], b]
        out.append(own - a if plain else before[own] - before[a])
    return out


@dataclass(frozen=True)
class RankIndex:
    """Segments (first rank, first offset, slope) and the residual of every boundary."""

    rank: np.ndarray
    offset: np.ndarray
    slope: np.ndarray
    residual: np.ndarray

    @staticmethod
    def fit(offsets: np.ndarray, error: int = ERROR) -> RankIndex:
        """The longest segments one after another: each goes on while some line through its first
        boundary passes all its others within ``error`` (what slopes allow narrows from one to the next)."""
        ranks, starts, slopes = len(offsets), [], []
        a, look = 0, 16 * _LOOK
        while a < ranks:
            low, high, end = -np.inf, np.inf, a + 1
            while end < ranks:
                to = min(ranks, end + look)
                run = np.arange(end - a, to - a, dtype=np.float64)
                rise = (offsets[end:to] - offsets[a]).astype(np.float64)
                lows = np.maximum(np.maximum.accumulate((rise - error) / run), low)
                highs = np.minimum(np.minimum.accumulate((rise + error) / run), high)
                bad = lows > highs
                k = int(bad.argmax()) if bad.any() else len(bad)
                if k:
                    low, high = lows[k - 1], highs[k - 1]
                end += k
                if k < len(bad):
                    break
                look *= 2
            starts.append(a)
            slopes.append(0.0 if end == a + 1 else (low + high) / 2)
            look = max(_LOOK, 2 * (end - a))
            a = end
        rank, slope = np.array(starts, np.int64), np.array(slopes)
        index = RankIndex(rank, offsets[rank], slope, np.empty(0, np.int8))
        off = offsets - index.predict(np.arange(ranks))
        kind = np.int8 if error < 127 else np.int64
        return RankIndex(rank, offsets[rank], slope, off.astype(kind))

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        """Offsets by the segments alone."""
        s = np.searchsorted(self.rank, ranks, "right") - 1
        return self.offset[s] + np.rint(self.slope[s] * (ranks - self.rank[s])).astype(np.int64)

    def at(self, ranks: np.ndarray) -> np.ndarray:
        """Exact offsets of the boundaries of these ranks."""
        return self.predict(ranks) + self.residual[ranks]

    @property
    def tokens(self) -> int:
        return len(self.residual) - 1

    def to_bytes(self) -> bytes:
        head = np.array([len(self.rank), len(self.residual), self.residual.itemsize], "<i8")
        return b"".join(x.tobytes() for x in (head, self.rank.astype("<i8"), self.offset.astype("<i8"), self.slope.astype("<f8"), self.residual.astype(f"<i{self.residual.itemsize}")))

    @staticmethod
    def from_bytes(data: bytes) -> RankIndex:
        n, m, width = (int(x) for x in np.frombuffer(data, "<i8", 3))
        part = lambda i, kind: np.frombuffer(data, kind, n, 24 + 8 * n * i)
        return RankIndex(part(0, "<i8"), part(1, "<i8"), part(2, "<f8"), np.frombuffer(data, f"<i{width}", m, 24 + 24 * n))


def rank_index(docs: DataFrame, error: int = ERROR) -> DataFrame:
    """doc_id, n (tokens), segments and ranks (``RankIndex.to_bytes``) of every text, for cuts drawn later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 21):
            made = [RankIndex.fit(x, error) for x in boundaries(pc.fill_null(batch.column("text"), ""))]
            columns = {"doc_id": batch.column("doc_id"), "n": [x.tokens for x in made], "segments": [len(x.rank) for x in made], "ranks": [x.to_bytes() for x in made]}
            yield pa.RecordBatch.from_pydict(columns, schema=pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("segments", pa.int64()), ("ranks", pa.binary())]))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, segments long, ranks binary")


def draws(doc_id: int | None, seed: int = 1) -> list[int]:
    """Four numbers of 32 bits from the seed and the document's id."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]


def arranged(text: str, index: RankIndex, doc_id: int | None, seed: int = 1, cut_percent: int = CUT_PERCENT, spm_percent: int = SPM_PERCENT) -> tuple[str, str, int | None, int | None]:
    """Form, output, and the lengths of prefix and middle (None if plain)."""
    h = draws(doc_id, seed)
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= cut_percent:
        return "plain", text, None, None
    n = index.tokens
    a, b = (int(x) for x in index.at(np.sort(np.array([h[0] % (n + 1), h[1] % (n + 1)]))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = MARKS
    if h[3] % 100 < spm_percent:
        return "spm", f"{s}{suffix}{p}{prefix}{m}{middle}", a, b - a
    return "psm", f"{p}{prefix}{s}{suffix}{m}{middle}", a, b - a


def restored(output: str, form: str) -> str:
    """The text from which ``output`` was made. No part holds a mark, so the first one found is the one set."""
    if form == "plain":
        return output
    p, s, m = MARKS
    first, second = (s, p) if form == "spm" else (p, s)
    one, rest = output.removeprefix(first).split(second, 1)
    two, middle = rest.split(m, 1)
    return two + middle + one if form == "spm" else one + middle + two


#: A text is cut, put together and hashed in a row; these columns follow the documents' own.
_MADE = {"n": ("long", pa.int64()), "form": ("string", pa.string()), "prefix_chars": ("long", pa.int64()), "middle_chars": ("long", pa.int64()), "output": ("string", pa.large_string())}


def transformed(docs: DataFrame, seed: int = 1, error: int = ERROR, prefix: str = "fim_", cut_percent: int = CUT_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """``docs`` with their tokens, form, lengths and output: one pass where the rows lie, without a shuffle."""
    names = [f"{prefix}{k}" for k in _MADE]
    if clash := set(names) & set(docs.columns):
        raise ValueError(f"choose another prefix: {sorted(clash)} are columns already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 21):
            texts = pc.fill_null(batch.column("text"), "")
            rows = []
            for doc_id, text, cuts in zip(batch.column("doc_id").to_pylist(), texts.to_pylist(), boundaries(texts)):
                index = RankIndex.fit(cuts, error)
                form, output, a, b = arranged(text, index, doc_id, seed, cut_percent, spm_percent)
                rows.append((index.tokens, form, a, b, output))
            made = [pa.array([r[i] for r in rows], kind[1]) for i, kind in enumerate(_MADE.values())]
            if batch.schema.field("text").type != pa.large_string():
                made[-1] = made[-1].cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *names])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, ", ".join([own, *[f"`{n}` {k[0]}" for n, k in zip(names, _MADE.values())]]))


def rebuilt(made: DataFrame, prefix: str = "fim_", column: str = "fim_restored") -> DataFrame:
    """``made`` with the text that output and form alone give back, by built-in string functions."""
    out, form = F.col(f"{prefix}output"), F.col(f"{prefix}form")
    p, s, m = MARKS
    spm = form == "spm"
    body = F.substr(out, F.lit(len(p) + 1))
    second = F.when(spm, F.lit(p)).otherwise(F.lit(s))
    at = F.expr(f"instr(`{prefix}output`, CASE WHEN `{prefix}form` = 'spm' THEN '{p}' ELSE '{s}' END)")
    one = F.substr(body, F.lit(1), at - len(p) - 1)
    rest = F.substr(out, at + F.length(second))
    split = F.instr(rest, m)
    two, middle = F.substr(rest, F.lit(1), split - 1), F.substr(rest, split + len(m))
    return made.withColumn(column, F.when(form == "plain", out).when(spm, F.concat(two, middle, one)).otherwise(F.concat(one, middle, two)))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and SHA-256 of the output and of the text rebuilt from it."""
    made = rebuilt(transformed(docs.select("doc_id", "text")))
    return made.select("doc_id", F.col("fim_n").alias("n"), F.col("fim_form").alias("form"), F.col("fim_prefix_chars").alias("prefix_chars"), F.col("fim_middle_chars").alias("middle_chars"), F.sha2("fim_output", 256).alias("output_sha256"), F.sha2("fim_restored", 256).alias("restored_sha256"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
     t AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS w, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2, ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM d),
     c AS (SELECT *, CAST(len(w) AS BIGINT) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b FROM t),
     x AS (SELECT doc_id, text, n, array_to_string(w[1:a], '') AS prefix, array_to_string(w[a + 1:b], '') AS middle, array_to_string(w[b + 1:], '') AS suffix,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM x
"""
