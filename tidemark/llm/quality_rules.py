"""Weak supervision for document quality, in DataFrame expressions only.

Rules look at a document and vote for good (1), for bad (-1) or abstain (0). A naive Bayes label
model ties them together: expectation-maximisation over the histogram of vote patterns estimates,
without labels, how often each rule votes for good, for bad or not at all on documents of either
class, and how common good documents are. Nothing bounds the estimates but one smoothing count for
each. A document is kept when its posterior probability of being good reaches the threshold; no rule
has a veto.

Defined results: null text counts as empty; an empty text has no words and fails the base test;
repeated rows each get the same verdict; other columns, whatever their names, are ignored by
``measured`` and carried through by ``filtered``; an empty table gives an empty table (the label
model then stays near its start values).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE_CLASS, stored

#: A power of two: hashes of runs are made by doubling.
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
_M = "_q_"


@dataclass(frozen=True)
class LabelModel:
    """Share of good documents; how often each rule votes -1, 0 and 1 on good and on bad ones."""

    prior: float
    on_good: tuple[tuple[float, float, float], ...]
    on_bad: tuple[tuple[float, float, float], ...]

    def accuracies(self) -> list[tuple[float, float]]:
        """How often each rule's vote is right when it votes, on good and on bad documents."""
        return [(g[2] / (g[0] + g[2]), b[0] / (b[0] + b[2])) for g, b in zip(self.on_good, self.on_bad)]


def _let(value: Column, body) -> Column:
    """``body`` applied to a value that is computed once per row."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside windows of eight words that occur twice or more, the first occurrence included."""

    def covered(sorted_windows: Column) -> Column:
        twice = F.filter(
            sorted_windows,
            lambda x, i: F.get(sorted_windows, i - 1)["h"].eqNullSafe(x["h"]) | F.get(sorted_windows, i + 1)["h"].eqNullSafe(x["h"]),
        )
        places = F.sort_array(F.transform(twice, lambda x: x["p"]))
        start = F.struct(F.lit(0).alias("total"), F.lit(-WINDOW).alias("last"))
        step = lambda s, p: F.struct((s["total"] + F.least(F.lit(WINDOW), p - s["last"])).alias("total"), p.alias("last"))
        return F.aggregate(places, start, step, lambda s: s["total"])

    def from_hashes(h: Column) -> Column:
        windows = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(windows, covered))

    def doubled(by: int):  # hashes of runs of 2 * by words from those of runs of by words
        return lambda h: F.zip_with(F.slice(h, 1, F.size(h) - by), F.slice(h, by + 1, F.size(h) - by), lambda x, y: F.xxhash64(x, y))

    def from_words(h: Column) -> Column:
        runs = _let(_let(_let(h, doubled(1)), doubled(2)), doubled(4))
        return F.when(F.size(h) <= WINDOW, F.lit(0)).otherwise(_let(runs, from_hashes))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), from_words)


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the measures of ``text`` that the rules look at, each named with a prefix of its own."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def taken(chars: str) -> Column:  # all of them are single bytes
        rest = F.col(f"{_M}text")
        for c in chars:
            rest = F.replace(rest, F.lit(c), F.lit(""))
        return F.octet_length(f"{_M}text") - F.octet_length(rest)

    lines = F.filter(F.split(F.col(f"{_M}text"), "\n", -1), lambda x: x.rlike(f"[^{SPACE_CLASS}]"))
    words = F.array_remove(F.split(F.col(f"{_M}text"), f"[{SPACE_CLASS}]+", -1), "")
    out = docs.withColumn(f"{_M}text", text)
    out = out.withColumns({f"{_M}words": words, f"{_M}lines": lines})
    ended = F.size(F.filter(F.col(f"{_M}lines"), lambda x: x.rlike(r"[.!?:;\"'’”»)]\s*$")))
    out = out.withColumns(
        {
            f"{_M}n_words": F.size(f"{_M}words").cast("long"),
            f"{_M}word_chars": F.length(F.array_join(f"{_M}words", "")).cast("long"),
            f"{_M}n_symbols": taken(SYMBOLS).cast("long"),
            f"{_M}n_lines": F.size(f"{_M}lines").cast("long"),
            f"{_M}n_dup_lines": (F.size(f"{_M}lines") - F.size(F.array_distinct(f"{_M}lines"))).cast("long"),
            f"{_M}n_repeat_words": _repeat_words(F.col(f"{_M}words")).cast("long"),
            f"{_M}n_echoes": _let(F.col(f"{_M}words"), lambda w: F.size(F.filter(w, lambda x, i: x.eqNullSafe(F.get(w, i - 1))))).cast("long"),
            f"{_M}n_marked": F.when(taken(SYMBOLS) == 0, F.lit(0)).otherwise(F.size(F.filter(f"{_M}words", lambda w: F.substring(w, -1, 1).isin(*SYMBOLS)))).cast("long"),
            f"{_M}n_shouts": taken("!").cast("long"),
            f"{_M}n_ended": ended.cast("long"),
        }
    )
    n, repeat = F.col(f"{_M}n_words"), F.col(f"{_M}n_repeat_words")
    out = out.withColumn(f"{_M}base_failed", (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n))
    return out.drop(f"{_M}text", f"{_M}words", f"{_M}lines")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0)).cast("int")


def votes() -> Column:
    """The vote of each rule on the measures, as an array."""
    c = lambda name: F.col(f"{_M}{name}")
    share = lambda a, b: F.coalesce(F.try_divide(c(a).cast("double"), c(b)), F.lit(0.0))
    symbols, shouts = share("n_symbols", "word_chars"), share("n_shouts", "n_words")
    dup, repeat, echoes = share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), share("n_echoes", "n_words")
    width, ended, marked = share("word_chars", "n_words"), share("n_ended", "n_lines"), share("n_marked", "n_words")
    return F.array(
        _vote(symbols < 0.01, symbols > 0.05),
        _vote(marked < 0.02, marked > 0.20),
        _vote(shouts < 0.05, shouts > 0.30),
        _vote((dup == 0) & (c("n_lines") >= 3), dup > 0.30),
        _vote(repeat < 0.05, repeat > 0.20),
        _vote(echoes < 0.05, echoes > 0.15),
        _vote((width >= 2.5) & (width <= 12), (width < 1.5) | (width > 25)),
        _vote(ended > 0.70, ended < 0.15),
    )


N_RULES = 8


#: Where estimation starts: votes -1, 0, 1 of any rule on good and on bad documents.
START_GOOD, START_BAD = (0.05, 0.05, 0.90), (0.40, 0.20, 0.40)


def fit(measures: DataFrame, rounds: int = 40, prior: float = 0.8) -> LabelModel:
    """Expectation-maximisation on the histogram of vote patterns (3 ** N_RULES rows at most).

    One row holds the histogram; ``aggregate`` runs the rounds. Only the model, 6 * N_RULES + 1
    numbers, comes to the driver. Without documents the model stays near its start values.
    """
    patterns = measures.where(~F.col(f"{_M}base_failed")).groupBy(votes().alias("v")).agg(F.count("*").alias("c"))
    one = patterns.agg(F.sort_array(F.collect_list(F.struct("v", F.col("c").cast("double").alias("c")))).alias("h"))
    fill = lambda x: F.array_repeat(F.array(*map(F.lit, x)), N_RULES)
    start = F.struct(F.lit(prior).alias("prior"), fill(START_GOOD).alias("good"), fill(START_BAD).alias("bad"))

    def posterior(v: Column, s: Column) -> Column:
        odds = F.ln(s["prior"] / (1 - s["prior"]))
        for j in range(N_RULES):
            odds = odds + F.ln(s["good"][j][v[j] + 1] / s["bad"][j][v[j] + 1])
        return 1 / (1 + F.exp(-odds))

    def step(h: Column, s: Column) -> Column:
        weighed = F.transform(h, lambda p: F.struct(p["v"].alias("v"), p["c"].alias("c"), (p["c"] * posterior(p["v"], s)).alias("g")))

        def updated(w: Column) -> Column:
            total = lambda f: F.aggregate(w, F.lit(0.0), lambda t, p: t + f(p))
            good, bad = [], []
            for j in range(N_RULES):
                for out, part in ((good, lambda p: p["g"]), (bad, lambda p: p["c"] - p["g"])):
                    counts = F.array(*[total(lambda p, v=v: F.when(p["v"][j] == v, part(p)).otherwise(0.0)) + 1 for v in (-1, 0, 1)])
                    out.append(_let(counts, lambda n: F.transform(n, lambda x: x / (n[0] + n[1] + n[2]))))
            share = (total(lambda p: p["g"]) + 1) / (total(lambda p: p["c"]) + 2)
            return F.struct(share.alias("prior"), F.array(*good).alias("good"), F.array(*bad).alias("bad"))

        return _let(weighed, updated)

    row = one.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda s, _: step(F.col("h"), s)).alias("m")).first()["m"]
    return LabelModel(row["prior"], tuple(map(tuple, row["good"])), tuple(map(tuple, row["bad"])))


def good_probability(model: LabelModel) -> Column:
    """The posterior probability that a document is good, from its votes."""
    odds, cast = F.lit(math.log(model.prior / (1 - model.prior))), votes()
    for j, (g, b) in enumerate(zip(model.on_good, model.on_bad)):
        odds = odds + F.when(cast[j] == 1, math.log(g[2] / b[2])).when(cast[j] == -1, math.log(g[0] / b[0])).otherwise(math.log(g[1] / b[1]))
    return 1 / (1 + F.exp(-odds))


def judged(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the base measures, base_failed, quality (posterior) and kept, for every row of ``docs``.

    The measures are taken once and stored without texts; both passes of the label model read them.
    """
    measures = stored(measured(docs.select("doc_id", "text")).drop("text"), "quality")
    model = fit(measures)
    base = [F.col(f"{_M}{n}").alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]
    return measures.select("doc_id", *base, good_probability(model).alias("quality")).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def filtered(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns and nothing else.

    The text is measured a second time for the verdict: that moves no text between executors.
    """
    model = fit(measured(docs.select("text")))
    return measured(docs).where(~F.col(f"{_M}base_failed") & (good_probability(model) >= threshold)).select(*[F.col(f"`{c}`") for c in docs.columns])
