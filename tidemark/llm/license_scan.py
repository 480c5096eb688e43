"""Licence scan: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs are runs of lines between blank ones, whatever the line breaks inside; a long one is read
in windows of ``WINDOW`` words, ``STEP`` apart, so that any notice of ``WINDOW`` - ``STEP`` words is
whole in one. Binary features are the words and word pairs that occur in templates; multinomial
logistic regression tells licence families and an unknown class apart. It is trained on templates
with words dropped and set into other text, and for the unknown class on a bounded sample of corpus
windows, on template words out of order, on too small parts of templates, and on notices of other licences.
The cut on the family probability is the quantile of held-out unknown windows that lets
``FALSE_ALARMS`` of them pass. A predicted window is confirmed when it has ``OVERLAP`` of the words and
of the adjacent word pairs of a template of the family, and every pair that names the licence
(``NAMES``) or states its version; or when one of its lines is a title (``TITLES``) and no more.
Families whose templates hardly differ, as versions of one licence, are kin: among them the one with
the largest overlap stands, the longer template among equals, in a window and among windows that
overlap each other. A notice that opens with another family's words is that family alone (``OPENS``).

Every confirmed window holds at least ``needed_words()`` telling template words and one of
``key_pairs()``; windows, paragraphs and texts without are passed over first, which changes no result. All steps are DataFrame
operations and JVM-side ML stages.

The labelled sample: windows of ``SAMPLE_DOCS`` documents chosen by a hash of doc_id, ``SAMPLE_WINDOWS``
of them by a hash of their words. All else covers all rows and whole texts.

Defined results: null and empty texts have no paragraphs; repeated rows give repeated findings; a null
doc_id is kept; extra columns are ignored; an empty table gives no findings (the unknown class then
trains on stock lines).
"""

from __future__ import annotations

import json
import math
import re

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_DOCS = 500
SAMPLE_WINDOWS = 4000
#: Of unknown windows that may pass the classifier; what passes is then compared with templates.
FALSE_ALARMS = 0.002
OVERLAP = 0.7
WINDOW, STEP = 64, 24
UNKNOWN = "unknown"

#: Short notices, identifiers and opening words of well-known licences.
TEMPLATES = {
    "mit": (
        "released under the mit license",
        "licensed under the mit license",
        "spdx license identifier mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    "isc": (
        "licensed under the isc license",
        "spdx license identifier isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    ),
    "zlib": (
        "licensed under the zlib license",
        "spdx license identifier zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
    ),
    "boost-1.0": ("distributed under the boost software license version 1 0", "spdx license identifier bsl 1 0", "boost software license version 1 0"),
    "apache-2.0": (
        "licensed under the apache license version 2 0",
        "licensed under apache 2 0",
        "license apache 2 0",
        "spdx license identifier apache 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
    ),
    "apache-1.1": (
        "licensed under the apache software license version 1 1",
        "the apache software license version 1 1",
        "spdx license identifier apache 1 1",
        "the apache software license version 1 1 copyright the apache software foundation all rights reserved redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    ),
    "gpl-3.0": (
        "this work is licensed under the gnu general public license version 3",
        "gnu general public license version 3",
        "spdx license identifier gpl 3 0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license either version 3 of the license",
    ),
    "gpl-2.0": (
        "this work is licensed under the gnu general public license version 2",
        "gnu general public license version 2",
        "spdx license identifier gpl 2 0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license either version 2 of the license",
    ),
    "lgpl-3.0": (
        "this library is licensed under the gnu lesser general public license version 3",
        "gnu lesser general public license version 3",
        "spdx license identifier lgpl 3 0",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license either version 3 of the license",
    ),
    "lgpl-2.1": (
        "this library is licensed under the gnu lesser general public license version 2 1",
        "gnu lesser general public license version 2 1",
        "spdx license identifier lgpl 2 1",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license either version 2 1 of the license",
    ),
    "agpl-3.0": (
        "licensed under the gnu affero general public license version 3",
        "gnu affero general public license version 3",
        "spdx license identifier agpl 3 0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license either version 3 of the license",
    ),
    "mpl-2.0": (
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        "licensed under the mozilla public license version 2 0",
        "mozilla public license version 2 0",
        "spdx license identifier mpl 2 0",
    ),
    "epl-2.0": (
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
        "this program and the accompanying materials are made available under the terms of the eclipse public license v2 0",
        "licensed under the eclipse public license version 2 0",
        "spdx license identifier epl 2 0",
    ),
    "epl-1.0": (
        "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0",
        "licensed under the eclipse public license version 1 0",
        "spdx license identifier epl 1 0",
    ),
    "eupl-1.2": ("licensed under the eupl version 1 2", "spdx license identifier eupl 1 2", "european union public licence v 1 2"),
    "bsd": (
        "licensed under the bsd 3 clause license",
        "licensed under the bsd license",
        "spdx license identifier bsd 3 clause",
        "spdx license identifier bsd 2 clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    ),
    "cc-by-4.0": ("licensed under cc by 4 0", "spdx license identifier cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"),
    "cc-by-sa-4.0": ("licensed under cc by sa 4 0", "spdx license identifier cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", "spdx license identifier cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    "cc-by-nd-4.0": ("licensed under cc by nd 4 0", "spdx license identifier cc by nd 4 0", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"),
    "cc-by-nc-sa-4.0": (
        "licensed under cc by nc sa 4 0",
        "spdx license identifier cc by nc sa 4 0",
        "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license",
    ),
    "cc-by-nc-nd-4.0": (
        "licensed under cc by nc nd 4 0",
        "spdx license identifier cc by nc nd 4 0",
        "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license",
    ),
    "cc0-1.0": ("dedicated to the public domain under cc0 1 0", "spdx license identifier cc0 1 0", "this work is released into the public domain under cc0 1 0 universal"),
    "unlicense": ("this is free and unencumbered software released into the public domain", "spdx license identifier unlicense"),
    "proprietary": ("all rights reserved", "copyright all rights reserved no part may be reproduced without written permission"),
}
#: Lines that name a licence when nothing else stands on them.
TITLES = {
    "mit": ("mit license", "the mit license", "the mit license mit", "license mit", "license mit license", "license osi approved mit license"),
    "isc": ("isc license", "the isc license", "license isc"),
    "zlib": ("zlib license", "the zlib license", "license zlib"),
    "bsd": ("bsd license", "license bsd", "bsd 3 clause license", "bsd 2 clause license", "license bsd 3 clause", "license bsd 2 clause"),
    "unlicense": ("the unlicense", "license unlicense"),
}
#: Word pairs that name a licence; a template that has one is confirmed only with it.
NAMES = frozenset((
    "the mit", "mit license", "identifier mit", "the isc", "identifier isc", "the zlib", "identifier zlib", "identifier unlicense", "boost software", "apache license", "apache software", "apache org",
    "gnu general", "gnu lesser", "gnu affero", "mozilla public", "eclipse public", "the eupl", "european union", "the bsd", "creative commons", "attribution sharealike", "attribution noncommercial",
    "attribution noderivatives", "noncommercial sharealike", "noncommercial noderivatives", "cc by", "by sa", "by nc", "by nd", "nc sa", "nc nd", "free of", "use copy", "hereby granted", "unencumbered software",
))
#: A family whose notice goes on with the other's words.
OPENS = {"apache-1.1": "bsd"}
#: Paragraphs after an opening in which its other family's words belong to it.
OPEN_PARAGRAPHS = 4
FAMILIES = (*TEMPLATES, UNKNOWN)
#: Words that any text has, which alone tell nothing of a licence.
COMMON = frozenset("a all an and any are at by can either except following for free in into is it may no not of or part person that the this to under use with without you".split())
#: Lines that speak of such words without being a notice.
STOCK_LINES = (
    "the weather was fine on the day of the fair", "she opened the door and went into the garden", "a public meeting was held in the general store", "he lost his driving license in the first version of the story",
    "all rights of the people must be respected", "the software was free and the source was open", "permission to enter the public garden was granted by the general", "the terms of the work were not in the form that you may use",
)
#: Notices of licences that are no family here.
OTHERS = (
    "the contents of this file are subject to the mozilla public license version 1 1", "this library is free software under the terms of the gnu library general public license version 2",
    "licensed under the academic free license version 3 0", "this package is distributed under the artistic license 2 0", "this source file is subject to version 3 01 of the php license",
    "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3", "licensed under the common development and distribution license version 1 0",
    "this font software is licensed under the sil open font license version 1 1", "this work is licensed under a creative commons attribution 3 0 unported license", "licensed under the microsoft public license",
)
_LINES = [t for table in (TEMPLATES, TITLES) for ts in table.values() for t in ts]
_WORDS = sorted({w for t in _LINES for w in t.split()})
_PAIRS = sorted({f"{a} {b}" for t in _LINES for a, b in zip(t.split(), t.split()[1:])})
TELLING = [w for w in _WORDS if w not in COMMON]


def needed_words(overlap_cut: float = OVERLAP) -> int:
    """How many distinct telling words a window has at least that is confirmed by any template."""
    sets = [set(t.split()) for ts in TEMPLATES.values() for t in ts]
    titles = [len(set(t.split()) - COMMON) for ts in TITLES.values() for t in ts]
    return max(0, min(*[math.ceil(overlap_cut * len(s) - 1e-9) - len(s & COMMON) for s in sets], *titles))


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _list(values: list[str]) -> str:
    """Words as an SQL list: one parsed text instead of a literal object for each."""
    return ", ".join(f"'{v}'" for v in values)


_PAIRS_OF = "zip_with(slice(words, 1, greatest(size(words) - 1, 0)), slice(words, 2, greatest(size(words) - 1, 0)), (a, b) -> concat(a, ' ', b))"


def _terms() -> Column:
    """The template words and word pairs of ``words``."""
    return F.expr(f"concat(filter(words, w -> w IN ({_list(_WORDS)})), filter({_PAIRS_OF}, p -> p IN ({_list(_PAIRS)})))")


def _pairs(template: str) -> set[str]:
    words = template.split()
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


def needed_pairs(template: str) -> set[str]:
    """The pairs without which a template isn't confirmed: names, and what leads to a number of a version."""
    return {p for p in _pairs(template) if p in NAMES or re.fullmatch(r"v?\d+", p.split()[1])}


def key_pairs(overlap_cut: float) -> set[str]:
    """Word pairs of which every window that is confirmed has one: of each template a needed pair, or so many that
    the rest of its pairs aren't enough; of each title its first. Pairs of telling words are taken first."""
    worth = lambda p: (sum(w in COMMON or w.isdigit() for w in p.split()), p)
    out = {" ".join(t.split()[:2]) for ts in TITLES.values() for t in ts}
    for t in (t for ts in TEMPLATES.values() for t in ts):
        need, own = needed_pairs(t), sorted(_pairs(t), key=worth)
        spare = len(own) - math.ceil(overlap_cut * len(own) - 1e-9)
        out.update([min(need, key=worth)] if need else own[: spare + 1])
    return out


def _telling(words: str, least: int, overlap_cut: float) -> Column:
    """Whether ``words`` (worked out once) have a key pair and ``least`` telling words."""
    keys = sorted(key_pairs(overlap_cut))
    paired = f"zip_with(v, slice(v, 2, size(v)), (a, b) -> a IN ({_list(sorted({k.split()[0] for k in keys}))}) AND concat(a, ' ', b) IN ({_list(keys)}))"
    return F.expr(f"exists(array({words}), v -> array_contains({paired}, true) AND size(array_distinct(filter(v, w -> w IN ({_list(TELLING)})))) >= {least})")


def windows_of(docs: DataFrame, least: int = 0, overlap_cut: float = OVERLAP) -> DataFrame:
    """doc_id, paragraph, line (of the window's first word), words and their lines, and whether words follow, of every
    window; ``least``: telling words it has, and a key pair."""
    some = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    if least:
        some = some.withColumn("own", words_of(F.col("text"))).where(_telling("own", least, overlap_cut)).drop("own")
    # a text is cut before each blank line; what a piece has of line ends gives the next one's first line
    pieces = some.select("row", "doc_id", F.posexplode(F.split("text", r"(?<=\n)(?=[ \t\f\r\x0B]*\n)")).alias("paragraph", "piece"))
    ends = F.length("piece") - F.length(F.replace(F.col("piece"), F.lit("\n"), F.lit("")))
    before = Window.partitionBy("row").orderBy("paragraph").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("base", F.coalesce(F.sum(ends).over(before), F.lit(0)))
    words = F.flatten(F.transform(F.split("piece", "\n"), lambda x, i: F.transform(words_of(x), lambda w: F.struct(w.alias("w"), i.alias("line")))))
    placed = pieces.withColumn("placed", words).where(F.size("placed") > 0)
    if least:
        placed = placed.where(_telling("placed.w", least, overlap_cut))
    last = F.greatest(F.lit(0), F.ceil((F.size("placed") - WINDOW) / STEP) * STEP).cast("int")
    spans = placed.withColumn("at", F.explode(F.sequence(F.lit(0), last, F.lit(STEP)))).withColumn("window", F.slice("placed", F.col("at") + 1, WINDOW))
    out = spans.select("row", "doc_id", "paragraph", "at", (F.col("base") + F.col("window")[0]["line"]).cast("int").alias("line"), F.col("window.w").alias("words"), F.col("window.line").alias("lines"), (F.size("placed") > F.col("at") + WINDOW).alias("more"))
    return out.where(_telling("words", least, overlap_cut)) if least else out


#: The whole lines of a window: not its first unless the paragraph begins there, nor its last if words follow.
_WHOLE_LINES = (
    "transform(slice(array_distinct(lines), if(at > 0, 2, 1), greatest(0, size(array_distinct(lines)) - if(at > 0, 1, 0) - if(more, 1, 0))), "
    "l -> array_join(transform(filter(arrays_zip(words, lines), z -> z.lines = l), z -> z.words), ' '))"
)


def kin(least: float = 0.8) -> dict[str, list[str]]:
    """The families of which some template shares ``least`` of all words with one of the family's, itself included."""
    sets = {f: [set(t.split()) for t in ts] for f, ts in TEMPLATES.items()}
    return {f: [g for g in TEMPLATES if any(len(x & y) >= least * len(x | y) for x in sets[f] for y in sets[g])] for f in TEMPLATES}


def _table() -> str:
    """All templates and titles as one SQL value: family, kin (those that may find it), words, pairs, needed pairs, titles."""
    near = kin()
    rows = [{"family": f, "kin": near[f], "words": sorted(set(t.split())), "pairs": sorted(_pairs(t)), "need": sorted(needed_pairs(t)), "titles": []} for f, ts in TEMPLATES.items() for t in ts]
    rows += [{"family": f, "kin": [f], "words": [], "pairs": [], "need": [], "titles": ts} for f, ts in TITLES.items()]
    lists = ", ".join(f"{c}: array<string>" for c in ("kin", "words", "pairs", "need", "titles"))
    return f"from_json('{json.dumps(rows)}', 'array<struct<family: string, {lists}>>')"


def confirmed() -> Column:
    """For the predicted ``family``: the largest overlap with a template of its kin, the template's size, and the
    family that has it; the longer template, then the predicted family, among equals. A title counts as whole."""
    share = lambda c: f"size(array_intersect({c}, t.{c})) / size(t.{c})"
    title = "if(arrays_overlap(whole_lines, t.titles), 1D, 0D)"
    overlap = f"CASE WHEN size(t.titles) > 0 THEN {title} WHEN size(array_except(t.need, pairs)) > 0 THEN 0D ELSE least({share('words')}, {share('pairs')}) END"
    row = f"named_struct('overlap', {overlap}, 'size', size(t.words), 'predicted', t.family = family, 'family', t.family)"
    return F.expr(f"array_max(transform(filter({_table()}, t -> array_contains(t.kin, family)), t -> {row}))")


def training_rows(docs: DataFrame) -> DataFrame:
    """family, words and whether a row is held out for calibration."""
    spark = docs.sparkSession
    chance = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1000)) / 1000.0
    ids = docs.where(F.length("text") > 0).select("doc_id").distinct().orderBy(F.xxhash64("doc_id")).limit(SAMPLE_DOCS)
    corpus = windows_of(docs.join(F.broadcast(ids), "doc_id", "left_semi")).select("words")  # ids: SAMPLE_DOCS rows at most
    corpus = corpus.where(F.expr(f"NOT exists({_table()}, t -> size(array_intersect(words, t.words)) >= 0.5 * size(t.words) AND size(t.words) > 0)")).orderBy(F.xxhash64("words")).limit(SAMPLE_WINDOWS).cache()
    spare = spark.createDataFrame([(STOCK_LINES[0].split(" "),)], "words array<string>")
    numbered = corpus.unionByName(spare).withColumn("n", F.row_number().over(Window.orderBy(F.xxhash64("words"))) - 1)  # SAMPLE_WINDOWS rows at most
    stock = spark.createDataFrame([(t.split(" "),) for t in (*STOCK_LINES, *OTHERS)], "words array<string>").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(20)))).select("words")
    lines = [(f, t.split(" ")) for table, times in ((TEMPLATES, 1), (TITLES, 3)) for f, ts in table.items() for t in ts * times]
    table = spark.createDataFrame(lines, "family string, template array<string>").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(39))))
    shuffled = F.sort_array(F.transform("template", lambda w: F.struct(F.xxhash64(w, "copy").alias("h"), w.alias("w"))))["w"]
    few = F.greatest(F.lit(1), F.floor(F.size("template") * (F.col("copy") % 5) / 10)).cast("int")
    filler = lambda k, seed: F.transform(F.sequence(F.lit(1), k), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("copy", "family", i, F.lit(seed)), F.lit(5000)).cast("string")))
    some = lambda most, seed: (F.pmod(F.xxhash64("copy", "template", F.lit(seed)), F.lit(most)) + 1).cast("int")
    stray = table.select(F.concat(filler(some(20, 1), 1), F.slice(shuffled, 1, few), filler(some(20, 2), 2)).alias("words"))  # words out of order, too few
    part = table.where("copy < 20").select(F.concat(F.slice("template", 1, few), filler(some(20, 3), 3)).alias("words"))  # the beginning only
    kept = F.filter("template", lambda w, i: (F.col("copy") < 20) | (F.size("template") < 5) | (chance(w, i, F.col("copy")) > 0.08))
    # a notice alone, behind a few words, and inside a window of the corpus
    table = table.withColumn("n", F.pmod(F.xxhash64("copy", "template", F.lit(7)), F.lit(numbered.count())).cast("int")).join(numbered.withColumnRenamed("words", "other"), "n")
    whole = F.when(F.col("copy") % 4 == 0, kept).when(F.col("copy") % 4 == 1, F.concat(filler(some(5, 4), 4), kept)).otherwise(F.concat(F.slice("other", 1, some(40, 5)), kept, F.slice("other", 41, some(24, 6))))
    licences = table.select("family", whole.alias("words"))
    none = corpus.unionByName(stock).unionByName(stray).unionByName(part).select(F.lit(UNKNOWN).alias("family"), "words")
    rows = licences.unionByName(none)
    return rows.withColumns({"held": F.pmod(F.xxhash64("words"), F.lit(5)) == 0, "terms": _terms()})


class LicenseModel:
    """The fitted stages and the calibrated cut."""

    def __init__(self, stages: PipelineModel, cut: float) -> None:
        self.stages, self.cut = stages, cut


def _probabilities(stages: PipelineModel, rows: DataFrame) -> DataFrame:
    p = stages.transform(rows).withColumn("p", vector_to_array("probability"))
    best = F.array_max(F.transform(F.slice("p", 1, len(TEMPLATES)), lambda x, i: F.struct(x.alias("p"), i.alias("i"))))
    return p.withColumn("best", best)


def fit(docs: DataFrame, false_alarms: float = FALSE_ALARMS) -> LicenseModel:
    """Train on bounded data; cut where at most ``false_alarms`` of the held-out unknown rows would pass."""
    number = F.create_map(*[F.lit(x) for i, f in enumerate(FAMILIES) for x in (f, float(i))])
    rows = training_rows(docs).withColumn("label", number[F.col("family")]).coalesce(4).cache()
    vector = CountVectorizerModel.from_vocabulary([*_WORDS, *_PAIRS], inputCol="terms", outputCol="features").setBinary(True)
    regression = LogisticRegression(family="multinomial", regParam=0.0001, maxIter=50, standardization=False)
    train = rows.where(~F.col("held"))
    stages = PipelineModel([vector, regression.fit(vector.transform(train))])
    unknown = _probabilities(stages, rows.where(F.col("held") & (F.col("family") == UNKNOWN)))
    cut = unknown.agg(F.percentile(F.col("best")["p"], F.lit(1.0 - false_alarms))).first()[0]
    rows.unpersist()
    return LicenseModel(stages, 0.5 if cut is None else cut)  # no unknown row held out: the middle


def _confirmed_windows(rows: DataFrame, model: LicenseModel, overlap_cut: float) -> DataFrame:
    """The windows that the model takes for a family and a template or title confirms."""
    found = _probabilities(model.stages, rows).where(F.col("best")["p"] > model.cut)
    names = F.array(*[F.lit(f) for f in TEMPLATES])
    named = found.select("row", "doc_id", "paragraph", "at", "line", F.get(names, F.col("best")["i"]).alias("family"), F.col("best")["p"].alias("probability"), "words", F.expr(_PAIRS_OF).alias("pairs"), F.expr(_WHOLE_LINES).alias("whole_lines"))
    return named.withColumn("c", confirmed()).where(F.col("c.overlap") >= overlap_cut).select("row", "doc_id", "paragraph", "at", "line", "c.family", "probability", "c.overlap", F.struct("c.overlap", "c.size").alias("rank"))


def scanned(docs: DataFrame, model: LicenseModel | None = None, overlap_cut: float = OVERLAP) -> DataFrame:
    """doc_id, paragraph, line, family, probability, overlap of every family confirmed in a paragraph.

    Of the windows that find a family in a paragraph the one with the largest overlap stands, the first
    of equal ones; ``line`` is the line (from 0) on which it begins.
    """
    model = model or fit(docs)
    rows = windows_of(docs, needed_words(overlap_cut), overlap_cut).withColumn("terms", _terms())
    sure = _confirmed_windows(rows, model, overlap_cut)
    first = F.create_map(*[F.lit(x) for f, own in kin().items() for x in (f, own[0])])  # a family in each kin stands for it
    near = Window.partitionBy("row", "paragraph", first[F.col("family")]).orderBy("at").rangeBetween(1 - WINDOW, WINDOW - 1)
    sure = sure.withColumn("most", F.max("rank").over(near)).where(F.col("rank") == F.col("most"))
    for opening, other in OPENS.items():
        before = Window.partitionBy("row").orderBy("paragraph").rangeBetween(-OPEN_PARAGRAPHS, 0)
        opened = F.max(F.col("family") == opening).over(before)
        sure = sure.withColumn("opened", opened).where(~(F.col("opened") & (F.col("family") == other))).drop("opened")
    best = F.max(F.struct("overlap", (-F.col("at")).alias("up"), "line", "probability")).alias("b")
    return sure.groupBy("row", "doc_id", "paragraph", "family").agg(best).select("doc_id", "paragraph", "b.line", "family", "b.probability", "b.overlap")
