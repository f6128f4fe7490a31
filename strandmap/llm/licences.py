"""Licence scans: a trained paragraph classifier whose predictions licence templates confirm."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, row_key, stored
from .sampling import temperature

ASCII_LOWER = str.maketrans(UPPER, LOWER)

#: Common wordings of licence notices by family.
TEMPLATES: dict[str, list[str]] = {
    "agpl": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "Licensed under the AGPL-3.0-or-later.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Released under the Apache 2.0 license.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Released under the BSD 3-Clause License.",
        "Licensed under the 2-clause BSD license.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation.",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
        "This work is dedicated to the public domain.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Available under the Creative Commons Attribution License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
        "Licensed under CC BY-NC-ND 4.0.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
        "Released under the Eclipse Public License.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "Licensed under the GPL-3.0.",
        "Released under the GNU GPL version 2.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "Licensed under the LGPL-2.1.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
        "Licensed under the MIT license.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "Released under the MPL-2.0.",
    ],
    "proprietary": [
        "All rights reserved. No part of this publication may be reproduced, distributed or transmitted without the prior written permission of the publisher.",
        "Copyright. All rights reserved.",
        "This software is proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
    ],
}
#: Paragraphs that speak of licences without being a known one; they train the unknown class.
OTHERS = [
    "Released under a license of the authors' own making.", "A driving license is required.", "The bar lost its liquor license.", "Licensed under the terms of the agreement between the parties.",
    "Released under the Community Software License.", "This work is licensed.", "Licensed under conditions to be announced.", "The copyright law of the country was amended.",
    "The permission of the owner is needed to enter.", "Permission was granted to build a house.", "The software was released in May.", "The general public was admitted free of charge.",
    "He studied at MIT.", "The Apache helicopter was developed later.", "A creative commons of ideas.", "The source of the river is in the hills.", "The warranty of this toaster ends after two years.",
    "Redistribution of wealth is debated.", "The public domain of the city.", "Conditions and terms apply to this offer.", "The mozilla festival took place in London.", "The gnu is an antelope.",
    "An eclipse was seen by the general public.", "Attribution of the painting is disputed.", "Noncommercial flights were cancelled.", "No rights were reserved for the press.", "This version of the library is old.",
]
UNKNOWN = "unknown"
#: Families whose wordings differ by a word or two.
KIN = {"agpl": "gnu", "gpl": "gnu", "lgpl": "gnu", "cc-by": "cc", "cc-by-nc": "cc", "cc-by-sa": "cc"}
#: Common words, the commonest first; alone or in a row they make no notice, which trains the unknown class.
COMMON = dict.fromkeys("the of and to in a is that it on for be as with by at an are this or not you from have all no has may can must which any its into under either following provided use used such own out without shall your made part file files c s v nd".split())
CONFIRM, EPOCHS, FOLDS, NGRAM = 0.6, 200, 4, 3
#: What the bias gives the unknown class, how far weak n-grams may outweigh it, and the errors allowed above the least probability.
BIAS, REACH, ERRORS = 3.0, 2.95, 0.02


def words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.translate(ASCII_LOWER))


def ngrams(w: list[str]) -> list[str]:
    """All 1- to 3-grams."""
    return [" ".join(w[i : i + n]) for n in range(1, NGRAM + 1) for i in range(len(w) - n + 1)]


def likeness(w: list[str], templates: list[str]) -> float:
    """The largest share of a template's n-grams that are among those of the words."""
    own = set(ngrams(w))
    return max((len(own & (g := set(ngrams(words(t))))) / len(g) for t in templates), default=0.0)


def weak(gram: str) -> bool:
    """Single words and rows of common words alone don't make a notice."""
    w = gram.split(" ")
    return len(w) == 1 or COMMON.keys() >= set(w)


@dataclass
class Model:
    families: list[str]
    features: dict[str, int]
    weights: np.ndarray
    bias: np.ndarray
    heat: float = 1.0
    least: float = 0.5
    held_back: dict[str, float] = field(default_factory=dict)  # shares of held-back rows: given their class, right of those confirmed, confirmed of known and of left-out families

    def probabilities(self, text: str) -> np.ndarray:
        """The same in Python as ``scan`` does in Spark, for tests."""
        seen = {self.features[g] for g in ngrams(words(text)) if g in self.features}
        z = (self.bias + (self.weights[sorted(seen)].sum(0) / len(seen) ** 0.5 if seen else 0)) / self.heat
        p = np.exp(z - z.max())
        return p / p.sum()

    def strong(self) -> list[str]:
        """The pairs of words without one of which a paragraph is unknown: its features are then all weak.

        A family leads the unknown class by the sum of its features' leads over the root of their number, at most the
        root of the sum of the squares of the positive ones. Training holds that, over all weak features, below the
        lead that the bias gives the unknown class. A longer feature that is not weak holds a pair that is not.
        """
        return sorted(g for g in self.features if g.count(" ") == 1 and not weak(g))


def noisy_rows(templates: dict[str, list[str]], others: list[str], families: list[str], rng: np.random.Generator) -> list[tuple[list[str], int, str]]:
    """Templates, cut and noisy versions of them and paragraphs that are no notices: words, class and the text they come from."""
    noise = sorted({w for t in others for w in words(t)} | COMMON.keys())
    some = lambda lo, hi: list(map(str, rng.choice(noise, rng.integers(lo, hi))))
    rows: list[tuple[list[str], int, str]] = []
    for y, name in enumerate(families):
        for text in templates.get(name, others):
            w = words(text)
            rows.append((w, y, text))
            for _ in range(12 if y < len(families) - 1 else 6):
                rows.append(([*some(0, 6), *(x for x in w if rng.random() > 0.08), *some(0, 6)], y, text))
    unknown = len(families) - 1
    rows.extend((some(1, 15), unknown, "") for _ in range(200))
    known = sorted({g for name in templates for t in templates[name] for g in ngrams(words(t))})
    for g in known:  # one or two words of a notice among others don't make a notice
        if " " not in g:
            for more in (0, 1):
                rows.append(([*some(0, 8), g, *some(0, 8), *(str(x) for x in rng.choice(known, more) if " " not in x)], unknown, ""))
        elif weak(g):
            rows.extend(([*some(0, 8), *g.split(" "), *some(0, 8)], unknown, "") for _ in range(8))
    plain = [g for g in known if weak(g) and " " in g]
    for _ in range(400 if plain else 0):  # nor do many common ones
        rows.append(([w for g in rng.choice(plain, rng.integers(2, 8)) for w in [*str(g).split(" "), *some(1, 2)]], unknown, ""))
    return rows


def _matrix(rows: list[tuple[list[str], int, str]], features: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(rows), len(features)), np.float32)
    for i, (w, *_) in enumerate(rows):
        seen = sorted({features[g] for g in ngrams(w) if g in features})
        x[i, seen] = 1 / max(1, len(seen)) ** 0.5
    return x


def _descended(x: np.ndarray, y: np.ndarray, k: int, faint: np.ndarray, epochs: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by gradient descent with momentum; after every step the leads of ``faint`` features are drawn back within REACH."""
    onehot = np.eye(k, dtype=np.float32)[y]
    weights, bias = np.zeros((x.shape[1], k), np.float32), np.zeros(k, np.float32)
    bias[-1] = BIAS  # a paragraph without any feature is unknown

    def draw_back() -> None:
        lead = weights[faint, :-1] - weights[faint, -1:]
        size = np.sqrt((np.maximum(lead, 0) ** 2).sum(0))
        weights[faint, :-1] = weights[faint, -1:] + np.where(lead > 0, lead * np.minimum(1, REACH / np.maximum(size, 1e-9)), lead)

    speed = np.zeros_like(weights)
    for epoch in range(epochs):
        z = x @ weights + bias
        p = np.exp(z - z.max(1, keepdims=True))
        g = (p / p.sum(1, keepdims=True) - onehot) / len(x)
        speed = 0.9 * speed - 40 * (1 - epoch / epochs) * (x.T @ g + 1e-5 * weights)
        weights += speed
        draw_back()
    weights[np.abs(weights) < 0.01] = 0
    draw_back()
    return weights, bias


def train(templates: dict[str, list[str]] = TEMPLATES, others: list[str] = OTHERS, seed: int = 1) -> Model:
    """Multinomial logistic regression on the binary n-grams of all templates.

    It learns from templates and from cut and noisy versions of them; the training set is the templates (a bound of
    its own). FOLDS models each leave out whole kins of families, and of the rest a part of the versions and of the
    other paragraphs. The temperature comes from these versions. The least probability is the smallest above which, of
    the families named and confirmed, at most a share ERRORS are wrong, where all that is left out whole is unknown.
    """
    families = [*sorted(templates), UNKNOWN]
    rng = np.random.default_rng(seed)
    rows = noisy_rows(templates, others, families, rng)
    features = {g: i for i, g in enumerate(sorted({g for name in templates for t in templates[name] for g in ngrams(words(t))}))}
    faint = np.array([weak(g) for g in features], bool)
    x, y, k = _matrix(rows, features), np.array([v for _, v, _ in rows]), len(families)
    weights, bias = _descended(x, y, k, faint, EPOCHS)
    kin = sorted({KIN.get(name, name) for name in templates})
    kin_fold = np.array([kin.index(KIN.get(families[v], families[v])) % FOLDS if v < k - 1 else -1 for v in y])
    other_fold = {t: i % FOLDS for i, t in enumerate(others)}
    own_fold = np.array([other_fold[t] if t in other_fold else int(rng.integers(FOLDS)) for *_, t in rows])
    logits, target, alike, whole = [], [], [], []
    for f in range(FOLDS):
        used, judged = (kin_fold != f) & (own_fold != f), (kin_fold == f) | (own_fold == f)
        w, b = _descended(x[used], y[used], k, faint, EPOCHS // 2)
        z = x[judged] @ w + b
        logits.append(z)
        whole.append(kin_fold[judged] == f)
        target.append(np.where(whole[-1], k - 1, y[judged]))
        best = z.argmax(1)
        alike.append([likeness(rows[i][0], templates[families[v]]) if v < k - 1 else 0.0 for i, v in zip(np.flatnonzero(judged), best, strict=True)])
    z, y, alike, whole = (np.concatenate(v) for v in (logits, target, alike, whole))
    heat = temperature(z[~whole], y[~whole])
    p = np.exp((z - z.max(1, keepdims=True)) / heat)
    p /= p.sum(1, keepdims=True)
    best, sure = p.argmax(1), p.max(1)
    named = np.flatnonzero((best < k - 1) & (alike >= CONFIRM))
    named = named[np.argsort(-sure[named], kind="stable")]
    good = np.flatnonzero(np.cumsum(best[named] != y[named]) <= ERRORS * np.arange(1, len(named) + 1))
    least = float(sure[named[good[-1]]]) if len(good) else 1.0
    passed = named[sure[named] >= least]
    held_back = {"accuracy": float((best == y)[~whole].mean()), "precision": float((best[passed] == y[passed]).mean()) if len(passed) else 1.0, "known": float(np.isin(np.flatnonzero(~whole & (y < k - 1)), passed).mean()), "left out": float(np.isin(np.flatnonzero(whole), passed).mean())}
    return Model(families, features, weights, bias, heat, least, held_back)


def _rows(df: DataFrame, rows: list[dict], schema: str) -> DataFrame:
    """A table of literals, as many as the templates give."""
    return df.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def prefix_tree(some: list[str]) -> str:
    """A pattern for any of the words, or rows of words with a space between, that looks at each letter once."""
    if some == [""]:
        return ""
    heads = sorted({w[0] for w in some if w})
    tails = [("[^a-z0-9]+" if c == " " else c) + prefix_tree([w[1:] for w in some if w[:1] == c]) for c in heads]
    return tails[0] if len(tails) == 1 and "" not in some else f"(?:{'|'.join(tails)})" + "?" * ("" in some)


def grams_of(w: Column) -> Column:
    """Distinct 1- to 3-grams of an array of words."""
    at = lambda n: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[at(n) for n in range(1, NGRAM + 1)]))


def _scored(found: DataFrame, model: Model, weights: DataFrame, templates: DataFrame) -> DataFrame:
    """Rows of ``found`` (r0, r1, pos, lines, paragraph) that have a known family, with it, its probability, the likeness of the
    nearest template and whether both suffice. Only n-grams of features are kept; no other counts."""
    known = ", ".join(f"'{g}'" for g in model.features)  # letters, digits and spaces
    w = F.regexp_extract_all(ascii_lower(F.col("paragraph")), F.lit("([a-z0-9]+)"), F.lit(1))
    found = found.withColumn("w", w).select("r0", "r1", "pos", "lines", "paragraph", grams_of(F.col("w")).alias("all"))
    found = found.selectExpr("r0", "r1", "pos", "lines", "paragraph", f"filter(all, g -> g IN ({known})) AS grams")
    found = stored(found, "paragraphs")  # unfiltered: a filter would be pushed below ``w``, which each n-gram would then take anew
    k = range(len(model.families))
    key = ["r0", "r1", "pos", "lines"]
    scored = found.select(*key, F.explode("grams").alias("g")).join(F.broadcast(weights), "g")
    scored = scored.groupBy(*key).agg(F.count("*").alias("n"), *[F.expr(f"sum(w[{j}]) AS s{j}") for j in k])
    z = ", ".join(f"({float(model.bias[j])!r}D + s{j} / sqrt(n)) / {float(model.heat)!r}D" for j in k)
    scored = scored.selectExpr(*key, f"array({z}) AS z").selectExpr(*key, "z", "array_max(z) AS top")
    names = ", ".join(f"'{f}'" for f in model.families)
    scored = scored.selectExpr(*key, f"element_at(array({names}), int(array_position(z, top))) AS predicted", "1 / aggregate(z, 0D, (a, v) -> a + exp(v - top)) AS probability")
    out = found.join(scored.filter(F.col("predicted") != UNKNOWN), key).join(F.broadcast(templates), "predicted")
    like = F.array_max(F.transform("templates", lambda t: F.size(F.array_intersect(t, F.col("grams"))) / F.size(t)))
    out = out.select(*key, "paragraph", "predicted", "probability", like.alias("likeness"))
    return out.withColumn("sure", (F.col("probability") >= model.least) & (F.col("likeness") >= CONFIRM))


def _runs(lines: Column, ends: Callable[[Column, Column], Column]) -> Column:
    """Runs (pos, lines) of two or more lines between those for which ``ends`` of line and number holds."""
    at = F.filter(F.transform(lines, lambda x, i: F.when(ends(x, i), i)), lambda i: i.isNotNull())
    pairs = F.arrays_zip(F.concat(F.array(F.lit(-1)), at).alias("a"), F.concat(at, F.array(F.size(lines))).alias("b"))
    runs = F.transform(pairs, lambda p: F.struct((p["a"] + 1).alias("pos"), (p["b"] - p["a"] - 1).alias("lines")))
    return F.filter(runs, lambda r: r["lines"] > 1)


def scan(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    r"""Licence paragraphs: one row for each line that the classifier gives a known family, and for each block of lines
    (a notice that is wrapped) that is confirmed to be of one.

    Returns ``id_col``, r0, r1 (key of the row), pos (of the first line, from 0), lines (1, or a block's), paragraph
    (a block's lines are joined by a space), predicted, probability, family and likeness. ``family`` is the predicted
    one if the probability reaches the calibrated least and a template of it shares at least CONFIRM of its 1- to
    3-grams with the paragraph, else "unknown". Lines predicted unknown are left out. Null or empty texts have none.
    Other columns are not read.

    Blocks are runs of two or more lines that are not blank; of these, runs of lines that are not known alone; and of
    these, runs of lines that each hold a strong pair of words. A block is left out where a line or a smaller block within
    it is of its family. Texts, lines and blocks without a strong pair are passed over: they are unknown (see
    ``Model.strong``). Weights and templates are bounded by the templates.
    """
    model = model or train()
    pair = rf"(?i)(?<![a-z0-9]){prefix_tree(model.strong())}(?![a-z0-9])"
    holds = lambda x: x.rlike(pair)
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter(holds(F.col("text")))
    texts = base.select("id", "text", *[k.alias(f"r{i}") for i, k in enumerate(row_key(F.col("id"), F.col("text")))]).dropDuplicates(["r0", "r1"])
    texts = stored(texts.select("id", "r0", "r1", F.split("text", "\n", -1).alias("all")), "licence-texts")

    weights = stored(_rows(docs, [{"g": g, "w": [round(float(v), 5) for v in model.weights[i]]} for g, i in model.features.items()], "g string, w array<double>"), "licence-weights")
    templates = [{"predicted": f, "templates": [sorted(set(ngrams(words(t)))) for t in TEMPLATES[f]]} for f in TEMPLATES]
    templates = stored(_rows(docs, templates, "predicted string, templates array<array<string>>"), "licence-templates")
    single = F.transform("all", lambda x, i: F.struct(i.alias("pos"), F.lit(1).alias("lines"), x.alias("paragraph")))
    alone = texts.select("r0", "r1", F.inline(F.filter(single, lambda s: holds(s["paragraph"]))))
    alone = stored(_scored(alone, model, weights, templates), "licence-lines")
    known = alone.filter("sure").groupBy("r0", "r1").agg(F.collect_list(F.struct("pos", "lines", "predicted")).alias("known"), F.collect_list("pos").alias("at"))

    both = texts.join(known.select("r0", "r1", "at"), ["r0", "r1"], "left").withColumn("at", F.coalesce("at", F.array().cast("array<int>")))
    blank = lambda x: x.rlike(r"^\s*$")
    taken = lambda x, i: blank(x) | F.array_contains("at", i)
    lines = F.col("all")
    runs = F.array_distinct(F.concat(_runs(lines, lambda x, i: blank(x)), _runs(lines, taken), _runs(lines, lambda x, i: taken(x, i) | ~holds(x))))
    blocks = F.transform(runs, lambda r: F.struct(r["pos"].alias("pos"), r["lines"].alias("lines"), F.array_join(F.slice(lines, r["pos"] + 1, r["lines"]), " ").alias("paragraph")))
    blocks = both.select("r0", "r1", F.inline(F.filter(blocks, lambda b: holds(b["paragraph"]))))
    blocks = stored(_scored(blocks, model, weights, templates), "licence-blocks").filter("sure")
    within = blocks.groupBy("r0", "r1").agg(F.collect_list(F.struct("pos", "lines", "predicted")).alias("found"))
    blocks = blocks.join(within, ["r0", "r1"]).join(known.select("r0", "r1", "known"), ["r0", "r1"], "left")
    end = F.col("pos") + F.col("lines")
    inside = lambda k: (k["predicted"] == F.col("predicted")) & (k["pos"] >= F.col("pos")) & (k["pos"] + k["lines"] <= end) & (k["lines"] < F.col("lines"))
    blocks = blocks.filter(~F.exists("found", inside) & ~F.coalesce(F.exists("known", inside), F.lit(False)))

    out = alone.unionByName(blocks.select(*alone.columns)).join(texts.select("id", "r0", "r1"), ["r0", "r1"])
    return out.select(F.col("id").alias(id_col), "r0", "r1", "pos", "lines", "paragraph", "predicted", "probability", F.when(F.col("sure"), F.col("predicted")).otherwise(F.lit(UNKNOWN)).alias("family"), "likeness")


def grams(text: str) -> list[str]:
    return ngrams(words(text))


def by_document(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: ``id_col``, n_licences (lines and blocks of a known family), n_unknown (licence-like lines of none),
    families (sorted, comma-joined; empty if none) and positions (array of the first lines' numbers, ascending)."""
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.select("id", *[k.alias(f"r{i}") for i, k in enumerate(row_key(F.col("id"), F.col("text")))])
    known = F.col("family") != UNKNOWN
    sums = scan(docs, model, id_col, text_col).groupBy("r0", "r1").agg(
        F.count_if(known).alias("known"), F.count_if(~known).alias("other"), F.sort_array(F.collect_set(F.when(known, F.col("family")))).alias("fams"), F.sort_array(F.collect_list(F.when(known, F.col("pos")))).alias("at")
    )
    out = base.join(sums, ["r0", "r1"], "left")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("known", F.lit(0)).cast("long").alias("n_licences"),
        F.coalesce("other", F.lit(0)).cast("long").alias("n_unknown"),
        F.coalesce(F.array_join("fams", ","), F.lit("")).alias("families"),
        F.coalesce("at", F.array().cast("array<int>")).alias("positions"),
    )
