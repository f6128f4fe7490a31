"""Mixing sources to target weights by soft membership."""

from __future__ import annotations

import json
import re
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, ascii_lower, drop, row_key, stored
from .sampling import in_order, labelled_sample, temperature

DOMAINS = ("high", "low", "toxic")
#: Target share of the tokens by domain.
WEIGHTS = {"high": 0.90, "low": 0.08, "toxic": 0.02}
SAMPLE, VOCABULARY, STEPS = 800, 2000, 300
ROUNDS, CLOSE, DEPTH = 40, 1e-6, 6
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Symbols that prose doesn't repeat.
SYMBOLS = "#$%&*!|~^=<>@{}[]\\_+"
N_SHAPES = 3


def shape_features(text: Column, words: Column, distinct: Column) -> list[Column]:
    """Shares of symbols and of capitals among characters, and of distinct words among words."""
    n = F.char_length(text)
    without = lambda some: (n - F.char_length(F.translate(text, some, ""))) / F.greatest(n, F.lit(1))
    return [without(SYMBOLS), without(UPPER), F.size(distinct) / F.greatest(F.size(words), F.lit(1))]


def python_features(text: str) -> tuple[list[str], list[float]]:
    """The same as the columns above, for training."""
    low = text.translate(str.maketrans(UPPER, UPPER.lower()))
    w = [x for x in re.split(BREAKS, low) if x]
    return w, [sum(map(text.count, SYMBOLS)) / max(1, len(text)), sum(map(text.count, UPPER)) / max(1, len(text)), len(set(w)) / max(1, len(w))]


@dataclass
class Model:
    domains: tuple[str, ...]
    words: dict[str, list[float]]  # what the presence of a word adds to the logits
    shapes: np.ndarray
    bias: np.ndarray
    heat: float

    def posteriors(self, text: str) -> np.ndarray:
        w, s = python_features(text)
        z = self.bias + np.array(s) @ self.shapes
        for x in set(w) & self.words.keys():
            z = z + np.array(self.words[x])
        p = np.exp((z - z.max()) / self.heat)
        return p / p.sum()


def train(sample: list[tuple[str, str]], domains: tuple[str, ...] = DOMAINS, size: int = VOCABULARY, seed: int = 1, counts: dict[str, int] | None = None) -> Model:
    """Multinomial logistic regression on the presence of words and on shapes. The words are those of the sample whose
    presence tells most about the domain; a fifth of the texts is held back for the temperature. ``counts`` has the
    labelled rows of each domain in the whole table, whose shares take the place of the sample's."""
    present = [d for d in domains if any(y == d for _, y in sample)]
    if not present:
        return Model(domains, {}, np.zeros((N_SHAPES, len(domains))), np.zeros(len(domains)), 1.0)
    rng = np.random.default_rng(seed)
    sample = [sample[i] for i in rng.permutation(len(sample))]
    number: dict[str, int] = {}
    bags, shapes = [], []
    for text, _ in sample:
        w, s = python_features(text)
        bags.append(np.array(sorted({number.setdefault(v, len(number)) for v in w}), np.int32))
        shapes.append(s)
    spelt = list(number)
    y = np.array([domains.index(d) for _, d in sample])
    seen = np.zeros((len(number), len(domains)))
    for bag, k in zip(bags, y, strict=True):
        seen[bag, k] += 1
    rate = np.bincount(y, minlength=len(domains)) / len(y)
    total = seen.sum(1)
    tells = ((seen - total[:, None] * rate) ** 2 / np.maximum(total[:, None] * rate, 1e-9)).sum(1)
    chosen = sorted(np.flatnonzero(total >= 5).tolist(), key=lambda i: (-tells[i], spelt[i]))[:size]
    col = {spelt[i]: j for j, i in enumerate(chosen)}
    place = np.full(len(number), -1)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((len(y), len(col) + N_SHAPES), np.float32)
    for i, bag in enumerate(bags):
        x[i, place[bag][place[bag] >= 0]] = 1
    x[:, len(col) :] = np.array(shapes) * 5
    held = np.arange(len(y)) % 5 == 0 if len(y) >= 20 else np.zeros(len(y), bool)
    tx, onehot = x[~held], np.eye(len(domains), dtype=np.float32)[y[~held]]
    w, b = np.zeros((x.shape[1], len(domains)), np.float32), np.log(np.maximum(rate, 1e-6)).astype(np.float32)
    step = 1.0 / max(1.0, float((tx**2).sum(1).mean()) / 4)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(STEPS):
        z = tx @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        g = (p / p.sum(1, keepdims=True) - onehot) / len(tx)
        vw = 0.9 * vw - step * (tx.T @ g + 1e-4 * w)
        vb = 0.9 * vb - step * g.sum(0)
        w, b = w + vw, b + vb
    absent = [k for k, d in enumerate(domains) if d not in present]
    b[absent] = -30
    heat = temperature(x[held] @ w + b, y[held])
    if counts:
        for j, d in enumerate(domains):
            if d in present:
                b[j] += heat * np.log(counts[d] / sum(counts.values()) / rate[j])
    return Model(domains, {v: [round(float(a), 6) for a in w[i]] for v, i in col.items()}, np.float64(w[len(col) :]) * 5, np.float64(b), heat)


def domain_of(quality: Column, toxic: Column) -> Column:
    """The labels' domain: toxic before the rest, then high or low quality; null where neither is known."""
    return F.when(toxic == 1, "toxic").when(quality == 1, "high").when(quality == 0, "low")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """The classifier, from at most ``sample`` labelled documents a domain."""
    marks = labels.select(F.col(id_col).alias("id"), domain_of(F.col("quality"), F.col("toxic")).alias("y")).filter(F.col("y").isNotNull())
    rows, counts = labelled_sample(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), marks, sample)
    return train(in_order(rows.collect()), counts=counts)  # on the driver, as no Python runs on executors


def literal_table(df: DataFrame, rows: list[dict], schema: str) -> DataFrame:
    """A small table of literals."""
    return df.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def posteriors(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per distinct (id, text): id, r0, r1 (its key), copies, n_tokens (words) and p0, p1, ... by domain.

    The distinct words of a text meet a broadcast table of at most VOCABULARY rows; what they add is summed map-side,
    so the shuffle carries a row a document.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    low = ascii_lower(F.col("text"))
    w = F.col("w")
    base = base.withColumn("w", F.array_remove(F.split(low, BREAKS, -1), "")).withColumn("u", F.array_distinct("w"))
    shapes = [c.alias(f"s{i}") for i, c in enumerate(shape_features(F.col("text"), w, F.col("u")))]
    keys = [k.alias(f"r{i}") for i, k in enumerate(row_key(F.col("id"), F.col("text")))]
    base = base.select("id", *keys, F.size(w).cast("long").alias("n"), *shapes, F.concat(F.array(F.lit("")), "u").alias("w"))
    k = len(model.domains)
    table = literal_table(docs, [{"word": "", "z": [0.0] * k}, *({"word": x, "z": z} for x, z in model.words.items())], "word string, z array<double>")
    table = table.select("word", *[F.col("z")[j].alias(f"z{j}") for j in range(k)])
    rows = base.select("id", "r0", "r1", "n", *[f"s{i}" for i in range(N_SHAPES)], F.explode("w").alias("word")).join(F.broadcast(table), "word")
    copies = F.count_if(F.col("word") == "")  # each row has the empty word once
    sums = rows.groupBy("r0", "r1").agg(F.max("id").alias("id"), copies.alias("copies"), F.max("n").alias("n_tokens"), *[F.max(f"s{i}").alias(f"s{i}") for i in range(N_SHAPES)], *[F.sum(f"z{j}").alias(f"z{j}") for j in range(k)])
    z = []
    for j in range(k):
        own = sum((F.col(f"s{i}") * float(model.shapes[i][j]) for i in range(N_SHAPES)), F.lit(float(model.bias[j])))
        z.append((own + F.col(f"z{j}") / F.col("copies")) / model.heat)
    sums = sums.select("id", "r0", "r1", "copies", "n_tokens", *[c.alias(f"z{j}") for j, c in enumerate(z)])
    top = F.greatest(*[F.col(f"z{j}") for j in range(k)])
    e = [F.exp(F.col(f"z{j}") - top) for j in range(k)]
    return sums.select("id", "r0", "r1", "copies", "n_tokens", *[(x / sum(e[1:], e[0])).alias(f"p{j}") for j, x in enumerate(e)])


def totals(post: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Expected tokens by domain, their products by pairs of domains, and all tokens: k * (k + 1) + 1 numbers."""
    n = F.col("copies") * F.col("n_tokens")
    cols = [F.sum(n * F.col(f"p{i}")) for i in range(k)] + [F.sum(n * F.col(f"p{i}") * F.col(f"p{j}")) for i in range(k) for j in range(k)] + [F.sum(n)]
    got = np.array([v or 0.0 for v in post.agg(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).head()], float)
    return got[:k], got[k:-1].reshape(k, k), got[-1]


def with_rates(post: DataFrame, targets: np.ndarray, gram: np.ndarray, rounds: int = ROUNDS, close: float = CLOSE) -> DataFrame:
    """Adds ``rate``: nonnegative, 1 at the start, moved by projected gradient steps until the expected tokens by domain
    (sum of copies * n_tokens * rate * p) match the targets in least squares.

    Rates are scaled by their documents' tokens and the misfit by the inverse of ``gram`` over the rates above 0; a
    step adds one number a domain times p to each rate, then cuts it at 0. So a round is one sum of a few numbers over
    the table, and rates are expressions until DEPTH steps are written out. Rates of which the targets are out of reach are the least
    squares ones; where the rounds end before that, a warning gives the misfit.
    """
    k = len(targets)
    post = post.withColumn("rate", F.lit(1.0))
    rate, depth, last, kept, metric = F.col("rate"), 0, np.inf, [], np.linalg.pinv(gram, rcond=1e-9)
    for _ in range(rounds):
        n, moves = F.col("copies") * F.col("n_tokens"), F.when(rate > 0, 1.0).otherwise(0.0)
        sums = [F.sum(n * rate * F.col(f"p{j}")) for j in range(k)] + [F.sum(n * moves * F.col(f"p{i}") * F.col(f"p{j}")) for i in range(k) for j in range(k)]
        got = np.array([v or 0.0 for v in post.agg(*[c.alias(f"c{i}") for i, c in enumerate(sums)]).head()], float)
        miss = targets - got[:k]
        size = float(miss @ metric @ miss)
        if np.linalg.norm(miss) <= close * max(1.0, np.linalg.norm(targets)) or size >= last * (1 - close):
            break
        # The step of the rates that can still move either way; the full one, which is never too long, if they are too few.
        free = got[k:].reshape(k, k)
        inverse = np.linalg.pinv(free if np.linalg.cond(free) < 1e8 else gram, rcond=1e-9)
        last, step = size, inverse @ miss
        rate, depth = F.greatest(F.lit(0.0), rate + sum((F.col(f"p{j}") * float(step[j]) for j in range(1, k)), F.col("p0") * float(step[0]))), depth + 1
        if depth == DEPTH:  # else expressions nest ever deeper
            post, rate, depth = stored(post.withColumn("rate", rate), "rates"), F.col("rate"), 0
            kept.append(post)
    else:
        warnings.warn(f"{rounds} rounds leave {np.linalg.norm(miss) / max(1.0, np.linalg.norm(targets)):.2e} of the targets", stacklevel=2)
    out = stored(post.withColumn("rate", rate), "rates")
    drop(*kept)
    return out


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, whole: str | None = None, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """Document rates under which the expected tokens of each domain match a target.

    Targets are ``weights`` (WEIGHTS if none are given) as shares of all tokens. With ``whole`` that domain's target is
    all it has, and the others' what their weights are beside it, but no more than they have. Returns one row per input
    row: ``id_col``, r0, r1 (key of the row), n_tokens, p (array of posteriors in the order of DOMAINS) and rate (0 or more). Rows of one id and text share one rate. Null or empty
    texts have no tokens and get the rate of their posterior. A domain without any mass is left out of the fit; empty
    tables give no rows. Labels that are null or name no document teach nothing. Other columns are not read.
    """
    model = model or fit(docs, labels, id_col, text_col)
    k = len(model.domains)
    post = stored(posteriors(docs, model, id_col, text_col), "posteriors")
    have, gram, every = totals(post, k)
    share = np.array([(weights or WEIGHTS)[d] for d in model.domains])
    if whole is not None:
        j = model.domains.index(whole)
        targets = np.minimum(have, have[j] * share / share[j])
    else:
        targets = share * every
    out = with_rates(post, targets, gram)
    drop(post)
    p = F.array(*[F.col(f"p{j}") for j in range(k)]).alias("p")
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return out.select(F.col("id").alias(id_col), "r0", "r1", "n_tokens", p, "rate", copies.alias("_c")).drop("_c")
