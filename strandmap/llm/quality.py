"""Quality classifier: random-indexing word vectors pooled by document under a two-layer network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import small_batches
from .langid import joined, sums
from .sampling import fitted, labelled_sample, temperature

BITS, DIM, ONES, REACH = 14, 64, 4, 2
SAMPLE, EPOCHS, HIDDEN, RATE, CUT = 2000, 40, 32, 0.003, 0.3
#: Classes of bytes: 0 blank, 1 line end, 2 letter, 3 digit, 4 symbol.
CLASS = np.full(256, 4, np.int8)
CLASS[[0, 9, 11, 12, 32]] = 0
CLASS[[10, 13]] = 1
CLASS[48:58] = 3
CLASS[65:91] = CLASS[97:123] = CLASS[128:] = 2
UPPER = np.zeros(256, bool)
UPPER[65:91] = True


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes of one class: a row of its spelling (case folded), one of its form, and the runs of each document.

    The form tells the class, the length, the case of the first and last letter and whether it repeats the run of
    its class before it.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(len(offs) - 1, np.int64)
    kind = CLASS[data]
    edge = np.ones(n + 1, bool)
    edge[1:n] = kind[1:] != kind[:-1]
    edge[offs] = True
    at = np.flatnonzero(edge)
    first, end = at[:-1], at[1:]
    keep = kind[first] > 0
    first, end = first[keep], end[keep]
    up, down = tk.POWERS.upto(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(tk.BYTE[data] * up, out=total[1:])
    spelt = tk.mix((total[end] - total[first]) * down[first])
    of = np.diff(np.searchsorted(first, offs))
    again = np.zeros(len(spelt), bool)
    for back in (1, 2):
        again[back:] |= (spelt[back:] == spelt[:-back]) & (kind[first[back:]] == 2)
    long = np.minimum(np.log2(end - first + 1).astype(np.int64), 7)
    form = kind[first] + 5 * (long + 8 * (UPPER[data[first]] + 2 * UPPER[data[end - 1]] + 4 * again))
    return (spelt >> np.uint64(64 - BITS)).astype(np.int32), form.astype(np.int32), of


N_FORMS = 5 * 8 * 8


def index_vectors(n: int, seed: int) -> np.ndarray:
    """Sparse random ternary vectors, the same wherever they are made."""
    rng = np.random.default_rng(seed)
    out = np.zeros((n, DIM), np.float32)
    for _ in range(ONES):
        out[np.arange(n), rng.integers(0, DIM, n)] += rng.choice(np.array([-1, 1], np.float32), n)
    return out


@dataclass
class Model:
    words: np.ndarray
    forms: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    heat: float = 1.0
    near: tuple | None = None

    def pooled(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        spelt, form, n = tokens(data, offs)
        d = np.maximum(n, 1)[:, None]
        return np.hstack([sums(self.words[spelt], n) / d, sums(self.forms[form], n) / d, np.log1p(n)[:, None]])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """As logits(pooled()), with the first layer taken into the tables: pooling is linear."""
        if self.near is None:
            w = self.w1 / self.scale[:, None]
            self.near = ((self.words @ w[:DIM]).astype(np.float32), self.forms @ w[DIM : 2 * DIM], w[-1], self.b1 - self.mean @ w)
        words, forms, size, bias = self.near
        spelt, form, n = tokens(data, offs)
        seen = np.bincount(np.repeat(np.arange(len(n)) * N_FORMS, n) + form, minlength=len(n) * N_FORMS).reshape(len(n), N_FORMS)
        h = np.tanh((sums(words[spelt], n) + seen @ forms) / np.maximum(n, 1)[:, None] + np.log1p(n)[:, None] * size + bias)
        z = (h @ self.w2 + self.b2) / self.heat
        return 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -60, 60)))


def random_indexing(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Word vectors: each row's own index vector plus the direction of the summed index vectors around it."""
    own = index_vectors(1 << BITS, 3)
    around = np.zeros_like(own)
    for _, _, part, part_offs in tk.chunks(data, offs):
        spelt, _, n = tokens(part, part_offs)
        doc = np.repeat(np.arange(len(n)), n)
        for step in range(1, REACH + 1):
            same = doc[step:] == doc[:-step]
            a, b = spelt[:-step][same], spelt[step:][same]
            for target, context in ((a, b), (b, a)):
                order = np.argsort(target, kind="stable")
                rows, starts = np.unique(target[order], return_index=True)
                if len(rows):
                    around[rows] += np.add.reduceat(own[context[order]], starts, axis=0)
    size = np.linalg.norm(around, axis=1, keepdims=True)
    return own + 2 * around / np.maximum(size, 1e-9)


def train(sample: list[tuple[str, int]], epochs: int = EPOCHS, seed: int = 1, counts: dict[int, int] | None = None) -> Model:
    """Two layers by Adam; every fifth text is held back for the temperature. ``counts`` has the labelled rows of each kind
    in the whole table, whose shares take the place of the sample's in the probabilities."""
    rng = np.random.default_rng(seed)
    if len({y for _, y in sample}) < 2:  # one kind or none: its share, or an even chance, for every text
        k, lean = 2 * DIM + 1, 0.0 if not sample else (1.0 if sample[0][1] else -1.0)
        flat = [np.zeros((1 << BITS, DIM), np.float32), np.zeros((N_FORMS, DIM), np.float32), np.zeros(k), np.ones(k)]
        return Model(*flat, np.zeros((k, HIDDEN)), np.zeros(HIDDEN), np.zeros((HIDDEN, 2)), np.array([-3.0, 3.0]) * lean)
    sample = [sample[i] for i in rng.permutation(len(sample))]
    data, offs = joined([t for t, _ in sample])
    y = np.array([int(v) for _, v in sample])
    k = 2 * DIM + 1
    m = Model(random_indexing(data, offs), index_vectors(N_FORMS, 5), np.zeros(k), np.ones(k), rng.normal(0, k**-0.5, (k, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, 2)), np.zeros(2))
    x = np.vstack([m.pooled(part, po) for _, _, part, po in tk.chunks(data, offs)])
    held = np.arange(len(y)) % 5 == 0
    tx, ty = x[~held], y[~held]
    m.mean, m.scale = tx.mean(0), tx.std(0) + 1e-6
    params = [m.w1, m.b1, m.w2, m.b2]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    tx = (tx - m.mean) / m.scale
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(ty)), max(1, len(ty) // 64)):
            h = np.tanh(tx[rows] @ m.w1 + m.b1)
            z = h @ m.w2 + m.b2
            g = np.exp(z - z.max(1, keepdims=True))
            g /= g.sum(1, keepdims=True)
            g[np.arange(len(rows)), ty[rows]] -= 1
            g /= len(rows)
            gh = g @ m.w2.T * (1 - h * h)
            t += 1
            for i, grad in enumerate((tx[rows].T @ gh + 1e-3 * m.w1, gh.sum(0), h.T @ g, g.sum(0))):
                first[i] = 0.9 * first[i] + 0.1 * grad
                second[i] = 0.999 * second[i] + 0.001 * grad * grad
                params[i] -= RATE * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    m.heat = temperature(m.logits(x[held]), y[held])
    if counts:
        for v in (0, 1):
            m.b2[v] += m.heat * np.log(counts[v] / sum(counts.values()) / (y == v).mean())
    return m


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out: Column | None = None, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled documents of each kind, of those not ``held_out``
    (a condition over the labels' columns), trained in one task."""
    marks = labels.filter(F.col(label_col).isin(0, 1))
    if held_out is not None:
        marks = marks.filter(F.coalesce(~held_out, F.lit(False)))
    marks = marks.select(F.col(id_col).alias("id"), F.col(label_col).alias("y"))
    rows, counts = labelled_sample(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), marks, sample)
    return fitted(rows, partial(train, counts=counts))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """A row per input row: ``id_col``, score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= cut).

    Every whole text is scored, from its text alone; null counts as empty. Other columns are not read.
    """
    small_batches(docs.sparkSession)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = tk.buffers(batch.column(1))
            s = np.zeros(batch.num_rows)
            for i, j, part, part_offs in tk.chunks(data, offs):
                s[i:j] = model.score(part, part_offs)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= cut).astype(np.int32))], [id_col, "score", "predicted"])

    base = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    kind = base.schema[0].dataType.simpleString()
    return base.mapInArrow(predict, f"`{id_col}` {kind}, score double, predicted int")
