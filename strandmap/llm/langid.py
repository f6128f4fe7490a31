"""Language identification: averaged hashed subword embeddings under a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import small_batches
from .sampling import fitted, labelled_sample, temperature

UNKNOWN = "und"
#: Subwords of 2 to 4 bytes; hashed to 2 ** BITS rows of DIM.
ORDERS, BITS, DIM = (2, 3, 4), 15, 16
SAMPLE, EPOCHS, RATE, REJECTED, MOST = 1500, 8, 0.5, 0.001, 0.35
#: ASCII other than letters only bounds words.
LETTER = np.ones(256, bool)
LETTER[:128] = False
LETTER[65:91] = LETTER[97:123] = True
ASCII_LETTER = LETTER.copy()
ASCII_LETTER[128:] = False
CODE = np.where(LETTER, tk.BYTE, np.uint64(0))


def subwords(data: np.ndarray, offs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order, the rows of its subwords and how many each document has. A subword holds a bound at its ends only."""
    letter, code = LETTER[data], CODE[data]
    out = []
    for n in ORDERS:
        m = max(0, len(data) - n + 1)
        h = np.zeros(m, np.uint64)
        for j in range(n):
            h += code[j : j + m] * tk.STEP[j]
        whole = np.ones(m, bool)
        for j in range(1, n - 1) if n > 2 else (0,):
            whole &= letter[j : j + m]
        for j in range(1, n):  # not over the bounds of documents
            cut = offs[1:-1] - j
            whole[cut[(cut >= 0) & (cut < m)]] = False
        at = np.flatnonzero(whole)
        rows = (tk.mix(h[at] + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int32)
        out.append((rows, np.diff(np.searchsorted(at, offs))))
    return out


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows; a run may be empty."""
    out = np.zeros((len(counts), values.shape[1]), values.dtype)
    some = counts > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(counts) - counts)[some], axis=0)
    return out


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # embeddings times the softmax layer
    bias: np.ndarray
    heat: float = 1.0
    least: float = 0.0

    def logits(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        total, n = np.zeros((len(offs) - 1, len(self.langs)), np.float32), np.zeros(len(offs) - 1)
        for rows, counts in subwords(data, offs):
            total += sums(self.table[rows], counts)
            n += counts
        return total / np.maximum(n, 1)[:, None] + self.bias

    def probabilities(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        z = self.logits(data, offs) / self.heat
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def by_chunks(f, texts: list[str]) -> np.ndarray:
    """f(bytes, offsets) over texts, a chunk at a time."""
    data, offs = joined(texts)
    return np.vstack([f(part, part_offs) for _, _, part, part_offs in tk.chunks(data, offs)])


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return tk.buffers(pa.array(texts, pa.large_string()))


def train(sample: list[tuple[str, str]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 1) -> Model:
    """Stochastic gradient descent over whole texts; every fifth text is held back for temperature and rejection."""
    langs = sorted({y for _, y in sample})
    if not langs:  # nothing to learn from: one unknown language, in which all that has letters is accepted
        return Model([UNKNOWN], np.zeros((1 << BITS, 1), np.float32), np.zeros(1, np.float32))
    rng = np.random.default_rng(seed)
    sample = [sample[i] for i in rng.permutation(len(sample))]
    held, used = (sample[::5], [s for i, s in enumerate(sample) if i % 5]) if len(sample) >= 10 else (sample, sample)
    bags = []
    for text, y in used:
        rows = np.concatenate([r for r, _ in subwords(*joined([text]))])
        if len(rows):
            ids, n = np.unique(rows, return_counts=True)
            bags.append((ids.astype(np.uint16), (n / n.sum()).astype(np.float32), langs.index(y)))
    emb = rng.normal(0, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    out += rng.normal(0, 0.3, out.shape)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in rng.permutation(len(bags)):
            ids, w, y = bags[k]
            v = w @ emb[ids]
            z = v @ out + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[y] -= 1
            back = out @ g
            out -= step * np.outer(v, g)
            bias -= 0.01 * step * g
            emb[ids] -= (step * 40 * w)[:, None] * back
    model = Model(langs, (emb @ out).astype(np.float32), bias)
    texts, y = [t for t, _ in held], np.array([langs.index(v) for _, v in held])
    model.heat = temperature(by_chunks(model.logits, texts), y)
    p = by_chunks(model.probabilities, texts)
    right = np.sort(p[np.arange(len(y)), y][p.argmax(1) == y])
    # The score below which at most a share REJECTED of held-back texts lies, and never above MOST: texts in two
    # known languages come to about a half for either and stay.
    model.least = float(min(MOST, 0.9 * right[int(REJECTED * len(right))])) if len(right) else 0.0
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: Column | None = None, sample: int = SAMPLE) -> Model:
    """A model from text and language of at most ``sample`` distinct texts a language, of those not ``held_out``, trained in one task."""
    rows = docs if held_out is None else docs.filter(F.coalesce(~held_out, F.lit(False)))
    return fitted(labelled_sample(rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("y")), None, sample)[0], train)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: ``id_col``, lang_pred, score (0 to 1) and rejected. Every whole text is scored, from its text alone.

    lang_pred is "und" (score 0, rejected) where the text is null or has no letter (Unicode categories L*), else the
    likeliest learned language, even where it is rejected for a score below the calibrated least. Other columns are
    not read.
    """
    small_batches(docs.sparkSession)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = tk.buffers(batch.column(1))
            best, score = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for i, j, part, part_offs in tk.chunks(data, offs):
                p = model.probabilities(part, part_offs)
                best[i:j], score[i:j] = p.argmax(1), p.max(1)
                seen = np.concatenate([[0], np.cumsum(ASCII_LETTER[part])])
                for d in np.flatnonzero(seen[part_offs[1:]] == seen[part_offs[:-1]]):
                    text = part[part_offs[d] : part_offs[d + 1]].tobytes().decode("utf-8", "replace")
                    if not any(map(str.isalpha, text)):
                        best[i + d], score[i + d] = -1, 0
            names = [*model.langs, UNKNOWN]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([names[k] for k in best], pa.string()), pa.array(np.clip(score, 0, 1)), pa.array((best < 0) | (score < model.least))], [id_col, "lang_pred", "score", "rejected"])

    base = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    kind = base.schema[0].dataType.simpleString()
    return base.mapInArrow(predict, f"`{id_col}` {kind}, lang_pred string, score double, rejected boolean")
