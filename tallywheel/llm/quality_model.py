"""Quality by a generalised additive model with pairwise interactions.

A text becomes a dozen figures. Each figure is cut into bins, and boosting that goes round the figures
again and again fits a small tree on one figure at a time and adds it to that figure's lookup table.
Then the pairs of figures that explain most of what is left get two-dimensional tables in the same way.
A score is the sum of one entry from each table, so texts are scored by bin lookups and additions.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from tallywheel.llm.labelled import labelled_sample, threshold_of
from tallywheel.llm.toxicity import with_scores
from tallywheel.llm.words import run_hashes, word_hashes

FIGURES = ("words", "word_length", "distinct", "symbols", "capitals", "digits", "shouts", "bars", "adjacent", "runs_again", "lines_again", "line_length", "stops")
_SYMBOLS, _CAPITALS, _DIGITS = b"#*$%&<>", bytes(range(65, 91)), bytes(range(48, 58))


def figures(texts: list[str | None]) -> np.ndarray:
    """One row of figures for each text; an empty text has zeros."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    lists = [r.split() for r in raw]
    flat, offsets = word_hashes(lists)
    out = np.zeros((len(texts), len(FIGURES)))
    for i, (r, words) in enumerate(zip(raw, lists, strict=True)):
        n = len(words)
        if not n:
            continue
        h = flat[offsets[i] : offsets[i + 1]]
        dense = len(b"".join(words))
        share = lambda chars: (len(r) - len(r.translate(None, chars))) / dense  # noqa: B023, E731
        runs = run_hashes(h, 4)
        lines = [x for x in r.split(b"\n") if x and not x.isspace()]
        out[i] = (
            math.log1p(n), dense / n, len(np.unique(h)) / n, share(_SYMBOLS), share(_CAPITALS), share(_DIGITS), r.count(b"!") / n, r.count(b"|") / n,
            float(np.mean(h[1:] == h[:-1])) if n > 1 else 0.0, 1 - len(np.unique(runs)) / len(runs) if len(runs) else 0.0, 1 - len(set(lines)) / len(lines), math.log1p(dense / len(lines)), (r.count(b".") + r.count(b",")) / n,
        )
    return out


@dataclass
class Additive:
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]
    base: float
    shift: float = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            z += t[b[:, j]]
        for i, j, t in self.pairs:
            z += t[b[:, i], b[:, j]]
        return z


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Values of a tree with so many leaves over the bins of one figure, from sums of gradients and weights."""
    bounds = [(0, len(g))]
    G, H = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))
    gain = lambda a, b: (G[b] - G[a]) ** 2 / (H[b] - H[a] + 1.0)
    while len(bounds) < leaves:
        best = (1e-9, None)
        for k, (a, b) in enumerate(bounds):
            if b - a > 1:
                m = np.arange(a + 1, b)
                won = gain(a, m) + gain(m, b) - gain(a, b)
                top = int(np.argmax(won))
                if won[top] > best[0]:
                    best = (won[top], (k, a, int(m[top]), b))
        if best[1] is None:
            break
        k, a, m, b = best[1]
        bounds[k : k + 1] = [(a, m), (m, b)]
    out = np.zeros(len(g))
    for a, b in bounds:
        out[a:b] = _leaf(G[b] - G[a], H[b] - H[a])
    return out


def _square(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best pair of cuts through a table of two figures: gain, and the values of the four parts."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    tot_g, tot_h = G[-1, -1], H[-1, -1]
    a, ah = G[:-1, :-1], H[:-1, :-1]
    b, bh = G[:-1, -1:] - a, H[:-1, -1:] - ah
    c, ch = G[-1:, :-1] - a, H[-1:, :-1] - ah
    d, dh = tot_g - a - b - c, tot_h - ah - bh - ch
    won = a**2 / (ah + 1) + b**2 / (bh + 1) + c**2 / (ch + 1) + d**2 / (dh + 1)
    if not won.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(np.argmax(won)), won.shape)
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :] = _leaf(a[i, j], ah[i, j]), _leaf(b[i, j], bh[i, j])
    out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = _leaf(c[i, j], ch[i, j]), _leaf(d[i, j], dh[i, j])
    return float(won[i, j] - tot_g**2 / (tot_h + 1)), out


def train(x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 150, pair_rounds: int = 60, n_pairs: int = 6, rate: float = 0.15, seed: int = 7) -> Additive:
    """Fit a model; a quarter of the rows is held back for the threshold."""
    y = np.asarray(y, float)
    if not len(y) or y.min() == y.max():
        return Additive([np.empty(0)] * len(FIGURES), [np.zeros(1)] * len(FIGURES), [], 0.0 if not len(y) else (4.0 if y[0] else -4.0))
    order = np.random.default_rng(seed).permutation(len(y))
    back, fit = order[: len(y) // 4], order[len(y) // 4 :]
    cuts = [np.unique(np.quantile(x[fit, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    share = np.clip(y[fit].mean(), 1e-3, 1 - 1e-3)
    model = Additive(cuts, [np.zeros(len(c) + 1) for c in cuts], [], math.log(share / (1 - share)))
    b, yf = model.bins(x[fit]), y[fit]
    z = np.full(len(fit), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-z))
        return yf - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j, t in enumerate(model.tables):
            g, h = slopes()
            add = rate * _tree(np.bincount(b[:, j], g, len(t)), np.bincount(b[:, j], h, len(t)))
            t += add
            z += add[b[:, j]]

    def sums(i, j):
        g, h = slopes()
        shape = len(model.tables[i]), len(model.tables[j])
        cell = b[:, i] * shape[1] + b[:, j]
        return np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape)

    ranked = sorted(itertools.combinations(range(x.shape[1]), 2), key=lambda ij: -_square(*sums(*ij))[0])
    model.pairs = [(i, j, np.zeros((len(model.tables[i]), len(model.tables[j])))) for i, j in ranked[:n_pairs]]
    for _ in range(pair_rounds):
        for i, j, t in model.pairs:
            add = rate * _square(*sums(i, j))[1]
            t += add
            z += add[b[:, i], b[:, j]]
    if len(back):
        model.shift = threshold_of(model.logits(x[back]), y[back].astype(int))
    return model


def score_texts(model: Additive, texts: list[str | None]) -> np.ndarray:
    """Scores between 0 and 1; the threshold lies at 0.3."""
    z = model.logits(figures(texts)) - model.shift + math.log(0.3 / 0.7)
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def quality_scores(docs: DataFrame, labels: DataFrame, most: int = 4000, modulus: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` (all columns but one named score) with its quality score.

    The model learns from at most ``most`` rows of each value of ``labels.quality`` outside the fold
    ``held_out`` of ``modulus``. Only the text decides a score. Null, empty and blank texts have zeros
    for all figures and are scored by them. Without labels of both values the score is the same for
    all texts. An empty table gives no rows.
    """
    texts, y = labelled_sample(docs, labels, "quality", modulus, held_out, most, id_col, text_col)
    model = docs.sparkSession.sparkContext.broadcast(train(figures(texts), np.asarray(y)))  # size set by bins and pairs
    return with_scores(docs, text_col, lambda part: score_texts(model.value, part))
