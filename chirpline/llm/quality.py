"""Document quality by a support vector machine over naive Bayes features.

Features are indicators of word n-grams, of the words themselves and of their shapes
(runs of letters, capitals, digits and other signs). Each indicator is scaled by the
class log-count ratio of its n-gram, and a linear hinge-loss model over the scaled
indicators is fitted by dual coordinate descent. Margins become probabilities by a
calibration on the part of the sample that the fit didn't see. A text's row of scaled
indicators has unit length both in the fit and in the score, so that margins don't grow
with the length of a text.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chirpline.llm.common import crc_fold, filter_rows, map_rows
from chirpline.llm.linear import labelled_sample, platt, sigmoid

#: At most about so many labelled texts of each class are used to fit; this bounds the model.
SAMPLE_ROWS = 3000
MIN_DOCS = 5

#: Classes of bytes for shapes: a small letter or any byte beyond ASCII, A capital, 0 digit.
_SHAPE = bytes(
    ord("a") if 97 <= c <= 122 or c >= 128 else ord("A") if 65 <= c <= 90 else ord("0") if 48 <= c <= 57 else 32 if c <= 32 else c for c in range(256)
)
_RUN = re.compile(rb"([^ ])\1+")


def ngrams(text: str | None) -> set[bytes]:
    """The distinct n-grams of a whole text: words, shapes, and shape pairs and triples."""
    if not text:
        return set()
    raw = text.encode("utf-8", "replace")
    shapes = _RUN.sub(rb"\1", raw.translate(_SHAPE)).split()
    out = {b"w" + w for w in set(raw.lower().split())}
    out.update(b"s" + s for s in set(shapes))
    out.update(b"p" + a + b" " + b for a, b in set(zip(shapes, shapes[1:])))
    out.update(b"t" + a + b" " + b + b" " + c for a, b, c in set(zip(shapes, shapes[1:], shapes[2:])))
    return out


@dataclass
class NaiveBayesSVM:
    """``weights`` has for each n-gram its log-count ratio and its weight in the margin."""

    weights: dict[bytes, tuple[float, float]]
    bias: float
    slope: float
    offset: float

    def margin(self, grams: set[bytes]) -> float:
        """The fitted linear function of the unit row (1, ratios of the n-grams)."""
        get, norm, total = self.weights.get, 1.0, self.bias
        for g in grams:
            if found := get(g):
                norm += found[0] * found[0]
                total += found[0] * found[1]
        return total / norm**0.5

    def score(self, text: str | None) -> float:
        return float(sigmoid(self.slope * self.margin(ngrams(text)) + self.offset))


def log_count_ratios(sets: list[set[bytes]], y: np.ndarray, alpha: float = 1.0) -> dict[bytes, float]:
    """log of the ratio of an n-gram's share of all indicators in either class.

    N-grams in fewer than MIN_DOCS documents are left out, and so are those whose
    ratio lies within three standard errors of zero.
    """
    pos, neg = Counter(), Counter()
    for s, label in zip(sets, y):
        (pos if label == 1 else neg).update(s)
    n_pos, n_neg = max(1, int((y == 1).sum())), max(1, int((y != 1).sum()))
    found = []
    for g in pos.keys() | neg.keys():
        p, q = pos[g], neg[g]
        if p + q < MIN_DOCS:
            continue
        r = np.log(((p + alpha) / (n_pos + 2 * alpha)) / ((q + alpha) / (n_neg + 2 * alpha)))
        z = abs(r) / np.sqrt(1 / (p + alpha) + 1 / (q + alpha))
        if z >= 3.0:
            found.append((z, g, float(r)))
    found.sort(key=lambda x: (-x[0], x[1]))
    return {g: r for _, g, r in found}


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, size: int, c: float = 0.1, epochs: int = 30, seed: int = 7) -> np.ndarray:
    """Weights that minimise ||w||^2 / 2 + c * sum of hinge losses.

    One dual variable in [0, c] for each row; each step solves for one of them.
    Rows are (indices, values); classes get costs in inverse proportion to their size.
    """
    w, alpha = np.zeros(size), np.zeros(len(rows))
    norms = np.array([float(v @ v) for _, v in rows])
    share = np.array([(signs == s).mean() for s in signs])
    cost = c * 0.5 / np.maximum(share, 1e-9)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        largest = 0.0
        for i in rng.permutation(len(rows)):
            idx, val = rows[i]
            if norms[i] == 0:
                continue
            g = signs[i] * float(w[idx] @ val) - 1.0
            new = min(max(alpha[i] - g / norms[i], 0.0), cost[i])
            if new != alpha[i]:
                w[idx] += (new - alpha[i]) * signs[i] * val
                largest = max(largest, abs(new - alpha[i]))
                alpha[i] = new
        if largest < 1e-4 * c:
            break
    return w


def fit(texts: list[str], y: np.ndarray) -> NaiveBayesSVM:
    """Fit on four fifths and calibrate on the rest. With no rows, every score is 0.5."""
    if not len(y):
        return NaiveBayesSVM({}, 0.0, 1.0, 0.0)
    sets = [ngrams(t) for t in texts]
    aside = np.arange(len(y)) % 5 == 4
    fit_sets = [s for s, a in zip(sets, aside) if not a]
    ratios = log_count_ratios(fit_sets, y[~aside])
    place = {g: i + 1 for i, g in enumerate(ratios)}
    scale = np.array([1.0, *ratios.values()])

    def row(s):
        idx = np.array([0, *(place[g] for g in s if g in place)])
        val = scale[idx]
        return idx, val / np.sqrt(val @ val)

    rows = [row(s) for s in fit_sets]
    w = dual_coordinate_descent(rows, np.where(y[~aside] == 1, 1.0, -1.0), len(scale))
    model = NaiveBayesSVM({g: (r, float(w[place[g]])) for g, r in ratios.items()}, float(w[0]), 1.0, 0.0)
    rest = aside if aside.sum() >= 20 else np.ones(len(y), bool)
    margins = np.array([model.margin(s) for s, a in zip(sets, rest) if a])
    model.slope, model.offset = platt(margins, (y[rest] == 1).astype(float))
    return model


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> NaiveBayesSVM:
    """Fit on a bounded sample of rows outside the held-out fold; a text is the only input."""
    sample = sorted((r["text"], r["label"]) for r in labelled_sample(docs, labels, "quality", sample_rows).collect())
    order = np.random.default_rng(11).permutation(len(sample))
    return fit([sample[i][0] for i in order], np.array([sample[i][1] for i in order]))


def quality_scores(docs: DataFrame, model: NaiveBayesSVM, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null and empty texts get the score of a text without n-grams. Repeated rows get the
    same result each. held_out is null where doc_id is. A score at the threshold itself is
    predicted 1. Very long texts are scored whole; an empty table gives no rows. Other
    columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # n-grams of at most 2 * SAMPLE_ROWS texts

    def make():
        m = shared.value
        return lambda c: {"doc_id": c["doc_id"], "score": [m.score(t) for t in c["text"]]}

    scored = map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, score double")
    return scored.select("doc_id", (crc_fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: NaiveBayesSVM, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score reaches the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        return lambda texts: [m.score(t) >= threshold for t in texts]

    return filter_rows(docs, make)
