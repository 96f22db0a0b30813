"""Toxicity by a classifier with counterfactual regularisation.

A logistic model over indicators of words and word beginnings is fitted to labelled
texts. In their sentences identity terms are swapped for others, and the fit is penalised
for each change of score that a swap makes, so that the mention of a group by itself
carries no weight.

Terms come from a table of English ones and from the labelled texts themselves: a word
that toxic texts name more often, but neutral ones name as well, may be swapped for the
words that stand in the most similar contexts and are about as frequent. Words of toxic
texts alone are no identity terms and keep their weight.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chirpline.llm.common import crc_fold, map_rows
from chirpline.llm.linear import labelled_sample, sigmoid

#: At most about so many labelled texts of each class are used to fit; this bounds the model.
SAMPLE_ROWS = 3000
MIN_DOCS = 5
#: A learned identity term has so many neutral texts at least, leans to the toxic ones by so
#: many standard errors, and is swapped for so many others whose contexts have this cosine
#: at least; so many swaps are penalised.
NEUTRAL, LEANING, PARTNERS, ALIKE, SWAPS = 10, 2.0, 3, 0.25, 20_000
#: Slots for the words before and after a term.
CONTEXT = 128
#: Groups of English terms that may stand for each other in a sentence.
IDENTITY_TERMS = [
    ["women", "men"],
    ["woman", "man"],
    ["girls", "boys"],
    ["gay", "straight", "lesbian", "bisexual"],
    ["transgender", "cisgender"],
    ["black", "white", "asian", "latino"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["immigrants", "citizens", "refugees"],
    ["deaf", "blind", "disabled"],
    ["old", "young"],
]
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features_of(words: set[str]) -> set[str]:
    """The words and their beginnings, so that inflected and compound forms share weight."""
    out = set(words)
    for n in (4, 5, 6, 7, 8):
        out.update({w[:n] + "-" for w in words if len(w) > n})
    return out


def swap_terms(texts: list[str], y: np.ndarray, groups: list[list[str]] = IDENTITY_TERMS) -> dict[str, list[str]]:
    """Each identity term and the terms that may replace it: those of its group in the
    table, or its nearest words among the texts by context and frequency."""
    out = {t: [o for o in g if o != t] for g in groups for t in g}
    place: dict[str, int] = {}
    rows = [np.array([place.setdefault(w, len(place)) for w in _WORD.findall(t.lower())], np.int32) for t in texts]
    names = list(place)
    if not names:
        return out
    in_toxic, in_neutral = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    for r, label in zip(rows, y):
        (in_toxic if label == 1 else in_neutral)[np.unique(r)] += 1
    odds = np.log((in_toxic + 0.5) / (in_neutral + 0.5)) - np.log(((y == 1).sum() + 0.5) / ((y != 1).sum() + 0.5))
    z = odds / np.sqrt(1 / (in_toxic + 0.5) + 1 / (in_neutral + 0.5))
    known = np.flatnonzero(in_neutral >= NEUTRAL)
    if not len(known):
        return out
    at = np.full(len(names), -1)
    at[known] = np.arange(len(known))
    context = np.zeros(len(known) * 2 * CONTEXT, np.float32)
    for r in rows:
        second, first = at[r[1:]], at[r[:-1]]
        np.add.at(context, second[second >= 0] * 2 * CONTEXT + r[:-1][second >= 0] % CONTEXT, 1)
        np.add.at(context, first[first >= 0] * 2 * CONTEXT + CONTEXT + r[1:][first >= 0] % CONTEXT, 1)
    context = np.sqrt(context.reshape(len(known), -1))
    context /= np.linalg.norm(context, axis=1, keepdims=True) + 1e-9
    often = np.log(in_neutral[known])
    for k in np.flatnonzero(z[known] >= LEANING):
        term = names[known[k]]
        if term not in out:
            alike = context @ context[k]
            near = np.where((alike >= ALIKE) & (z[known] < LEANING), alike - 0.1 * np.abs(often - often[k]), -np.inf)
            best = np.argsort(-near, kind="stable")[:PARTNERS]
            out[term] = [names[known[b]] for b in best if np.isfinite(near[b])]
    return {t: o for t, o in out.items() if o}


def swaps(text: str, terms: dict[str, list[str]]) -> list[tuple[set[str], set[str]]]:
    """For each sentence with an identity term and each term that may replace it: the
    features that the swap removes from and adds to the sentence's indicators."""
    out = []
    for sentence in _SENTENCE.split(text):
        words = words_of(sentence)
        for term in sorted(words & terms.keys()):
            rest = features_of(words - {term})
            for other in terms[term]:
                if other not in words:
                    before, after = features_of({term}) - rest, features_of({other}) - rest
                    out.append((before - after, after - before))
    return out


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        get = self.weights.get
        return float(sigmoid(self.bias + sum(get(w, 0.0) for w in features_of(words_of(text)))))


def indicators(texts: list[str]) -> tuple[list[str], list[np.ndarray]]:
    """The features of at least MIN_DOCS texts, and each text's as indices.

    Most features are of one text. A first pass counts slots of their hashes, which may
    only count too many, and the second keeps the strings of frequent slots.
    """
    slots, mask = np.zeros(1 << 22, np.int32), (1 << 22) - 1
    for t in texts:
        found = features_of(words_of(t))
        np.add.at(slots, np.fromiter((hash(f) & mask for f in found), np.int64, len(found)), 1)
    often = slots >= MIN_DOCS
    index: dict[str, int] = {}
    rows = [np.array([index.setdefault(f, len(index)) for f in sorted(f for f in features_of(words_of(t)) if often[hash(f) & mask])], np.int32) for t in texts]
    return list(index), rows


def telling(features: list[str], rows: list[np.ndarray], y: np.ndarray, terms: set[str]) -> list[int]:
    """Features whose log-odds between the classes lie beyond four standard errors, and all
    features of identity terms in the sample."""
    of_terms = features_of(terms)

    def counts(chosen):
        found = [r for r, c in zip(rows, chosen) if c]
        return np.bincount(np.concatenate(found) if found else [], minlength=len(features)).astype(float), max(1, len(found))

    (p, n_pos), (q, n_neg) = counts(y == 1), counts(y != 1)
    r = np.log((p + 0.5) * (n_neg - q + 0.5) / ((q + 0.5) * (n_pos - p + 0.5)))
    z = np.abs(r) / np.sqrt(1 / (p + 0.5) + 1 / (q + 0.5) + 1 / (n_pos - p + 0.5) + 1 / (n_neg - q + 0.5))
    named = np.array([f in of_terms for f in features], bool)
    found = np.flatnonzero((p + q >= MIN_DOCS) & ((z >= 4.0) | named))
    return sorted(found.tolist(), key=lambda i: (-z[i], features[i]))


def fit(texts: list[str], y: np.ndarray, swap_penalty: float = 10.0, ridge: float = 2e-4, prior: float | None = None, steps: int = 400, rate: float = 0.05, groups: list[list[str]] = IDENTITY_TERMS) -> ToxicityModel:
    """Weights that minimise log loss + ridge * ||w||^2 + swap_penalty * mean squared
    change of the margin over all swaps, by Adam over the whole sample.

    ``prior`` is the share of toxic texts among all labelled ones, if the sample has
    another: losses are weighted to match it. With no rows every score is 0.
    """
    if not len(y):
        return ToxicityModel({}, -30.0)
    features, everything = indicators(texts)
    terms = swap_terms(texts, y, groups)
    chosen = telling(features, everything, y, set(terms))
    vocabulary = {features[i]: k for k, i in enumerate(chosen)}
    place = np.full(len(features), -1)
    place[chosen] = np.arange(len(chosen))
    rows = [place[r][place[r] >= 0] for r in everything]
    idx = np.concatenate(rows).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    pairs = penalised(texts, terms)
    # terms without a place in the sample are swapped for those that have one
    s_idx = np.array([vocabulary[w] for r, a in pairs for w in (*r, *a) if w in vocabulary], np.int64)
    s_own = np.array([k for k, (r, a) in enumerate(pairs) for w in (*r, *a) if w in vocabulary], np.int64)
    s_val = np.array([-1.0 if w in r else 1.0 for r, a in pairs for w in (*r, *a) if w in vocabulary])
    share = y.mean()
    prior = share if prior is None else prior
    weight = np.where(y == 1, prior / max(share, 1e-9), (1 - prior) / max(1 - share, 1e-9)) / len(y)
    n = len(vocabulary)
    w, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    w[n] = np.log((prior * len(y) + 1) / ((1 - prior) * len(y) + 1))
    for step in range(1, steps + 1):
        p = sigmoid(np.bincount(owner, w[idx], len(rows)) + w[n])
        d = (p - y) * weight
        g = np.append(np.bincount(idx, d[owner], n), d.sum())
        g[:n] += 2 * ridge * w[:n]
        if len(pairs):
            change = np.bincount(s_own, s_val * w[s_idx], len(pairs))
            g[:n] += 2 * swap_penalty / len(pairs) * np.bincount(s_idx, s_val * change[s_own], n)
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return ToxicityModel({t: float(w[i]) for t, i in vocabulary.items()}, float(w[n]))


def penalised(texts: list[str], terms: dict[str, list[str]], most: int = SWAPS) -> list[tuple[set[str], set[str]]]:
    """The swaps of the texts, which are taken in random order until ``most`` are found."""
    pairs: list[tuple[set[str], set[str]]] = []
    for k in np.random.default_rng(17).permutation(len(texts)):
        if len(pairs) >= most:
            break
        pairs += swaps(texts[k], terms)
    return pairs[:most]


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Fit on a bounded sample of rows outside the held-out fold; a text is the only input."""
    known = labels.where(F.col("toxic").isin(0, 1)).where(crc_fold("doc_id", 4) != 2)
    prior = known.agg(F.avg("toxic")).first()[0]
    sample = sorted((r["text"], r["label"]) for r in labelled_sample(docs, labels, "toxic", sample_rows).collect())
    return fit([t for t, _ in sample], np.array([y for _, y in sample], dtype=np.float64), prior=prior)


def toxicity_scores(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null and empty texts get the score of a text without words. Repeated rows get the
    same result each; held_out is null where doc_id is. A score at the threshold itself is
    predicted 1. Very long texts are scored whole; an empty table gives no rows. Other
    columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # words of at most 2 * SAMPLE_ROWS texts

    def make():
        m = shared.value
        return lambda c: {"doc_id": c["doc_id"], "score": [m.score(t) for t in c["text"]]}

    scored = map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, score double")
    return scored.select("doc_id", (crc_fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
