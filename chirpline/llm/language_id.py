"""Language of documents by a bidirectional gated recurrent network over bytes.

A text is cut into windows of bytes. Two recurrent layers with one gate for each unit read
every window, one from either end; a linear layer over both states labels every byte,
and a document's probabilities are the means of its bytes'. The network is trained here
by backpropagation through time.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chirpline.llm.common import crc_fold, map_rows

#: Bytes in a window, units in each direction, windows that are run at once.
WINDOW, UNITS, COLUMNS = 64, 8, 4096
#: Bounds of the training sample: texts of each language, and windows of each text.
TEXTS, WINDOWS = 1500, 6
#: Most languages that one network tells apart; those with the most texts are learned.
LANGUAGES = 500
_LETTER = re.compile(r"[^\W\d_]")


def tanh_gate(x):
    """Logistic function through tanh, in place."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


class Layer:
    """One direction: h' = h + f * (c - h), f = gate(a_f + U_f h), c = tanh(a_c + f * U_c h)."""

    def __init__(self, rng):
        self.inputs = (rng.standard_normal((256, 2 * UNITS)) * 0.3).astype(np.float32)
        self.inner = (rng.standard_normal((2 * UNITS, UNITS)) * 0.3).astype(np.float32)

    def run(self, x: np.ndarray, backwards: bool, keep: bool = False):
        """States of each step, (steps, UNITS, columns); with ``keep`` what training needs."""
        steps, columns = x.shape
        states = np.empty((steps, UNITS, columns), np.float32)
        h = np.zeros((UNITS, columns), np.float32)
        trace = []
        for t in range(steps - 1, -1, -1) if backwards else range(steps):
            a = self.inputs.take(x[t], axis=0).T
            g = self.inner @ h
            f = tanh_gate(a[:UNITS] + g[:UNITS])
            c = f * g[UNITS:]
            c += a[UNITS:]
            np.tanh(c, out=c)
            if keep:
                trace.append((t, h, f, c, g[UNITS:]))
            new = np.subtract(c, h, out=states[t])
            new *= f
            new += h
            h = new
        return (states, trace) if keep else states

    def back(self, x, trace, d_states):
        """Gradients of inputs and inner weights."""
        d_inner = np.zeros_like(self.inner)
        d_a = np.empty((len(trace), 2 * UNITS, x.shape[1]), np.float32)
        order = np.empty(len(trace), np.int64)
        dh = np.zeros_like(trace[0][1])
        for k, (t, h, f, c, q) in enumerate(reversed(trace)):
            dh = dh + d_states[t]
            dc = dh * f * (1 - c * c)
            df = (dh * (c - h) + dc * q) * f * (1 - f)
            dg = np.concatenate([df, dc * f])
            d_a[k, :UNITS], d_a[k, UNITS:], order[k] = df, dc, t
            d_inner += dg @ h.T
            dh = dh * (1 - f) + self.inner.T @ dg
        flat, ids = d_a.transpose(0, 2, 1).reshape(-1, 2 * UNITS), x[order].ravel()
        d_inputs = np.stack([np.bincount(ids, flat[:, j], 256) for j in range(2 * UNITS)], axis=1).astype(np.float32)
        return d_inputs, d_inner


class ByteNetwork:
    def __init__(self, languages: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.layers = [Layer(rng), Layer(rng)]
        self.out = (rng.standard_normal((len(languages), 2 * UNITS)) * 0.1).astype(np.float32)
        self.bias = np.zeros((len(languages), 1), np.float32)

    def label(self, x: np.ndarray, keep: bool = False):
        """Probabilities of each byte: (steps, languages, columns)."""
        runs = [layer.run(x, bool(i), keep) for i, layer in enumerate(self.layers)]
        both = np.concatenate([r[0] if keep else r for r in runs], axis=1)
        z = np.matmul(self.out, both) + self.bias
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        return (z, both, [r[1] for r in runs]) if keep else z

    def gradients(self, x, mask, y):
        """Cross-entropy of the labelled bytes and its gradients."""
        p, both, traces = self.label(x, keep=True)
        columns, total = np.arange(x.shape[1]), max(1.0, float(mask.sum()))
        loss = -float((np.log(p[:, y, columns] + 1e-9) * mask).sum()) / total
        d = p
        d[:, y, columns] -= 1
        d *= (mask / total)[:, None, :]
        d_out = np.einsum("tlc,tuc->lu", d, both)
        d_both = np.matmul(self.out.T, d)
        grads = [d_out, d.sum(axis=(0, 2))[:, None]]
        for i, (layer, trace) in enumerate(zip(self.layers, traces)):
            grads += layer.back(x, trace, d_both[:, i * UNITS : (i + 1) * UNITS])
        return loss, grads

    def train(self, x, mask, y, steps: int = 250, batch: int = 256, rate: float = 0.01, seed: int = 3):
        """Adam on windows drawn with equal weight for each language."""
        rng = np.random.default_rng(seed)
        weights = [self.out, self.bias, *[w for la in self.layers for w in (la.inputs, la.inner)]]
        m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        groups = [np.flatnonzero(y == k) for k in range(len(self.languages))]
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(g, max(1, batch // len(groups))) for g in groups])
            _, grads = self.gradients(x[:, pick], mask[:, pick], y[pick])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            pace = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
            for w, g, mi, vi in zip(weights, grads, m, v):
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                mi += 0.1 * (g - mi)
                vi += 0.01 * (g * g - vi)
                w -= pace * (mi / (1 - 0.9**step)) / (np.sqrt(vi / (1 - 0.99**step)) + 1e-8)

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        """Mean probabilities over all bytes of each text; zeros for empty texts."""
        out = np.zeros((len(texts), len(self.languages)))
        raw = [np.frombuffer((t or "").encode("utf-8", "replace"), np.uint8) for t in texts]
        flat, mask, owner = windows(raw)
        for k in range(0, len(owner), COLUMNS):
            p = self.label(np.ascontiguousarray(flat[k : k + COLUMNS].T))
            pooled = np.einsum("tlc,ct->cl", p, mask[k : k + COLUMNS])
            for j in range(len(self.languages)):
                out[:, j] += np.bincount(owner[k : k + COLUMNS], pooled[:, j], len(texts))
        return out / np.maximum(1, [len(r) for r in raw])[:, None]


def windows(raw: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes in rows of WINDOW, padded with zeros; the mask of true bytes; the text of
    each row."""
    counts = [-(-len(r) // WINDOW) for r in raw]
    flat, mask = np.zeros((sum(counts), WINDOW), np.uint8), np.zeros((sum(counts), WINDOW), np.float32)
    at = 0
    for r, n in zip(raw, counts):
        flat[at : at + n].reshape(-1)[: len(r)] = r
        mask[at : at + n].reshape(-1)[: len(r)] = 1
        at += n
    return flat, mask, np.repeat(np.arange(len(raw)), counts)


def training_windows(docs: DataFrame, texts: int = TEXTS, count: int = WINDOWS) -> DataFrame:
    """(lang, parts): windows at hashed places of a bounded sample of labelled texts.

    Only rows outside the held-out fold with a language and a text count. A language
    gives about ``texts`` distinct texts, all if it has fewer; sampling is by the hash of
    the text, and equal texts count once, so copies can't fill the sample.
    """
    known = docs.where("lang is not null and text is not null").where(crc_fold("doc_id", 5) != 0).select("lang", "text").where(F.length("text") > 0)
    sizes = known.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("size")).orderBy(F.desc("size"), "lang").limit(LANGUAGES)
    share = F.broadcast(sizes.select("lang", F.least(F.lit(1.0), texts / F.greatest("size", F.lit(1))).alias("share")))  # at most LANGUAGES rows
    slot = F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 24))
    picked = known.join(share, "lang").where(slot < F.col("share") * (1 << 24) + 1)
    start = lambda i: (F.pmod(F.xxhash64("text", i), F.greatest(F.length("text") - WINDOW, F.lit(1))) + 1).cast("int")
    parts = F.transform(F.sequence(F.lit(1), F.lit(count)), lambda i: F.substring(F.col("text"), start(i), F.lit(WINDOW)))
    return picked.select("lang", F.xxhash64("text").alias("key"), F.array_distinct(parts).alias("parts")).groupBy("lang", "key").agg(F.first("parts").alias("parts"))


def train(docs: DataFrame, steps: int = 250) -> ByteNetwork | None:
    """A network for the languages of the training rows; None if there are none."""
    rows = sorted((r["lang"], r["key"], r["parts"]) for r in training_windows(docs).collect())
    languages = sorted({r[0] for r in rows})
    if not languages:
        return None
    raw = [(np.frombuffer(p.encode("utf-8", "replace")[:WINDOW], np.uint8), languages.index(lang)) for lang, _, parts in rows for p in parts if p]
    flat, mask, owner = windows([r for r, _ in raw])
    y = np.array([k for _, k in raw])[owner]
    network = ByteNetwork(languages)
    if len(languages) > 1:
        network.train(np.ascontiguousarray(flat.T), np.ascontiguousarray(mask.T), y, steps)
    return network


def languages_of(docs: DataFrame, network: ByteNetwork | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row.

    A text that is null or has no letter is 'und' with score 0, and so are all texts if
    nothing could be learned. Repeated rows get the same result each; held_out is null
    where doc_id is. Of languages with equal probabilities the first by name is taken. All
    bytes of very long texts are labelled. An empty table gives no rows. Other columns are
    ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)  # a few thousand weights

    def make():
        net = shared.value

        def work(c):
            texts = [t if t and _LETTER.search(t) else None for t in c["text"]]
            if net is None:
                return {"doc_id": c["doc_id"], "lang_pred": ["und"] * len(texts), "score": [0.0] * len(texts)}
            p = net.probabilities(texts)
            best = p.argmax(axis=1)
            return {
                "doc_id": c["doc_id"],
                "lang_pred": [net.languages[b] if t else "und" for t, b in zip(texts, best)],
                "score": [min(1.0, float(p[i, b])) if t else 0.0 for i, (t, b) in enumerate(zip(texts, best))],
            }

        return work

    found = map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", (crc_fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
