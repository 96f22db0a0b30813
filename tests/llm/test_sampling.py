"""Importance resampling and fill-in-the-middle against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from chirpline.llm import fill_middle, importance
from tests.llm import cases


def plain_words(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def plain_buckets(words, most, buckets):
    grams = [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]
    return [zlib.crc32(g.encode()) % buckets for g in grams]


@pytest.mark.parametrize("most", [1, 2, 3, 5])
def test_suffix_runs_scatter_the_bucket_of_every_ngram(most):
    rng = random.Random(most)
    texts = [[rng.choice([b"a", b"b", "é".encode(), b"dd"]) for _ in range(rng.choice([0, 1, 2, 7, 60]))] for _ in range(40)] + [[b"x"] * 50]
    document, bucket = importance.buckets_of(texts, most, 97)
    for k, t in enumerate(texts):
        assert Counter(bucket[document == k].tolist()) == Counter(plain_buckets([w.decode() for w in t], most, 97))
    assert len(importance.buckets_of([], most, 97)[0]) == 0


def plain_resampled(docs, target, most, buckets, seed, percent, least):
    s, t = Counter(), Counter()
    every = [(i, plain_words(x), plain_buckets(plain_words(x), most, buckets)) for i, x in docs]
    for _, _, b in every:
        s.update(b)
    for x in target:
        t.update(plain_buckets(plain_words(x), most, buckets))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets)))) for b in range(buckets)]
    rows = []
    for i, words, b in every:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x] for x in b)
        rows.append((i, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    out = [(*r[:4], k + 1 if k < percent * len(fit) // 100 else None) for k, r in enumerate(fit)]
    return out + [(*r[:4], None) for r in rows if r[4] < least]


@pytest.mark.parametrize(("most", "percent"), [(1, 10), (2, 50), (1, 100)])
def test_resampling_matches_plain(spark, most, percent):
    docs = cases.rows()
    target = ["One two three", None, "", docs[0][1][:90]]
    bench = spark.createDataFrame([(str(k), t) for k, t in enumerate(target)], "item_id string, text string")
    got = importance.resampled(cases.frame(spark), bench, most, 500, 7, percent, 5)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = plain_resampled([(r[0], r[1]) for r in docs], target, most, 500, 7, percent, 5)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id string, text string")
    assert importance.resampled(cases.empty(spark), none).count() == 0
    got = importance.resampled(cases.frame(spark), none, percent=100, least_words=1).collect()
    ranks = sorted(r["rank"] for r in got if r["rank"])
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) == sum(bool(plain_words(t)) for _, t, *_ in cases.rows())


def test_ranks_with_one_score_for_most_rows(spark):
    rows = spark.createDataFrame([(k % 7, 5 if k % 3 else k) for k in range(3000)], "doc_id long, score long")
    from pyspark.sql import functions as F

    got = [tuple(r) for r in importance.ranked(rows, [F.col("score").desc(), F.col("doc_id")], (50, 100)).collect()]
    assert sorted(r[2] for r in got if r[2]) == list(range(1, 1501))
    by_rank = sorted((r for r in got if r[2]), key=lambda r: r[2])
    assert [(-s, i) for i, s, _ in by_rank] == sorted((-s, i) for i, s, _ in got)[:1500]


MARKED = ["", "a", "a\n", "\n\n\n", "é\n🙂\n日本", "has <P> in it\nx", "<S>", "x <M>\n", "<P", "ends in <\n<S", "one line " * 50]


def plain_fim(i, text, seed, fim, spm):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim:
        return i, len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return i, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("fim", "spm"), [(100, 50), (40, 0), (0, 50), (100, 100)])
def test_fill_in_middle_matches_plain_and_restores(spark, fim, spm):
    rng = random.Random(3)
    texts = [t for _, t, *_ in cases.rows()] + MARKED + ["\n".join(cases.words(rng, rng.randint(0, 4)) for _ in range(n)) for n in (63, 64, 65, 700)]
    rows = [(k // 2 if k % 9 else None, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = [plain_fim(i, t or "", 7, fim, spm) for i, t in rows]
    got = [tuple(r) for r in fill_middle.fill_in_middle(df, 7, fim, spm).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    digests = [tuple(r) for r in fill_middle.fim_digest(df, 7, fim, spm).collect()]
    assert sorted(map(repr, digests)) == sorted(repr((*w[:5], sha(w[5]), sha(t or ""))) for w, (_, t) in zip(want, rows))


def test_fill_in_middle_odd_tables(spark):
    assert fill_middle.fim_digest(cases.empty(spark)).count() == 0
    assert fill_middle.fim_digest(cases.frame(spark)).count() == len(cases.rows())


def test_checkpoints_cut_long_texts():
    rng = random.Random(5)
    raw = "".join("é" * rng.randint(0, 5) + "x" * rng.randint(0, 30) + "\n" for _ in range(20_000)).encode() + b"tail"
    index = fill_middle.LineIndex(raw)
    units = re.findall(rb"[^\n]*\n|[^\n]+", raw)
    assert index.n == len(units) and len(index.units) == len(units) // fill_middle.EVERY + 1
    ends = np.concatenate([[0], np.cumsum([len(u) for u in units])])
    for unit in [0, 1, 63, 64, 65, 12_345, len(units) - 1, len(units)]:
        assert index.cut(unit) == (ends[unit], len(raw[: ends[unit]].decode()))
