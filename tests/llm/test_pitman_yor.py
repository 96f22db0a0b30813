"""Language-model scores: plain unigram scores, exact seatings, probabilities that sum to one."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from chirpline.llm import pitman_yor, seating
from tests.llm import cases


def plain_tokens(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", folded), "\n"]


def plain_base(rows):
    fold = lambda i: zlib.crc32(str(i).encode()) % 5 if i is not None else 0
    counts = Counter(w for i, t in rows if fold(i) != 1 for w in plain_tokens(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        words = plain_tokens(t)
        out.append((i, fold(i) == 1, len(words), sum(counts[w] > 0 for w in words), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words), 6)))
    return out


@pytest.mark.parametrize("frequent", [0, 5, 200_000])
def test_unigram_scores_match_plain(spark, frequent):
    df = cases.frame(spark)
    got = pitman_yor.scores(df, pitman_yor.train(df, lexicon=8, contexts=3, frequent=frequent))
    assert got.columns[:7] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = got.collect()
    mine = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows]
    assert sorted(map(repr, mine)) == sorted(map(repr, plain_base([(r[0], r[1]) for r in cases.rows()])))
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in rows)
    same = {(r["doc_id"], r["n_tokens"]): r["score"] for r in rows}
    assert same[(7, 2)] == same[(8, 2)] and same[(5, 1)] == same[(6, 1)]


def test_empty_tables(spark):
    df = cases.empty(spark)
    model = pitman_yor.train(df)
    assert pitman_yor.scores(df, model).count() == 0
    known_nothing = pitman_yor.scores(cases.frame(spark), model).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in known_nothing)


def test_probabilities_sum_to_one(spark):
    model = pitman_yor.train(cases.frame(spark), lexicon=30, contexts=6)
    assert np.allclose((10.0 ** model.log10).sum(axis=1), 1, atol=1e-5)
    assert len(model.log10) > 3
    words = Counter(w for i, t, *_ in cases.rows() if zlib.crc32(str(i).encode()) % 5 != 1 or i is None for w in plain_tokens(t))
    sizes = Counter(c for w, c in words.items() if w.encode() not in list(model.number)[:len(model.context_of) - 1])
    assert model.rare.keys() == {0, *sizes}
    assert sum(model.rare[c] * n for c, n in sizes.items()) + model.rare[0] == pytest.approx(1, abs=0.01)


def seatings(customers):
    """All ways to seat customers one after another, as lists of table sizes."""
    if customers == 0:
        yield []
        return
    for sizes in seatings(customers - 1):
        yield [*sizes, 1]
        for k in range(len(sizes)):
            yield [*sizes[:k], sizes[k] + 1, *sizes[k + 1 :]]


@pytest.mark.parametrize("discount", [0.2, 0.7])
def test_stirling_numbers_count_weighted_seatings(discount):
    table = seating.log_stirling(discount, 8)
    for c in range(1, 7):
        want = Counter()
        for sizes in seatings(c):
            want[len(sizes)] += math.prod(math.prod(j - discount for j in range(1, n)) for n in sizes)
        for t, weight in want.items():
            assert math.exp(table[c, t]) == pytest.approx(weight)


def test_tables_are_drawn_from_the_conditional():
    c, others, p0, d, strength = 5, 7, 0.03, 0.6, 1.0
    weights = np.array([math.exp(seating.log_stirling(d, 8)[c, t]) * math.prod(strength + d * (others + i) for i in range(t)) * p0**t for t in range(1, c + 1)])
    n = 200_000
    rng = np.random.default_rng(2)
    t = seating.drawn_tables(np.full(n, c), np.full(n, others), np.full(n, p0), d, strength, seating.log_stirling(d), rng)
    assert np.allclose(np.bincount(t, minlength=c + 1)[1:] / n, weights / weights.sum(), atol=0.005)
    many = seating.drawn_tables(np.full(500, 100_000), np.full(500, 50), np.full(500, 0.01), 0.5, 1.0, seating.log_stirling(0.5), rng)
    assert (many >= 1).all() and (many <= 100_000).all() and many.std() < many.mean()


def test_levels_share_parents():
    shorter = lambda key, depth: key & ((1 << 8 * (depth - 1)) - 1)
    empty = tuple(np.empty(0, np.int64) for _ in range(3))
    two = (np.array([0x6162, 0x6362, 0x6163]), np.array([5, 5, 6]), np.array([3, 4, 1]))
    levels = seating.build([empty, empty, two], shorter, 256)
    assert levels[1].keys.tolist() == [0x62, 0x63] and levels[0].keys.tolist() == [0]
    house = seating.Restaurants(levels, 256)
    assert levels[1].customers.tolist() == [2, 1]  # a table of each restaurant that ends in 0x62
    for rows in house.averaged(5, 1):
        assert np.allclose(rows.sum(axis=1), 1)
    for level, above in itertools.pairwise(reversed(levels)):
        assert level.tables.sum() == above.customers.sum()


def test_model_predicts_unseen_texts_better_than_unigrams(spark):
    rng = random.Random(4)
    stems = ["".join(rng.choice("abcdefghij") for _ in range(3)) for _ in range(12)]
    word = lambda: "".join(rng.choice(stems) for _ in range(rng.randint(1, 4)))
    text = lambda: " ".join(x for _ in range(60) for x in ("the", word(), rng.choice(["of", "is"]), word()))
    df = spark.createDataFrame([(i, text()) for i in range(150)], "doc_id long, text string")
    rows = [r for r in pitman_yor.scores(df, pitman_yor.train(df, lexicon=200)).collect() if r["held_out"]]
    assert len(rows) > 15 and sum(r["score"] - r["base_score"] for r in rows) > 0.1 * sum(r["n_tokens"] for r in rows)
    assert all(r["perplexity"] == pytest.approx(10 ** (-r["score"] / r["n_tokens"])) for r in rows)
