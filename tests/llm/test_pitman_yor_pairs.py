"""Language-model scores: every word has a restaurant of its own, however rare it is."""

import itertools
import random
import zlib

import numpy as np
import pytest

from chirpline.llm import pitman_yor
from tests.llm import cases


def trained_on(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 != 1


def plain_pairs(rows):
    out = {}
    for i, t, *_ in rows:
        if trained_on(i):
            for pair in itertools.pairwise([b"\n", *pitman_yor.tokens_of(t.encode() if t else None)]):
                out[pair] = out.get(pair, 0) + 1
    return out


@pytest.mark.parametrize("frequent,frequent_pairs", [(0, 0), (200_000, 1_000_000)])
def test_words_beyond_the_classes_keep_what_follows_them(spark, frequent, frequent_pairs):
    rng = random.Random(3)
    pairs = [f"left{k} right{k}" for k in range(60)]
    texts = [" ".join(f"the {p}" for p in rng.sample(pairs, 12)) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = pitman_yor.train(df, lexicon=8, contexts=3, frequent=frequent, frequent_pairs=frequent_pairs)
    probes = [(k, f"the left{k} right{j}") for k in range(60) for j in (k, (k + 7) % 60)]
    got = pitman_yor.scores(spark.createDataFrame(probes, "doc_id long, text string").repartition(1), model).collect()
    score = {}
    for r in got:
        score.setdefault(r["doc_id"], []).append(r["score"])
    # the rare word that always follows is likelier by far than another as frequent
    assert all(abs(max(s) - min(s)) > 1 for s in score.values())


def test_links_are_all_pairs_without_a_cell(spark):
    model = pitman_yor.train(cases.frame(spark), lexicon=30, contexts=6)
    words, other = list(model.number), len(model.context_of) - 1
    got = [(words[r["u"]], words[r["w"]]) for r in model.links.collect()]
    number = model.number
    alone = lambda u, w: number[w] < other and (u == b"\n" or number[u] < other and model.context_of[number[u]] > 1)
    want = {p for p in plain_pairs(cases.rows()) if not alone(*p)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000


@pytest.mark.parametrize("frequent", [0, 200_000])
def test_probabilities_after_every_word_sum_to_one(spark, frequent):
    model = pitman_yor.train(cases.frame(spark), lexicon=30, contexts=6, frequent=frequent)
    other, named = len(model.context_of) - 1, int(model.context_of.max()) - 1
    words = {r["code"]: r for r in model.far.collect()}
    own = lambda w: 1.0 if 0 <= w < other else model.rare[words[w]["train"] if w < 0 else int(model.trained[w])]
    base = lambda u, w: own(w) if 0 <= u <= named else own(w) * 10.0 ** float(model.log10[1, w if 0 <= w < other else other])
    more = {}
    for r in model.links.collect():
        more[r["u"]] = more.get(r["u"], 0.0) + base(r["u"], r["w"]) * (10 ** r["gain"] - 1)
    shift = lambda u: words[u]["shift"] if u < 0 else model.shift[u]
    sums = [10 ** shift(u) * (1 + m) for u, m in more.items()]
    assert len(sums) > 500 and np.allclose(sums, 1, atol=1e-4)
    assert (frequent == 0) == any(u < 0 for u in more)


def test_what_tasks_hold_changes_no_score(spark):
    df = cases.frame(spark)
    runs = []
    for frequent, pairs in ((0, 0), (200_000, 0), (200_000, 1_000_000)):
        got = pitman_yor.scores(df, pitman_yor.train(df, lexicon=30, contexts=6, frequent=frequent, frequent_pairs=pairs)).collect()
        runs.append(sorted((r["doc_id"] or 0, r["n_tokens"], r["score"]) for r in got))
    # draws differ with the order of rows, a little
    for some in runs[1:]:
        assert [r[:2] for r in some] == [r[:2] for r in runs[0]]
        assert np.allclose([r[2] for r in some], [r[2] for r in runs[0]], rtol=0.01, atol=0.05)
