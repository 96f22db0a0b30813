"""Packed arrays come back exactly, in few bytes; pairs go by chunks and slots and not one by one."""

import numpy as np
import pytest

from chirpline.llm import packing, pitman_yor
from tests.llm import cases


@pytest.mark.parametrize("values", [[], [0], [5, 5, 5], [-(2**63), 2**63 - 1, 0, -1], list(range(1000, 0, -3)), [-(2**60) - 2, -1, 7]])
def test_packed_arrays_come_back(values):
    whole, real = np.array(values, np.int64), np.array(values, np.float64)
    got = packing.unpacked(packing.packed(whole, real, real.astype(np.float32), whole[:0]))
    assert [a.dtype for a in got] == [np.int64, np.float64, np.float32, np.int64]
    assert all(np.array_equal(a, b) for a, b in zip(got, (whole, real, real.astype(np.float32), whole[:0])))


def test_sorted_keys_take_few_bytes():
    key = np.sort(np.random.default_rng(1).choice(1 << 24, 50_000, replace=False)).astype(np.int64)
    assert len(packing.packed(key)) < 2.2 * len(key)


def test_a_chunk_asks_for_a_pair_once(spark):
    text = " ".join(f"a{k % 50} b{k % 50}" for k in range(2_000))
    df = spark.createDataFrame([(k, text) for k in range(20)], "doc_id long, text string").repartition(1)
    model = pitman_yor.train(df, lexicon=4, contexts=2, frequent=0, frequent_pairs=0)
    asked = pitman_yor.scored_here(pitman_yor._with_folds(df, 5, 1), model).where("kind = 1").collect()
    pairs, times = [], 0
    for r in asked:
        u, w, n, row = packing.unpacked(r["blob"])
        pairs += [(r["chunk"], *p) for p in zip(u.tolist(), w.tolist())]
        times += int(n.sum())
        assert len(row) == n.sum() and row.min() >= 0 and row.max() < 20
    assert len(pairs) == len(set(pairs)) < 300 and times > 20 * 4_000
    # what goes to the slots is far less than a row of 16 bytes for each occurrence
    assert sum(len(r["blob"]) for r in asked) < 2 * times


@pytest.mark.parametrize("tokens", [1, 200, 500_000])
def test_chunks_change_no_score(spark, monkeypatch, tokens):
    df = cases.frame(spark)
    model = pitman_yor.train(df, lexicon=30, contexts=6, frequent=50, frequent_pairs=10)
    key = lambda rows: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 3)) for r in rows)
    want = key(pitman_yor.scores(df, model).collect())
    monkeypatch.setattr(pitman_yor, "CHUNK_TOKENS", tokens)
    monkeypatch.setattr(pitman_yor, "HELD_VALUES", tokens)
    got = key(pitman_yor.scores(df, model).collect())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 0.01


def test_few_pairs_make_few_packs(spark):
    # a row for each slot and task; tables dealt over many partitions had one task for each
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        model = pitman_yor.train(cases.frame(spark), lexicon=30, contexts=6, frequent=50)
        assert model.slotted.count() <= model.slots * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
