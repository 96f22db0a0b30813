from collections import Counter

import corpus_pipeline
from chirpline.llm import byte_bpe, quality, vocab
from chirpline.llm.common import written
from tests.llm import cases
from tests.llm.test_models import plain_contamination
from tests.llm.test_native import plain_line_dedup
from tests.llm.test_near_dedup import plain_components


def test_every_stage_matches_a_plain_version(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    seen, now = [], docs
    for _, stage in corpus_pipeline.STAGES:
        seen.append([tuple(r) for r in now.collect()])
        now = written(stage(spark, now, data))
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert now.schema == docs.schema
    seen.append([tuple(r) for r in now.collect()])
    model = quality.train(docs, spark.read.parquet(f"{data}/labels.parquet"))
    assert sorted(seen[1]) == sorted(r for r in seen[0] if model.score(r[1]) >= 0.7)
    assert sorted((r[0], r[1]) for r in seen[2]) == sorted((i, t) for i, _, _, t in plain_line_dedup(seen[1]))
    parts = plain_components(seen[2], 5, 80)
    assert sorted(seen[3]) == sorted(r for r in seen[2] if parts[r[0]] == r[0])
    assert sorted(seen[4]) == sorted(r for r in seen[3] if not plain_contamination(r[1], bench)[-1])
    path, pattern = vocab.rank_file()
    tokens = byte_bpe.read_ranks(path)
    bpe = byte_bpe.ByteBPE(byte_bpe.serialised_model(tokens), tokens, pattern)
    assert sorted((r[0], r[1]) for r in seen[5]) == sorted((r[0], len(bpe.encode(r[1])) // 4) for r in seen[4])


def test_stages_take_odd_rows(spark, data):
    now = cases.frame(spark)
    for name, stage in corpus_pipeline.STAGES:
        rows = [r["text"] for r in now.collect()]
        now = written(stage(spark, now, data))
        if name == "line_dedup":
            assert now.count() == len(rows)
        if name in ("quality", "decontamination"):
            assert not Counter(r["text"] for r in now.collect()) - Counter(rows)
    assert now.count() == len(rows)
    now = cases.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        now = written(stage(spark, now, data))
        assert now.count() == 0


def test_texts_that_share_an_id_all_stay(spark):
    rng = __import__("random").Random(8)
    a, b, c = (cases.words(rng, 40) for _ in range(3))
    rows = [(1, a, "y"), (1, b, "y"), (2, a + " more", "y"), (3, b, "y"), (4, c, "z"), (4, c, "x"), (None, c, "y")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, source string")
        got = sorted(map(tuple, corpus_pipeline.unique_documents(spark, docs, "").collect()), key=str)
        assert got == sorted([(1, a, "y"), (1, b, "y"), (4, c, "x"), (None, c, "y")], key=str)
