import base64
import hashlib
import random
import re
import zlib

import numpy as np
import tiktoken
from pyspark.sql import functions as F

from chirpline.llm import byte_bpe, decontam, language_id, quality, toxicity, vocab
from chirpline.llm.linear import labelled_sample
from tests.llm import cases


def fold(i, m):
    return zlib.crc32(str(i).encode()) % m


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = language_id.ByteNetwork(["a", "b", "c"])
    x, mask, y = rng.integers(0, 256, (7, 5)), (rng.random((7, 5)) > 0.2).astype("f4"), np.array([0, 1, 2, 1, 0])
    _, grads = net.gradients(x, mask, y)
    weights = [net.out, net.bias, *[w for la in net.layers for w in (la.inputs, la.inner)]]
    for w, g in zip(weights, grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, e = w[at], 1e-2
        w[at] = old + e
        up, _ = net.gradients(x, mask, y)
        w[at] = old - e
        down, _ = net.gradients(x, mask, y)
        w[at] = old
        assert abs((up - down) / (2 * e) - g[at]) < 2e-3 + 0.05 * abs(g[at])


def test_language_of_held_out_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    net = language_id.train(docs, steps=120)
    got = language_id.languages_of(docs, net).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (fold(r["doc_id"], 5) == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.9
    odd = {r["doc_id"]: r for r in language_id.languages_of(cases.frame(spark), net).collect()}
    assert odd[5]["lang_pred"] == odd[6]["lang_pred"] == odd[10]["lang_pred"] == "und"
    assert odd[7]["lang_pred"] in net.languages and odd[None]["held_out"] is None
    assert language_id.train(cases.empty(spark)) is None
    assert {r["lang_pred"] for r in language_id.languages_of(cases.frame(spark), None).collect()} == {"und"}


def test_every_byte_counts():
    net = language_id.ByteNetwork(["a", "b"])
    text = "é" * 100 + "xyz" * 50
    raw = [np.frombuffer(text.encode(), np.uint8)]
    flat, mask, owner = language_id.windows(raw)
    assert mask.sum() == len(raw[0]) and flat.reshape(-1)[: len(raw[0])].tobytes() == text.encode()
    assert abs(net.probabilities([text]).sum() - 1) < 1e-4


def test_pooling_is_the_mean_over_bytes(spark):
    """Window by window, byte by byte; long texts, ties and repeated rows."""
    net = language_id.ByteNetwork(["a", "b", "c"])
    rng = random.Random(4)
    texts = ["x", "é" * 33, cases.words(rng, 20), cases.words(rng, 5000)]
    got = net.probabilities(texts)
    for t, p in zip(texts, got):
        raw, total = t.encode(), np.zeros(3)
        for k in range(0, len(raw), language_id.WINDOW):
            part = np.frombuffer(raw[k : k + language_id.WINDOW].ljust(language_id.WINDOW, b"\0"), np.uint8)
            total += net.label(part[:, None])[: len(raw) - k, :, 0].sum(axis=0)
        assert np.abs(total / len(raw) - p).max() < 1e-5
    net.out[:] = 0  # all languages tie
    rows = [(1, texts[2]), (1, texts[2]), (2, texts[3]), (3, "12")]
    found = [tuple(r) for r in language_id.languages_of(spark.createDataFrame(rows, "doc_id long, text string"), net).select("doc_id", "lang_pred").collect()]
    assert sorted(found) == [(1, "a"), (1, "a"), (2, "a"), (3, "und")]


def test_scores_at_the_threshold_and_of_repeated_rows(spark):
    rows = [(1, "word"), (1, "word"), (2, None), (3, "other " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    half = quality.NaiveBayesSVM({}, 0.0, 1.0, 0.0)
    got = quality.quality_scores(docs, half, threshold=0.5).collect()
    assert len(got) == 4 and all(r["score"] == 0.5 and r["predicted"] == 1 for r in got)
    even = toxicity.ToxicityModel({"word": 1.0}, 0.0)
    got = sorted((r["doc_id"], r["predicted"]) for r in toxicity.toxicity_scores(docs, even, threshold=0.6).collect())
    assert got == [(1, 1), (1, 1), (2, 0), (3, 0)]


def test_quality_held_out(spark, data):
    docs, labels = spark.read.parquet(f"{data.replace('0.001', '0.01')}/documents.parquet"), spark.read.parquet(f"{data.replace('0.001', '0.01')}/labels.parquet")
    model = quality.train(docs, labels)
    got = quality.quality_scores(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.93
    everything = quality.quality_scores(cases.frame(spark), model)
    assert everything.count() == len(cases.rows()) and everything.where("score < 0 or score > 1 or score is null").count() == 0
    kept = quality.keep_good(docs, model)
    assert kept.schema == docs.schema and kept.count() == quality.quality_scores(docs, model).where("predicted = 1").count()
    none = quality.train(cases.empty(spark), labels.limit(0))
    assert quality.quality_scores(cases.frame(spark), none).first()["score"] == 0.5


def test_dual_coordinate_descent_closes_the_gap():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((200, 5))
    y = np.where(x[:, 0] + 0.5 * x[:, 1] + 0.3 * rng.standard_normal(200) > 0, 1.0, -1.0)
    w = quality.dual_coordinate_descent([(np.arange(5), r) for r in x], y, 5, c=1.0, epochs=400)
    assert ((x @ w > 0) == (y > 0)).mean() > 0.85
    cost = 0.5 / np.array([(y == s).mean() for s in y])
    primal = lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - y * (x @ v))).sum()
    for _ in range(300):
        assert primal(w + 0.01 * rng.standard_normal(5)) > primal(w) - 1e-3


def test_quality_score_is_the_fitted_function():
    """The score of any text, short or long, from ratios and weights in plain sums."""
    rng = random.Random(2)
    texts = [f"{cases.words(rng, rng.randint(1, 60))} {'GOOD words HERE' if k % 2 else 'bad!!! 12 stuff'} {cases.words(rng, 3)}" for k in range(300)]
    y = np.array([k % 2 for k in range(300)])
    model = quality.fit(texts, y)
    assert model.weights
    for t in [texts[0], texts[1] * 40, "", "GOOD"]:
        row = {b"": (1.0, model.bias)} | {g: model.weights[g] for g in quality.ngrams(t) if g in model.weights}
        norm = np.sqrt(sum(r * r for r, _ in row.values()))
        margin = sum(r / norm * w for r, w in row.values())
        assert abs(model.score(t) - 1 / (1 + np.exp(-(model.slope * margin + model.offset)))) < 1e-9
    ratios = quality.log_count_ratios([quality.ngrams(t) for t in texts], y)
    g = b"wgood"
    p, q = (sum(g in quality.ngrams(t) for t, k in zip(texts, y) if k == c) for c in (1, 0))
    assert abs(ratios[g] - np.log(((p + 1) / 152) / ((q + 1) / 152))) < 1e-9


def test_samples_take_copies_once(spark):
    docs = spark.createDataFrame([(k, "copy" if k < 500 else f"text {k}", "x") for k in range(1000)] + [(None, "n", "x"), (7, None, "x"), (501, "text 501", "x")], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(k, k % 2, 5) for k in range(1000)] + [(1, None, 5), (2, 7, 5), (3, 1, 5)], "doc_id long, quality int, toxic int")
    got = labelled_sample(docs, labels, "quality", 10_000).collect()
    want = {"copy": 1} | {f"text {k}": k % 2 for k in range(500, 1000) if fold(k, 4) != 2}
    assert {r["text"]: r["label"] for r in got} == want and len(got) == len(want)
    some = labelled_sample(docs, labels, "quality", 50).collect()
    assert 60 < len(some) < 140 and {(r["text"], r["label"]) for r in some} <= set(want.items())
    assert labelled_sample(docs.limit(0), labels, "quality", 5).count() == 0


def group_texts(groups):
    """Toxic texts name the first group more often; neutral ones name both."""
    rng = random.Random(3)
    texts, y = [], []
    for k in range(400):
        toxic = k % 2
        group = rng.choice(groups[0]) if toxic or rng.random() < 0.2 else rng.choice(groups[1])
        texts.append(f"the {group} had {'idiot scum' if toxic else 'house garden'} {cases.words(rng, 5)}.")
        y.append(toxic)
    return texts, np.array(y, float)


def test_swaps_cost_nothing_after_training():
    texts, y = group_texts([["women", "muslim"], ["men", "christian"]])
    free, fair = toxicity.fit(texts, y, swap_penalty=0.0), toxicity.fit(texts, y)
    change = lambda m: abs(m.score("the women met") - m.score("the men met"))
    assert change(free) > 0.05 > change(fair)
    assert fair.score("idiot scum") > 0.5 > fair.score("women in a garden")


def test_terms_are_learned_from_the_texts():
    """Words that no table has, and that toxic texts alone use, are told apart."""
    texts, y = group_texts([["zorbs"], ["quixes"]])
    terms = toxicity.swap_terms(texts, y, [])
    assert "quixes" in terms["zorbs"] and not {"idiot", "scum"} & terms.keys()
    free, fair = toxicity.fit(texts, y, swap_penalty=0.0, groups=[]), toxicity.fit(texts, y, groups=[])
    assert free.weights["zorbs"] - free.weights["quixes"] > 10 * abs(fair.weights["zorbs"] - fair.weights["quixes"])
    assert free.score("the zorbs had a garden") > fair.score("the zorbs had a garden")
    assert toxicity.swap_terms([], np.array([])) and toxicity.swap_terms(["", "1"], np.array([1.0, 0.0]), []) == {}


def test_swaps_match_plain_features():
    terms = {"men": ["women", "boys"], "old": ["young"]}
    got = toxicity.swaps("Old men sat. No one else!\nWomen and men", terms)
    for (before, after), (a, b) in zip(got, [("old men sat", "old women sat"), ("old men sat", "old boys sat"), ("old men sat", "young men sat"), ("women and men", "women and boys")], strict=True):
        x, y = (toxicity.features_of(toxicity.words_of(t)) for t in (a, b))
        assert (before, after) == (x - y, y - x)


def test_toxicity_fit_is_a_minimum():
    """The plain objective doesn't fall when any weight is moved."""
    texts, y = group_texts([["women"], ["men"]])
    model = toxicity.fit(texts, y, steps=1500, rate=0.02)
    rows = [toxicity.features_of(toxicity.words_of(t)) for t in texts]
    pairs = toxicity.penalised(texts, toxicity.swap_terms(texts, y))

    def loss(w, bias):
        z = np.array([bias + sum(w.get(f, 0.0) for f in r) for r in rows])
        change = np.array([sum(w.get(f, 0.0) for f in a) - sum(w.get(f, 0.0) for f in r) for r, a in pairs])
        return np.mean(np.logaddexp(0, z) - y * z) + 2e-4 * sum(v * v for v in w.values()) + 10.0 * np.mean(change**2)

    least = loss(model.weights, model.bias)
    for f in [*sorted(model.weights)[:25], "women", "men", "idiot"]:
        for step in (-0.05, 0.05):
            assert loss(model.weights | {f: model.weights[f] + step}, model.bias) > least - 1e-5


def test_toxicity_held_out(spark, data):
    d = data.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.train(docs, labels)
    got = toxicity.toxicity_scores(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in got]) > 0.9
    odd = toxicity.toxicity_scores(cases.frame(spark), model)
    assert odd.count() == len(cases.rows()) and odd.where("score is null").count() == 0
    assert toxicity.toxicity_scores(cases.frame(spark), toxicity.train(cases.empty(spark), labels.limit(0))).agg(F.max("predicted")).first()[0] == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_contamination(text, items):
    lower = lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, found = lower(text), set(), set()
    for item, t in items:
        w = lower(t)
        m = min(13, len(w))
        for k in range(len(w) - m + 1) if m else ():
            for p in range(len(words) - m + 1):
                if words[p : p + m] == w[k : k + m]:
                    hit.update(range(p, p + m))
                    found.add(str(item))
    names = ",".join(sorted(found))
    return len(words), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(words)


def test_contamination_matches_plain(spark):
    rng = random.Random(9)
    items = [(k, cases.words(rng, n)) for k, n in enumerate([40, 13, 12, 1, 20])] + [(10, None), (11, "..."), (12, "éa, B-c 12"), (13, None), (14, "aa bb " * 15)]
    texts = [f"{cases.words(rng, 30)}, {items[0][1].upper()}! {cases.words(rng, 5)}", items[1][1], " ".join(items[0][1].split()[3:20]), items[2][1] + " x", "Éa b c 12 éa B.C 12", "aa bb " * 40, cases.words(rng, 400) + " " + items[3][1], None, "", items[4][1] + "\n" + items[1][1]]
    docs = spark.createDataFrame([(k, t, "q") for k, t in enumerate(texts)] + [(0, texts[0], "q"), (None, "x", "q")], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items + [(10, "")], "item_id long, text string")
    for block in (decontam.BLOCK_CHARS, 400, 20):  # 1, 2 and some 40 blocks
        got = decontam.contamination(docs, bench, block).collect()
        assert len(got) == docs.count()
        for r in got:
            want = plain_contamination(texts[r["doc_id"]] if r["doc_id"] is not None else "x", items)
            assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == want
        clean = decontam.keep_clean(docs, bench, block)
        assert clean.schema == docs.schema and clean.count() == sum(not r["contaminated"] for r in got)
    assert decontam.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.contamination(cases.empty(spark), bench).count() == 0


def test_tokens_match_tiktoken(spark):
    path, pattern = vocab.rank_file()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    bpe = byte_bpe.ByteBPE(byte_bpe.serialised_model(byte_bpe.read_ranks(path)), byte_bpe.read_ranks(path), pattern)
    rng = random.Random(5)
    pool = [" ", "  ", "\n", "\t", "\x1c", "\x85", "　", "'s", "'LL", " 123", "½", "a", "É", "日本", "🙂", "###", "\x00", "́", "<|endoftext|>", " the", "tion"]
    for _ in range(3000):
        s = "".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))
        assert bpe.encode(s) == np.array(plain.encode_ordinary(s), "<u4").tobytes()
    rows = {i: t or "" for i, t, *_ in cases.rows() if i is not None}
    got = byte_bpe.tokenized(cases.frame(spark), path, pattern).collect()
    assert len(got) == len(cases.rows())
    for r in got:
        if r["doc_id"] is not None:
            ids = plain.encode_ordinary(rows[r["doc_id"]])
            assert r["ids"] == ids and r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(rows[r["doc_id"]].encode()).hexdigest()
    assert byte_bpe.tokenized(cases.empty(spark), path, pattern).count() == 0
