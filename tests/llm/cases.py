"""Documents with nulls, empty and long texts, ties, repeats and clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key string, n string, __id string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n))


def rows(seed=1):
    rng = random.Random(seed)
    base = words(rng, 120).split()
    near = base[:60] + ["changed"] + base[61:]
    texts = [
        (1, " ".join(base)),
        (2, " ".join(near)),
        (3, " ".join(base)),
        (3, " ".join(base)),
        (4, words(rng, 6000)),
        (5, ""),
        (6, None),
        (7, "one"),
        (8, "one"),
        (9, "É ÀÉ 日本 🙂 two"),
        (None, "no id here"),
        (None, None),
        (10, " \n\t\n "),
        (11, "\n".join([words(rng, 30), words(rng, 30), words(rng, 30)])),
    ]
    shared = [words(rng, 30) for _ in range(5)]
    texts += [(20 + k, "\n".join([words(rng, 9), *shared, words(rng, 9)])) for k in range(4)]
    texts += [(100 + k, words(rng, rng.randint(1, 80))) for k in range(30)]
    return [(i, t, ["en", "de", None][k % 3], "src", len(t or ""), "x", "y", "z", "w") for k, (i, t) in enumerate(texts)]


def frame(spark, seed=1):
    return spark.createDataFrame(rows(seed), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
