"""Language-model scores by a hierarchical Pitman-Yor model over words.

Every word of the training texts, however rare, has a restaurant for what follows it, and every
word is a dish there. Its base is a bounded model of classes: a word that is frequent in
training has a class of its own as a context and as a dish, one more context is the start of a
text, and all other words share one context and one dish, behind which stands a restaurant whose
dishes are all of them and a single unknown one. For a pair of two frequent words the bounded
model is the restaurant of the word itself, so only other pairs have one on top of it.

The counts of all words and pairs of all training texts are added up by Spark and stay in
tables. Tasks hold those of the most frequent words and pairs; scores look up all others, each in
the slot that a hash of the pair gives. What goes there and back are packed arrays, one for each
slot of a chunk of texts, with every pair of the chunk once.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chirpline.llm import seating
from chirpline.llm.common import arrow_batches, crc_fold, forget
from chirpline.llm.common import written as _written
from chirpline.llm.packing import packed, unpacked

#: Words that are dishes of their own in the bounded model, at most.
LEXICON = 16_384
#: Words that are contexts of their own in the bounded model, at most.
CONTEXTS = 254
#: Words whose counts are sent to the tasks, at most; the counts of others are joined.
FREQUENT = 200_000
#: Pairs whose gains are sent to the tasks, at most; those of others are joined.
FREQUENT_PAIRS = 1_000_000
#: Longer words are in neither list.
WORD_BYTES = 64
#: Gibbs sweeps, and those of them that aren't averaged.
SWEEPS, BURN = 6, 2
#: Draws for each count of rare words in a sweep.
DRAWS = 32
#: Different words that a task counts before it sends them on.
HELD_WORDS = 500_000
#: Tokens whose pairs a task adds up before it sends them on.
HELD_TOKENS = 1_000_000
#: Rows of an Arrow batch of pairs.
PAIR_ROWS = 50_000
#: Tokens of a chunk of texts whose pairs a task looks up together.
CHUNK_TOKENS = 500_000
#: Pairs that a task packs together.
PACKED_PAIRS = 250_000
#: Training tokens for each task that looks pairs up, at most, and its slots.
LOOKED_UP, SLOTS = 4_000_000, 4
#: Values of single rows that such a task holds before it adds them up.
HELD_VALUES = 2_000_000
#: Strength of the restaurants of single words.
STRENGTH = 1.0
#: What stands for the context in rows that count cells of the bounded model.
GRID = -1

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: The end of a text as a token; no word holds white space.
END = b"\n"


def written(df: DataFrame) -> DataFrame:
    """As in common; the shuffle files go at once, since nothing else reads them."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name)
    conf.set(name, "true")
    try:
        return _written(df)
    finally:
        conf.set(name, before)


def tokens_of(text: bytes | None) -> list[bytes]:
    """Words, A-Z in small letters, and one end."""
    return [*(text or b"").translate(_FOLD).split(), END]


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, train, n): how often each token occurs in training texts and in all, of rows
    (text binary, held_out). A task adds up its own words first."""
    arrow_batches(docs.sparkSession)
    schema = pa.schema([("word", pa.binary()), ("train", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained, held = Counter(), Counter()

        def sums():
            words = list(trained.keys() | held.keys())
            for k in range(0, len(words), 20_000):
                some = words[k : k + 20_000]
                t = [trained[w] for w in some]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), pa.array(t), pa.array([a + held[w] for a, w in zip(t, some)])], schema=schema)

        for b in batches:
            for text, out in zip(b.column("text").to_pylist(), b.column("held_out").to_pylist()):
                (held if out else trained).update(tokens_of(text))
            if len(trained) + len(held) > HELD_WORDS:
                yield from sums()
                trained.clear()
                held.clear()
        yield from sums()

    return docs.select("text", "held_out").mapInArrow(run, "word binary, train long, n long").groupBy("word").agg(F.sum("train").alias("train"), F.sum("n").alias("n"))


def _steps(count: str):
    """Counts in steps of a 32nd of a factor e."""
    return F.floor(32 * F.log(F.col(count).cast("double"))).cast("int")


def most_frequent(words: DataFrame, count: str, most: int) -> list[tuple[bytes, int, int]]:
    """(word, train, n) of the most frequent words: as many whole steps of counts as ``most``
    words hold. No sort of all words is needed."""
    fit = words.where((F.col(count) > 0) & (F.length("word") <= WORD_BYTES))
    sizes = {r["step"]: r["count"] for r in fit.groupBy(_steps(count).alias("step")).count().collect()}
    floor, total = None, 0
    for step in sorted(sizes, reverse=True):
        total += sizes[step]
        if total > most:
            break
        floor = step
    if floor is None:
        return []
    found = fit.where(_steps(count) >= floor).select("word", "train", "n").toArrow()
    return sorted(zip(*(found[c].to_pylist() for c in ("word", "train", "n"))), key=lambda r: (-r[1], r[0]))


def _rare_code(word: bytes, salt: str) -> int:
    return -2 - int(hashlib.md5(salt.encode() + word).hexdigest()[:15], 16)


def rare_code(word, salt: str):
    """The code of a word that has no number: below GRID, by a hash."""
    return F.lit(-2) - F.conv(F.substring(F.md5(F.concat(F.lit(salt.encode()), word)), 1, 15), 16, 10).cast("long")


def _unlike(words: DataFrame) -> str:
    """A salt with which no two of the words have one code."""
    for k in itertools.count():
        salt = str(k or "")
        if words.groupBy(rare_code(F.col("word"), salt).alias("code")).count().where("count > 1").isEmpty():
            return salt


class _Places(dict):
    """Places of words in the order that a task meets them, with their codes; the first is END."""

    def __init__(self, number: dict[bytes, int], salt: str):
        super().__init__()
        self.number, self.salt = number, salt
        self.start()

    def start(self) -> None:
        self.clear()
        self.words, self.codes = [], array("q")
        self[END]

    def __missing__(self, word: bytes) -> int:
        code = self.number.get(word)
        self.codes.append(_rare_code(word, self.salt) if code is None else code)
        self.words.append(word)
        self[word] = place = len(self.words) - 1
        return place

    def of(self, texts: list[list[bytes]]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, itertools.chain.from_iterable(texts)), np.int64)


def _classes(code: np.ndarray, context_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code before, context, dish) of the tokens of whole texts in a row: 0 is the end of
    the text before, so that it stands for the start."""
    other = len(context_of) - 1
    dish = np.where((code >= 0) & (code < other), code, other)
    before = np.concatenate([[0], code[:-1]])
    context = np.where(before == 0, 0, context_of[np.concatenate([[0], dish[:-1]])])
    return before, context, dish


def _slot_of(u: np.ndarray, w: np.ndarray, slots: int) -> np.ndarray:
    mixed = u.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + w.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(32)) % np.uint64(slots)).astype(np.min_scalar_type(slots))


def _starts(slot: np.ndarray, slots: int) -> list[int]:
    """Where each slot starts in sorted ones, and the end."""
    return np.concatenate([[0], np.cumsum(np.bincount(slot, minlength=slots))]).tolist()


def _blobs(u: np.ndarray, w: np.ndarray, slots: int, *more: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(slot, blob) of pairs in the order of u and w, and what belongs to them."""
    slot = _slot_of(u, w, slots)
    order = np.argsort(slot, kind="stable")
    arrays = [x[order] for x in (u, w, *more)]
    for k, (a, b) in enumerate(itertools.pairwise(_starts(slot, slots))):
        if a < b:
            yield k, packed(*(x[a:b] for x in arrays))


def _rows_of(blobs: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    while some := list(itertools.islice(blobs, 64)):
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.int32()), pa.array([x for _, x in some], pa.binary())], names=["slot", "blob"])


def _ranks(codes: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the places by their codes, and the code of each rank; GRID has rank 0."""
    used = np.zeros(len(codes), bool)
    used[place] = used[0] = True
    used = np.flatnonzero(used)
    used = used[np.argsort(codes[used])]
    rank = np.zeros(len(codes), np.int64)
    rank[used] = 1 + np.arange(len(used))
    return rank, np.concatenate([[GRID], codes[used]])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, w, c) added up, of (slot, blob) sorted by slot."""

    def out(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        u, w, n = (np.concatenate(x) for x in zip(*(unpacked(x) for x in blobs)))
        us, ws = np.unique(u), np.unique(w)
        key = np.searchsorted(us, u) << 32 | np.searchsorted(ws, w)
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n, key = np.add.reduceat(n[order], first), key[first]
        for k in range(0, len(key), PAIR_ROWS):
            some = key[k : k + PAIR_ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(us[some >> 32]), pa.array(ws[some & 0xFFFFFFFF]), pa.array(n[k : k + PAIR_ROWS])], names=["u", "w", "c"])

    blobs, slot = [], None
    for b in batches:
        for k, blob in zip(b.column("slot").to_pylist(), b.column("blob").to_pylist()):
            if k != slot and blobs:
                yield from out(blobs)
                blobs = []
            slot = k
            blobs.append(blob)
    if blobs:
        yield from out(blobs)


def pair_counts(docs: DataFrame, number: dict[bytes, int], context_of: np.ndarray, salt: str, slots: int) -> DataFrame:
    """(u, w, c): how often word w follows u in training texts, by their codes. With u = GRID, w
    is a cell of the bounded model, contexts x dishes; pairs that have such a cell alone to
    themselves aren't counted again. 0 stands for the start as u, for the end as w.
    """
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((number, context_of))
    dishes = len(context_of)
    contexts = int(context_of.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, context_of = shared.value
        places = _Places(number, salt)
        grid, waiting, held = np.zeros(contexts * dishes, np.int64), [], 0

        def sums():
            place = np.concatenate(waiting)
            codes = np.array(places.codes, np.int64)
            _, context, dish = _classes(codes[place], context_of)
            np.add(grid, np.bincount(context * dishes + dish, minlength=len(grid)), out=grid)
            own = (context == 1) | (dish == dishes - 1)
            rank, ranked = _ranks(codes, place)
            before = np.concatenate([[0], place[:-1]])
            pair, n = np.unique(rank[before[own]] << 32 | rank[place[own]], return_counts=True)
            yield from _rows_of(_blobs(ranked[pair >> 32], ranked[pair & 0xFFFFFFFF], slots, n))

        for b in batches:
            waiting.append(places.of([tokens_of(t) for t in b.column("text").to_pylist()]))
            held += len(waiting[-1])
            if held > HELD_TOKENS or len(places) > HELD_WORDS:
                yield from sums()
                places.start()
                waiting, held = [], 0
        if waiting:
            yield from sums()
        some = np.flatnonzero(grid)
        yield from _rows_of(_blobs(np.full(len(some), GRID), some, slots, grid[some]))

    blobs = docs.where("not held_out").select("text").mapInArrow(run, "slot int, blob binary")
    return blobs.repartition(slots // SLOTS, "slot").sortWithinPartitions("slot").mapInArrow(_summed, "u long, w long, c long")


def rare_levels(sizes: dict[int, int], sweeps: int, burn: int, seed: int = 1, strength: float = 1.0) -> dict[int, float]:
    """Probability of a word of the last restaurant by its count, of the number of words that
    have each count; count 0 is the unknown word.

    The base is uniform, so how a word is seated depends on its count alone, and words with
    one count are drawn together.
    """
    counts = np.array(sorted(c for c in sizes if c > 0), np.int64)
    words = np.array([sizes[c] for c in counts.tolist()], np.int64)
    types, customers = int(words.sum()), int((counts * words).sum())
    once, twice = sizes.get(1, 0), sizes.get(2, 0)
    discount = float(np.clip(once / max(1, once + 2 * twice), 0.05, 0.95))
    stirling, rng = seating.log_stirling(discount), np.random.default_rng(seed)
    base, tables = 1 / (types + 1), types
    mean, unknown = np.zeros(len(counts)), 0.0
    for k in range(sweeps):
        # many draws for each count give its mean; words of a count add up to as many draws
        draws = [seating.drawn_tables(np.full(DRAWS, c), np.full(DRAWS, max(0, tables - 1)), np.full(DRAWS, base), discount, strength, stirling, rng).mean() for c in counts.tolist()]
        each = np.array(draws)
        tables = int(round(float((each * words).sum())))
        if k >= burn:
            spare = (strength + discount * tables) * base
            mean += (np.maximum(counts - discount * each, 0) + spare) / (customers + strength) / (sweeps - burn)
            unknown += spare / (customers + strength) / (sweeps - burn)
    return {0: unknown, **dict(zip(counts.tolist(), mean.tolist()))}


def _base(count, tokens: int, types: int):
    return np.log10((count + 0.5) / (tokens + 0.5 * (types + 1)))


@dataclass
class Model:
    """What scoring needs. ``far`` (word, code, train, own, shift) is the table of the words that have
    no number, ``slotted`` (slot, blob) has the pairs and what scores need of those words, packed
    for each of ``slots`` slots; the rest is bounded.

    The probability of w after u is that of the bounded model times 10 ** (shift of u + gain of
    (u, w)); pairs that have a cell of the bounded model to themselves have neither.
    """

    far: DataFrame
    slotted: DataFrame
    slots: int
    tokens: int
    types: int
    number: dict[bytes, int]
    dish: np.ndarray
    context_of: np.ndarray
    trained: np.ndarray
    log10: np.ndarray
    rare: dict[int, float]
    salt: str
    shift: np.ndarray
    pair: np.ndarray
    gain: np.ndarray

    @property
    def links(self) -> DataFrame:
        """(u, w, gain) of all pairs."""
        arrow_batches(self.slotted.sparkSession)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for blob in (x for b in batches for x in b.column("blob").to_pylist()):
                u, w, gain, _ = unpacked(blob)
                some = u != GRID
                yield pa.RecordBatch.from_pydict({"u": pa.array(u[some]), "w": pa.array(w[some]), "gain": pa.array(gain[some].astype(np.float64))})

        return self.slotted.select("blob").mapInArrow(run, "u long, w long, gain double")

    def base(self, count):
        return _base(count, self.tokens, self.types)


def _with_folds(docs: DataFrame, folds: int, held: int) -> DataFrame:
    fold = F.coalesce(crc_fold(F.col("doc_id").cast("long"), folds), F.lit(0))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), (fold == held).alias("held_out"))


def fitted_words(pairs: tuple[np.ndarray, np.ndarray, np.ndarray], contexts: int, dishes: int, sweeps: int = SWEEPS, burn: int = BURN) -> np.ndarray:
    """(contexts, dishes) averaged probabilities. Contexts without customers predict as their parent."""
    empty = tuple(np.empty(0, np.int64) for _ in range(3))
    levels = seating.build([empty, pairs], lambda key, depth: np.zeros_like(key), dishes)
    root, seen = seating.Restaurants(levels, dishes).averaged(sweeps, burn)
    out = np.repeat(root, contexts, axis=0)
    out[levels[1].keys] = seen
    return out


def _by_code(cells: DataFrame, words: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Add ``columns``, doubles, of the words without a number whose code is ``key``. They are null
    where the word has a number: tasks are given arrays of those."""
    of = words.select(F.col("code").alias(key), *(F.col(c).cast("double").alias(name) for name, c in columns.items()))
    numbered = cells.where(F.col(key) >= 0).select("*", *(F.lit(None).cast("double").alias(name) for name in columns))
    return numbered.unionByName(cells.where(F.col(key) < 0).join(of.hint("merge"), key))


def _filled(values: pa.Array, code: np.ndarray, numbered: np.ndarray) -> np.ndarray:
    return np.where(code >= 0, numbered[np.maximum(code, 0)], values.to_numpy(zero_copy_only=False))


def _unpriced(cells: DataFrame, far: DataFrame, column: str) -> DataFrame:
    """Add of_u, any_p, rare_p, what ``far`` has of u and w. A join is made of those without a number alone."""
    rare = {"any_p": "any_p", "rare_p": "rare_p"}
    null = lambda names: [F.lit(None).cast("double").alias(n) for n in names]
    near_u, far_u = cells.where("u >= 0"), cells.where("u < 0").join(far.select(F.col("code").alias("u"), F.col(column).cast("double").alias("of_u")).hint("merge"), "u")
    return near_u.where("w >= 0").select("*", *null(["of_u", *rare])).unionByName(_by_code(near_u.where("w < 0").select("*", *null(["of_u"])), far, "w", rare)).unionByName(_by_code(far_u, far, "w", rare))


def _prices(b: pa.RecordBatch, near: tuple[np.ndarray, np.ndarray, np.ndarray], named: int) -> tuple[np.ndarray, np.ndarray]:
    """What of_u is, and what the base predicts for w after u."""
    of_u, any_p, rare_p = near
    u, w = b.column("u").to_numpy(), b.column("w").to_numpy()
    p0 = np.where((u >= 0) & (u <= named), _filled(b.column("rare_p"), w, rare_p), _filled(b.column("any_p"), w, any_p))
    return _filled(b.column("of_u"), u, of_u), p0


def _priced(cells: DataFrame, near: dict[str, np.ndarray], far: DataFrame, named: int, column: str) -> DataFrame:
    """(u, w, c, t, of_u, p0) of (u, w, c, t): ``column`` of u, and what the base predicts for w after u."""
    shared = cells.sparkSession.sparkContext.broadcast((near[column], near["any_p"], near["rare_p"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of_u, p0 = _prices(b, shared.value, named)
            yield pa.RecordBatch.from_pydict({n: b.column(n) for n in ("u", "w", "c", "t")} | {"of_u": pa.array(of_u), "p0": pa.array(p0)})

    return _unpriced(cells, far, column).mapInArrow(run, "u long, w long, c long, t double, of_u double, p0 double")


def _drawn(cells: DataFrame, saved: np.ndarray, discount: float, sweep: int, kept: bool, seed: int = 1) -> DataFrame:
    """Draw the tables t of each (u, w, c, t, of_u, p0, total, saved) once, given the last draw of the
    others of its restaurant; add them to total if ``kept``. of_u is the restaurant's size."""
    shared = cells.sparkSession.sparkContext.broadcast((seating.log_stirling(discount), saved))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stirling, numbered = shared.value
        rng = np.random.default_rng([seed, sweep, TaskContext.get().partitionId()])
        for b in batches:
            u, c, t, size, p0, total = (b.column(n).to_numpy() for n in ("u", "c", "t", "of_u", "p0", "total"))
            others = size - _filled(b.column("saved"), u, numbered) - t
            t = seating.drawn_tables(c, others, p0, discount, STRENGTH, stirling, rng).astype(np.float64)
            yield pa.RecordBatch.from_pydict({n: b.column(n) for n in ("u", "w", "c")} | {"t": pa.array(t), "of_u": b.column("of_u"), "p0": b.column("p0"), "total": pa.array(total + t * kept)})

    return cells.mapInArrow(run, "u long, w long, c long, t double, of_u double, p0 double, total double")


def _saved(cells: DataFrame, numbered: int) -> tuple[DataFrame, np.ndarray]:
    """Customers of each restaurant less its tables: (code, saved), and an array for numbered words."""
    table = written(cells.groupBy(F.col("u").alias("code")).agg(F.sum(F.col("c") - F.col("t")).alias("saved")))
    near = table.where("code >= 0").toArrow()
    out = np.zeros(numbered)
    out[near["code"].to_numpy()] = near["saved"].to_numpy()
    return table, out


def seated(cells: DataFrame, numbered: int, discount: float, sweeps: int = SWEEPS, burn: int = BURN) -> DataFrame:
    """(u, w, c, t): average numbers of tables, by Gibbs sweeps, of priced pairs that occur more
    than once. Others have one table each, so a restaurant's tables are its size less the
    customers that share one."""
    spark = cells.sparkSession
    arrow_batches(spark, PAIR_ROWS)
    live = written(cells.withColumn("total", F.lit(0.0)))
    for k in range(sweeps):
        table, saved = _saved(live, numbered)
        old, live = live, written(_drawn(_by_code(live, table, "u", {"saved": "saved"}), saved, discount, k, k >= burn))
        forget(old)
        forget(table)
    arrow_batches(spark)
    return live.select("u", "w", "c", (F.col("total") / (sweeps - burn)).alias("t"))


def _frequent_pairs(links: DataFrame, most: int) -> DataFrame:
    """The most frequent pairs of numbered words, as many whole steps of counts as ``most`` hold."""
    fit = links.where("u >= 0 and w >= 0")
    sizes = {r["step"]: r["count"] for r in fit.groupBy(_steps("c").alias("step")).count().collect()}
    floor, total = math.inf, 0
    for step in sorted(sizes, reverse=True):
        total += sizes[step]
        if total > most:
            break
        floor = step
    return fit.where(_steps("c") >= F.lit(float(floor)))


def fitted_grid(pairs: DataFrame, contexts: int, dishes: int) -> tuple[np.ndarray, np.ndarray]:
    """The bounded model's probabilities, and how many tokens after each context have no cell
    to themselves."""
    grid = pairs.where(F.col("u") == GRID).select("w", "c").toArrow()
    cell, n = grid["w"].to_numpy(), grid["c"].to_numpy()
    del grid
    context, dish = cell // dishes, cell % dishes
    del cell
    free = (context == 1) | (dish == dishes - 1)
    return fitted_words((context, dish, n), contexts, dishes), np.bincount(context[free], n[free], minlength=contexts).astype(np.int64)


def train(
    docs: DataFrame, folds: int = 5, held: int = 1, lexicon: int = LEXICON, contexts: int = CONTEXTS, frequent: int = FREQUENT, frequent_pairs: int = FREQUENT_PAIRS
) -> Model:
    """Learn from the documents whose crc32(doc_id as text) modulo ``folds`` isn't ``held``.

    A null doc_id counts as remainder 0. Null texts count as empty: one end. Of an empty table
    the model knows nothing, and every token is as likely. ``lexicon`` and ``contexts`` bound the
    base alone; ``frequent`` and ``frequent_pairs`` what tasks hold, which changes no result.
    """
    spark = docs.sparkSession
    rows = _with_folds(docs, folds, held)
    words = written(vocabulary(rows))
    tokens, types = words.agg(F.coalesce(F.sum("train"), F.lit(0)), F.count_if(F.col("train") > 0)).first()
    trained_most = most_frequent(words, "train", lexicon - 1)
    dishes = [END, *(w for w, _, _ in trained_most if w != END)]
    # contexts: 0 the start, 1 all words without one of their own; the last dish is any other word
    context_of = np.ones(len(dishes) + 1, np.int64)
    named = min(contexts, len(dishes) - 1)
    context_of[1 : named + 1] = 2 + np.arange(named)
    # counts that the tasks are given: of the dishes, and of all words that are frequent anywhere
    counts = {w: t for w, t, _ in [*trained_most, *most_frequent(words, "n", frequent)]}
    counts |= {bytes(r["word"]): r["train"] for r in words.where(F.col("word") == F.lit(END)).collect()}
    lexical = set(dishes)
    every = [*dishes, *(w for w in counts if w not in lexical)]
    number = {w: k for k, w in enumerate(every)}
    trained = np.array([counts.get(w, -1) for w in every], np.int64)
    dish = np.minimum(np.arange(len(every)), len(dishes))
    numbered = spark.createDataFrame(pa.table({"word": pa.array(every, pa.binary())}))
    least = min((float(t) for _, t, _ in trained_most), default=math.inf)
    del trained_most, counts, lexical
    unnumbered = written(words.join(F.broadcast(numbered), "word", "left_anti"))
    salt = _unlike(unnumbered)

    slots = SLOTS * max(int(spark.conf.get("spark.sql.shuffle.partitions")), tokens // LOOKED_UP + 1)
    pairs = written(pair_counts(rows, number, context_of, salt, slots))
    width = len(dishes) + 1
    probabilities, followers = fitted_grid(pairs, int(context_of.max()) + 1, width)
    first, log10 = probabilities[1].copy(), np.log10(probabilities).astype(np.float32)
    del probabilities
    long = F.length("word") > WORD_BYTES
    others = words.where((F.col("train") > 0) & (long | (F.col("train") < least)) & (F.col("word") != F.lit(END)))
    rare = rare_levels({r["train"]: r["count"] for r in others.groupBy("train").count().collect()}, SWEEPS, BURN)

    # restaurants of single words: customers, and what the base predicts for each word after one
    # without a context of its own (any_p), and after one with it, among rare words (rare_p)
    size = np.maximum(trained, 0)
    size[: named + 1] = np.concatenate([followers[:1], followers[2:]])
    rare_p = np.array([rare[c] if d == width - 1 else 1.0 for d, c in zip(dish.tolist(), np.maximum(trained, 0).tolist())])
    near = {"size": size.astype(np.float64), "any_p": first[dish] * rare_p, "rare_p": rare_p}
    levels = spark.createDataFrame(list(rare.items()), "train long, rare_p double")
    far = written(
        unnumbered.join(F.broadcast(levels), "train").select("word", rare_code(F.col("word"), salt).alias("code"), "train", F.col("train").alias("size"), (F.col("rare_p") * float(first[-1])).alias("any_p"), "rare_p")
    )
    forget(unnumbered)
    cells = pairs.where(F.col("u") != GRID)
    twice, many = cells.agg(F.count_if(F.col("c") == 2), F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c"))), F.lit(0))).first()
    once = int(followers.sum()) - many
    discount = float(np.clip(once / max(1, once + 2 * twice), 0.05, 0.95))
    with_t = lambda cells: cells.withColumn("t", F.lit(1.0))
    more = seated(_priced(with_t(cells.where("c > 1")), near, far, named, "size"), len(every), discount)
    saved, shared = _saved(more, len(every))
    near["opened"] = STRENGTH + discount * (size - shared)
    opened = F.lit(STRENGTH) + F.lit(discount) * (F.col("size") - F.coalesce("saved", F.lit(0.0)))
    unopened = far
    far = written(
        far.join(saved.where("code < 0"), "code", "left").withColumn("opened", opened).withColumn("own", F.log10("rare_p")).withColumn("shift", F.log10(F.col("opened") / (F.col("size") + STRENGTH))).drop("saved")
    )
    forget(unopened)
    gain = F.log10(1 + (F.col("c") - discount * F.col("t")) / (F.col("of_u") * F.col("p0"))).alias("gain")
    several = written(_priced(more, near, far, named, "opened").select("u", "w", "c", gain))
    none = F.lit(0).cast("long").alias("train")
    null = [F.lit(None).cast("double").alias(n) for n in ("gain", "of_u", "any_p", "rare_p")]
    single = _unpriced(cells.where("c = 1").select("u", "w", null[0], none), far, "opened")
    top = _frequent_pairs(several, frequent_pairs).select((F.col("u") * len(every) + F.col("w")).alias("pair"), "gain").toArrow().sort_by("pair")
    of_words = far.where("train > 0").select(F.lit(GRID).cast("long").alias("u"), F.col("code").alias("w"), (F.col("own") + F.col("shift") - math.log10(rare[0])).alias("gain"), "train", *null[1:])
    packs = written(slotted(several.select("u", "w", "gain", none, *null[1:]).unionByName(single).unionByName(of_words), slots, (near["opened"], near["any_p"], near["rare_p"]), named, discount, max(spark.sparkContext.defaultParallelism, tokens // PACKED_PAIRS)))
    for table in (words, pairs, more, saved, several):
        forget(table)
    return Model(
        far, packs, slots, int(tokens), int(types), number, dish, context_of, trained, log10, rare,
        salt, np.log10(near["opened"] / (size + STRENGTH)), top["pair"].to_numpy(), top["gain"].to_numpy(),
    )


def slotted(links: DataFrame, slots: int, near: tuple[np.ndarray, np.ndarray, np.ndarray], named: int, discount: float, tasks: int) -> DataFrame:
    """(slot, blob) of (u, w, gain, train, of_u, any_p, rare_p): the rows of each slot, as tasks
    pack them together. Where gain is null, it's that of a pair that occurs once. Each task has a
    row for every slot, so a table of few pairs gets few tasks, however it is dealt."""
    arrow_batches(links.sparkSession, PAIR_ROWS)
    shared = links.sparkSession.sparkContext.broadcast(near)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blobs(held: list[tuple]):
            u, w, gain, train = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((w, u))
            yield from _rows_of(_blobs(u[order], w[order], slots, gain[order].astype(np.float32), train[order]))

        held, n = [], 0
        for b in batches:
            of_u, p0 = _prices(b, shared.value, named)
            once = np.log10(1 + (1 - discount) / (of_u * p0))
            gain = b.column("gain").to_numpy(zero_copy_only=False)
            held.append((b.column("u").to_numpy(), b.column("w").to_numpy(), np.where(b.column("gain").is_null().to_numpy(zero_copy_only=False), once, gain), b.column("train").to_numpy()))
            n += b.num_rows
            if n > PACKED_PAIRS:
                yield from blobs(held)
                held, n = [], 0
        if n:
            yield from blobs(held)

    return links.coalesce(tasks).mapInArrow(run, "slot int, blob binary")


def scored_here(rows: DataFrame, model: Model) -> DataFrame:
    """(slot, kind, chunk, blob). Kind 2: the texts of a chunk, with the sums over the words and pairs
    that the tasks have. Kind 1: the others of a slot, each once, and the rows that have it; a
    word without a number stands after GRID."""
    spark = rows.sparkSession
    arrow_batches(spark)
    own = np.array([math.log10(model.rare[c]) if c in model.rare else 0.0 for c in np.maximum(model.trained, 0).tolist()])
    own[model.dish < len(model.context_of) - 1] = 0  # the dishes have all of their probability in the bounded model
    shared = spark.sparkContext.broadcast((model.number, model.context_of, model.trained, model.base(np.maximum(model.trained, 0)), own, model.log10, model.shift, model.pair, model.gain.astype(np.float32)))
    salt, slots, no_base, no_own = model.salt, model.slots, float(model.base(0)), math.log10(model.rare[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, context_of, trained, base, own, log10, shift, pair, gain = shared.value
        places = _Places(number, salt)
        chunks = itertools.count(TaskContext.get().partitionId() << 32)

        def blobs(held: list[tuple]):
            ids, null, out, sizes, place = (np.concatenate(x) for x in zip(*held))
            starts = np.cumsum(sizes) - sizes
            row = np.repeat(np.arange(len(sizes)), sizes)
            codes = np.array(places.codes, np.int64)
            code = codes[place]
            before, context, dish = _classes(code, context_of)
            at, last = np.maximum(code, 0), np.maximum(before, 0)
            here = (code >= 0) & (trained[at] >= 0)
            score = log10[context, dish].astype(np.float64) + np.where(here, own[at], no_own)
            free = (context == 1) | (dish == len(context_of) - 1)
            score += np.where(free & (before >= 0), shift[last], 0)
            # pairs: those that the tasks have, and others that may have been seen
            free &= (code < 0) | (trained[at] > 0)
            key = last * len(number) + at
            found = np.minimum(np.searchsorted(pair, key), max(0, len(pair) - 1))
            hit = free & (code >= 0) & (before >= 0) & (pair[found] == key) if len(pair) else np.zeros(len(key), bool)
            score[hit] += gain[found[hit]]
            sums = lambda values: np.add.reduceat(values, starts)
            known = sums((here & (trained[at] > 0)).astype(np.int64))
            texts = packed(ids, null, out, sizes, known, sums(np.where(here, base[at], no_base)), sums(score))
            chunk = next(chunks)
            yield int(_slot_of(np.array([chunk]), np.array([GRID]), slots)[0]), 2, chunk, texts
            rank, ranked = _ranks(codes, place)
            left = free & ~hit
            key = np.concatenate([rank[np.concatenate([[0], place[:-1]])[left]] << 32 | rank[place[left]], rank[place[~here]]])
            row = np.concatenate([row[left], row[~here]])
            order = np.argsort(key, kind="stable")
            key, row = key[order], row[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
            times = np.diff(first, append=len(key))
            u, w = ranked[key[first] >> 32], ranked[key[first] & 0xFFFFFFFF]
            slot = _slot_of(u, w, slots)
            row = row[np.argsort(np.repeat(slot, times), kind="stable")]
            order = np.argsort(slot, kind="stable")
            u, w, times = u[order], w[order], times[order]
            ends = np.concatenate([[0], np.cumsum(times)]).tolist()
            for k, (a, b) in enumerate(itertools.pairwise(_starts(slot, slots))):
                if a < b:
                    yield k, 1, chunk, packed(u[a:b], w[a:b], times[a:b], row[ends[a] : ends[b]])

        def batch(held: list[tuple]) -> Iterator[pa.RecordBatch]:
            all_blobs = blobs(held)
            while some := list(itertools.islice(all_blobs, 64)):
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*some), (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["slot", "kind", "chunk", "blob"])

        held, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            texts = [tokens_of(t) for t in b.column("text").to_pylist()]
            ids = b.column("doc_id")
            null = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            held.append((ids.fill_null(0).to_numpy(), null, b.column("held_out").to_numpy(zero_copy_only=False).astype(np.int64), np.array([len(t) for t in texts]), places.of(texts)))
            n += len(held[-1][-1])
            if n > CHUNK_TOKENS:
                yield from batch(held)
                held, n = [], 0
                if len(places) > HELD_WORDS:
                    places.start()
        if held:
            yield from batch(held)

    return rows.mapInArrow(run, "slot int, kind int, chunk long, blob binary")


def looked_up(rows: DataFrame, model: Model) -> DataFrame:
    """(chunk, part, blob) of the rows of ``scored_here`` and of the model, dealt and sorted by slot:
    sums of what the slots have for each text. The texts themselves are part -1."""
    tokens, types = model.tokens, model.types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = itertools.count(TaskContext.get().partitionId() << 32)
        links, texts, found, held, slot = [], [], [], 0, None

        def find() -> None:
            """The gains of the pairs of one slot."""
            nonlocal held
            if not links or not texts:
                return
            u, w, gain, train = (np.concatenate(x) for x in zip(*(unpacked(x) for x in links)))
            us, ws = np.unique(u), np.unique(w)
            key = np.searchsorted(us, u) << 32 | np.searchsorted(ws, w)
            order = np.argsort(key)
            key, gain, train = key[order], gain[order].astype(np.float64), train[order]
            for chunk, blob in texts:
                u, w, times, row = unpacked(blob)
                a, b = np.minimum(np.searchsorted(us, u), len(us) - 1), np.minimum(np.searchsorted(ws, w), len(ws) - 1)
                at = np.minimum(np.searchsorted(key, a << 32 | b), len(key) - 1)
                hit = (us[a] == u) & (ws[b] == w) & (key[at] == (a << 32 | b))
                at, some = np.repeat(at, times), np.repeat(hit, times)
                at = at[some]
                found.append((np.full(len(at), chunk), row[some], gain[at], train[at]))
                held += len(at)

        def sums() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if not found:
                return
            chunk, row, gain, train = (np.concatenate(x) for x in zip(*found))
            found.clear()
            held = 0
            chunks, of = np.unique(chunk, return_inverse=True)
            key, of = np.unique(of << 32 | row, return_inverse=True)
            score = np.bincount(of, gain, minlength=len(key)).astype(np.float32)
            word = train > 0
            known = np.bincount(of[word], minlength=len(key))
            more = np.bincount(of[word], _base(train[word], tokens, types) - _base(0, tokens, types), minlength=len(key))
            part = next(parts)
            for k, (a, b) in enumerate(itertools.pairwise(_starts(key >> 32, len(chunks)))):
                if a < b:
                    some = known[a:b] > 0
                    blob = packed(key[a:b] & 0xFFFFFFFF, known[a:b], more[a:b][some], score[a:b])
                    yield pa.RecordBatch.from_arrays([pa.array([int(chunks[k])], pa.int64()), pa.array([part], pa.int64()), pa.array([blob], pa.binary())], names=["chunk", "part", "blob"])

        for b in batches:
            for k, kind, chunk, blob in zip(*(b.column(c).to_pylist() for c in ("slot", "kind", "chunk", "blob"))):
                if k != slot:
                    find()
                    links, texts, slot = [], [], k
                    if held > HELD_VALUES:
                        yield from sums()
                if kind == 2:
                    yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([-1], pa.int64()), pa.array([blob], pa.binary())], names=["chunk", "part", "blob"])
                elif kind:
                    texts.append((chunk, blob))
                else:
                    links.append(blob)
        find()
        yield from sums()

    both = rows.unionByName(model.slotted.select("slot", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("chunk"), "blob"))
    dealt = both.repartition(model.slots // SLOTS, "slot").sortWithinPartitions("slot", "kind", "chunk")
    return dealt.mapInArrow(run, "chunk long, part long, blob binary")


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of each chunk with all of their sums, of rows sorted by chunk and part."""
    texts = None

    def out():
        ids, null, held_out, sizes, known, base, score = texts
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, mask=null > 0), "held_out": pa.array(held_out > 0), "n_tokens": pa.array(sizes), "n_known": pa.array(known), "base_score": pa.array(base), "score": pa.array(score)})

    for b in batches:
        for part, blob in zip(b.column("part").to_pylist(), b.column("blob").to_pylist()):
            arrays = unpacked(blob)
            if part < 0:
                if texts:
                    yield from out()
                texts = [a.copy() for a in arrays]
            else:
                row, known, base, score = arrays
                texts[4][row] += known
                texts[5][row[known > 0]] += base
                texts[6][row] += score
    if texts:
        yield from out()


def scores(docs: DataFrame, model: Model, folds: int = 5, held: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity for every row.

    score is the log10 probability of the whole text, perplexity that of a token. Null texts
    count as empty: one end. Repeated rows get the same result each. Very long texts count
    whole. An empty table gives no rows. Other columns are ignored.
    """
    parts = looked_up(scored_here(_with_folds(docs, folds, held), model), model)
    rows = parts.repartition("chunk").sortWithinPartitions("chunk", "part").select("part", "blob")
    added = rows.mapInArrow(_added, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return added.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity")
    )
