"""Near-duplicate documents by fast similarity sketching.

A document's set holds its distinct word shingles. The sketch has t coordinates that
are filled in rounds: in round i every element is hashed to one coordinate and
competes there with the value i + v, 0 <= v < 1, and coordinates keep the least. After
t rounds, round t + j hashes all elements to coordinate j, so each coordinate fills.
Two sketches agree in a coordinate with probability equal to the Jaccard similarity,
with the concentration of full MinHash. Bands of coordinates give candidates, and
pairs count only after comparison of the full sets.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from chirpline.llm.common import map_rows, written
from chirpline.llm.linking import FINE, components, similar_links

U64 = np.uint64
#: Coordinates of a sketch, and words of 64 one-bit coordinates.
COORDINATES, WORDS = 256, 4
#: Odd multipliers of a 64-bit mixer (fixed values).
MIX_A, MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
GOLDEN = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words."""
    x = x ^ (x >> U64(30))
    x = x * MIX_A
    x = x ^ (x >> U64(27))
    x = x * MIX_B
    return x ^ (x >> U64(31))


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles, ascending."""
    if not words:
        return np.empty(0, U64)
    seen: dict[bytes, int] = {}
    h = np.fromiter((seen[w] if w in seen else seen.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words), U64, len(words))
    if len(h) < width:
        width = len(h)
    out = np.full(len(h) - width + 1, U64(width), U64)
    for i in range(width):
        out = mix(out * GOLDEN + h[i : len(h) - width + 1 + i])
    return np.unique(out)


class FastSimilaritySketch:
    """Sketches of t coordinates; deterministic, so that tasks agree."""

    def __init__(self, t: int):
        assert t & (t - 1) == 0, "t is a power of two"
        self.t, self.shift = t, U64(64 - int(math.log2(t)))
        self.value_bits = 64 - 12 - int(math.log2(t))
        self.seeds = mix(np.arange(1, 2 * t + 1, dtype=U64) * GOLDEN)
        assert 2 * t <= 1 << 12

    def _values(self, elements: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        h = mix(elements[None, :] ^ self.seeds[first:last, None])
        rounds = np.arange(first, last, dtype=U64)[:, None] << U64(52)
        return (h >> self.shift).astype(np.int64), rounds | (h & U64((1 << 52) - 1))

    def __call__(self, elements: np.ndarray) -> np.ndarray:
        """The sketch of a set that isn't empty: round and value of each coordinate's least."""
        t, none = self.t, np.iinfo(U64).max
        out = np.full(t, none, U64)
        done = 0
        while done < t and (done == 0 or (out == none).any()):
            step = min(t - done, max(1, math.ceil(t * (math.log(t) + 2) / len(elements))), max(1, (1 << 18) // len(elements)))
            bins, values = self._values(elements, done, done + step)
            np.minimum.at(out, bins.ravel(), values.ravel())
            done += step
        for j in np.flatnonzero(out == none):
            h = mix(elements ^ self.seeds[t + j])
            out[j] = (U64(t + j) << U64(52)) | (h & U64((1 << 52) - 1)).min()
        return out


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One signed 64-bit key for each band of ``rows`` coordinates; bands have keys apart.
    Takes one sketch or rows of them."""
    key = mix(np.arange(1, bands + 1, dtype=U64))
    banded = sketch[..., : bands * rows].reshape(*sketch.shape[:-1], bands, rows)
    for i in range(rows):
        key = mix(key * GOLDEN + banded[..., i])
    return key.view(np.int64)


def one_bits(sketch: np.ndarray, words: int) -> np.ndarray:
    """One bit of each of 64 * ``words`` coordinates, as signed words, for one sketch or rows."""
    bits = (mix(sketch[..., : 64 * words]) & U64(1)).astype(np.uint8)
    return np.packbits(bits, axis=-1).view("<i8")


def sketched(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n, set_key (128-bit hash of the full set), bands, bits."""

    def make():
        sketch = FastSimilaritySketch(COORDINATES)

        def work(c):
            out = {k: [] for k in ("doc_id", "n", "set_key", "bands", "bits")}
            memo: dict[bytes, tuple] = {}
            for doc_id, text in zip(c["doc_id"], c["text"]):
                elements = shingle_hashes(words_of(text), shingle)
                key = xxhash.xxh3_128_digest(elements.tobytes())
                if key not in memo:
                    if len(elements):
                        s = sketch(elements)
                        memo[key] = (band_keys(s, bands, rows), one_bits(s, WORDS))
                    else:
                        memo[key] = ([], [])
                for k, v in zip(out, (doc_id, len(elements), key, *memo[key])):
                    out[k].append(v)
            return out

        return work

    rest = StructType.fromDDL("n long, set_key binary, bands array<long>, bits array<long>")
    return map_rows(docs.select("doc_id", "text"), make, StructType([docs.schema["doc_id"], *rest]))


def shingle_elements(texts: DataFrame, shingle: int) -> DataFrame:
    """(id, elements), the hashed shingle sets of (id, text)."""

    def make():
        return lambda c: {"id": c["id"], "elements": [shingle_hashes(words_of(t), shingle).view(np.int64) for t in c["text"]]}

    return map_rows(texts.select("id", "text"), make, StructType([texts.schema["id"], StructField("elements", ArrayType(LongType()))]))


def fine_sketches(texts: DataFrame, shingle: int, words: int = FINE) -> DataFrame:
    """(id, bits) with ``words`` words of one-bit coordinates for (id, text)."""

    def make():
        sketch = FastSimilaritySketch(64 * words)

        def work(c):
            sets = (shingle_hashes(words_of(t), shingle) for t in c["text"])
            return {"id": c["id"], "bits": [one_bits(sketch(s), words) if len(s) else [0] * words for s in sets]}

        return work

    return map_rows(texts.select("id", "text"), make, StructType([texts.schema["id"], StructField("bits", ArrayType(LongType()))]))


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the percentage, exactly."""

    def make():
        def grams(text):
            w = words_of(text)
            return {tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set()

        def work(c):
            out = {"a": [], "b": []}
            last, x = None, set()
            for a, b, s, t in zip(c["a"], c["b"], c["s"], c["t"]):
                if s != last:
                    last, x = s, grams(s)
                y = grams(t)
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both) > 0:
                    out["a"].append(a)
                    out["b"].append(b)
            return out

        return work

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("s"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("t"))
    return map_rows(pairs.join(left, "a").join(right, "b").select("a", "b", "s", "t"), make, pairs.select("a", "b").schema)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 42, rows: int = 6) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text).

    Documents whose full sets agree are first put into one class, so groups of copies
    cost one sketch comparison. At the threshold a pair shares a band of the default
    sketch with probability 1 - 3e-6; beyond it the chance rises to certainty.

    Sets are compared by 128 bits of hash over the 64-bit hashes of their shingles, and
    n_shingles counts these; links between different sets are confirmed on the shingles
    themselves. Null and empty texts have an empty set and are linked with nothing. A null
    doc_id gets a null component and is kept. Rows that repeat a doc_id count as one document
    with the links of all its texts. Very long texts are taken whole. An empty table gives
    no rows. Other columns are ignored.
    """
    return near_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shingle, percent, bands, rows)


def near_documents(rows_in: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 42, rows: int = 6) -> DataFrame:
    """``near_duplicates`` of (doc_id, text) for a doc_id of any type that has an order."""
    signed = written(sketched(rows_in, shingle, bands, rows))
    linkable = signed.where("n > 0 and doc_id is not null")
    classes = written(linkable.groupBy("set_key").agg(F.min("doc_id").alias("id")))
    items = written(
        linkable.withColumnRenamed("doc_id", "id").join(classes, ["set_key", "id"]).dropDuplicates(["set_key", "id"]).select("id", "n", "bands", "bits")
    )
    texts = rows_in.select(F.col("doc_id").alias("id"), "text")

    def texts_of(ids: DataFrame) -> DataFrame:
        found = texts.join(ids.hint("merge"), "id")
        # rows that repeat an id and a text are one
        return found.groupBy("id", F.xxhash64("text").alias("key")).agg(F.min("text").alias("text")).select("id", "text")

    links = similar_links(items, texts_of, lambda pairs, found: confirmed(pairs, found, shingle, percent), lambda found: fine_sketches(found, shingle), lambda found: shingle_elements(found, shingle), WORDS, percent / 100, large=None)
    same = linkable.select("doc_id", "set_key").join(classes, "set_key").select("doc_id", F.col("id").alias("b"))
    split = written(same.groupBy("doc_id").agg(F.min("b").alias("a"), F.max("b").alias("high")).where("a < high").select("doc_id", "a"))
    if not split.isEmpty():  # a doc_id with several texts ties their classes
        links = links.unionByName(same.join(split, "doc_id").select("a", "b"))
    parts = components(links)
    placed = signed.select("doc_id", "n", "set_key").join(classes, "set_key", "left").join(parts, "id", "left")
    component = F.when(F.col("n") > 0, F.coalesce("part", "id")).otherwise(F.col("doc_id"))
    out = placed.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
