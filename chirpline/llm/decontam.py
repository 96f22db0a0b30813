"""Benchmark passages in documents, by Wu-Manber search over words.

The patterns are the windows of 13 consecutive words of each benchmark item. The text
is searched as a sequence of words: a table gives, for the last block of two words of
the current window, how far the search may move because no pattern has that block
nearer to its end. Where the shift is zero, the patterns with that last block (their
suffix bucket) are compared directly with the text. Items of fewer words have their
own tables by length.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chirpline.llm.common import filter_rows, fresh, map_rows

WINDOW = 13
#: Characters of benchmark text in one set of tables. More text is searched in blocks, one
#: pass over the documents for each.
BLOCK_CHARS = 8_000_000

#: A-Z to small letters; the ASCII bytes that are no letter or digit to spaces.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_FOLD).split() if text else []


class WuManber:
    """Search for patterns that all have ``m`` words."""

    def __init__(self, patterns: Iterable[tuple[tuple[bytes, ...], str]], m: int):
        self.m, self.block = m, min(2, m)
        self.bucket: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list[str]]] = defaultdict(dict)
        self.far = m - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        for words, item in patterns:
            for end in range(self.block, m + 1):
                key = words[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.far), m - end)
            self.bucket[words[m - self.block :]].setdefault(words, []).append(item)

    def occurrences(self, words: list[bytes]) -> Iterable[tuple[int, list[str]]]:
        """(first word, items) of each place where a pattern occurs."""
        m, block, far, shift, bucket = self.m, self.block, self.far, self.shift.get, self.bucket
        end = m
        while end <= len(words):
            key = tuple(words[end - block : end])
            step = shift(key, far)
            if step:
                end += step
                continue
            if items := bucket[key].get(tuple(words[end - m : end])):
                yield end - m, items
            end += 1


def tables(items: Iterable[tuple[str, str | None]], window: int = WINDOW) -> list[WuManber]:
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        words = words_of(text)
        m = min(window, len(words))
        for i in range(len(words) - m + 1) if m else ():
            by_length[m][tuple(words[i : i + m])].add(item)
    return [WuManber(((w, i) for w, found in ps.items() for i in sorted(found)), m) for m, ps in sorted(by_length.items())]


def search(words: list[bytes], found: list[WuManber]) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged spans of hit words and the items that occur."""
    spans, items = [], set()
    for t in found:
        for start, its in t.occurrences(words):
            spans.append((start, start + t.m))
            items.update(its)
    return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def covered(spans: list[tuple[int, int]]) -> int:
    return sum(e - s for s, e in merged(spans))


def benchmark_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[str, str]]]:
    """Whole items as text, in blocks of about ``block_chars`` characters at most, one by one.

    The benchmark is the stated query set of this search; its size is measured first, and
    the number of blocks follows from it.
    """
    items = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("string").alias("item"), "text").distinct()
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = int(chars // block_chars) + 1
    for k in range(n):
        yield [(r["item"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).toLocalIterator()]


def broadcast_blocks(benchmark: DataFrame, block_chars: int) -> list:
    """One broadcast for each block. The driver holds one block at a time; a task that
    searches for a block loads that one and builds its tables once."""
    return [benchmark.sparkSession.sparkContext.broadcast(b) for b in benchmark_blocks(benchmark, block_chars)]


def _result(words: list[bytes], spans: list[tuple[int, int]], items: Iterable[str]) -> tuple:
    names = sorted(items)
    return len(words), covered(spans), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), names


RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, items array<string>"
CONTAMINATED = "n_hit > 0 and 20 * n_hit >= n_words"


def text_keys() -> tuple[Column, Column]:
    """128 bits of hash of the text, or null."""
    return F.when(F.col("text").isNotNull(), F.xxhash64("text")), F.when(F.col("text").isNotNull(), F.xxhash64("text", F.lit(1)))


def hit_texts(docs: DataFrame, shared: list) -> DataFrame:
    """(k1, k2) and the result for each text in which an item of any block occurs.

    Every block is one pass over the documents, in tasks of its own, and gives the spans
    of the few texts that it hits; the spans of a text are then merged over the blocks.
    """
    k1, k2 = text_keys()
    rows = docs.select(k1.alias("k1"), k2.alias("k2"), "text").where("text is not null")

    def search_for(block):
        def make():
            found = tables(block.value)

            def work(c):
                out = {k: [] for k in ("k1", "k2", "n_words", "spans", "items")}
                for a, b, text in zip(c["k1"], c["k2"], c["text"]):
                    words = words_of(text)
                    spans, items = search(words, found)
                    if items:
                        for k, v in zip(out, (a, b, len(words), [x for s in spans for x in s], sorted(items))):
                            out[k].append(v)
                return out

            return work

        return map_rows(rows, make, "k1 long, k2 long, n_words int, spans array<int>, items array<string>").dropDuplicates(["k1", "k2"])

    parts = reduce(DataFrame.unionByName, map(search_for, shared))
    texts = parts.groupBy("k1", "k2").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))

    def finish():
        def work(c):
            out = {k: [] for k in ("k1", "k2", "n_words", "n_hit", "n_items", "items_sha256", "items")}
            for a, b, n, flat, items in zip(*(c[k] for k in ("k1", "k2", "n_words", "spans", "items"))):
                found = _result([], list(zip(flat[::2], flat[1::2])), set(items))
                for k, v in zip(out, (a, b, n, *found[1:])):
                    out[k].append(v)
            return out

        return work

    return map_rows(texts, finish, f"k1 long, k2 long, {RESULT}")


def contamination(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, items, contaminated for every row.

    A word inside an occurrence of a window is hit; a document is contaminated if hit
    words are at least a twentieth of it. Null and empty texts have no words and are
    clean. A null item_id or item text has no window; an empty benchmark hits nothing, and
    an empty table gives no rows. Very long texts are searched whole. Repeated rows get the
    same result each. Other columns are ignored.
    """
    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = broadcast_blocks(benchmark, block_chars)
    first = shared[0] if len(shared) == 1 else None

    def make():
        found = tables(first.value) if first else []

        def work(c):
            out = {k: [] for k in ("doc_id", *c.keys() - {"doc_id", "text"}, "n_words", "n_hit", "n_items", "items_sha256", "items")}
            for k in c.keys() - {"text"}:
                out[k] = c[k]
            for words in map(words_of, c["text"]):
                for k, v in zip(("n_words", "n_hit", "n_items", "items_sha256", "items"), _result(words, *search(words, found))):
                    out[k].append(v)
            return out

        return work

    if first:
        rows = map_rows(rows_in, make, f"doc_id long, {RESULT}")
    else:
        k1, k2 = text_keys()
        rows = map_rows(rows_in.select("doc_id", k1.alias("k1"), k2.alias("k2"), "text"), make, f"doc_id long, k1 long, k2 long, {RESULT}")
        hits = hit_texts(docs, shared).select("k1", "k2", F.struct("n_words", "n_hit", "n_items", "items_sha256", "items").alias("hit"))
        names = ("n_words", "n_hit", "n_items", "items_sha256", "items")
        rows = rows.join(hits, ["k1", "k2"], "left").select("doc_id", *[F.when(F.col("hit").isNotNull(), F.col(f"hit.{c}")).otherwise(F.col(c)).alias(c) for c in names])
    return rows.withColumn("contaminated", F.expr(CONTAMINATED))


def keep_clean(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not contaminated."""
    shared = broadcast_blocks(benchmark, block_chars)
    if len(shared) > 1:
        a, b = fresh(docs, "hit_k1"), fresh(docs, "hit_k2")
        k1, k2 = text_keys()
        bad = hit_texts(docs, shared).where(CONTAMINATED).select(F.col("k1").alias(a), F.col("k2").alias(b))
        return docs.join(bad, (k1 == F.col(a)) & (k2 == F.col(b)), "left_anti")

    def make():
        found = tables(shared[0].value)

        def keep(texts):
            out = []
            for words in map(words_of, texts):
                n = covered(search(words, found)[0])
                out.append(not (n > 0 and 20 * n >= len(words)))
            return out

        return keep

    return filter_rows(docs, make)
