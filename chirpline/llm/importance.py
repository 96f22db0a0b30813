"""Importance resampling of documents towards a target distribution of hashed n-grams.

The words of a run of documents become numbers. A suffix array of that sequence, sorted by
the first words only, puts equal n-grams next to each other, and the array of common prefix
lengths marks where one n-gram ends and the next begins. So each different n-gram of a run
is hashed once, and its bucket is scattered back to all its occurrences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chirpline.llm.common import arrow_batches, map_rows, written
from chirpline.llm.decontam import words_of

BUCKETS = 10_000
#: Words in one suffix array; longer documents have one of their own.
RUN_WORDS = 400_000


class SuffixArray:
    """Positions of a sequence of numbers, sorted by their first ``depth`` numbers, and the
    length of the prefix (up to ``depth``) that each has in common with the one before it.

    Sequences are separated by numbers that occur once, so that no n-gram crosses them.
    """

    def __init__(self, sequence: np.ndarray, depth: int):
        rank, length = sequence.astype(np.int64), 1
        # ranks of prefixes of doubled length, until they are long enough
        while length < depth:
            step = min(length, depth - length)
            ahead = np.concatenate([rank[step:] + 1, np.zeros(min(step, len(rank)), np.int64)])
            _, rank = np.unique(rank * (ahead.max(initial=0) + 1) + ahead, return_inverse=True)
            length += step
        self.order = np.argsort(rank, kind="stable")
        self.common = np.zeros(len(sequence), np.int64)
        alive = np.ones(max(0, len(sequence) - 1), bool)
        for k in range(depth):
            here = self.order + k
            value = np.where(here < len(sequence), sequence[np.minimum(here, len(sequence) - 1)], -1 - self.order)
            alive &= value[1:] == value[:-1]
            self.common[1:] += alive


def buckets_of(texts: list[list[bytes]], most: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of each n-gram of 1 to ``most`` words, by document."""
    numbers: dict[bytes, int] = {}
    lengths = np.array([len(t) for t in texts], np.int64)
    total = int(lengths.sum())
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for t in texts for w in t), np.int64, total)
    words = list(numbers)
    document = np.repeat(np.arange(len(texts)), lengths)
    # one separator after each document
    place = np.arange(total) + document
    sequence = np.full(total + len(texts), -1, np.int64)
    sequence[place] = ids
    gaps = np.flatnonzero(sequence < 0)
    sequence[gaps] = len(words) + np.arange(len(gaps))
    suffixes = SuffixArray(sequence, most)
    starts = suffixes.order
    owner = np.zeros(len(sequence), np.int64)
    owner[place], owner[gaps] = document, np.arange(len(texts))
    end = gaps[owner]
    found_docs, found = [], []
    for n in range(1, most + 1):
        head = suffixes.common < n  # a run of n-grams begins where fewer words are in common
        run = np.cumsum(head) - 1
        firsts = starts[head]
        fits = firsts + n <= end[firsts]
        hashed = np.zeros(len(firsts), np.int64)
        hashed[fits] = [zlib.crc32(b" ".join([words[i] for i in sequence[s : s + n].tolist()])) % buckets for s in firsts[fits].tolist()]
        there = starts + n <= end[starts]
        found_docs.append(owner[starts[there]])
        found.append(hashed[run[there]])
    return np.concatenate(found_docs), np.concatenate(found)


def _runs(texts: Iterable[tuple[int, list[bytes]]]) -> Iterator[tuple[list[int], list[list[bytes]]]]:
    at, held, size = [], [], 0
    for k, words in texts:
        if held and size + len(words) > RUN_WORDS:
            yield at, held
            at, held, size = [], [], 0
        at.append(k)
        held.append(words)
        size += len(words)
    if held:
        yield at, held


def bucket_counts(texts: DataFrame, most: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over the n-grams of all texts. Every task adds up its own before the shuffle."""
    arrow_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        every = ((k, words_of(t)) for b in batches for k, t in enumerate(b.column("text").to_pylist()))
        for _, held in _runs(every):
            total += np.bincount(buckets_of(held, most, buckets)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(target: DataFrame, raw: DataFrame, most: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket: floor(1000 ln) of the smoothed target share over the raw one.

    One pair of numbers for each bucket comes to the driver.
    """
    n = lambda df, name: bucket_counts(df, most, buckets).withColumnRenamed("n", name)
    s, t = np.zeros(buckets), np.zeros(buckets)
    for r in n(raw, "s").join(n(target, "t"), "bucket", "full").na.fill(0, ["s", "t"]).collect():
        s[r["bucket"]], t[r["bucket"]] = r["s"], r["t"]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weights(docs: DataFrame, gains: np.ndarray, most: int = 1) -> DataFrame:
    """doc_id, n_words, n_features, weight for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def make():
        gain = shared.value

        def work(c):
            n = len(c["text"])
            features, weight, sizes = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for at, held in _runs((k, words_of(t)) for k, t in enumerate(c["text"])):
                document, bucket = buckets_of(held, most, len(gain))
                at = np.array(at)
                sizes[at] = [len(w) for w in held]
                features[at] = np.bincount(document, minlength=len(held))
                np.add.at(weight, at[document], gain[bucket])
            return {"doc_id": c["doc_id"], "n_words": sizes, "n_features": features, "weight": weight}

        return work

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_rows(rows, make, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 * Gumbel noise), drawn by the digest of seed and id (a null id counts as empty)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, order: list[Column], share: tuple[int, int]) -> DataFrame:
    """``rows`` with rank 1, 2, 3, ... in ``order`` for the first share (of 100) of them, else null.

    Rows are dealt to ranges of the order and numbered inside them, once, in a written table;
    the counts of earlier ranges, one number for each, are added. No task sorts them all.
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = written(placed)
    block = F.shiftright("__at", 33)
    sizes = {r["block"]: r["n"] for r in placed.groupBy(block.alias("block")).count().withColumnRenamed("count", "n").collect()}
    total = sum(sizes.values())
    before, so_far = {}, 0
    for k in sorted(sizes):
        before[k], so_far = so_far, so_far + sizes[k]
    drawn = share[0] * total // share[1]
    starts = F.array(*[F.lit(before.get(k, 0)).cast("long") for k in range(max(before, default=0) + 1)])
    rank = F.get(starts, block.cast("int")) + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn("rank", F.when(rank <= drawn, rank)).drop("__at")


def resampled(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = BUCKETS, seed: int = 2024, percent: int = 10, least_words: int = 20) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of ``docs``.

    The weight of a document is the sum of its n-grams' gains; with Gumbel noise added, the
    highest scores are a sample without replacement. ``percent`` of the documents with at
    least ``least_words`` words are drawn; ties go to the smaller doc_id (nulls first), then
    to the rows' other values, and rows that are alike in all of them follow each other. Null
    and empty texts have no words: weight 0, never drawn. Very long texts count whole. An
    empty table gives no rows; with an empty target every bucket has the smoothed share. Other
    columns are ignored.
    """
    rows = weights(docs, bucket_gains(target, docs, most, buckets), most).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    rows = written(rows)
    known = rows.where(F.col("n_words") >= least_words)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n_features"), F.col("weight")]
    drawn = ranked(known, order, (percent, 100))
    rest = rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def sql(buckets: int = BUCKETS, seed: int = 2024, percent: int = 10, least_words: int = 20) -> str:
    """The same rows for single words in DuckDB, with crc32 by its definition."""
    bits = "x"
    for _ in range(8):
        bits = f"list_transform([{bits}], lambda y: xor(y >> 1, 3988292384 * (y & 1)))[1]"
    step = bits.replace("[x]", "[xor(c, b)]")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = lambda t, key: rf"select {key}, unnest(regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from {t}"
    return rf"""with d as materialized (select row_number() over () as r, doc_id, text from documents),
dw as materialized ({words('d', 'r')}), bw as materialized ({words('benchmark', 'item_id')}),
v as (select w, hex(encode(w)) as x from (select w from dw union select w from bw)),
k as materialized (select w, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(x) + 1, 2), lambda i: ('0x' || substr(x, i, 2))::bigint)), lambda c, b: {step}), 4294967295) % {buckets} as bucket from v),
s as (select bucket, count(*) as s from dw join k using (w) group by 1), t as (select bucket, count(*) as t from bw join k using (w) group by 1),
g as (select bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::double) * ((select coalesce(sum(s), 0) from s) + {buckets}.0::double) / ((coalesce(s, 0) + 1.0::double) * ((select coalesce(sum(t), 0) from t) + {buckets}.0::double))))::bigint as gain from s full join t using (bucket)),
f as (select r, count(*) as n, sum(gain)::bigint as weight from dw join k using (w) join g using (bucket) group by 1),
e as (select doc_id, coalesce(n, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
  coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296.0::double)))::bigint as score from d left join f using (r)),
o as (select *, row_number() over (partition by n_features >= {least_words} order by score desc, doc_id nulls first, n_features, weight) as place, {percent} * count(*) over (partition by n_features >= {least_words}) // 100 as most from e)
select doc_id, n_features, weight, score, case when n_features >= {least_words} and place <= most then place end::bigint as rank from o"""
