"""From banded signatures to verified links and connected components.

Every step is a join or a grouping. Nothing is collected, no bucket is capped, and
pairs inside a bucket are only formed between parts that are not yet connected. The
members of large buckets meet by their rarest elements instead, which is exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chirpline.llm.common import written


#: Words of 64 coordinates in the finer sketch of items whose buckets hold several parts.
FINE = 32
#: Buckets of more members are split by rare elements.
LARGE = 100


def most_apart(bits: int, threshold: float) -> int:
    """One-bit coordinates of equal sets' minima differ with probability (1 - J) / 2.
    Pairs at the threshold differ in more than this many with a probability below 1e-7."""
    p = (1 - threshold) / 2
    return int(bits * p + 5.3 * math.sqrt(bits * p * (1 - p)))


def apart(a: str, b: str, words: int) -> Column:
    """Coordinates of the one-bit sketches that differ."""
    return sum((F.bit_count(F.get(f"{a}.bits", i).bitwiseXOR(F.get(f"{b}.bits", i))) for i in range(1, words)), F.bit_count(F.get(f"{a}.bits", 0).bitwiseXOR(F.get(f"{b}.bits", 0))))


def plausible(a: str, b: str, words: int, threshold: float) -> Column:
    """Set sizes and one-bit sketches allow the similarity."""
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return (apart(a, b, words) <= most_apart(64 * words, threshold)) & (small >= large * F.lit(threshold - 1e-9))


def similar_links(items: DataFrame, texts_of: Callable[[DataFrame], DataFrame], confirm: Callable[[DataFrame, DataFrame], DataFrame], finer: Callable[[DataFrame], DataFrame], elements: Callable[[DataFrame], DataFrame], words: int, threshold: float = 0.8, fine: int = FINE, large: int | None = LARGE) -> DataFrame:
    """Links (a, b) that connect all items which banding and verification connect.

    ``items`` has one row for each distinct set: id, n (set size), bands (array of
    bucket keys) and bits (a one-bit sketch of 64 * ``words`` coordinates). If it has a
    column only, sets with the same value there that isn't null aren't linked.
    ``texts_of`` gives (id, text) of the wanted ids, and ``confirm`` takes pairs (a, b)
    with those texts and returns the pairs whose full sets are similar enough.
    ``finer`` makes (id, bits) with ``fine`` words of sketch from texts, and ``elements``
    (id, elements), the hashed sets.

    First each item is compared with the nearest of its buckets' heads. The head of a
    bucket is the member that shares the most buckets with others, so copies of one
    original meet it rather than each other, and a large group is connected by one
    link for each member. Then every pair of a bucket whose two parts are still apart
    is compared, after a finer sketch has excluded those that are clearly too far:
    the remoter copies of a popular original lie just below the threshold from each
    other. In a bucket of more than ``large`` members pairs are formed only between those
    with a common element among their rarest ones (``by_rare_elements``), so a frequent
    passage that many sets share doesn't make them candidates. With ``large`` None all pairs
    of every bucket are formed. Joins that carry many rows merge sorted shuffles at every size.
    """
    if "only" not in items.columns:
        items = items.withColumn("only", F.lit(None).cast("long"))
    foreign = lambda a, b: F.coalesce(F.col(f"{a}.only") != F.col(f"{b}.only"), F.lit(True))
    rows = items.select("id", F.explode("bands").alias("key"))
    buckets = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    shared = written(rows.join(buckets.hint("merge"), "key"))
    known = written(items.select("id", "n", "bits", "only").join(shared.groupBy("id").agg(F.sum("m").alias("weight")), "id"))
    placed = written(shared.select("key", "id").join(known, "id"))
    heads = placed.groupBy("key").agg(F.max(F.struct("weight", "id", "n", "bits", "only")).alias("h")).select("key", "h.*")
    nearest = (
        placed.alias("x")
        .join(heads.alias("h"), (F.col("x.key") == F.col("h.key")) & (F.struct("x.weight", "x.id") < F.struct("h.weight", "h.id")) & foreign("x", "h") & plausible("x", "h", words, threshold))
        .groupBy(F.col("x.id").alias("b"))
        .agg(F.min(F.struct(apart("x", "h", words).alias("apart"), F.col("h.id").alias("a"))).alias("best"))
        .select("best.a", "b")
    )
    texts = written(texts_of(known.select("id")))
    first = written(confirm(written(nearest), texts))
    parts = components(first)

    still = written(placed.drop("weight").join(parts, "id", "left").withColumn("part", F.coalesce("part", "id")))
    mixed = still.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("members")).where("low < high").select("key", "members")
    open_rows = written(still.drop("bits").join(mixed, "key"))
    wanted = written(texts.join(open_rows.select("id").distinct(), "id", "left_semi"))
    sketches = written(finer(wanted))
    few = open_rows if large is None else open_rows.where(F.col("members") <= large)
    few = written(few.join(sketches.join(items.select("id", "bands"), "id"), "id"))
    apart_yet = (F.col("x.id") < F.col("y.id")) & (F.col("x.part") != F.col("y.part")) & foreign("x", "y") & plausible("x", "y", fine, threshold)
    once = F.array_min(F.array_intersect("x.bands", "y.bands")) == F.col("x.key")  # of the buckets that they share
    pair = [F.col("x.id").alias("a"), F.col("y.id").alias("b")]
    pairs = few.alias("x").join(few.alias("y"), (F.col("x.key") == F.col("y.key")) & apart_yet & once).select(*pair)
    if large is not None:
        many = open_rows.where(F.col("members") > large).select("id", "n", "only", "part").distinct()
        rare = by_rare_elements(elements(wanted.join(many.select("id"), "id", "left_semi")), threshold)
        met = written(rare.join(many.join(sketches, "id"), "id"))
        at_first = F.array_min(F.array_intersect("x.rare", "y.rare")) == F.col("x.element")  # of the rare elements that they share
        pairs = pairs.unionByName(met.alias("x").join(met.alias("y"), (F.col("x.element") == F.col("y.element")) & apart_yet & at_first).select(*pair)).distinct()
    second = confirm(written(pairs), texts)
    return written(first.unionByName(second))


def by_rare_elements(sets: DataFrame, threshold: float) -> DataFrame:
    """(id, element, rare) for the rarest elements of each (id, elements) that other sets
    have too; rare is the array of them.

    Two sets of at least the similarity share ceil(threshold * n) elements of the one with
    n, so if all sets order their elements alike, the first n - ceil(threshold * n) + 1 of
    either hold a common one.
    """
    rows = sets.select("id", F.explode("elements").alias("element"))
    known = written(rows.groupBy("element").agg(F.count(F.lit(1)).alias("sets")))
    ranked = rows.join(known.hint("merge"), "element").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("sets", "element"))).alias("order"))
    first = F.size("order") - F.ceil(F.size("order") * F.lit(threshold - 1e-9)).cast("int") + 1
    rare = F.filter(F.slice("order", F.lit(1), first), lambda e: e["sets"] > 1)["element"]
    return ranked.select("id", rare.alias("rare")).select("id", F.explode("rare").alias("element"), "rare")


def components(links: DataFrame) -> DataFrame:
    """(id, part) for every linked id; part is the smallest id that can be reached.

    Alternating large-star and small-star steps; each step hangs nodes on the
    smallest known neighbour, so the number of rounds grows with the logarithm of
    the size. They end when every node hangs on one root. Minima are grouped with
    partial sums, so a node with very many links doesn't load one task.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _loose(edges).isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    own = edges.select(F.col("v").alias("id"), F.col("v").alias("part")).distinct()
    return written(edges.select(F.col("u").alias("id"), F.col("v").alias("part")).unionByName(own))


def _loose(edges: DataFrame) -> DataFrame:
    """Nodes that hang on several others, or on one that hangs itself."""
    several = edges.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high")).where("low < high").select("u")
    return several.unionByName(edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi"))
