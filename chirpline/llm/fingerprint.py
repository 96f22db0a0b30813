"""Threshold-scaled fingerprints of documents.

A fingerprint retains every hash of a five-word shingle below a fixed fraction of the
hash range. Fingerprints of parts merge by union, and the share of one that lies in
another estimates containment even between texts of very unequal length. Only
DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chirpline.llm.common import let

SHINGLE = 5
FRACTION = 1 / 8
LOWEST = -(1 << 63)


def shingle_hashes(text: Column) -> Column:
    """Hashes of all word shingles in order; the whole sequence is one if it's shorter."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")

    def hashes(ws):
        one = lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(SHINGLE)])
        return F.when(F.size(ws) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.greatest(F.size(ws) - SHINGLE, F.lit(0))), one)).when(F.size(ws) > 0, F.array(F.xxhash64(F.array_join(ws, " ")))).otherwise(
            F.array().cast("array<bigint>")
        )

    return let(words, hashes)


def sketch(text: Column, fraction: float = FRACTION) -> Column:
    """The distinct shingle hashes below the fraction, ascending.

    If none lies below, the least hash stands alone, so that short texts keep an
    identity; the least hash of a union is the least of the parts', so this merges too.
    """
    bound = LOWEST + int(fraction * (1 << 64))

    def keep(hs):
        low = F.array_distinct(F.filter(hs, lambda h: h < F.lit(bound)))
        return let(low, lambda k: F.when(F.size(k) > 0, F.sort_array(k)).when(F.size(hs) > 0, F.array(F.array_min(hs))).otherwise(k))

    return let(shingle_hashes(text), keep)


def as_string(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard estimate; two empty fingerprints are alike, one is like no other."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; an empty a is contained."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merge(a: Column, b: Column) -> Column:
    """The fingerprint of two parts together (shingles across the seam apart)."""
    return let(F.array_union(a, b), lambda u: let(F.filter(u, lambda h: h < F.lit(LOWEST + int(FRACTION * (1 << 64)))), lambda k: F.when(F.size(k) > 0, F.sort_array(k)).when(F.size(u) > 0, F.array(F.array_min(u))).otherwise(k)))


def with_next(rows: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """``rows`` with next_<column> of the row that follows by (order, columns); the first
    row follows the last.

    Rows are dealt to ranges of ``order`` between quantiles, and each range also gets the
    first row of the following one, so no task sees more than its range.
    """
    ranges = min(2000, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = rows.select(order).agg(F.min(order).alias("low"), F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 10_000).alias("cuts")).first()
    if found["low"] is None:
        bounds = [LOWEST]
    else:
        bounds = sorted({found["low"], *found["cuts"]})
    place = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(order))) - 1
    opens = F.col(order) == F.get(F.array(*map(F.lit, bounds)), F.col("__range"))
    before = F.pmod(F.col("__range") - 1, F.lit(len(bounds)))
    own = F.struct(F.col("__range").alias("range"), F.lit(0).alias("borrowed"))
    dealt = rows.withColumn("__range", place).withColumn("__to", F.explode(F.when(opens, F.array(own, F.struct(before.alias("range"), F.lit(1).alias("borrowed")))).otherwise(F.array(own))))
    dealt = dealt.select(*rows.columns, "__to.range", "__to.borrowed")
    w = Window.partitionBy("range").orderBy("borrowed", order, *columns)
    return dealt.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns]).where("borrowed = 0").drop("range", "borrowed")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next for every row of ``docs`` (doc_id, text).

    The edited text has its last floor(n / 2) code points replaced by the first as many
    of the next document's, by ascending doc_id; the first follows the last, and a lone
    document follows itself. Null texts count as empty. Null ids come first; rows with
    the same id are ordered by text, and repeated rows follow each other. Very long texts
    are taken whole. An empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("ord", F.coalesce("doc_id", F.lit(LOWEST))).withColumn("sk", sketch(F.col("text")))
    near = with_next(rows, "ord", ["text", "sk"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = near.select(
        "doc_id", n.cast("long").alias("n_chars"), "sk", "next_sk", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)).alias("edited")
    )
    both = edited.select("doc_id", "n_chars", "sk", "next_sk", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("edited")).alias("edited_sk"))
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_string(F.col("sk")).alias("fingerprint"),
        as_string(F.col("edited_sk")).alias("edited_fingerprint"),
        likeness(F.col("sk"), F.col("edited_sk")).alias("near_edited"),
        likeness(F.col("sk"), F.col("next_sk")).alias("near_next"),
    )
