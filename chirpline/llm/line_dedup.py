"""Removal of repeated passages of lines, by overlapping windows of three lines.

Every window of three consecutive lines is hashed. A window that occurs more than once
among all documents keeps its first occurrence, by (doc_id, line); the lines of later
occurrences go, where overlapping and touching occurrences merge into one span. Only
DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chirpline.llm.common import fresh, let

WINDOW = 3


def _windows(lines: Column) -> Column:
    """96 bits of hash for each window of the lines, as structs in order."""

    def at(ls):
        def one(i):
            three = [F.get(ls, i + k) for k in range(WINDOW)]
            return F.struct(F.xxhash64(*three).alias("h"), F.hash(*three).alias("g"), F.length(F.trim(F.concat(*three))).alias("n"))

        return F.when(F.size(ls) >= WINDOW, F.transform(F.sequence(F.lit(0), F.greatest(F.size(ls) - WINDOW, F.lit(0))), one)).otherwise(F.array().cast("array<struct<h:bigint,g:int,n:int>>"))

    return let(lines, at)


def line_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, pos, h, g) for each window that isn't blank."""
    keyed = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.split("text", "\n").alias("lines"))
    return keyed.select("doc_id", "text_key", F.posexplode(_windows(F.col("lines"))).alias("pos", "w")).where("w.n > 0").select("doc_id", "text_key", "pos", "w.h", "w.g")


def later_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, starts) of documents with windows that occurred earlier.

    First occurrences are minima with partial sums, and the join back has one row for
    each window on one side, so a window with very many occurrences can be split.
    """
    rows = line_windows(docs)
    first = rows.groupBy("h", "g").agg(F.min(F.struct("doc_id", "text_key", "pos")).alias("first"), F.max(F.struct("doc_id", "text_key", "pos")).alias("last")).where("first < last").select("h", "g", "first")
    later = rows.join(first, ["h", "g"]).where(F.struct("doc_id", "text_key", "pos") > F.col("first"))
    return later.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("pos")).alias("starts"))


def without_spans(lines: Column, starts: Column) -> Column:
    """The lines outside the merged spans of the windows that begin at ``starts`` (sorted)."""

    def cut(both):
        ls, ps = both["ls"], both["ps"]
        begins = F.filter(ps, lambda p, j: (j == 0) | (p > F.get(ps, j - 1) + WINDOW))
        ends = F.transform(F.filter(ps, lambda p, j: (j == F.size(ps) - 1) | (F.get(ps, j + 1) > p + WINDOW)), lambda p: p + WINDOW)
        kept = F.zip_with(F.concat(F.array(F.lit(0)), ends), F.concat(begins, F.array(F.size(ls))), lambda s, e: F.slice(ls, s + 1, e - s))
        return F.flatten(kept)

    return let(F.struct(lines.alias("ls"), starts.alias("ps")), cut)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, text for every row of ``docs`` (doc_id, text).

    Lines end at line feeds and are compared as they are. Windows of three blank lines
    don't count, and a text of fewer than three lines has none and stays whole. Null
    texts stay null with no lines; an empty text is one empty line. Null ids come first
    in the order. Rows that repeat both doc_id and text are one document and get the
    same result each; texts of one doc_id are ordered by their hash. Very long texts are cut
    whole. An empty table gives no rows. Other columns are ignored.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_key"))
    found = later_windows(docs).select(F.col("doc_id").alias("found_id"), F.col("text_key").alias("found_key"), "starts")
    joined = keyed.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_key") == F.col("found_key")), "left")
    lines = F.split("text", "\n")
    cut = F.when(F.col("starts").isNull(), lines).otherwise(without_spans(lines, F.col("starts")))
    both = joined.select("doc_id", "text", "starts", lines.alias("lines"), cut.alias("kept"))
    n = F.coalesce(F.when(F.col("text").isNotNull(), F.size("lines")), F.lit(0))
    return both.select(
        "doc_id",
        n.cast("long").alias("n_lines"),
        F.coalesce(F.when(F.col("starts").isNotNull(), F.size("lines") - F.size("kept")), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("starts").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n")).alias("text"),
    )


def dedup_lines_in(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, text without repeated passages and n_chars to match."""
    at, key, starts = (fresh(docs, c) for c in ("found_id", "found_key", "found_starts"))
    found = later_windows(docs.select("doc_id", "text")).select(F.col("doc_id").alias(at), F.col("text_key").alias(key), F.col("starts").alias(starts))
    joined = docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(at)) & (F.xxhash64("text") == F.col(key)), "left")
    text = F.when(F.col(starts).isNull(), F.col("text")).otherwise(F.array_join(without_spans(F.split("text", "\n"), F.col(starts)), "\n"))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


SQL = r"""
with ls as (
  select doc_id, text, string_split(text, chr(10)) as lines from documents
), w as (
  select doc_id, unnest(range(0, len(lines) - 2)) as pos, lines from ls where len(lines) >= 3
), k as (
  select doc_id, pos, md5(concat(lines[pos + 1], chr(10), lines[pos + 2], chr(10), lines[pos + 3])) as h,
         length(trim(concat(lines[pos + 1], lines[pos + 2], lines[pos + 3]), ' ')) as n
  from w
), o as (
  select doc_id, pos, row_number() over (partition by h order by doc_id, pos) as r from k where n > 0
), gone as (
  select distinct doc_id, unnest([pos, pos + 1, pos + 2]) as line from o where r > 1
), flat as (
  select doc_id, unnest(lines) as l, unnest(range(0, len(lines))) as line from ls where text is not null
), kept as (
  select f.doc_id, count(*) as n_lines, count(g.line) as n_removed,
         coalesce(string_agg(case when g.line is null then f.l end, chr(10) order by f.line), '') as text
  from flat f left join gone g on f.doc_id = g.doc_id and f.line = g.line group by f.doc_id
)
select d.doc_id, coalesce(k.n_lines, 0) as n_lines, coalesce(k.n_removed, 0) as n_removed,
       case when d.text is null then null else k.text end as text
from documents d left join kept k on d.doc_id = k.doc_id
"""
