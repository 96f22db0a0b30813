"""Fill-in-the-middle: texts cut at two units (lines) and put together in another order.

While the units of a text are counted, every ``EVERY``-th one leaves a checkpoint: its
number with its offsets in bytes and in code points. A cut is found by binary search of the
checkpoints and a short rescan from the one before it, so a text of any length is walked
once, and its index has one entry for ``EVERY`` units.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chirpline.llm.common import map_rows

#: Units between two checkpoints.
EVERY = 64
#: Marks of the three parts (fixed values).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))


def code_points(raw: bytes) -> int:
    return len(raw.decode("utf-8", "replace"))


class LineIndex:
    """Checkpoints of the lines of a UTF-8 text; a line ends after its newline or with the text."""

    def __init__(self, raw: bytes, every: int = EVERY):
        self.raw, self.n = raw, 0
        self.units, self.bytes_at, self.points_at = [0], [0], [0]
        at, find = 0, raw.find
        while at < len(raw):
            at = find(b"\n", at) + 1 or len(raw)
            self.n += 1
            if self.n % every == 0:
                self.points_at.append(self.points_at[-1] + code_points(raw[self.bytes_at[-1] : at]))
                self.units.append(self.n)
                self.bytes_at.append(at)

    def cut(self, unit: int) -> tuple[int, int]:
        """(bytes, code points) before the unit."""
        k = bisect_right(self.units, unit) - 1
        at = self.bytes_at[k]
        for _ in range(unit - self.units[k]):
            at = self.raw.find(b"\n", at) + 1 or len(self.raw)
        return at, self.points_at[k] + code_points(self.raw[self.bytes_at[k] : at])


def draws(doc_id: int | None, seed: int) -> list[int]:
    """The first four 32-bit numbers of the digest of seed and id; a null id counts as empty."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def rearranged(raw: bytes, doc_id: int | None, seed: int, fim_percent: int, spm_percent: int) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of prefix and of middle, output) of one text."""
    index = LineIndex(raw)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not raw or any(m in raw for m in _MARKS) or h3 % 100 >= fim_percent:
        return index.n, "plain", None, None, raw
    first, second = sorted((h1 % (index.n + 1), h2 % (index.n + 1)))
    (a, points_a), (b, points_b) = index.cut(first), index.cut(second)
    p, s, m = _MARKS
    prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
    if h4 % 100 < spm_percent:
        return index.n, "spm", points_a, points_b - points_a, b"".join((s, suffix, p, prefix, m, middle))
    return index.n, "psm", points_a, points_b - points_a, b"".join((p, prefix, s, suffix, m, middle))


def fill_in_middle(docs: DataFrame, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output for every row of ``docs``.

    n counts lines. ``fim_percent`` of the documents are rearranged, ``spm_percent`` of those
    with the suffix first; both are decided by the digest of seed and doc_id alone. Empty texts
    and texts that hold a mark stay plain, and their lengths are null. Null texts count as
    empty; a null doc_id counts as an empty number. Repeated rows get the same result each.
    Very long texts are cut whole. An empty table gives no rows. Other columns are ignored.
    """

    def make():
        def work(c):
            made = [rearranged(t or b"", i, seed, fim_percent, spm_percent) for i, t in zip(c["doc_id"], c["text"])]
            names = ("n", "form", "prefix_chars", "middle_chars", "output")
            out = dict(zip(names, map(list, zip(*made)))) if made else {k: [] for k in names}
            return out | {"doc_id": c["doc_id"], "output": pa.array(out["output"], pa.binary()).cast(pa.string())}

        return work

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return map_rows(rows, make, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text again, from output and form alone. The text holds no mark, so the first of each
    mark is the one that was written."""
    turn = F.when(form == "spm", F.locate(PREFIX, output, 4)).otherwise(F.locate(SUFFIX, output, 4))
    b = F.locate(MIDDLE, output, 4)
    one = F.substring(output, F.lit(4), turn - 4)
    two = F.substring(output, turn + 3, b - turn - 3)
    three = F.substring(output, b + 3, F.length(output))
    return F.when(form == "spm", F.concat(two, three, one)).when(form == "psm", F.concat(one, three, two)).otherwise(output)


def fim_digest(docs: DataFrame, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50) -> DataFrame:
    """The rows of ``fill_in_middle`` with digests of the output and of the text restored from it."""
    made = fill_in_middle(docs, seed, fim_percent, spm_percent)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    )


def sql(seed: int = 7, fim_percent: int = 100, spm_percent: int = 50) -> str:
    """The same rows in DuckDB."""
    h = lambda k: f"('0x' || substr(digest, {8 * k + 1}, 8))::bigint"
    return rf"""with d as (select doc_id, coalesce(text, '') as text, sha256('{seed}:' || coalesce(doc_id::varchar, '')) as digest from documents),
u as (select *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') as units, {h(0)} as h1, {h(1)} as h2, {h(2)} as h3, {h(3)} as h4 from d),
c as (select *, len(units) as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as b from u),
p as (select *, array_to_string(units[1:a], '') as prefix, array_to_string(units[a + 1:b], '') as middle, array_to_string(units[b + 1:], '') as suffix,
  case when text = '' or contains(text, '{PREFIX}') or contains(text, '{SUFFIX}') or contains(text, '{MIDDLE}') or h3 % 100 >= {fim_percent} then 'plain' when h4 % 100 < {spm_percent} then 'spm' else 'psm' end as form from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(prefix) end::bigint as prefix_chars, case when form <> 'plain' then length(middle) end::bigint as middle_chars,
  sha256(case form when 'plain' then text when 'spm' then '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle else '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle end) as output_sha256,
  sha256(text) as restored_sha256 from p"""
