"""Secrets in documents, through an inverted index of trigrams.

From each rule's regular expression a Boolean query over trigrams is derived: a text can
only match if it holds certain substrings. Postings say which documents hold the
trigrams of the queries, their intersection gives each rule's candidates, and only
candidates are matched. Rules without mandatory trigrams scan all texts. Only
DataFrame functions are used.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chirpline.llm.common import let


@dataclass(frozen=True)
class Rule:
    """A kind of secret: spans of ``pattern`` whose ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base kinds, in their order, then well-known key formats (fixed values).
RULES = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
    Rule("github", r"gh[opusr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"sk_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
]
BASE = ("assign", "access", "hex")
#: Strings that one part of a pattern may enumerate.
MOST = 64

#: A query is a conjunction of clauses, a clause a choice between sets of trigrams.
Query = list[list[frozenset[str]]]


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query that every match satisfies, over lower-case text."""
    clauses: Query = []

    def flush(strings: set[str]) -> None:
        choice = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in (x.lower() for x in strings)}
        if choice and all(choice):
            clauses.append(sorted((c for c in choice if not any(d < c for d in choice)), key=sorted))

    def strings_of(items) -> set[str] | None:
        """All strings that the items match, or None if they aren't few."""
        out = {""}
        for item in items:
            one = one_of(item)
            if one is None or len(out) * len(one) > MOST:
                return None
            out = {a + b for a, b in product(out, one)}
        return out

    def one_of(item) -> set[str] | None:
        op, arg = item
        if op is sre.LITERAL:
            return {chr(arg)}
        if op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
            return {chr(a) for _, a in arg}
        if op is sre.SUBPATTERN:
            return strings_of(arg[-1])
        if op is sre.BRANCH:
            parts = [strings_of(b) for b in arg[1]]
            return None if any(p is None for p in parts) else set().union(*parts)
        if op is sre.MAX_REPEAT and arg[1] is not sre.MAXREPEAT and arg[1] <= 5:
            one = strings_of(arg[2])
            if one is not None and len(one) ** int(arg[1]) <= MOST:
                return {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(one, repeat=n)}
        return None

    run = {""}
    for item in sre_parser.parse(pattern):
        one = one_of(item)
        if one is not None and len(run) * len(one) <= MOST:
            run = {a + b for a, b in product(run, one)}
            continue
        flush(run)
        run = {""} if one is None else one
    flush(run)
    return clauses


def postings(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, doc_id, text_key): the documents that hold each trigram of the queries."""
    held = let(F.lower("text"), lambda low: F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(low, t)))
    return rows.select("doc_id", "text_key", F.explode(held).alias("trigram"))


def satisfied(query: Query, held: Column) -> Column:
    """The trigrams held satisfy every clause."""
    out = F.lit(True)
    for clause in query:
        any_of = F.lit(False)
        for choice in clause:
            any_of = any_of | (F.size(F.array_except(F.array(*map(F.lit, sorted(choice))), held)) == 0)
        out = out & any_of
    return out


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """Structs (start, order, end, kind) of the rule's leftmost matches that don't overlap,
    in code points. Starts add up the lengths of matches and of the text between them."""
    pattern = F.lit(rule.pattern)

    def place(t):
        parts = F.struct(F.regexp_extract_all(t, pattern, F.lit(0)).alias("all"), F.regexp_extract_all(t, pattern, F.lit(rule.group)).alias("value"), F.split(t, rule.pattern, -1).alias("between"))

        def add(p):
            empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>").alias("found"))

            def step(acc, i):
                start = acc["at"] + F.length(F.get(p["between"], i))
                end = start + F.length(F.get(p["all"], i))
                span = F.struct(start.alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(rule.kind).alias("kind"))
                good = F.length(F.get(p["value"], i)) >= rule.least
                return F.struct(end.alias("at"), F.when(good, F.array_append(acc["found"], span)).otherwise(acc["found"]).alias("found"))

            steps = F.when(F.size(p["all"]) > 0, F.sequence(F.lit(0), F.greatest(F.size(p["all"]) - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
            return F.aggregate(steps, empty, step)["found"]

        return let(parts, add)

    return let(text, place)


def scanned(pattern: Rule) -> Rule:
    """A form with the same spans that skips short runs, for rules that scan all texts."""
    m = re_run(pattern.pattern)
    return Rule(pattern.kind, f"{m}{{{pattern.least},}}", 0, 0) if m and pattern.group == 0 and pattern.least else pattern


def re_run(pattern: str) -> str | None:
    """The character class of a pattern that is one run of it."""
    parsed = list(sre_parser.parse(pattern))
    return pattern[:-1] if len(parsed) == 1 and parsed[0][0] is sre.MAX_REPEAT and pattern.endswith("]+") else None


def secret_spans(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """doc_id and found, the array of all spans (start, order, end, kind) by start and kind,
    for every row of ``docs`` (doc_id, text).

    Null texts count as empty. Rows that repeat doc_id and text get the same spans. A null
    doc_id is a value like any other. Spans of several kinds that begin together are in the
    order of the rules. Very long texts are scanned whole. An empty table gives no rows.
    Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    queries = [trigram_query(r.pattern) for r in rules]
    trigrams = sorted({t for q in queries for clause in q for choice in clause for t in choice})
    held = postings(rows, trigrams).groupBy("doc_id", "text_key").agg(F.collect_set("trigram").alias("held"))
    passed = [(satisfied(q, F.col("held")) if q else F.lit(True)).alias(f"c{i}") for i, q in enumerate(queries)]
    some = F.lit(False)
    for i, q in enumerate(queries):
        some = some | F.col(f"c{i}") if q else some
    candidates = held.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), *passed).where(some)
    joined = rows.join(candidates, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")), "left")
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    found = []
    for i, (rule, q) in enumerate(zip(rules, queries)):
        quick = rule if q else scanned(rule)
        guard = F.col(f"c{i}") if q else F.col("text").rlike(quick.pattern)
        found.append(F.when(guard, spans_of(F.col("text"), quick, i)).otherwise(none))
    return joined.select("doc_id", F.sort_array(F.concat(*found)).alias("found"))


def secret_digest(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    named = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    found = secret_spans(docs, rules)
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(of, BASE), F.sha2(named(base), 256).alias("base_sha256"), named(F.col("found")).alias("spans"))


def sql(rules: list[Rule] = RULES) -> str:
    """The digest as DuckDB SQL."""
    parts = []
    for i, r in enumerate(rules):
        p = r.pattern.replace("'", "''")
        parts.append(
            f"select doc_id, '{r.kind}' as kind, {i} as ord, string_split_regex(t, '{p}') as g, regexp_extract_all(t, '{p}') as m, regexp_extract_all(t, '{p}', {r.group}) as v, {r.least} as least from d"
        )
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents), raw as ({" union all ".join(parts)}),
n as (select doc_id, kind, ord, least, g, m, v, unnest(range(1, len(m) + 1)) as i from raw where len(m) > 0),
s as (
  select doc_id, kind, ord, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as b, length(m[i]) as l
  from n where length(v[i]) >= least
), j as (
  select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
    string_agg(concat(kind, ':', b::bigint, ':', (b + l)::bigint), ',' order by b, ord) filter (kind in ('assign', 'access', 'hex')) as base,
    string_agg(concat(kind, ':', b::bigint, ':', (b + l)::bigint), ',' order by b, ord) as spans
  from s group by doc_id
)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join j on d.doc_id = j.doc_id
"""
