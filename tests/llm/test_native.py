import hashlib
import re

import xxhash
from pyspark.sql import functions as F

from chirpline.llm import fingerprint, line_dedup, secrets
from tests.llm import cases


def test_fingerprints_edit_by_the_next_document(spark):
    rows = [(i, t or "") for i, t, *_ in cases.rows()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for k, (i, t) in enumerate(rows):
        nxt, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()))
    got = fingerprint.fingerprints(cases.frame(spark)).collect()
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["n_chars"], r["edited_sha256"])) for r in got)
    prints = {}
    for r in got:
        prints.setdefault(r["doc_id"], set()).add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert prints[1] == prints[3] and prints[7] == prints[8] and prints[5] == {""}
    assert next(r["near_next"] for r in got if r["doc_id"] == 7) == 1.0
    assert fingerprint.fingerprints(cases.empty(spark)).count() == 0
    lone = fingerprint.fingerprints(spark.createDataFrame([(4, "abcd")], "doc_id long, text string")).first()
    assert lone["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()


def plain_fingerprint(text):
    """Hashes below an eighth of the range, else the least, from chained hashes of words."""
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text.lower()) if w]
    if not words:
        return []
    runs = [words[i : i + 5] for i in range(len(words) - 4)] if len(words) >= 5 else [[" ".join(words)]]
    found = set()
    for run in runs:
        h = 42
        for w in run:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        found.add(h - (1 << 64) if h >> 63 else h)
    return sorted(h for h in found if h < -(1 << 63) + (1 << 61)) or [min(found)]


def test_fingerprints_match_plain(spark):
    rows = [(i, t or "") for i, t, *_ in cases.rows()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    text_of = lambda h: "".join(f"{x & (1 << 64) - 1:016x}" for x in h)
    like = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if set(a) | set(b) else 1.0
    want = []
    for k, (i, t) in enumerate(rows):
        nxt, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        own, edited, following = map(plain_fingerprint, (t, t[: len(t) - half] + nxt[:half], nxt))
        want.append((i, text_of(own), text_of(edited), round(like(own, edited), 9), round(like(own, following), 9)))
    got = [(r["doc_id"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in fingerprint.fingerprints(cases.frame(spark)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_likeness_containment_and_merge(spark):
    rng_words = [cases.words(__import__("random").Random(k), 3000) for k in range(2)]
    whole, part = rng_words[0], " ".join(rng_words[0].split()[:300])
    df = spark.createDataFrame([(whole, part, rng_words[1])], "a string, b string, c string")
    sk = {c: fingerprint.sketch(F.col(c)) for c in "abc"}
    r = df.select(
        fingerprint.containment(sk["b"], sk["a"]).alias("inside"),
        fingerprint.likeness(sk["a"], sk["c"]).alias("apart"),
        fingerprint.likeness(sk["a"], sk["a"]).alias("same"),
        (fingerprint.merge(sk["a"], sk["c"]) == fingerprint.merge(sk["c"], sk["a"])).alias("commutes"),
        F.size(sk["a"]).alias("size"),
    ).first()
    assert r["inside"] == 1.0 and r["apart"] == 0.0 and r["same"] == 1.0 and r["commutes"]
    assert abs(r["size"] - 3000 / 8) < 80


def plain_line_dedup(rows):
    seen, gone = {}, {}
    order = sorted({(i, t) for i, t, *_ in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, t in order:
        lines = t.split("\n")
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if not "".join(w).strip(" "):
                continue
            if w in seen:
                gone.setdefault((i, t), set()).update((p, p + 1, p + 2))
            seen.setdefault(w, (i, p))
    out = []
    for i, t, *_ in rows:
        lines = [] if t is None else t.split("\n")
        g = gone.get((i, t), set())
        out.append((i, len(lines), len(g), None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in g)))
    return out


def test_line_dedup_matches_plain(spark):
    rows = cases.rows() + [(i, "\n".join("abcbcabcabxyz"[k % 13] for k in range(i - 190, i - 165)), "", "", 0, "", "", "", "") for i in (200, 201, 203)]
    df = spark.createDataFrame(rows, cases.SCHEMA)
    got = [(r["doc_id"], r["n_lines"], r["n_removed"], r["text"]) for r in line_dedup.dedup_lines(df).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain_line_dedup(rows)))
    kept = line_dedup.dedup_lines_in(df)
    assert kept.schema == df.schema
    assert sorted(repr((r["doc_id"], r["text"], r["n_chars"])) for r in kept.collect()) == sorted(repr((i, t, None if t is None else len(t))) for i, _, _, t in plain_line_dedup(rows))
    assert line_dedup.dedup_lines(cases.empty(spark)).count() == 0


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_spans(text):
    spans = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(s for *_, s in sorted(spans))


def test_secrets_match_plain(spark):
    texts = [
        "é🙂 Password: hunter2hunter2 and TOKEN='abc' token=secret=abcdefgh12 token:secret:abcdefghij",
        "AKIA" + "A1" * 6 + " AKIAAKIAAKIA1234567 AKIA123",
        "f" * 31 + " " + "0a" * 16 + "g" + "ab" * 20,
        'api_key" : "' + "deadbeef" * 5 + '" apikey=12345678 API_KEY=x',
        "\n".join(["secret = aaaaaaaa"] * 300),
        "",
        "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl ghp_" + "a" * 36 + " -----BEGIN RSA PRIVATE KEY-----",
    ]
    rows = [(k, t) for k, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1]), (90, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = secrets.secret_digest(df).collect()
    assert len(got) == len(rows)
    by = {}
    for i, t in rows:
        by[i] = plain_spans(t or "")
    for r in got:
        assert r["base_sha256"] == hashlib.sha256(by[r["doc_id"]].encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(by[r["doc_id"]].count(k) for k in ("assign:", "access:", "hex:"))
    more = next(r["spans"] for r in got if r["doc_id"] == 6)
    assert all(k in more for k in ("jwt:0:", "github:", "pem:"))
    assert secrets.secret_digest(cases.empty(spark)).count() == 0
    assert secrets.secret_digest(cases.frame(spark)).count() == len(cases.rows())


def test_queries_hold_for_every_match():
    for rule, text in [("assign", "apikey=abcdefgh"), ("assign", "Api_Key: 'abcdefgh"), ("google", "AIza" + "x" * 35), ("slack", "xoxp-1234567890"), ("stripe", "sk_live_" + "a" * 16)]:
        pattern = next(r.pattern for r in secrets.RULES if r.kind == rule)
        assert re.search(pattern, text)
        assert all(any(all(t in text.lower() for t in choice) for choice in clause) for clause in secrets.trigram_query(pattern))
    assert secrets.trigram_query("[0-9a-f]+") == []
