"""Reads that wait for their data: ranges, answers, and what the state still holds."""

import random

import numpy as np
import pandas as pd
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chirpline.streaming.pending_reads import BLOCK, Reads, answered, covers, log_of, read_many, united


def test_ranges_unite():
    assert united([], 0, 100) == [(0, 100)]
    assert united([(0, 100)], 100, 200) == [(0, 200)]
    assert united([(0, 150)], 100, 200) == [(0, 200)]
    assert united([], 50, 50) == []
    assert united([(0, 50)], 100, 200) == [(0, 50), (100, 200)]
    assert covers([(0, 100)], 0, 100) and covers([(0, 100)], 10, 90) and covers([], 50, 50)
    assert not covers([(0, 100)], 0, 101) and not covers([], 0, 10)


@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 8)), max_size=12), st.integers(0, 40), st.integers(0, 10))
def test_ranges_match_sets_of_samples(pieces, start, size):
    islands, held = [], set()
    for a, n in pieces:
        islands = united(islands, a, a + n)
        held |= set(range(a, a + n))
    assert {k for a, b in islands for k in range(a, b)} == held
    assert all(a < b for a, b in islands) and all(b < c for (_, b), (c, _) in zip(islands, islands[1:]))
    assert covers(islands, start, start + size) == (set(range(start, start + size)) <= held)


def run(spark, tmp_path, steps, wait=100):
    """Rows of one log (kind, source, request, start, end, second) a batch; the answers."""
    for k, rows in enumerate(steps):
        made = spark.createDataFrame(rows, "kind string, source_id string, request_id long, start long, end long, second long").withColumn("at", F.timestamp_seconds(F.col("second") + 5000))
        parts = [made.where(F.col("kind") == kind).drop("kind", "second") for kind in ("piece", "read", "end")]
        log_of(parts[0].drop("request_id"), parts[1], parts[2].drop("request_id", "start")).coalesce(1).write.parquet(f"{tmp_path}/in/{k:03}")
    schema = spark.read.parquet(f"{tmp_path}/in/*").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = answered(stream, wait, "10 seconds").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out").collect()


def test_a_lost_piece_leaves_bounded_state(spark, tmp_path):
    order = list(range(40))
    random.Random(3).shuffle(order)
    steps = [[("read", "a", 1, 0, 100, 0), ("read", "a", 2, 150, 170, 0), ("read", "b", 9, 0, 5, 0)]]
    steps += [[("piece", "a", None, 10 * k, 10 * k + 10, 1) for k in order[i : i + 10] if k != 16] for i in range(0, 40, 10)]
    steps += [[("end", "a", None, 0, 400, 2), ("piece", "b", None, 3, 4, 2)], [("read", "a", 3, 380, 500, 3), ("read", "a", 4, 7, 7, 3), ("read", "a", 5, 600, 700, 3), ("read", "a", 6, 155, 161, 3)]]
    steps += [[("piece", "~", None, 0, 0, 1000)]]
    rows = run(spark, tmp_path, steps)
    answers = {r["request_id"]: (r["source_id"], r["status"], r["start"], r["end"]) for r in rows if r["request_id"] is not None}
    assert answers == {
        1: ("a", "full", 0, 100),
        2: ("a", "expired", 150, 170),
        9: ("b", "expired", 0, 5),
        3: ("a", "partial", 380, 400),
        4: ("a", "full", 7, 7),
        5: ("a", "partial", 600, 600),
        6: ("a", "expired", 155, 161),
    }
    told = [r["end"] for r in rows if r["status"] == "frontier" and r["source_id"] == "a"]
    assert max(told) == 160 and len(told) == len(set(told))
    arrived = spark.read.format("statestore").option("stateVarName", "arrived").load(f"{tmp_path}/state").collect()
    held = {r["key"]["source_id"]: list(zip(r["value"]["starts"], r["value"]["ends"])) for r in arrived}
    assert held["a"] == [(0, 160), (170, 400)] and held["b"] == [(3, 4)]
    assert spark.read.format("statestore").option("stateVarName", "waiting").load(f"{tmp_path}/state").count() == 0


def test_numbers_and_deadlines_stay_exact(spark, tmp_path):
    """Requests beyond 2**53 beside pieces without one; deadlines in a session of another time zone."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Denver")
    try:
        first, second, third = (2**53 + k for k in (1, 3, 5))
        steps = [[("piece", "a", None, 0, 10, 0), ("read", "a", first, 0, 5, 0), ("read", "a", second, 20, 25, 0), ("read", "a", third, 40, 50, 300)]]
        steps += [[("piece", "~", None, 0, 0, 310)], [("piece", "a", None, 40, 50, 320)], [("piece", "~", None, 0, 0, 2000)]]
        rows = run(spark, tmp_path, steps)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert {r["request_id"]: r["status"] for r in rows if r["request_id"] is not None} == {first: "full", second: "expired", third: "full"}


def test_read_many_takes_all_samples_of_each_range(spark):
    chunks = spark.createDataFrame([("a", n0, [float(k) for k in range(n0, min(n0 + 8, 50))]) for n0 in range(0, 50, 8)], "source_id string, n0 long, x array<double>")
    asked = [(1, "a", 0, 50), (2, "a", 5, 6), (3, "a", 45, 80), (4, "a", 9, 9), (5, "b", 0, 4), (6, "a", 16, 24), (7, "a", -3, 2)]
    got = read_many(chunks, spark.createDataFrame(asked, "request_id long, source_id string, start long, end long"), 8).collect()
    want = [(i, float(n)) for i, s, a, b in asked if s == "a" for n in range(max(0, a), min(b, 50))]
    assert sorted((r["request_id"], r["x"]) for r in got) == sorted(want) and all(r["n"] == r["x"] for r in got)


class Held:
    """State in memory that counts how often it is asked; a handle, a value and a map."""

    def __init__(self):
        self.calls, self.value, self.map, self.timers, self.states = 0, None, {}, set(), {}

    def getValueState(self, name, *schema):
        return self.states.setdefault(name, Held())

    getMapState = getValueState

    def exists(self):
        return bool(self.value or self.map)

    def get(self):
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def iterator(self):
        self.calls += len(self.map)
        return iter(list(self.map.items()))

    def updateValue(self, key, value):
        self.calls, self.map[key] = self.calls + 1, value

    def removeKey(self, key):
        self.calls += 1
        del self.map[key]

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


class Due:
    def __init__(self, at):
        self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: at


def test_many_reads_wait_in_few_entries():
    """Batches of pieces with gaps and reads, as sets of samples answer them; the state is asked by block."""
    rng = np.random.default_rng(5)
    handle, reads = Held(), Reads(1000)
    reads.init(handle)
    held, waiting, total, size = np.zeros(60_100, bool), {}, 3 * BLOCK, 0
    for k in range(6):
        start = rng.permutation(6000)[:900] * 10
        ids = np.arange(size, size := size + total // 6)
        low = rng.integers(0, 60_000, len(ids))
        wide = rng.integers(0, 25, len(ids))
        rows = pd.DataFrame({"kind": ["piece"] * 900 + ["read"] * len(ids), "request_id": [-1] * 900 + ids.tolist(), "start": [*start, *low], "end": [*(start + 10), *(low + wide)], "at_ms": [0] * 900 + (ids % 5).tolist()})
        for a in start:
            held[a : a + 10] = True
        waiting |= {i: (a, a + n) for i, a, n in zip(ids.tolist(), low.tolist(), wide.tolist())}
        got = pd.concat(reads.handleInputRows(("s",), iter([rows.iloc[:700], rows.iloc[700:]]), None))
        full = got[got["status"] == "full"]["request_id"].tolist()
        want = [i for i, (a, b) in waiting.items() if held[a:b].all()]
        assert sorted(full) == want
        for i in want:
            del waiting[i]
    assert len(waiting) > BLOCK
    expired, due = [], 0
    while left := [t for t in handle.timers if t > due]:
        due = min(left)
        expired += [r for made in reads.handleExpiredTimer(("s",), Due(due), Due(due)) for r in made.itertuples()]
    assert sorted((r.request_id, r.start, r.end) for r in expired) == sorted((i, a, b) for i, (a, b) in waiting.items())
    assert not handle.states["waiting"].map and handle.calls + sum(s.calls for s in handle.states.values()) < 150
