"""Seeking: ranges answered from few bytes equal those of a walk over the whole file."""

import random
import struct

import pytest

from chirpline.sources import mp3, mp3_seek


def frame(rng, version, rate_at):
    """A layer III frame of a random bitrate."""
    kind, index, pad = {1.0: 3, 2.0: 2}[version], rng.randint(1, 14), rng.randint(0, 1)
    head = struct.pack(">I", 0x7FF << 21 | kind << 19 | 1 << 17 | 1 << 16 | index << 12 | rate_at << 10 | pad << 9)
    return head + bytes(mp3.frame_header(head, 0).length - 4)


def made(seed, frames=300):
    rng = random.Random(seed)
    out = b"ID3\4\0\0\0\0\0" + bytes([seed % 100]) + bytes(seed % 100) if seed % 2 else b""
    for k in range(frames):
        out += frame(rng, rng.choice([1.0, 2.0]) if seed % 3 == 0 else 1.0, rng.randrange(3) if seed % 5 == 0 else 1)
        if seed % 7 == 1 and k % 20 == 10:
            out += bytes(rng.randint(1, 9))
    return out


def walk(raw):
    out, seconds = [], 0.0
    for at, h in mp3.walked(raw, mp3.next_frame(raw, mp3.tag_size(raw))):
        out.append((len(out), at, h.length, seconds, seconds + h.samples / h.rate))
        seconds = out[-1][-1]
    return out


@pytest.mark.parametrize("grid", [0.1, 1.0, 100.0])
def test_ranges_equal_a_whole_walk(spark, tmp_path, grid):
    raws = {str(tmp_path / f"{s}.mp3"): made(s) for s in (1, 2, 3, 5, 15, 22)}
    for path, raw in raws.items():
        with open(path, "wb") as f:
            f.write(raw)
    files = spark.createDataFrame(list(raws.items()), "path string, content binary")
    rng = random.Random(9)
    asked = [(i, rng.choice([*raws, "none"]), a := rng.uniform(-1, 9), a + rng.choice([0.0, 0.01, 0.5, 3.0, 20.0])) for i in range(80)]
    requests = spark.createDataFrame(asked, "id int, path string, start double, end double")
    index = mp3_seek.seek_index(files, grid).cache()
    ranges = mp3_seek.byte_ranges(requests, index, grid)
    want = sorted((i, n, at, size) for i, path, a, b in asked if path in raws and b > max(0, a) for n, at, size, s, e in walk(raws[path]) if s < b and e > a)
    for found in (mp3_seek.frames_between(ranges, files), mp3_seek.frames_in_files(ranges)):
        assert sorted((r["id"], r["frame_idx"], r["at"], r["length"]) for r in found.collect()) == want
    for r in ranges.collect():
        held = [f for f in walk(raws[r["path"]]) if f[3] < r["end"] and f[4] > r["start"]]
        assert not held or r["a"] <= held[0][1] and r["b"] >= held[-1][1] + held[-1][2]
        if grid == 0.1 and held:  # no more than two steps beside the range
            assert r["b"] - r["a"] <= held[-1][1] + held[-1][2] - held[0][1] + 18 * 1500
    totals = {r["path"]: (r["frames"], r["duration"]) for r in mp3_seek.durations(index).collect()}
    assert totals == {p: (len(w), pytest.approx(w[-1][4])) for p, raw in raws.items() if (w := walk(raw))}


def test_files_without_frames(spark):
    files = spark.createDataFrame([("a", b""), ("b", b"no frames here" * 50), ("c", None)], "path string, content binary").where("content is not null")
    assert mp3_seek.seek_index(files).count() == 0


def test_files_are_walked_once_by_many_tasks(spark, data):
    """One Python stage makes the index and one the answers; no content is exchanged."""
    from chirpline.queries import mp3_seeks

    found = mp3_seeks.mp3_seek_frames(spark, data)
    found.collect()
    lines = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    assert sum("MapInArrow" in line for line in lines) == 2
    exchanged = [below for line, below in zip(lines, lines[1:]) if "Exchange" in line]
    assert exchanged and not any("content" in line for line in exchanged)
    assert mp3_seeks.varied_files(spark, data).rdd.getNumPartitions() == mp3_seeks.TASKS * spark.sparkContext.defaultParallelism


def test_ranges_that_touch_the_ends(spark):
    """Ends far beyond a file, starts just before its end, and requests that occur twice."""
    raw = made(2, 50)
    seconds = walk(raw)[-1][4]
    files = spark.createDataFrame([("f", raw)], "path string, content binary")
    asked = [(1, "f", -5.0, 1e15), (2, "f", seconds - 1e-6, seconds), (3, "f", seconds, seconds + 1), (4, "f", 0.3, 0.4), (4, "f", 0.3, 0.4)]
    found = mp3_seek.byte_ranges(spark.createDataFrame(asked, "id int, path string, start double, end double"), mp3_seek.seek_index(files, 0.1), 0.1).collect()
    assert sorted(r["id"] for r in found) == [1, 2, 4, 4]
    whole = next(r for r in found if r["id"] == 1)
    assert (whole["a"], whole["b"]) == (walk(raw)[0][1], walk(raw)[-1][1] + walk(raw)[-1][2])
