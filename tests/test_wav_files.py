"""Files by byte ranges: what filters spare, what bad files give, what writers leave behind."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from chirpline.sources import wav
from chirpline.sources.byte_files import listed
from chirpline.sources.signals import chunked
from chirpline.sources.wav_source import PARTITIONS, WavReader, interleaved, register


def long_file(path, frames=10_000, channels=2):
    x = np.random.default_rng(4).uniform(-1, 1, (frames, channels)).astype("<f4")
    path.write_bytes(wav.encode(x, 100, bits=32))
    return x


def with_metadata(raw, body):
    """The file with one more chunk before its format."""
    chunk = b"LIST" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    return raw[:12] + chunk + raw[12:]


def read(spark, path, **options):
    return spark.read.format("chirpline_wav").options(**options).load(str(path))


def test_filters_reach_the_file(spark, tmp_path):
    register(spark)
    x = long_file(tmp_path / "a.wav")
    long_file(tmp_path / "b.wav")
    one = read(spark, tmp_path, chunk=128, split=8192).where(f"source_id = '{tmp_path}/a.wav' and channel = 1 and n0 >= 1000 and n0 < 2000 and size(x) > 1")
    plan = one._jdf.queryExecution().explainString(one.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pushed = plan[plan.index("PushedFilters") :].splitlines()[0]
    assert all(f in pushed for f in ("EqualTo(source_id", "EqualTo(channel,1)", "GreaterThanOrEqual(n0,1000)", "LessThan(n0,2000)"))
    rows = sorted(one.collect(), key=lambda r: r["n0"])
    assert [r["n0"] for r in rows] == list(range(1024, 2000, 128)) and {r["channel"] for r in rows} == {1}
    assert np.allclose(np.concatenate([r["x"] for r in rows]), x[1024:2048, 1])


def test_only_the_asked_bytes_are_read(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan, StringContains

    long_file(tmp_path / "a.wav", 100_000)
    long_file(tmp_path / "b.wav", 100_000)
    reader = WavReader({"path": str(tmp_path), "chunk": "1000", "split": "65536"})
    other = StringContains(("source_id",), "x")
    assert list(reader.pushFilters([EqualTo(("source_id",), f"{tmp_path}/a.wav"), GreaterThanOrEqual(("n0",), 50_000), LessThan(("n0",), 53_000), other])) == [other]
    pieces = reader.partitions()
    assert {p.uri for p in pieces} == {f"{tmp_path}/a.wav"} and len(pieces) == 13
    rows = sum(b.num_rows for p in pieces for b in reader.read(p))
    assert rows == 6 and reader.read_bytes == 13 * wav.PREFIX + 3000 * 8
    timed = WavReader({"path": str(tmp_path / "a.wav"), "chunk": "1000", "split": "65536", "start": "10", "end": "12.5"})
    assert sum(b.num_rows for p in timed.partitions() for b in timed.read(p)) == 2 and timed.read_bytes == 13 * wav.PREFIX + 250 * 8


def test_bad_files_are_rows_with_an_error(spark, tmp_path):
    register(spark)
    long_file(tmp_path / "good.wav", 300, 1)
    (tmp_path / "cut.wav").write_bytes((tmp_path / "good.wav").read_bytes()[:30])
    (tmp_path / "empty.wav").write_bytes(b"")
    (tmp_path / "text.wav").write_bytes(b"no audio" * 99)
    (tmp_path / "odd.wav").write_bytes(wav.encode(np.zeros(8), 8)[:20] + struct.pack("<H", 7) + wav.encode(np.zeros(8), 8)[22:])
    rows = read(spark, tmp_path / "*.wav", split=500).collect()
    assert {os.path.basename(r["source_id"]): r["error"] is None for r in rows} == {"good.wav": True, "cut.wav": False, "empty.wav": False, "text.wav": False, "odd.wav": False}
    assert len([r for r in rows if r["error"]]) == 4 and sum(len(r["x"]) for r in rows if r["x"]) == 300
    assert {os.path.basename(r["source_id"]) for r in read(spark, tmp_path / "*.wav").where("channel = 0").collect()} == {"good.wav"}
    assert read(spark, tmp_path / "none*.wav").count() == 0


@pytest.mark.parametrize("body", [b"some data in a comment", b"x" * 9001, b"data" * 3000, b"odd"])
def test_chunks_before_the_data(spark, tmp_path, body):
    register(spark)
    x = np.linspace(-1, 1, 700)
    raw = with_metadata(wav.encode(x, 50, bits=32), body)
    (tmp_path / "m.wav").write_bytes(raw)
    back = read(spark, tmp_path / "m.wav").first()
    assert back["error"] is None and np.allclose(back["x"], x)
    files = spark.read.format("binaryFile").load(f"{tmp_path}/m.wav")
    head = wav.headers(files).first()
    assert (head["rate"], head["n_samples"], head["error"]) == (50, 700, None)
    sent = files.select(F.length(wav.header_bytes(F.col("content")))).first()[0]
    assert sent == len(raw) - 2800


def test_many_tasks_write_one_file(spark, tmp_path):
    register(spark)
    x = np.random.default_rng(1).uniform(-1, 1, (5000, 2))
    rows = [("s", c, n, float(x[n, c])) for n in range(5000) for c in range(2)]
    chunks = chunked(spark.createDataFrame(rows, "source_id string, channel int, n long, x double"), 100)
    both = interleaved(chunks).repartition(9, "n0")
    both.write.format("chirpline_wav").mode("append").options(rate=100, channels=2, bits=32).save(str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == ["s.wav"]
    assert (tmp_path / "s.wav").read_bytes() == wav.encode(x, 100, bits=32)
    # a writer that fails leaves nothing, and the file that was there stays
    broken = both.withColumn("xs", F.when(F.col("n0") == 3000, F.array(F.array(F.lit(1.0)))).otherwise(F.col("xs")))
    with pytest.raises(Exception, match="2 channels"):
        broken.write.format("chirpline_wav").mode("append").options(rate=100, channels=2).save(str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == ["s.wav"] and len(wav.decode_pcm((tmp_path / "s.wav").read_bytes()[44:], wav.parse_header((tmp_path / "s.wav").read_bytes()))) == 5000


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    register(spark)
    x = np.linspace(-1, 1, 1000).astype("<f4")
    raw = wav.encode(x, 50, bits=32)
    (tmp_path / "in").mkdir()
    grown = tmp_path / "in" / "g.wav"

    def step():
        stream = spark.readStream.format("chirpline_wav").option("chunk", 64).load(f"{tmp_path}/in/*.wav")
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.parquet(f"{tmp_path}/out").where("error is null").collect() if (tmp_path / "out").exists() else []
        return sorted((r["source_id"], n, round(v, 6)) for r in rows for n, v in enumerate(r["x"], r["n0"]))

    want = [round(float(v), 6) for v in x]
    for size, seen in ((20, 0), (44 + 4 * 10 + 3, 10), (44 + 4 * 11, 11), (44 + 4 * 500 + 1, 500), (len(raw), 1000)):
        grown.write_bytes(raw[:size])
        got = step()
        assert [n for _, n, _ in got] == list(range(seen)) and [v for *_, v in got] == want[:seen]
    (tmp_path / "in" / "h.wav").write_bytes(raw)
    assert len(step()) == 2000


def test_listing(tmp_path):
    for name in ("a.wav", "b.wav", "_c.wav", "d.txt"):
        (tmp_path / name).write_bytes(b"1")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "e.wav").write_bytes(b"22")
    names = lambda p: [os.path.relpath(f.uri, tmp_path) for f in listed(str(p))]
    assert names(tmp_path / "*.wav") == ["a.wav", "b.wav"] and names(tmp_path) == ["a.wav", "b.wav", "d.txt"]
    assert names(tmp_path / "*" / "*.wav") == ["sub/e.wav"] and names(tmp_path / "a.wav") == ["a.wav"] and names(tmp_path / "nothing") == []
    assert [f.uri for f in listed(f"file://{tmp_path}/a.*")] == [f"file://{tmp_path}/a.wav"]


def test_small_splits_of_long_files_make_no_more_tasks(tmp_path):
    """Partitions of a scan are bounded; they hold every byte once, and all chunks are read."""
    for name, frames in (("a", 40_000), ("b", 7)):
        (tmp_path / f"{name}.wav").write_bytes(wav.encode(np.arange(frames).reshape(-1, 1) % 100 / 128, 100, bits=16))
    reader = WavReader({"path": str(tmp_path), "chunk": "100", "split": "64"})
    pieces = reader.partitions()
    assert len(pieces) <= PARTITIONS + 2
    for name in ("a", "b"):
        mine = [p for p in pieces if p.uri.endswith(f"{name}.wav")]
        assert mine[0].first == 0 and mine[-1].last == mine[-1].size and all(p.last == q.first for p, q in zip(mine, mine[1:]))
    starts = sorted(n for p in pieces for b in reader.read(p) for n in b.column("n0").to_pylist())
    assert starts == sorted([*range(0, 40_000, 100), 0])
