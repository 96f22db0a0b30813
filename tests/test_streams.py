import numpy as np

from chirpline.config import Stft
from chirpline.operators.stft import spectra
from chirpline.sources import wav
from chirpline.streaming.incremental import stream_stft
from chirpline.streaming.wav_bytes import stream_samples


def run(spark, tmp_path, batches, schema, make, name):
    """Feed one file for each batch to a stream and return its rows."""
    src = f"{tmp_path}/{name}"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    make(stream).writeStream.format("parquet").option("path", f"{src}-out").option("checkpointLocation", f"{src}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{src}-out").collect()


def test_bytes_in_any_order(spark, tmp_path):
    x = np.round(np.random.default_rng(1).uniform(-1, 1, (500, 2)) * 32767) / 32768
    raw = wav.encode(np.where(x < 0, x, x * 32768 / 32767), 100) + b"LISTjunk"
    cuts = [0, 7, 50, 51, 700, 701, 1500, len(raw)]
    pieces = [("f", a, raw[a:b]) for a, b in zip(cuts, cuts[1:])]
    order = [[pieces[1], pieces[6]], [pieces[0]], [pieces[2], pieces[0]], [pieces[4]], [pieces[3]], [pieces[5]]]
    got = run(spark, tmp_path, order, "source_id string, at long, bytes binary", stream_samples, "bytes")
    for c in (0, 1):
        mine = sorted((r["n0"], r["x"]) for r in got if r["channel"] == c)
        assert [n for n, _ in mine] == [sum(len(v) for _, v in mine[:k]) for k in range(len(mine))]
        assert np.allclose(np.concatenate([v for _, v in mine]), x[:, c], atol=1e-6)


def test_frames_of_late_and_repeated_chunks(spark, tmp_path):
    x = np.random.default_rng(2).standard_normal(100)
    cfg = Stft(16, 16, 24)  # hops beyond the window skip samples
    chunk = lambda a, b: ("s", 0, a, x[a:b].tolist())
    order = [[chunk(30, 60)], [chunk(0, 30), chunk(0, 10)], [chunk(95, 100)], [chunk(20, 70)], [chunk(60, 95)]]
    got = run(spark, tmp_path, order, "source_id string, channel int, n0 long, x array<double>", lambda s: stream_stft(s, cfg), "chunks")
    want = spectra(x, cfg, cfg.weights())
    assert sorted(r["frame_idx"] for r in got) == list(range(len(want)))
    assert all(np.allclose(r["mag"], want[r["frame_idx"]]) for r in got)


def test_a_lost_chunk_stops_nothing(spark, tmp_path):
    x = np.random.default_rng(2).standard_normal(400)
    cfg = Stft(16, 16, 8)
    chunk = lambda a, b: ("s", 0, a, x[a:b].tolist())
    order = [[chunk(0, 50)], [chunk(90, 130)], [chunk(130, 200)], [chunk(200, 300)], [chunk(50, 90)], [chunk(320, 400)], [chunk(300, 320)]]
    got = run(spark, tmp_path, order, "source_id string, channel int, n0 long, x array<double>", lambda s: stream_stft(s, cfg, 150), "lost")
    want = spectra(x, cfg, cfg.weights())
    # samples 50 to 89 came when more than 150 later ones had waited
    kept = [k for k in range(len(want)) if k * 8 + 16 <= 50 or k * 8 >= 90]
    assert sorted(r["frame_idx"] for r in got) == kept
    assert all(np.allclose(r["mag"], want[r["frame_idx"]]) for r in got)


def test_lost_bytes_stop_nothing(spark, tmp_path):
    x = np.round(np.random.default_rng(1).uniform(-1, 1, (500, 2)) * 32767) / 32768
    raw = wav.encode(np.where(x < 0, x, x * 32768 / 32767), 100)
    piece = lambda a, b: ("f", a, raw[a:b])
    order = [[piece(0, 333)], [piece(502, 900)], [piece(900, 1400)], [piece(333, 502)], [piece(1400, len(raw))]]
    got = run(spark, tmp_path, order, "source_id string, at long, bytes binary", lambda s: stream_samples(s, 600), "lost-bytes")
    have = {r["n0"] + k: v for r in got if r["channel"] == 1 for k, v in enumerate(r["x"])}
    assert sorted(have) == [n for n in range(500) if 44 + 4 * n + 4 <= 333 or 44 + 4 * n >= 502]
    assert all(abs(v - x[n, 1]) < 1e-6 for n, v in have.items())


def test_frames_are_found_behind_lost_bytes(spark, tmp_path):
    from chirpline.sources import mp3
    from chirpline.streaming.mp3_frames import stream_frames
    from tests.test_mp3_seek import made

    raw = made(7, 60)
    frames = mp3.frames_of(raw)
    piece = lambda a, b: ("f", a, raw[a:b])
    order = [[piece(0, 5000)], [piece(9000, 14000)], [piece(14000, 19000)], [piece(5000, 9000)], [piece(19000, len(raw))]]
    got = run(spark, tmp_path, order, "source_id string, at long, bytes binary", lambda s: stream_frames(s, 8000), "lost-frames")
    want = [(at, n) for at, n in frames if at + n <= 5000 or at >= 9000]
    found = [(r["at"], r["length"]) for r in sorted(got, key=lambda r: r["frame_idx"])]
    assert found == want and [r["frame_idx"] for r in sorted(got, key=lambda r: r["frame_idx"])] == list(range(len(want)))


def test_pieces_in_order():
    from chirpline.streaming.waiting import in_order

    waiting = {5: "fgh", 0: "abc", 2: "cdef"}
    assert list(in_order(waiting, 0, 10)) == [(0, "abc"), (3, "def"), (6, "gh")] and not waiting
    held, told = {9: "xy", 20: "z"}, []
    assert list(in_order(held, 3, 3, told.append)) == [] and told == [] and len(held) == 2
    assert list(in_order(held, 3, 2, told.append)) == [(9, "xy")] and told == [9] and list(held) == [20]
