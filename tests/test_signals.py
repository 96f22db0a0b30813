"""Kernels, framing, sources and settings."""

import math
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chirpline.config import Navigation, Stft, ValueScale, Viewport
from chirpline.functions import axis, colormap
from chirpline.operators.stft import by_bin, spectra, stft, stft_arrays, stft_catalyst
from chirpline.operators.transforms import applied, smooth_time
from chirpline.sources import mp3, signals, wav


def test_settings_are_checked():
    for bad in ({"fft_size": 1000}, {"window_size": 2048}, {"hop": 0}, {"window": "kaiser"}, {"tile_cells": 0}):
        with pytest.raises(ValueError):
            Stft(**bad)
    assert Stft().frames_per_tile == 256 and Stft().frames(1023) == 0 and Stft().frames(16000) == 59
    with pytest.raises(ValueError):
        ValueScale("volume")
    assert ValueScale("magnitude", -20, 0).bounds() == (0.1, 1.0)


def test_windows_and_known_spectra():
    assert np.allclose(Stft(4, 4, 1, "hamming").weights()[[0, -1]], 0.08)
    assert np.allclose(Stft(4, 4, 1, "blackman").weights()[[0, -1]], 0, atol=1e-12)
    assert Stft(1, 2, 1).weights().tolist() == [1.0]
    one = Stft(4, 4, 2, "rectangular")
    assert np.allclose(spectra(np.array([1.0, 0, 0, 0]), one, one.weights()), [[0.25, 0.25]])
    flat = spectra(np.ones(8), one, one.weights())
    assert flat.shape == (3, 2) and np.allclose(flat[:, 0], 1.0)


@pytest.mark.parametrize("window,win,hop,frames", [("hann", 512, 256, 61), ("hamming", 512, 128, 122), ("blackman", 256, 128, 124), ("rectangular", 512, 256, 61)])
def test_tone_lands_in_its_bin(window, win, hop, frames):
    cfg = Stft(win, 512, hop, window)
    mags = spectra(np.sin(2 * np.pi * 440 * np.arange(16000) / 16000), cfg, cfg.weights())
    assert mags.shape == (frames, 256)
    assert (np.abs(mags.argmax(axis=1) - 440 * 512 / 16000) <= 1).all()


@pytest.mark.parametrize("cfg,size", [(Stft(64, 64, 16, tile_cells=32 * 5), 100), (Stft(32, 64, 48, "hamming", tile_cells=32 * 4), 37)])
def test_tiles_equal_whole_signals(spark, cfg, size):
    rng = np.random.default_rng(1)
    x = rng.standard_normal(1003)
    rows = [("a", 0, n0, x[n0 : n0 + size].tolist()) for n0 in range(0, len(x), size)] + [("short", 0, 0, [1.0] * 5)]
    chunks = spark.createDataFrame(rows, "source_id string, channel int, n0 long, x array<double>")
    got = {r["frame_idx"]: r["mag"] for r in stft(chunks, cfg).collect()}
    want = spectra(x, cfg, cfg.weights())
    assert sorted(got) == list(range(len(want)))
    assert np.allclose([got[k] for k in range(len(want))], want)
    part = stft(chunks, cfg, tiles=(1, 2)).collect()
    assert {r["tile_idx"] for r in part} == {1, 2} and all(np.allclose(r["mag"], want[r["frame_idx"]]) for r in part)


def test_engines_agree(spark):
    x = np.random.default_rng(2).standard_normal(40).tolist()
    cfg = Stft(16, 32, 8, "blackman")
    chunks = spark.createDataFrame([("a", 0, 0, x)], "source_id string, channel int, n0 long, x array<double>")
    a = {(r["frame_idx"], r["bin"]): r["mag"] for r in by_bin(stft_arrays(chunks, cfg)).collect()}
    b = {(r["frame_idx"], r["bin"]): r["mag"] for r in stft_catalyst(signals.exploded(chunks), cfg).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_transforms_ignore_tile_edges(spark):
    x = np.random.default_rng(3).standard_normal(200).tolist()
    chunks = spark.createDataFrame([("a", 0, 0, x)], "source_id string, channel int, n0 long, x array<double>")
    out = []
    for cells in (8 * 3, 8 * 1000):
        cfg = Stft(16, 16, 4, tile_cells=cells)
        out.append({r["frame_idx"]: r["mag"] for r in applied(stft_arrays(chunks, cfg), [smooth_time(), smooth_time()], cfg).collect()})
    assert out[0].keys() == out[1].keys() and all(np.allclose(out[0][k], out[1][k]) for k in out[0])


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3), st.sampled_from([(1, 8), (1, 16), (1, 24), (1, 32), (3, 32)]), st.integers(0, 50), st.booleans())
def test_wav_decodes_every_depth(channels, kind, n, odd_chunk):
    code, bits = kind
    rng = np.random.default_rng(n)
    x = rng.uniform(-1, 0.99, (n, channels))
    if code == 3:
        raw = x.astype("<f4").tobytes()
    elif bits == 8:
        raw = (np.floor(x * 128) + 128).astype(np.uint8).tobytes()
    else:
        ints = np.floor(x * (1 << (bits - 1))).astype("<i8")
        raw = b"".join(int(v).to_bytes(8, "little", signed=True)[: bits // 8] for v in ints.ravel())
    align = channels * bits // 8
    extra = struct.pack("<4sI", b"LIST", 3) + b"abc\0" if odd_chunk else b""
    head = b"RIFF\0\0\0\0WAVE" + extra + struct.pack("<4sIHHIIHH", b"fmt ", 16, code, channels, 8000, 8000 * align, align, bits) + struct.pack("<4sI", b"data", len(raw) + 10)
    info = wav.parse_header(head + raw)
    assert (info.frames, info.rate, info.channels) == (n, 8000, channels)
    y = wav.decode_pcm(raw, info)
    assert y.shape == (n, channels) and (np.abs(y - x) < (1e-6 if code == 3 else 1e-7 + 1.001 / (1 << (bits - 1)))).all()


def test_wav_bytes_and_errors():
    raw = wav.encode(np.array([[0.5, -1.0], [2.0, -2.0]]), 100)
    assert wav.decode_pcm(raw[44:], wav.parse_header(raw)).tolist() == [[16384 / 32768, -1.0], [32767 / 32768, -1.0]]
    assert np.frombuffer(wav.encode([0.99999], 8, quantizer="trunc")[44:], "<i2")[0] == 32766
    info = wav.parse_header(wav.encode(np.zeros(100), 10))
    assert wav.byte_range(info, 1.0, 2.05) == (44 + 20, 44 + 42)
    for bad in (b"", b"RIFF0000WAVE", b"junk" * 20):
        with pytest.raises(ValueError):
            wav.parse_header(bad)


def test_wav_source_splits_files(spark, tmp_path):
    from chirpline.sources.dispatch import read_audio
    from chirpline.sources.wav_source import register

    x = np.random.default_rng(4).uniform(-1, 1, (1000, 2))
    (tmp_path / "a.wav").write_bytes(wav.encode(x, 100, bits=32))
    (tmp_path / "b.txt").write_bytes(b"no audio")
    register(spark)
    df = spark.read.format("chirpline_wav").option("split", 2400).option("chunk", 128).load(f"{tmp_path}/*.wav")
    assert df.rdd.getNumPartitions() == 4
    got = sorted((r["channel"], r["n0"], r["x"]) for r in df.collect())
    assert np.allclose(np.concatenate([v for c, _, v in got if c == 1]), x[:, 1], atol=1e-7)
    part = spark.read.format("chirpline_wav").option("start", 2.0).option("end", 3.0).load(f"{tmp_path}/*.wav").where("channel = 0").collect()
    assert sum(len(r["x"]) for r in part) == 100 and part[0]["n0"] == 200
    whole = read_audio(spark, f"{tmp_path}/*")
    assert whole.selectExpr("sum(size(x))").first()[0] == 2000
    files = spark.read.format("binaryFile").load(f"{tmp_path}/*")
    assert [(r["rate"], r["n_samples"]) for r in wav.headers(files).collect()] == [(100, 1000)]


def frame(kbps_index=9, extra=b""):
    h = 0x7FF << 21 | 3 << 19 | 1 << 17 | 1 << 16 | kbps_index << 12
    body = struct.pack(">I", h) + extra
    size = 144 * 128000 // 44100
    return body + b"\0" * (size - len(body))


def test_mp3_headers():
    h = mp3.frame_header(frame())
    assert (h.version, h.layer, h.rate, h.kbps, h.samples, h.length) == (1.0, 3, 44100, 128, 1152, 417)
    tag = b"ID3\4\0\0" + bytes([0, 0, 1, 2]) + b"x" * 130
    assert mp3.tag_size(tag) == 140 and mp3.is_mp3(tag) and mp3.is_mp3(frame() * 2) and not mp3.is_mp3(b"\xff\xfb" + b"\0" * 60)
    raw = tag + frame() * 3
    assert mp3.info(raw)[3] == pytest.approx(3 * 417 * 8 / 128000)
    xing = frame(extra=b"\0" * 32 + b"Xing" + struct.pack(">II", 1, 1000)) + frame()
    assert mp3.info(xing)[3] == pytest.approx(1000 * 1152 / 44100)
    assert [n for _, n in mp3.frames_of(b"junk" + raw[140:])] == [417] * 3
    assert mp3.info(b"nothing here") is None


def test_colours():
    assert colormap.parse_colour("#abc") == (170, 187, 204, 255) and colormap.parse_colour("rgba(1, 2, 3, 0.5)") == (1, 2, 3, 128)
    assert colormap.parse_colour("rgba(1,2,3,128)") == (1, 2, 3, 128) and colormap.parse_colour("RGBA( 1 , 2.5 , 300 , 1 )") == (1, 3, 255, 255)
    for bad in ("rgb(1, 2)", "rgba(1, 2, 3, 4, 5)", "rgb(a, 2, 3)", "rgb()"):
        with pytest.raises(ValueError):
            colormap.parse_colour(bad)
    assert len(set(colormap.colour_map("tab20"))) == 20 and colormap.colour_map("TAB20")[255] == (158, 218, 229, 255)
    assert colormap.parse_colour("transparent") == (0, 0, 0, 0)
    with pytest.raises(ValueError):
        colormap.parse_colour("blueish")
    assert colormap.colour_map("GRAY")[100] == (100, 100, 100, 255)
    assert colormap.colour_map("magma_r") == colormap.colour_map("magma")[::-1]
    assert colormap.colour_map("unknown") == colormap.colour_map("viridis")
    assert colormap.colour_map(points=[(0, "#000"), (1, "#fff")])[7][:3] == (7, 7, 7)
    assert colormap.colour_map("gray", brightness=2.0)[0][:3] == (255, 255, 255)


def test_axes_and_viewports():
    v = Viewport(10, 20)
    assert v.followed(15, 100) == v and v.followed(25, 100).start == 25 and v.followed(99, 100).start == 90
    assert v.followed(50, 100, "smooth", 0.25).start == 47.5
    assert v.clamped(0, 5) == Viewport(0, 5) and v.clamped(12, 100).start == 12


def test_bars_and_peaks_by_hand(spark):
    from chirpline.operators import peaks

    rows = [("a", 0, n, math.sin(n)) for n in range(57)]
    samples = spark.createDataFrame(rows, "source_id string, channel int, n long, x double")
    got = {r["k"]: (r["low"], r["high"]) for r in peaks.decimated(samples, 10).collect()}
    for k in range(10):
        block = [math.sin(n) for n in range(math.floor(k * 5.7), math.floor((k + 1) * 5.7))]
        assert got[k] == (min(block), max(block))
    a = {r["k"]: r["low"] for r in peaks.envelope(samples, 0, 30, 10, 1.0).collect()}
    b = {r["k"]: r["low"] for r in peaks.envelope(samples, 6, 36, 10, 1.0).collect()}
    assert all(a[k] == b[k] for k in a.keys() & b.keys()) and a.keys() & b.keys()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["pan", "pan_to", "zoom", "zoom_hz", "zoom_both"]), st.floats(-50, 50)), max_size=12), st.floats(0.2, 500))
def test_navigation_stays_inside(moves, seconds):
    n = Navigation.opened(seconds, 16000)
    assert n.view.end == min(10, seconds) and n.view.high_hz == 8000
    for name, by in moves:
        n = getattr(n, name)(by)
        v = n.view
        assert -1e-9 <= v.start < v.end <= seconds + 1e-6 and -1e-9 <= v.low_hz < v.high_hz <= 8000 + 1e-6
        assert v.seconds <= 40 + 1e-6 and v.high_hz - v.low_hz >= 10 - 1e-6


def test_navigation_keeps_what_is_under_the_pointer():
    n = Navigation.opened(100, 16000).pan_to(30).zoom(0.5, 34)
    assert (n.view.start, n.view.end) == (32, 37)
    assert n.zoom(1.0) == n and n.zoom(-1) == n and n.pan(1000).view.end == 100
