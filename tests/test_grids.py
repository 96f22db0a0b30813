"""Tiles of frames and bins against whole arrays; lines and components against plain searches."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chirpline.config import Stft
from chirpline.operators.components import components
from chirpline.operators.contours import contour_lines
from chirpline.operators.grid_tiles import banded, blur5, blur9, by_cell, halo, padding, stencilled

CFG = Stft(32, 32, 16)


def picture(spark, frames=23, sources=2, seed=1):
    rng = np.random.default_rng(seed)
    arrays = {str(s): np.cumsum(rng.normal(0, 0.1, (frames, CFG.bins)), axis=0) for s in range(sources)}
    rows = [(s, 0, f, [float(v) for v in x[f]]) for s, x in arrays.items() for f in range(frames)]
    return arrays, spark.createDataFrame(rows, "source_id string, channel int, frame_idx long, mag array<double>")


def taps(x, w):
    around = np.pad(x, 1, "edge")
    return sum(w[i][j] * around[i : i + x.shape[0], j : j + x.shape[1]] for i in range(3) for j in range(3))


@pytest.mark.parametrize(("bins_per", "frames_per"), [(3, 4), (16, 5), (1, 1), (5, 100), (64, 2)])
def test_stencils_do_not_depend_on_tiles(spark, bins_per, frames_per):
    arrays, frames = picture(spark)
    nine, five = [[0.07, 0.12, 0.07], [0.12, 0.24, 0.12], [0.07, 0.12, 0.07]], [[0, 0.125, 0], [0.125, 0.5, 0.125], [0, 0.125, 0]]
    got = by_cell(stencilled(frames, [blur9(), blur5(), blur9()], CFG, bins_per, frames_per)).collect()
    assert len(got) == 2 * 23 * CFG.bins
    want = {s: taps(taps(taps(x, nine), five), nine) for s, x in arrays.items()}
    assert all(abs(r["mag"] - want[r["source_id"]][r["frame_idx"], r["bin"]]) < 1e-12 for r in got)
    assert by_cell(stencilled(frames, [], CFG, bins_per, frames_per)).agg(F.sum("mag")).first()[0] == pytest.approx(sum(x.sum() for x in arrays.values()))


def test_no_row_exceeds_a_tile_with_its_halo(spark):
    _, frames = picture(spark)
    assert padding([blur9(), blur5()]) == (1, 1) and halo([blur9(), blur5()]) == (2, 2) and padding([]) == (0, 0)
    tiles = banded(frames, CFG, 3, (2, 2), 4)
    sizes = tiles.select(F.size("cells").alias("rows"), F.size(F.col("cells")[0]).alias("columns")).agg(F.max("rows"), F.max("columns"), F.count("*")).first()
    assert tuple(sizes) == (8, 7, 2 * 6 * 6)
    plan = tiles._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def plain_lines(x, interval, least, steepest):
    level, scaled = np.floor(x / interval + 0.5), x / interval
    edges = set()
    for f in range(x.shape[0]):
        for b in range(x.shape[1]):
            near = [(min(f + 1, x.shape[0] - 1), b), (f, min(b + 1, x.shape[1] - 1))]
            if any(level[n] != level[f, b] for n in near) and x[f, b] >= least and sum(abs(scaled[n] - scaled[f, b]) for n in near) <= steepest:
                edges.add((f, b))
    line = {}
    for start in sorted(edges):
        if start not in line:
            todo, first = [start], start[0] * x.shape[1] + start[1]
            while todo:
                f, b = todo.pop()
                if (f, b) in edges and (f, b) not in line:
                    line[f, b] = first
                    todo += [(f + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return {(f, b, int(level[f, b]), n) for (f, b), n in line.items()}


@pytest.mark.parametrize(("bins_per", "frames_per", "steepest"), [(3, 4, 6.0), (16, 23, np.inf), (5, 2, 3.0)])
def test_lines_are_linked_over_tiles(spark, bins_per, frames_per, steepest):
    arrays, frames = picture(spark, 40)
    got = {s: set() for s in arrays}
    for r in contour_lines(frames, CFG, 0.12, -0.4, steepest, bins_per, frames_per).collect():
        got[r["source_id"]].add((r["frame_idx"], r["bin"], r["level"], r["line"]))
    for s, x in arrays.items():
        want = plain_lines(x, 0.12, -0.4, steepest)
        assert got[s] == want and len({n for *_, n in want}) > 1


def test_no_lines_on_flat_ground(spark):
    frames = spark.createDataFrame([("a", 0, f, [0.5] * CFG.bins) for f in range(9)], "source_id string, channel int, frame_idx long, mag array<double>")
    assert contour_lines(frames, CFG, 0.1, bins_per=4, frames_per=2).count() == 0


@pytest.mark.parametrize("kind", ["path", "star", "random", "none"])
def test_components(spark, kind):
    rng = random.Random(6)
    names = list(range(300))
    rng.shuffle(names)
    links = {"path": list(zip(names, names[1:])), "star": [(names[0], n) for n in names[1:]], "random": [(rng.choice(names), rng.choice(names)) for _ in range(170)], "none": []}[kind]
    parent = {n: n for n in names}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    want = {(n, find(n)) for n in {n for link in links for n in link if link[0] != link[1]}}
    got = [tuple(r) for r in components(spark.createDataFrame(links + links[:5], "a long, b long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want
