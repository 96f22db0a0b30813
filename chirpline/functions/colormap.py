"""Colour maps of 256 entries, as small tables."""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Anchors (place, red, green, blue) of the maps (fixed values).
ANCHORS = {
    "viridis": [(0, 68, 1, 84), (0.33, 49, 104, 142), (0.66, 53, 183, 121), (1, 253, 231, 37)],
    "magma": [(0, 0, 0, 4), (0.33, 87, 15, 109), (0.66, 187, 55, 84), (1, 252, 253, 191)],
    "inferno": [(0, 0, 0, 4), (0.33, 120, 28, 109), (0.66, 237, 105, 37), (1, 252, 255, 164)],
    "plasma": [(0, 13, 8, 135), (0.33, 126, 3, 168), (0.66, 240, 89, 97), (1, 240, 249, 33)],
    "cividis": [(0, 0, 32, 77), (0.25, 65, 83, 102), (0.5, 124, 123, 120), (0.75, 197, 180, 99), (1, 255, 234, 70)],
    "turbo": [(0, 48, 18, 59), (0.25, 50, 101, 214), (0.5, 37, 213, 118), (0.75, 249, 210, 60), (1, 122, 4, 3)],
    "gray": [(0, 0, 0, 0), (1, 255, 255, 255)],
    "binary": [(0, 255, 255, 255), (1, 0, 0, 0)],
    "bone": [(0, 0, 0, 0), (0.375, 84, 84, 116), (0.75, 166, 198, 198), (1, 255, 255, 255)],
    "blues": [(0, 247, 251, 255), (0.25, 198, 219, 239), (0.5, 107, 174, 214), (0.75, 33, 113, 181), (1, 8, 48, 107)],
    "reds": [(0, 255, 245, 240), (0.25, 252, 187, 161), (0.5, 251, 106, 74), (0.75, 203, 24, 29), (1, 103, 0, 13)],
    "jet": [(0, 0, 0, 143), (0.15, 0, 0, 255), (0.4, 0, 255, 255), (0.65, 255, 255, 0), (0.85, 255, 0, 0), (1, 128, 0, 0)],
}
#: Colours of the map in steps (fixed values).
TAB20 = [
    (31, 119, 180), (174, 199, 232), (255, 127, 14), (255, 187, 120), (44, 160, 44), (152, 223, 138), (214, 39, 40),
    (255, 152, 150), (148, 103, 189), (197, 176, 213), (140, 86, 75), (196, 156, 148), (227, 119, 194), (247, 182, 210),
    (127, 127, 127), (199, 199, 199), (188, 189, 34), (219, 219, 141), (23, 190, 207), (158, 218, 229),
]
_HEX = re.compile(r"#([0-9a-f]{3,4}|[0-9a-f]{6}|[0-9a-f]{8})", re.I)
_CALL = re.compile(r"rgba?\((.*)\)", re.I)


def js_round(x: float) -> int:
    return math.floor(x + 0.5)


def parse_colour(text: str) -> tuple[int, int, int, int]:
    """#rgb, #rgba, #rrggbb, #rrggbbaa, rgb(), rgba() or 'transparent'; channels stop at 255.

    An alpha of at most 1 is a share, a greater one a level.
    """
    text = text.strip()
    if text.lower() == "transparent":
        return 0, 0, 0, 0
    if m := _HEX.fullmatch(text):
        h = m[1] if len(m[1]) > 4 else "".join(c + c for c in m[1])
        parts = [int(h[i : i + 2], 16) for i in range(0, len(h), 2)]
        return tuple([*parts, 255][:4])
    if m := _CALL.fullmatch(text):
        try:
            parts = [float(v) for v in m[1].split(",")]
        except ValueError:
            parts = []
        if len(parts) in (3, 4):
            alpha = parts[3] if len(parts) == 4 else 255.0
            parts[3:] = [alpha * 255 if alpha <= 1 else alpha]
            return tuple(min(255, max(0, js_round(v))) for v in parts)
    raise ValueError(f"no colour: {text}")


def stops_of(name: str) -> list[tuple[float, int, int, int]]:
    """Anchors by name in either case; '_r' or '_inverted' turns a map round; viridis for
    names that aren't known."""
    name = name.lower()
    if name in ANCHORS:
        return ANCHORS[name]
    root = name.removesuffix("_r").removesuffix("_inverted")
    if root in ANCHORS:
        return sorted((1 - at, r, g, b) for at, r, g, b in ANCHORS[root])
    return ANCHORS["viridis"]


def colour_map(name: str = "viridis", points: list[tuple[float, str]] | None = None, gamma: float = 1.0, contrast: float = 1.0, brightness: float = 0.0) -> list[tuple[int, int, int, int]]:
    """256 colours between anchors or given points, or in the steps of tab20, then gamma,
    contrast and brightness."""
    if not points and name.lower() == "tab20":
        level = np.array(TAB20, float)[np.arange(256) * len(TAB20) // 256].T
    else:
        stops = np.array(sorted((at, *parse_colour(c)[:3]) for at, c in points) if points else stops_of(name), float)
        places = np.arange(256) / 255
        level = np.stack([np.interp(places, stops[:, 0], channel) for channel in stops[:, 1:].T])
    level = np.clip(np.floor(level + 0.5) / 255, 0, 1) ** gamma
    level = np.clip((level - 0.5) * contrast + 0.5 + brightness, 0, 1)
    whole = np.floor(level * 255 + 0.5).astype(int)
    return [(*map(int, rgb), 255) for rgb in whole.T]


def colour_table(spark: SparkSession, *args, **kwargs) -> DataFrame:
    """(idx, r, g, b, a): 256 rows, small enough to be broadcast at any scale."""
    return spark.createDataFrame([(i, *c) for i, c in enumerate(colour_map(*args, **kwargs))], "idx int, r int, g int, b int, a int")


def colour_tables(spark: SparkSession, names: list[str], **kwargs) -> DataFrame:
    """(map, idx, r, g, b, a) of several maps: 256 rows each, to be joined by name and index."""
    rows = [(name, i, *c) for name in names for i, c in enumerate(colour_map(name, **kwargs))]
    return spark.createDataFrame(rows, "map string, idx int, r int, g int, b int, a int")


def css_colour(name: str, index: float = 220) -> str:
    r, g, b, _ = colour_map(name)[max(0, min(255, js_round(index)))]
    return f"rgb({r}, {g}, {b})"
