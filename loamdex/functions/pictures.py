"""Numbers of pictures on the way into a model and out of it: strips of lines, resizing, places of lines, pieces of text."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Height of a strip, widths of batches, and the share of height in width from which a strip is turned.
HEIGHT, WIDTHS, TURNED = 48, (320, 640, 960), 1.5


def strip(corners: Column) -> Column:
    """struct(across, down, turned, need, width) of a line's place, eight numbers clockwise from its top left: its sides, whether it is read turned, and
    the width that it needs, and gets, at HEIGHT."""
    c = lambda i: F.get(corners, F.lit(i))
    side = lambda a, b, d, e: F.greatest(F.hypot(c(b) - c(a), c(b + 1) - c(a + 1)), F.hypot(c(e) - c(d), c(e + 1) - c(d + 1))).cast("int")
    sides = F.struct(side(0, 2, 6, 4).alias("across"), side(0, 6, 2, 4).alias("down"))

    def shaped(s: Column) -> Column:
        turned = (s["across"] > 0) & (s["down"] >= TURNED * s["across"])
        shape = F.when((s["across"] > 0) & (s["down"] > 0), F.when(turned, s["down"] / s["across"]).otherwise(s["across"] / s["down"])).otherwise(0.0)
        need = F.ceil(HEIGHT * shape).cast("int")
        width = F.coalesce(*[F.when(need <= w, F.lit(w)) for w in WIDTHS], F.greatest(F.floor(HEIGHT * shape).cast("int"), F.lit(1)))
        return F.struct(s["across"].alias("across"), s["down"].alias("down"), turned.alias("turned"), need.alias("need"), width.alias("width"))

    return F.transform(F.array(sides), shaped)[0]


def taps(size: int, to: int) -> list[tuple[int, list[float]]]:
    """For each new place the first old one that it is made of and their weights: bicubic (a = -1/2), widened where a picture shrinks."""

    def cubic(x: float) -> float:
        x = abs(x)
        return 1.5 * x**3 - 2.5 * x**2 + 1 if x < 1 else -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2 if x < 2 else 0.0

    out, scale = [], size / to
    wide = max(scale, 1.0)
    for place in range(to):
        centre = (place + 0.5) * scale
        first, last = max(0, int(centre - 2 * wide + 0.5)), min(size, int(centre + 2 * wide + 0.5))
        weights = [cubic((k - centre + 0.5) / wide) for k in range(first, last)]
        out.append((first, [w / sum(weights) for w in weights]))
    return out


def resized(pixels: Column, width: int, height: int, size: int) -> Column:
    """A picture of one channel (rows of 0 to 255) squashed to ``size`` x ``size``, along rows and then down, each rounded to 8 bits, scaled to -1 to 1."""
    literal = lambda ts: F.array(*[F.struct(F.lit(a).alias("at"), F.array(*[F.lit(w) for w in ws]).alias("w")) for a, ws in ts])
    clipped = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x + 0.5).cast("int")))
    weigh = lambda values, t: clipped(F.aggregate(F.zip_with(F.slice(values, t["at"] + 1, F.size(t["w"])), t["w"], lambda v, w: v * w), F.lit(0.0), lambda a, x: a + x))
    along = F.transform(pixels, lambda row: F.transform(literal(taps(width, size)), lambda t: weigh(row, t)))

    def down(rows: Column) -> Column:
        column = lambda x: F.transform(rows, lambda row: F.get(row, x))
        columns = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), column)
        return F.transform(literal(taps(height, size)), lambda t: F.transform(columns, lambda c: weigh(c, t) / 127.5 - 1))

    return F.transform(F.array(along), down)[0]


def _labels(on: np.ndarray) -> list[np.ndarray]:
    """Shapes of touching places (corners touch, too) as arrays of (y, x), by runs of rows joined to those of the row before."""
    root: list[int] = []
    runs: list[tuple[int, int, int]] = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    before: list[int] = []
    for y, row in enumerate(on):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
        now = []
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            own = len(runs)
            runs.append((y, a, b))
            root.append(own)
            now.append(own)
            for k in before:
                if runs[k][1] <= b and a <= runs[k][2]:
                    x, z = find(k), find(own)
                    root[max(x, z)] = min(x, z)
        before = now
    shapes: dict[int, list[np.ndarray]] = {}
    for k, (y, a, b) in enumerate(runs):
        shapes.setdefault(find(k), []).append(np.column_stack([np.full(b - a, y), np.arange(a, b)]))
    return [np.concatenate(parts) for parts in shapes.values()]


def smallest_box(points: np.ndarray) -> np.ndarray:
    """The four corners of the smallest rectangle, at any angle, around points (x, y): one side lies on a side of their hull."""
    points = np.unique(points.astype(float), axis=0)

    def chain(order: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in order:
            while len(out) > 1 and (out[-1] - out[-2])[0] * (p - out[-2])[1] - (out[-1] - out[-2])[1] * (p - out[-2])[0] <= 0:
                out.pop()
            out.append(p)
        return out

    hull = np.array(chain(points)[:-1] + chain(points[::-1])[:-1] or points)
    best = None
    for a, b in zip(hull, np.roll(hull, -1, axis=0), strict=True):
        length = math.hypot(*(b - a))
        u = (b - a) / length if length else np.array([1.0, 0.0])
        v = np.array([-u[1], u[0]])
        s, t = hull @ u, hull @ v
        area = (s.max() - s.min()) * (t.max() - t.min())
        if best is None or area < best[0] - 1e-9:
            best = area, np.array([i * u + j * v for i, j in ((s.min(), t.min()), (s.max(), t.min()), (s.max(), t.max()), (s.min(), t.max()))])
    return best[1]


def line_places(maps: DataFrame, id_col: str, map_col: str, thresh: float = 0.3, least: float = 0.6, side: float = 3.0) -> DataFrame:
    """(id, place, corners, score) of the lines in maps of chances (rows of numbers): shapes above ``thresh`` in their smallest rectangles; those of a
    mean chance under ``least`` or a side under ``side`` are left out.  Places count from the top, and from the left."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, rows in zip(b[id_col], b[map_col], strict=True):
                chance, found = np.array([list(r) for r in rows], float), []
                for shape in _labels(chance > thresh) if chance.size else []:
                    box = smallest_box(np.concatenate([shape[:, ::-1] + corner for corner in ([0, 0], [0, 1], [1, 0], [1, 1])]))
                    score = float(chance[shape[:, 0], shape[:, 1]].mean())
                    if score >= least and min(math.hypot(*(box[1] - box[0])), math.hypot(*(box[2] - box[1]))) >= side - 1e-9:
                        found.append((float(box[:, 1].min()), float(box[:, 0].min()), box.ravel().round(6).tolist(), round(score, 6)))
                out += [(key, i, corners, score) for i, (_, _, corners, score) in enumerate(sorted(found))]
            yield pd.DataFrame(out, columns=[id_col, "place", "corners", "score"])

    kind = maps.schema[id_col].dataType.simpleString()
    return maps.select(id_col, map_col).mapInPandas(run, f"{id_col} {kind}, place int, corners array<double>, score double")


def piece_ids(path: str) -> Callable[[Column], Column]:
    """A column function: ids of a text's pieces by pair merging with byte fallback, of a SentencePiece model file that all executors have."""
    models: dict = {}

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: pd.Series) -> pd.Series:
        from sentencepiece import SentencePieceProcessor

        if path not in models:
            models[path] = SentencePieceProcessor(model_file=path)
        return pd.Series([None if t is None else models[path].encode(t) for t in texts])

    return ids
