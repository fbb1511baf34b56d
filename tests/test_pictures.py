"""Numbers of pictures: resizing, places of lines and pieces of text against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamdex.functions import pictures as pc


def plain_resize(grid, size):
    def along(rows, n):
        out = []
        for row in rows:
            new, scale = [], len(row) / n
            for x in range(n):
                wide, centre, total, weight = max(scale, 1), (x + 0.5) * scale, 0.0, 0.0
                for k, v in enumerate(row):
                    if max(0, int(centre - 2 * wide + 0.5)) <= k < min(len(row), int(centre + 2 * wide + 0.5)):
                        d = abs((k - centre + 0.5) / wide)
                        w = (1.5 * d - 2.5) * d * d + 1 if d < 1 else ((-0.5 * d + 2.5) * d - 4) * d + 2 if d < 2 else 0
                        total, weight = total + w * v, weight + w
                new.append(min(255, max(0, math.floor(total / weight + 0.5))))
            out.append(new)
        return out

    once = along(grid, size)
    return np.array(along(list(map(list, zip(*once))), size)).T / 127.5 - 1


@pytest.mark.parametrize(("w", "h", "size"), [(8, 8, 4), (6, 9, 3), (3, 4, 7), (5, 5, 5)])
def test_resized(spark, w, h, size):
    rng = np.random.default_rng(w * h)
    grids = [rng.integers(0, 256, (h, w)).tolist() for _ in range(5)]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(grids)], "id int, g array<array<int>>")
    for r in df.select("id", pc.resized(F.col("g"), w, h, size).alias("x")).collect():
        assert np.abs(np.array(r.x) - plain_resize(grids[r.id], size)).max() < 1e-9


def test_places_of_lines(spark):
    grid = np.zeros((30, 60))
    grid[3:8, 5:40] = 0.9
    grid[12:15, 2:12] = 0.8
    grid[12:14, 30:50] = 0.35  # too unlikely
    grid[20, 3] = 1.0  # too small
    for k in range(12):  # a slanted line
        grid[16 + k, 20 + 2 * k : 26 + 2 * k] = 0.9
    df = spark.createDataFrame([(1, grid.tolist()), (2, [])], "id long, m array<array<double>>")
    got = pc.line_places(df, "id", "m").orderBy("place").collect()
    assert [r.id for r in got] == [1, 1, 1] and [round(r.score, 3) for r in got] == [0.9, 0.8, 0.9]
    assert sorted(zip(got[0].corners[::2], got[0].corners[1::2])) == [(5, 3), (5, 8), (40, 3), (40, 8)]
    a, b, c, _ = np.array(got[2].corners).reshape(4, 2)
    assert 20 < max(math.dist(a, b), math.dist(b, c)) < 36 and min(math.dist(a, b), math.dist(b, c)) < 9


def test_smallest_box_of_a_turned_rectangle():
    rng = np.random.default_rng(1)
    for angle in (0.0, 0.3, 1.1, 2.5):
        u, v = np.array([math.cos(angle), math.sin(angle)]), np.array([-math.sin(angle), math.cos(angle)])
        corners = np.array([0 * u, 10 * u, 10 * u + 3 * v, 3 * v])
        inside = rng.random((50, 2)) * [10, 3]
        box = pc.smallest_box(np.concatenate([corners, inside[:, :1] * u + inside[:, 1:] * v]))
        sides = sorted(math.dist(box[i], box[(i + 1) % 4]) for i in range(4))
        assert sides == pytest.approx([3, 3, 10, 10], abs=1e-6)


def test_pieces_merge_the_best_pair_first(spark):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    model = SentencePieceProcessor(model_file=path)
    number, score = {model.id_to_piece(i): i for i in range(model.get_piece_size())}, model.get_score

    def plain(text):
        parts = list("▁" + text.replace(" ", "▁")) if text else []
        while True:
            pairs = [(-score(number[a + b]), i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in number]
            if not pairs:
                break
            _, i = min(pairs)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [n for p in parts for n in ([number[p]] if p in number else [number[f"<0x{b:02X}>"] for b in p.encode()])]

    said = ["the license of the work", "Ünïcode ☃ text", "a", "", None, "mississippi rivers"]
    df = spark.createDataFrame(list(enumerate(said)), "id int, t string")
    got = {r.id: r.x for r in df.select("id", pc.piece_ids(path)(F.col("t")).alias("x")).collect()}
    assert got[4] is None and all(got[i] == plain(x) for i, x in enumerate(said) if x is not None)
