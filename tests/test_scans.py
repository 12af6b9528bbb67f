"""Picture work against plain loops."""

from __future__ import annotations

import numpy as np

from spanweave.functions import picture
from spanweave.plans import scans


def plain_change(before, after, court, threshold):
    high, wide = np.shape(before)

    def at(p, y, x):
        y, x = abs(y), abs(x)
        y, x = (2 * (high - 1) - y if y >= high else y), (2 * (wide - 1) - x if x >= wide else x)
        return p[y][x]

    weights = [1 / 16, 4 / 16, 6 / 16, 4 / 16, 1 / 16]
    soft = [[[sum(weights[i] * weights[j] * at(p, y + i - 2, x + j - 2) for i in range(5) for j in range(5)) for x in range(wide)] for y in range(high)] for p in (before, after)]
    mask = [[abs(soft[1][y][x] - soft[0][y][x]) > threshold for x in range(wide)] for y in range(high)]

    def around(m, y, x, outside):
        return [m[y + i][x + j] if 0 <= y + i < high and 0 <= x + j < wide else outside for i in (-1, 0, 1) for j in (-1, 0, 1)]

    less = [[all(around(mask, y, x, True)) for x in range(wide)] for y in range(high)]
    more = [[any(around(less, y, x, False)) for x in range(wide)] for y in range(high)]
    return sum(more[y][x] and court[y][x] for y in range(high) for x in range(wide)) / court.sum()


def test_change_ratio_against_loops():
    r = np.random.default_rng(0)
    some = 0
    for _ in range(25):
        a, b = r.random((8, 7)), r.random((8, 7))
        b[2:6, 1:5] += r.random() * 2
        court = r.random((8, 7)) > 0.3
        court[0, 0] = True
        got = picture.change_ratio(a, b, court, 0.4)
        assert abs(got - plain_change(a.tolist(), b.tolist(), court, 0.4)) < 1e-12
        some += got > 0
    assert some > 5 and picture.change_ratio(a, b, court & False, 0.1) == 0.0


def test_court_change_of_a_camera(spark):
    r = np.random.default_rng(1)
    frames = [[float(v) for v in r.random(64)] for _ in range(6)]
    df = spark.createDataFrame([(1, k, f) for k, f in enumerate(frames)] + [(2, 9, frames[0])], "camera_id long, frame_no long, pixels array<double>")
    got = {(x["camera_id"], x["frame_no"]): x["energy"] for x in scans.court_change(df).collect()}
    court = np.zeros((8, 8), bool)
    court[1:, 1:-1] = True
    want = {(1, k): picture.change_ratio(np.reshape(frames[k - 1], (8, 8)), np.reshape(frames[k], (8, 8)), court, 0.05) for k in range(1, 6)}
    assert got == want
