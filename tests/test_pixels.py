"""Picture metrics against loops over pixels."""

import math

import numpy as np
import pytest

from quarrykit.operators import pixels
from quarrykit.operators.pixels import metrics

RNG = np.random.default_rng(9)


def picture(h, w):
    return RNG.integers(0, 256, (h, w, 4)).astype(np.uint8)


def opaque(g):
    return np.dstack([g, g, g, np.full_like(g, 255)]).astype(np.uint8)


@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (7, 2), (16, 16), (19, 33)])
def test_against_loops(shape):
    p = picture(*shape)
    h, w = shape
    got = metrics(p)
    flat = [[[int(x) for x in px] for px in line] for line in p]
    seen = [[[int(np.float32(c) * (np.float32(a) / np.float32(255)) + np.float32(255) * (np.float32(1) - np.float32(a) / np.float32(255))) for c in (r, g, b)] for r, g, b, a in line] for line in flat]
    g = [[(9798 * r + 19235 * gr + 3735 * b + 16384) >> 15 for r, gr, b in line] for line in seen]
    every = [x for line in g for x in line]
    assert got["black_pixel_ratio"] == pytest.approx(sum(x <= 12 for x in every) / len(every))
    assert got["white_pixel_ratio"] == pytest.approx(sum(x >= 243 for x in every) / len(every))
    mean = sum(every) / len(every)
    assert got["luminance_std"] == pytest.approx(math.sqrt(sum((x - mean) ** 2 for x in every) / len(every)))
    alphas = [px[3] for line in flat for px in line]
    assert got["transparent_pixel_ratio"] == pytest.approx(sum(a < 255 for a in alphas) / len(alphas))
    assert got["fully_transparent_ratio"] == pytest.approx(sum(a == 0 for a in alphas) / len(alphas))
    assert got["alpha_edge_ratio"] == pytest.approx(sum(0 < a < 255 for a in alphas) / len(alphas))
    tints = [round((max(px) - min(px)) * 255 / max(px)) if max(px) else 0 for line in seen for px in line]
    assert got["mean_saturation"] == pytest.approx(sum(tints) / len(tints) / 255, abs=1e-3)
    bits = 0.0
    for c in range(3):
        values = [px[c] for line in seen for px in line]
        bits -= sum(values.count(v) / len(values) * math.log2(values.count(v) / len(values)) for v in set(values))
    assert got["rgb_entropy"] == pytest.approx(bits / 3)
    mirror = lambda i, n: 0 if n == 1 else -i if i < 0 else 2 * n - 2 - i if i >= n else i
    lap = [sum(g[mirror(y + a, h)][mirror(x + b, w)] for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1))) - 4 * g[y][x] for y in range(h) for x in range(w)]
    assert got["laplacian_variance"] == pytest.approx(np.var(lap))
    line, inner = [], []
    for y in range(h):
        for x in range(w):
            if x + 1 < w:
                (line if x % 8 == 7 else inner).append(abs(g[y][x + 1] - g[y][x]))
            if y + 1 < h:
                (line if y % 8 == 7 else inner).append(abs(g[y + 1][x] - g[y][x]))
    want = max(0.0, (np.mean(line) - np.mean(inner)) / max(np.mean(inner), 1)) if min(shape) >= 16 else 0.0
    assert got["blockiness"] == pytest.approx(want)


def test_spectrum():
    g = RNG.integers(0, 256, (24, 31))
    total = far = 0.0
    for u in range(-12, 12):
        for v in range(-15, 16):
            y, x = np.mgrid[:24, :31]
            power = abs((g * np.exp(-2j * np.pi * (u * y / 24 + v * x / 31))).sum()) ** 2
            if (u, v) != (0, 0):
                total += power
                far += power * (math.hypot(u, v) >= 6)
    assert pixels.high_frequency_ratio(g) == pytest.approx(far / total)
    assert pixels.high_frequency_ratio(np.full((40, 700), 77)) == 0.0
    assert pixels.by_area(np.repeat(np.arange(4), 256)[None, :].repeat(1024, 0), 512).shape == (512, 512)
    assert (pixels.by_area(np.repeat(np.arange(4), 256)[None, :], 512)[0] == np.repeat(np.arange(4), 128)).all()


def test_edges_and_borders():
    g = np.zeros((20, 20), int)
    assert not pixels.edges(g).any()
    g[:, 10:] = 200
    on = pixels.edges(g)
    assert on.sum() == 20 and set(np.nonzero(on)[1]) <= {9, 10}  # one line for one step
    assert (pixels.edges(g.T) == on.T).all()
    faint = np.zeros((9, 9), int)
    faint[:, 5:] = 20  # a gradient of 80 is under both thresholds
    assert not pixels.edges(faint).any()
    framed = np.full((40, 50), 128)
    framed[:4] = framed[-6:] = 0
    m = metrics(opaque(framed))
    assert m["black_border_ratio"] == pytest.approx(10 / 40) and m["white_border_ratio"] == 0
    framed[-6:] = 128
    assert metrics(opaque(framed))["black_border_ratio"] == 0  # one strip alone is none
    assert metrics(opaque(np.zeros((8, 8), int)))["black_border_ratio"] == 0


def test_rows(spark):
    clear = picture(5, 6)
    clear[..., 3] = 0
    rows = [(1, 6, 5, clear.tobytes()), (2, 6, 5, b"short"), (3, None, 5, clear.tobytes()), (4, 6, 5, None), (5, 0, 0, b""), (1, 6, 5, clear.tobytes())]
    t = spark.createDataFrame([(*r, "x") for r in rows], "sample_id long, width int, height int, pixels binary, code string")
    got = pixels.measure_pixels(t).collect()
    assert len(got) == 2 * 14 + 4
    assert [r["sample_id"] for r in got if r["code"] == "metric_error"] == [2, 3, 4, 5]
    one = {r["code"]: r for r in got if r["sample_id"] == 1}
    assert one["fully_transparent_ratio"]["value"] == 1.0 and one["white_pixel_ratio"]["severity"] == "medium" and one["laplacian_variance"]["review_only"]
    assert one["edge_density"]["threshold"] is None and one["edge_density"]["severity"] == "info"
    assert pixels.measure_pixels(t.limit(0)).count() == 0
