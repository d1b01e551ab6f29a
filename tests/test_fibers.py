"""Fibre kernels against plain versions and drawn lines."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tissuelake.operators import fibers


@pytest.mark.parametrize("share", [0.0, 0.1, 0.9, 0.99])
def test_distances(share):
    rng = np.random.default_rng(1)
    mask = rng.random((21, 33)) < share
    mask[0, 0] = False
    out = np.argwhere(~mask)
    want = [[np.sqrt(((out - [y, x]) ** 2).sum(1)).min() for x in range(33)] for y in range(21)]
    assert fibers.distances(mask) == pytest.approx(np.array(want))


def test_two_thresholds():
    rng = np.random.default_rng(2)
    image = np.concatenate([rng.normal(m, 0.3, 400) for m in (0, 4, 9)])
    low, high = fibers.two_thresholds(image)
    assert 0.8 < low < 3.2 and 4.8 < high < 8.2
    count, edges = np.histogram(image, 16)
    middle = (edges[:-1] + edges[1:]) / 2

    def between(i, j):
        parts = [(count[a:b], middle[a:b]) for a, b in ((0, i), (i, j), (j, 16))]
        return sum((n * m).sum() ** 2 / n.sum() for n, m in parts if n.sum())

    best = max(itertools.combinations(range(1, 16), 2), key=lambda p: between(*p))
    assert fibers.two_thresholds(image, 16) == (pytest.approx(middle[best[0] - 1]), pytest.approx(middle[best[1] - 1]))


def test_flooding_meets_at_the_ridge():
    height = np.abs(np.arange(11) - 5)[None].repeat(5, 0).max() - np.abs(np.arange(11) - 5)[None].repeat(5, 0)
    markers = np.zeros((5, 11), int)
    markers[2, 0], markers[2, 10] = 1, 2
    got = fibers.flooded(height, markers)
    assert (got[:, :5] == 1).all() and (got[:, 6:] == 2).all() and (got > 0).all()


def test_equalising_evens_out_contrast():
    x = np.linspace(0, 1, 64)
    image = np.where(np.arange(64)[None] % 8 < 4, 0.02, 0.0) * (x[:, None] + 0.1) + x[:, None] * 0.5
    made = fibers.equalised(image, 16, clip=1.0)
    assert made.min() >= 0 and made.max() <= 1 + 1e-9 and (made[8, :4] > made[8, 4:8]).all()
    assert np.ptp(fibers.equalised(np.full((9, 9), 3.0), 3)) < 1e-9


def test_slope_and_lines():
    ramp = np.arange(9.0)[None].repeat(9, 0)
    assert fibers.slope(ramp)[4, 4] == pytest.approx(1 / np.sqrt(2))
    line = np.zeros((41, 41))
    line[20] = 1
    found = fibers.vesselness(line, (1, 3))
    assert found[20].min() > 0.5 * found.max() and found[35].max() < 0.01 and fibers.vesselness(np.ones((8, 8)), (1,)).max() == 0


def test_euler_numbers():
    ring = np.ones((3, 3), bool)
    ring[1, 1] = False
    two = np.zeros((3, 5), bool)
    two[:, 0] = two[:, 4] = True
    assert (fibers.euler(ring), fibers.euler(np.ones((2, 2), bool)), fibers.euler(two), fibers.euler(np.eye(3, dtype=bool))) == (0, 1, 2, 1)


def drawn():
    image = np.random.default_rng(3).uniform(0, 0.02, (96, 96))
    yy, xx = np.mgrid[:96, :96]
    image[np.abs(yy - 20) <= 1] += (xx[np.abs(yy - 20) <= 1] > 10) * (xx[np.abs(yy - 20) <= 1] < 80)
    image[(np.abs(xx - yy - 10) <= 1) & (yy > 40) & (yy < 80)] += 1.0
    return image


def test_fibers_are_found(spark):
    image = drawn()
    rows = [(1, "collagen", y, x, float(image[y, x])) for y in range(96) for x in range(96)] + [(2, "collagen", 5, 5, 0.0)]
    df = spark.createDataFrame(rows, "fov long, channel string, y long, x long, value double")
    labels, table = fibers.run_fibers(df, "collagen", k=1, sigma=1, divisor=4, widths=(1, 2), least=15)
    mask = labels.filter("fov = 1").toPandas().pivot(index="y", columns="x", values="label").to_numpy()
    assert mask[20, 40] > 0 and mask[60, 70] > 0 and mask[20, 40] != mask[60, 70]
    made = {r.label: r for r in table.collect()}
    flat, steep = made[mask[20, 40]], made[mask[60, 70]]
    assert flat.major > 3 * flat.minor and abs(flat.cy - 20) < 2 and abs(abs(flat.orientation) - np.pi / 2) < 0.15
    assert abs(steep.orientation - np.pi / 4) < 0.15 and steep.alignment is not None
    assert labels.filter("fov = 2 and label > 0").count() == 0
    assert fibers.segment_fibers(df.filter(F.col("fov") == 9), "collagen").count() == 0
