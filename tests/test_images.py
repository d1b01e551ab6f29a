"""Image kernels and meta clusters against plain versions, and the edge cases of mask operators."""

import itertools

import numpy as np
import pytest

from tissuelake.operators import cells, clusters, images, labels, masks


def flood(mask, corners):
    out, n = np.zeros(mask.shape, int), 0
    for y, x in np.argwhere(mask):
        if not out[y, x]:
            n += 1
            todo = [(y, x)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not out[a, b]:
                    out[a, b] = n
                    todo += [(a + i, b + j) for i, j in itertools.product((-1, 0, 1), repeat=2) if corners or i == 0 or j == 0]
    return out


@pytest.mark.parametrize("corners", [True, False])
def test_components(corners):
    rng = np.random.default_rng(1)
    for share in (0.0, 0.3, 0.45, 0.6, 1.0):
        mask = rng.random((23, 31)) < share
        assert (images.components(mask, corners) == flood(mask, corners)).all()
    spiral = np.zeros((9, 9), bool)
    spiral[0], spiral[:, 8], spiral[8], spiral[2:, 0], spiral[2, :7], spiral[2:7, 6] = (True,) * 6
    assert (images.components(spiral, corners) == flood(spiral, corners)).all()


def test_blur_keeps_constants_and_mass():
    assert images.blur(np.full((5, 7), 3.0), 2.0) == pytest.approx(3.0)
    point = np.zeros((41, 41))
    point[20, 20] = 1
    assert images.blur(point, 2.0).sum() == pytest.approx(1.0)


def test_objects_fill_holes_and_filter_by_area():
    image = np.zeros((12, 20))
    image[1:7, 1:7] = 5
    image[3, 3] = 0
    image[9, 15] = 5
    got = images.objects(image, 0, 0, 5, 0, 1000)
    assert got.max() == 0  # nothing exceeds the least of equal values
    image[image > 0] += np.arange((image > 0).sum()) / 1000
    got = images.objects(image, 0, 0, 5, 2, 36)
    assert got[3, 3] == 1 and (got > 0).sum() == 35 and got[9, 15] == 0


def test_empty_image_table(spark):
    none = spark.createDataFrame([], "fov long, channel long, y long, x long, value double")
    assert images.smooth_channels(none, 1.0).count() == 0
    assert masks.composite(none, [0], [1]).count() == 0


def test_ward_matches_exhaustive_first_merges():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.1, (6, 3)) for c in (0, 3, 9)])
    assert clusters.ward(x, 3).tolist() == [1] * 6 + [2] * 6 + [3] * 6
    assert sorted(set(clusters.ward(x, 18))) == list(range(1, 19))
    y = rng.random((7, 2))
    spread = lambda part: sum(((p - p.mean(0)) ** 2).sum() for p in part)
    best = min(itertools.combinations(range(7), 2), key=lambda ij: spread([y[list(ij)]]))
    got = clusters.ward(y, 6)
    assert got[best[0]] == got[best[1]]


def test_merge_takes_the_whole_cell(spark):
    schema = "fov long, y long, x long, label long"
    objects = spark.createDataFrame([(0, 0, x, 1) for x in range(3)], schema)
    cells = spark.createDataFrame([(0, 0, x, 5) for x in range(1, 4)] + [(0, 5, 5, 6)], schema)
    got = {(r.y, r.x): (r.merged, r.remaining) for r in masks.merge(objects, cells, 50).collect()}
    assert got == {(0, 0): (1, 0), (0, 1): (1, 0), (0, 2): (1, 0), (0, 3): (1, 0), (5, 5): (0, 6)}
    kept = {(r.y, r.x): (r.merged, r.remaining) for r in masks.merge(objects, cells, 70).collect()}
    assert kept[(0, 3)] == (0, 5) and kept[(0, 1)] == (1, 5)


def test_stitch_rejects_other_names(spark):
    rows = spark.createDataFrame([("tile", 0, 0, 0, 1.0)], "fov string, channel long, y long, x long, value double")
    with pytest.raises(Exception, match="not a tile name"):
        masks.stitch(rows, 4, 4).collect()


def test_natural_order_takes_any_name(spark):
    names = spark.createDataFrame([("fov10",), ("fov2",), ("a",), ("fov99999999999999999999",)], "name string")
    assert [r.name for r in labels.natural_order(names, "name").orderBy("place").collect()][0] == "a"
    assert labels.natural_order(names.limit(0), "name").count() == 0


def test_hull_of_simple_shapes():
    square = np.ones((5, 7), bool)
    assert (cells.hull_image(square) == square).all() and cells.hull_image(np.ones((1, 1), bool)).all()
    ell = square.copy()
    ell[:3, 3:] = False
    hull = cells.hull_image(ell)
    assert (hull | ell == hull).all() and hull[3, 5] and not hull[0, 6]
    cup = np.ones((20, 20), bool)
    cup[:15, 5:15] = False
    assert cells.hull_image(cup).all()
    assert cells.concavities(~cup, 10, 60, 150) == 1 and cells.concavities(~cup, 10, 1, 150) == 0


def test_perimeter_of_a_square():
    assert cells.perimeter(np.ones((5, 5), bool)) == pytest.approx(16)
    assert cells.perimeter(np.ones((1, 1), bool)) == 0


def test_hull_features_of_masks(spark):
    mask = spark.createDataFrame([(0, y, x, 1) for y in range(4) for x in range(4)] + [(0, 9, 9, 0)], "fov long, y long, x long, label long")
    got = cells.hull_features(mask).collect()
    assert [(r.label, r.convex_area, r.convex_hull_resid, r.centroid_dif, r.num_concavities) for r in got] == [(1, 16, 0.0, 0.0, 0)]
    assert cells.hull_features(mask.filter("label = 0")).count() == 0


def test_spanning_tree_weight(spark):
    rng = np.random.default_rng(3)
    at = rng.integers(0, 50, (40, 2)).tolist()
    table = spark.createDataFrame([(0, i + 1, y, x) for i, (y, x) in enumerate(at)] + [(1, 7, 0, 0)], "fov long, label long, cy long, cx long")
    got = cells.spanning_tree(table).collect()
    parent = list(range(40))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    weight = 0
    for d, i, j in sorted(((at[i][0] - at[j][0]) ** 2 + (at[i][1] - at[j][1]) ** 2, i, j) for i in range(40) for j in range(i)):
        if root(i) != root(j):
            parent[root(i)] = root(j)
            weight += d
    assert len(got) == 39 and sum(r.d2 for r in got) == weight and {r.fov for r in got} == {0}
