"""Learned operators, image sources, sinks and edge cases against plain versions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tissuelake.operators import cells, clusters, images, labels, masks, pixie, spatial, topics
from tissuelake.sources import files, tables
from tissuelake.streaming.ingest import windowed_counts

DATA = "/root/testdata/sf0.001"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3)


# -- neighbourhoods


def test_mixing_of_two_populations(spark):
    """Cells 1-3 are targets, 4-5 references, 6 another type; 7 is a target without neighbour and does not count."""
    at = [(1, "A", 0, 0), (2, "A", 0, 10), (3, "B", 10, 0), (4, "C", 10, 10), (5, "D", 20, 10), (6, "E", 5, 5), (7, "A", 500, 500)]
    df = frame(spark, [(1, *c) for c in at] + [(2, 1, "A", 0, 0)], "fov long, label long, cell_type string, cy long, cx long")
    kind = {i: t for i, t, _, _ in at}
    near = [(a[0], b[0]) for a, b in itertools.permutations(at, 2) if 0 < math.dist(a[2:], b[2:]) < 12]
    t, r = {1, 2, 3}, {4, 5}
    tt, tr, rr = (sum(a in x and b in y for a, b in near) for x, y in ((t, t), (t, r), (r, r)))
    got = {row.fov: row for row in spatial.mixing_scores(df, 12, ["A", "B"], ["C", "D"], 5, 5).collect()}
    assert (got[1].n, got[1].percent, got[1].homogeneous) == (5, pytest.approx(tr / (tr + tt), abs=1e-6), pytest.approx(tr / (tt + rr), abs=1e-6))
    assert (got[2].n, got[2].percent, got[2].homogeneous) == (0, None, None)
    assert all(x.percent is None for x in spatial.mixing_scores(df, 12, ["A", "B"], ["C", "D"], 5, 6).collect())
    ratio = {row.fov: tuple(row)[1:] for row in spatial.cell_ratios(df, 12, ["A", "B"], ["C", "D"]).collect()}
    assert ratio == {1: (1.5, 0.666667), 2: (None, None)} and kind[6] == "E"
    with pytest.raises(ValueError, match="both populations"):
        spatial.mixing_scores(df, 12, ["A"], ["A"])


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_on_a_grid(spark, k):
    """Crowded and lonely kinds, equal places, ties and queries outside the targets' frame."""
    rng = np.random.default_rng(k)
    spots = np.concatenate([rng.integers(0, 60, (300, 2)), rng.integers(0, 2000, (60, 2)), [[5000, 5000]], np.zeros((5, 2), int)])
    rows = [(i % 2, i, "crowd" if i < 300 else "far", int(y), int(x)) for i, (y, x) in enumerate(spots)] + [(0, 900, "lone", 7, 7), (1, 901, "query", -4000, 9)]
    df = frame(spark, rows, "fov long, label long, cell_type string, cy long, cx long")
    targets = df.filter("label <> 901").select("fov", F.col("cell_type").alias("kind"), F.col("label").alias("nb"), F.col("cy").alias("ny"), F.col("cx").alias("nx"))
    got = {(r.fov, r.label, r.kind, r.r, r.nb, r.d2) for r in spatial.nearest(df.select("fov", "label", "cy", "cx"), targets, k, F.col("d2") > 0).collect()}
    want = set()
    for f, i, _, y, x in rows:
        for kind in ("crowd", "far", "lone"):
            near = sorted(((y - b) ** 2 + (x - c) ** 2, j) for g, j, t, b, c in rows if g == f and t == kind and j != 901)
            want |= {(f, i, kind, n + 1, j, d) for n, (d, j) in enumerate([p for p in near if p[0] > 0][:k])}
    assert got == want


def test_silhouette_and_distance_sums(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (30, 2)), rng.normal(4, 1, (25, 2)), [[9.0, 9.0]], [[1.0, 1.0]] * 3])
    g = np.array([0] * 30 + [1] * 25 + [2] + [3] * 3)
    df = frame(spark, [(int(a), float(b), float(c)) for a, (b, c) in zip(g, x, strict=True)], "g long, a double, b double")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    score = []
    for i in range(len(x)):
        own = (g == g[i]) & (np.arange(len(x)) != i)
        a, b = d[i][own].mean() if own.any() else None, min(d[i][g == h].mean() for h in set(g) - {g[i]})
        score.append(0 if a is None else (b - a) / max(a, b))
    assert clusters.silhouette(df, ["a", "b"], "g").first()[0] == pytest.approx(np.mean(score), abs=1e-6)
    want = sum(d[np.ix_(g == k, g == k)].sum() / 2 / (2 * (g == k).sum()) for k in set(g))
    assert topics.within_cluster_sums(df, "g", ["a", "b"]).first()[0] == pytest.approx(want, abs=1e-5)
    some = clusters.silhouette(df, ["a", "b"], "g", subsample=10).first()[0]
    assert -1 <= some <= 1 and some == clusters.silhouette(df.repartition(7), ["a", "b"], "g", subsample=10).first()[0]
    assert clusters.silhouette(df.filter("g = 0"), ["a", "b"], "g").first()[0] is None


def test_best_of_ten_and_scan(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.2, (20, 2)) for c in ((0, 0), (5, 0), (0, 5))])
    df = clusters.features(frame(spark, [(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "label long, a double, b double"), ["a", "b"])
    made = clusters.neighborhood_clusters(df, 3, ["label"]).toPandas().set_index("label").cluster.sort_index()
    assert set(made) == {1, 2, 3} and all(made[i * 20 : i * 20 + 20].nunique() == 1 for i in range(3))
    scan = clusters.kmeans_scan(df, range(2, 5)).toPandas().set_index("k")
    assert scan.silhouette.idxmax() == 3 and scan.inertia.is_monotonic_decreasing
    with pytest.raises(ValueError):
        clusters.neighborhood_clusters(df, 1, ["label"])


def test_gap_and_topic_figures(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.1, (15, 2)) for c in ((0, 0), (6, 0), (0, 6))])
    df = frame(spark, [(float(a), float(b)) for a, b in x], "a double, b double")
    made, _ = topics._clustered(df, ["a", "b"], 3, 42)
    within = topics.within_cluster_sums(made, "cluster", ["a", "b"]).first()[0]
    gap, spread = topics.gap_statistic(df, ["a", "b"], 3, within, boots=2)
    assert gap > 1 and spread >= 0
    rows = topics.topic_figures(df, ["a", "b"], [3, 4], with_silhouette=True).toPandas()
    assert sorted(rows.k.value_counts().items()) == [(3, 3), (4, 4)]
    assert rows.groupby("k").a.sum().tolist() == pytest.approx([x[:, 0].sum()] * 2) and rows.gap.isna().all()
    for bad in ({"topics": [2, 3]}, {"topics": [3], "boots": 5}, {"topics": [44]}):
        with pytest.raises(ValueError):
            topics.topic_figures(df, ["a", "b"], **bad)
    uniform = topics.uniform_like(df, ["a", "b"], 1).toPandas()
    assert len(uniform) == 45 and uniform.a.between(x[:, 0].min(), x[:, 0].max()).all()


def test_topic_arguments(spark):
    df = tables.cells(spark, DATA)
    assert topics.format_cells(df, markers=["cy"]).columns == ["fov", "label", "cluster", "y", "x", "cy", "is_index"]
    for bad in ({}, {"markers": ["none"]}, {"clusters": ["none"]}, {"markers": ["cy"], "featurization": "x"}, {"clusters": ["BUILDING"], "featurization": "marker"}, {"markers": ["cy"], "radius": 3}):
        with pytest.raises(ValueError):
            topics.check_arguments(df, bad.get("markers"), bad.get("clusters"), bad.get("featurization"), bad.get("radius"))


# -- maps and consensus


def test_som_covers_all_rows(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.1, (50, 2)) for c in ((0, 0), (5, 5))] + [rng.normal((9, 0), 0.05, (3, 2))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [None, 1.0])]
    df = frame(spark, rows, "id long, v array<double>")
    a = clusters.som(df, "v", ["id"], side=2).toPandas().set_index("id").node.sort_index()
    assert len(a) == 103 and a.between(1, 4).all()
    assert a.to_dict() == clusters.som(df.repartition(6), "v", ["id"], side=2).toPandas().set_index("id").node.to_dict()
    assert set(a[:50]) & set(a[50:100]) == set()
    assert clusters.som(df.limit(0), "v", ["id"]).count() == 0


def test_online_rule_by_hand():
    """The rule in plain loops, with the same draws."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 3))
    got = pixie.train_nodes(x, 3, 3, passes=2, seed=9)
    rng = np.random.default_rng(9)
    nodes = x[rng.choice(40, 9, replace=False)].copy()
    draws = rng.integers(0, 40, 80)
    place = [(i // 3, i % 3) for i in range(9)]
    apart = [[max(abs(a - c), abs(b - d)) for c, d in place] for a, b in place]
    for t, r in enumerate(draws):
        near = min(range(9), key=lambda n: sum((nodes[n][k] - x[r][k]) ** 2 for k in range(3)))
        radius = np.quantile(apart, 0.67) * (1 - t / 80)
        radius = radius if radius >= 1 else 0.5
        for n in range(9):
            if apart[near][n] <= radius:
                nodes[n] = nodes[n] + (0.05 - 0.04 * t / 80) * (x[r] - nodes[n])
    assert got == pytest.approx(nodes)


def test_som_cluster_keeps_weights(spark, tmp_path):
    rng = np.random.default_rng(6)
    df = frame(spark, [(i, *map(float, rng.normal(size=2))) for i in range(60)], "id long, a double, b double")
    som = pixie.SomCluster(spark, f"{tmp_path}/w", ["a", "b"], xdim=2, ydim=2)
    with pytest.raises(ValueError, match="not trained"):
        som.assign(df)
    assert som.train(df)
    one = som.assign(df).toPandas().set_index("id").som_cluster
    again = pixie.SomCluster(spark, f"{tmp_path}/w", ["b", "a"], xdim=2, ydim=2)
    with pytest.warns(UserWarning, match="already"):
        assert not again.train(df)
    assert again.assign(df.select("b", "id", "a")).toPandas().set_index("id").som_cluster.to_dict() == one.to_dict()
    w = som.weights.to_numpy()
    for r in df.collect():
        assert one[r.id] == ((w - [r.a, r.b]) ** 2).sum(1).argmin() + 1
    with pytest.warns(UserWarning, match="overwrite"):
        assert again.train(df, overwrite=True)
    other = pixie.SomCluster(spark, f"{tmp_path}/w", ["a"], xdim=2, ydim=2)
    with pytest.warns(UserWarning, match="other columns"):
        assert other.train(df)
    with pytest.raises(ValueError, match="not in the table"):
        som.assign(df.drop("a"))
    assert som.assign(df.limit(0)).count() == 0


def test_consensus_clustering():
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(c, 0.1, (12, 2)) for c in ((0, 0), (4, 0), (0, 4))])
    group = np.repeat([0, 1, 2], 12)
    found = pixie.ConsensusCluster(low=2, high=6, times=20).fit(x)
    same = group[:, None] == group[None]
    assert (found.agreement[3][same] > 0.99).all() and (found.agreement[3][~same] == 0).all()
    for m in found.agreement.values():
        assert (m == m.T).all() and (np.diag(m) == 1).all() and m.min() >= 0 and m.max() <= 1
    assert found.gain.shape == (3,) and found.best == 2 + int(found.gain.argmax())
    fixed = pixie.ConsensusCluster(low=3, high=3).fit(x)  # one candidate: nothing to compare
    assert fixed.best == 3 and len({tuple(sorted(set(fixed.predict_data(x)[group == g]))) for g in range(3)}) == 3
    assert pixie.ConsensusCluster(low=3, high=5).fit(x).predict().shape == (36,)

    class Halves:
        def __init__(self, n_clusters):
            self.n_clusters = n_clusters

        def fit_predict(self, x):
            return (x[:, 0] > 2).astype(int)

    assert (pixie.ConsensusCluster(Halves, 2, 3).fit(x).agreement[2] > 0.5).sum() == 24**2 + 12**2
    with pytest.raises(ValueError):
        pixie.ConsensusCluster(share=2)
    with pytest.raises(ValueError):
        pixie.ConsensusCluster().predict()


def test_consensus_map_and_remapping(spark):
    means = frame(spark, [(i, float(i % 2 * 9 + i / 100), 1.0) for i in range(8)], "node long, a double, b double")
    made = {r.node: r.meta for r in pixie.consensus_map(means, "node", ["a", "b"], "meta", 2).collect()}
    assert set(made.values()) == {1, 2} and len({made[i] for i in (0, 2, 4, 6)}) == 1
    rows = frame(spark, [(1,), (2,), (2,)], "node long")
    names = frame(spark, [(1, 1, "x"), (2, 2, "y")], "node long, meta int, name string")
    assert sorted(map(tuple, pixie.remapped(rows, names, "node", "meta", "name").collect())) == [(1, 1, "x"), (2, 2, "y"), (2, 2, "y")]
    with pytest.raises(ValueError, match="without a meta"):
        pixie.remapped(frame(spark, [(3,)], "node long"), names, "node", "meta", "name")
    with pytest.raises(ValueError, match="several"):
        pixie.remapped(rows, frame(spark, [(1, 1, "x"), (2, 2, "x")], "node long, meta int, name string"), "node", "meta", "name")


# -- pixel matrices


def pictures(spark, fovs, channels=("b", "a")):
    rows = [(f"fov{f}", c, y, x, float((y * 5 + x * 3 + k + f) % 7)) for f in fovs for k, c in enumerate(channels) for y in range(6) for x in range(5)]
    return frame(spark, rows, "fov string, channel string, y long, x long, value double")


def test_pixel_matrix_is_kept_and_extended(spark, tmp_path):
    path = f"{tmp_path}/pixie"
    run = lambda df, channels=("a", "b"): pixie.save_pixel_matrix(spark, df, list(channels), path, {"a": 2.0}, 0, 3.0 if "b" in channels else 0.5, 0.5)
    assert run(pictures(spark, [1, 2])) == ["fov1", "fov2"]
    rows = spark.read.parquet(f"{path}/pixels").toPandas()
    want = [(f"fov{f}", y, x, a / (a + b), b / (a + b)) for f in (1, 2) for y in range(6) for x in range(5) if (a := (y * 5 + x * 3 + 1 + f) % 7 / 2) + (b := (y * 5 + x * 3 + f) % 7) > 3]
    assert sorted(rows[["fov", "y", "x", "a", "b"]].itertuples(index=False, name=None)) == [(f, y, x, pytest.approx(a), pytest.approx(b)) for f, y, x, a, b in sorted(want)]
    some = spark.read.parquet(f"{path}/training").toPandas()
    assert len(some) == sum(round(sum(w[0] == f for w in want) * 0.5) for f in ("fov1", "fov2"))
    assert run(pictures(spark, [1, 2])) == [] and run(pictures(spark, [1, 2, 3])) == ["fov3"]
    assert spark.read.parquet(f"{path}/pixels").select("fov").distinct().count() == 3
    with pytest.warns(UserWarning, match="another list"):
        assert run(pictures(spark, [1]), ["a"]) == ["fov1"]
    assert "b" not in spark.read.parquet(f"{path}/pixels").columns
    with pytest.raises(ValueError, match="without an image"):
        pixie.image_pixels(pictures(spark, [1]), ["zzz"], {})


def test_pixels_carry_blur_and_labels(spark):
    mask = frame(spark, [("fov1", 1, 1, 7)], "fov string, y long, x long, label long")
    rows = pixie.image_pixels(pictures(spark, [1]), ["a"], {}, 1.0, mask).toPandas()
    image = np.array([[(y * 5 + x * 3 + 2) % 7 for x in range(5)] for y in range(6)], float)
    assert rows.sort_values(["y", "x"]).a.to_numpy().reshape(6, 5) == pytest.approx(images.blur(image, 1.0))
    assert rows[rows.label == 7][["y", "x"]].values.tolist() == [[1, 1]]


def test_pixel_matrix_drops_zero_rows(spark):
    df = frame(spark, [("f", 1.0, -1.0), ("f", 0.0, 0.0), ("f", 2.0, 2.0), ("f", None, 3.0)], "fov string, a double, b double")
    assert sorted((r.a, r.b) for r in pixie.pixel_matrix(df, ["a", "b"], -1.0).filter("a is not null and b is not null").collect()) == [(0.5, 0.5)]


def test_missing_columns_and_modified_channels(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/a")
    spark.range(3).withColumn("som", F.lit(1)).write.parquet(f"{tmp_path}/b")
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "part.parquet").write_bytes(b"broken")
    assert pixie.without_column(spark, {k: f"{tmp_path}/{k}" for k in "abc"}, "som") == ["a", "c"]
    assert pixie.modified_channels(["x", "y"], ["x", "x_smoothed", "y_nuc_exclude", "z_smoothed"]) == ["x_smoothed", "y_nuc_exclude"]


# -- masks and images


def test_edges_of_sparse_masks(spark):
    far = frame(spark, [(1, 0, 0, 1), (1, 0, 9, 2)], "fov long, y long, x long, label long")
    assert {(r.x, r.edge) for r in masks.edge(far).collect()} == {(0, True), (9, True)}  # background lies between them
    full = [(1, y, x, 5 if 1 <= y <= 3 and 1 <= x <= 3 else 0) for y in range(5) for x in range(5)]
    schema = "fov long, y long, x long, label long"
    dense = {(r.y, r.x) for r in masks.erode(frame(spark, full, schema)).filter("label > 0").collect()}
    sparse = {(r.y, r.x) for r in masks.erode(frame(spark, [r for r in full if r[3]], schema), 5, 5).filter("label > 0").collect()}
    assert dense == sparse == {(2, 2)}
    rim = [(1, y, x, 5) for y in range(3) for x in range(3)]
    assert masks.erode(frame(spark, rim, schema)).filter("label > 0").count() == 9


def test_object_options():
    rng = np.random.default_rng(8)
    image = np.zeros((60, 60))
    yy, xx = np.mgrid[:60, :60]
    image[(yy - 20) ** 2 + (xx - 20) ** 2 < 64] = 5
    image += np.linspace(0, 8, 60)[None] + rng.normal(0, 0.01, (60, 60))
    image[(yy - 40) ** 2 + (xx - 45) ** 2 < 36] += 5
    assert images.objects(image, 0, 60, None, 30, 1000).max() >= 1
    auto = images.objects(image, 0, "auto", "auto", 40, 600, fov_dim=20)
    assert auto[20, 20] > 0 and auto[40, 45] > 0 and auto[20, 20] != auto[40, 45]
    assert images.objects(np.zeros((8, 8)), 1, "auto", None, 1, 9).max() == 0
    assert images.block_size("local_thresh", 400, 1024) == 27 and images.block_size("small_holes", 400, 1024) == 632
    for bad in ({"shape": "x"}, {"percentile": "x"}):
        with pytest.raises(ValueError):
            images.objects(image, **{"sigma": 0, "percentile": 50, "hole": 1, "least": 1, "most": 9, **bad})
    with pytest.raises(ValueError):
        images.block_size("x", 1, 1)
    line = np.zeros((40, 40))
    line[20, 5:35] = 1
    found = images.ridges(line, (2,))
    assert found[20, 20] > 0.9 and found[5, 5] < 0.05 and images.ridges(np.ones((9, 9))).max() < 1e-6


def test_signal_and_smooth_masks(spark):
    df = pictures(spark, [1]).withColumn("value", F.when((F.col("y") < 3) & (F.col("channel") == "a"), F.col("value") + 50).otherwise(F.col("value")))
    made = images.signal_masks(df, ["a", "b"], 0, 40, None, 1, 100)
    assert {r.channel for r in made.filter("label > 0").collect()} == {"a", "b"} and made.count() == 60
    spot = frame(spark, [(1, y, x, 1 if (y - 10) ** 2 + (x - 10) ** 2 < 9 else 0) for y in range(21) for x in range(21)], "fov long, y long, x long, label long")
    wide = images.smooth_mask(spot, 1.0, 0.05).filter("label = 1").count()
    assert spot.filter("label = 1").count() < wide < 21 * 21 and images.smooth_mask(spot, 0, least=1000).filter("label = 1").count() == 0


def test_compartments_without_nuclei(spark):
    signal = frame(spark, [(1, y, x, 1 + (x > 2), float(y)) for y in range(4) for x in range(6)], "fov long, y long, x long, label long, a double")
    nuclei = frame(spark, [(1, 1, 1, 9), (1, 2, 1, 9)], "fov long, y long, x long, label long")
    for mode in ("total_intensity", "mean_intensity", "positive_pixel", "center_weighting"):
        rows = {r.label: r for r in cells.compartment_table(signal, nuclei, ["a"], mode).collect()}
        assert rows[1].area_nuclear == 2 and rows[1].nc_ratio == pytest.approx(2 / 12, abs=1e-6) and (rows[2].area_nuclear, rows[2].nc_ratio, rows[2].a_nuclear) == (0, 0, 0)
    assert rows[1].a_nuclear == pytest.approx(1 * (1 - 0.5 / 1.5) + 2 * (1 - 0.5 / 1.5), abs=1e-6)


# -- labels


def test_as_of_edges(spark):
    keys = frame(spark, [(k, str(k)) for k in (-5, 0, 1, 1, 1023, 1024, 5000, None)], "key long, v string")
    steps = frame(spark, [(0, 10), (0, 11), (1024, 12), (4000, None), (9000, 13)], "step long, value long")
    got = sorted(((r.key, r.value) for r in labels.as_of(keys, steps, "key", "step", "value").collect()), key=str)
    assert got == sorted([(-5, None), (0, 11), (1, 11), (1, 11), (1023, 11), (1024, 12), (5000, 12), (None, None)], key=str)


def test_small_sets(spark):
    df = tables.cells(spark, DATA)
    assert labels.missing(["BUILDING", "NONE"], df, "cell_type") == ["NONE"]
    assert labels.columns_like(df.withColumns({"count_10": F.lit(1), "count_9": F.lit(1)}), r"count_\d+") == ["count_9", "count_10"]
    assert tables.nan_to_null(spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "a double, b long")).filter("a is null").count() == 1


def test_windowed_counts(spark):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "a")], "t string, k string").withColumn("t", F.to_timestamp("t"))
    assert sorted(r.n for r in windowed_counts(rows, "t", "k").collect()) == [1, 2]


# -- files


@pytest.mark.parametrize("kind", ["uint8", "uint16", "int32", "float32"])
def test_tiff_round_trip(kind):
    pages = np.arange(3 * 5 * 7).reshape(3, 5, 7).astype(kind)
    assert (files.decode_tiff(files.encode_tiff(pages)) == pages).all()
    assert files.decode_tiff(files.encode_tiff(pages[0])).shape == (1, 5, 7)
    for bad in (b"", b"II*\0", b"MM\0*\0\0\0\x08\0\x01", files.encode_tiff(pages)[:60]):
        with pytest.raises(ValueError):
            files.decode_tiff(bad)


def test_image_tree(spark, tmp_path):
    path = f"{tmp_path}/tree"
    made = files.write_image_tree(pictures(spark, [1, 2]), path, "uint16")
    assert [m.removeprefix(path) for m in made] == [f"/fov{f}/{c}.tiff" for f in (1, 2) for c in ("a", "b")]
    back = files.read_image_tree(spark, path, fovs=["fov1"], channels=["a"]).toPandas()
    want = pictures(spark, [1]).filter("channel = 'a'").toPandas()
    key = ["y", "x", "value"]
    assert back[key].sort_values(key).to_numpy().tolist() == want[key].sort_values(key).to_numpy().tolist() and back.error.isna().all()
    with pytest.raises(ValueError, match="no files"):
        files.read_image_tree(spark, path, channels=["zzz"])
    (tmp_path / "tree" / "fov2" / "b.tiff").write_bytes(b"broken")
    bad = files.read_image_tree(spark, path).filter("error is not null").collect()
    assert len(bad) == 1 and (bad[0].fov, bad[0].channel, bad[0].y) == ("fov2", "b", None)


def test_stacks_and_masks(spark, tmp_path):
    (tmp_path / "s").mkdir()
    pages = np.arange(2 * 3 * 4).reshape(2, 3, 4).astype("uint8")
    (tmp_path / "s" / "p1.tiff").write_bytes(files.encode_tiff(pages))
    rows = files.read_image_stacks(spark, f"{tmp_path}/s", ["c0", "c1"]).toPandas()
    assert rows[rows.channel == "c1"].sort_values(["y", "x"]).value.tolist() == pages[1].ravel().tolist()
    assert len(files.split_stacks(spark, f"{tmp_path}/s", f"{tmp_path}/out", ["c0", "c1"])) == 2
    mask = spark.createDataFrame([("p1", 0, 1, 70000), ("p1", 2, 2, 5)], "fov string, y long, x long, label long")
    files.write_masks(mask, f"{tmp_path}/m", "_whole_cell")
    got = files.read_masks(spark, f"{tmp_path}/m", "_whole_cell").filter("label > 0")
    assert sorted(map(tuple, got.select("fov", "y", "x", "label").collect())) == [("p1", 0, 1, 70000), ("p1", 2, 2, 5)]


@pytest.mark.parametrize("compress", [False, True])
def test_csv(spark, tmp_path, compress):
    df = frame(spark, [(1, "a,b", "m1", 1.5), (2, 'q"u', "m2", None), (3, None, "m1", 2.0)], "id long, name string, mask string, v double")
    made = files.write_csv(df, f"{tmp_path}/csv", by="mask", compress=compress, name=lambda k: f"filtered_{k}")
    assert [m.rsplit("/", 1)[1].split(".")[0] for m in made] == ["filtered_m1", "filtered_m2"]
    back = files.read_csv(spark, f"{tmp_path}/csv", "id long, name string, v double", tag="file")
    assert sorted(map(tuple, back.collect())) == [(1, "a,b", 1.5, "filtered_m1"), (2, 'q"u', None, "filtered_m2"), (3, None, 2.0, "filtered_m1")]
    assert len(files.write_csv(df, f"{tmp_path}/parts", compress=compress)) >= 1
    if not compress:
        assert files.csv_columns(spark, made[0]) == ["id", "name", "mask", "v"]
        assert files.concatenate_csv(spark, f"{tmp_path}/csv", "id long", f"{tmp_path}/all").filter("fov = 'filtered_m1'").count() == 2


def test_feather(spark, tmp_path):
    df = frame(spark, [("f1", 1, 0.5), ("f1", 2, 1.5), ("f2", 3, None)], "fov string, id long, v double")
    assert len(files.write_feather(df, f"{tmp_path}/f", "fov")) == 2
    (tmp_path / "f" / "bad.feather").write_bytes(b"x")
    assert sorted(map(tuple, files.read_feather(spark, f"{tmp_path}/f", "fov string, id long, v double").collect())) == [("f1", 1, 0.5), ("f1", 2, 1.5), ("f2", 3, None)]


def test_kept_and_replaced_outputs(spark, tmp_path):
    path, made = f"{tmp_path}/t", []
    make = lambda: made.append(1) or spark.range(5)
    assert files.keep_or_make(spark, path, make).count() == 5 and files.keep_or_make(spark, path, make).count() == 5 and len(made) == 1
    assert files.keep_or_make(spark, path, lambda: spark.range(2), overwrite=True).count() == 2
    assert sorted(r[0] for r in files.replace(spark.read.parquet(path).withColumn("id", F.col("id") + 10), path).collect()) == [10, 11]
    files.write_log(spark, {"a": 1, "b": [2], "c": "x"}, f"{tmp_path}/log")
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/log").collect()) == ["a: 1", "b: [2]", "c: x"]
    tables.write_split(frame(spark, [(1, "a"), (2, "b")], "id long, k string"), f"{tmp_path}/split", "k")
    assert spark.read.parquet(f"{tmp_path}/split/k=a").count() == 1


# -- learned summaries


def test_pca_against_numpy(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(50, 4)) * [5, 2, 1, 0.1]
    df = clusters.features(frame(spark, [(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double, c double, d double"), ["a", "b", "c", "d"])
    got = clusters.pca(df, 2, ["id"]).toPandas().sort_values("id")[["pc1", "pc2"]].to_numpy()
    axis = np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, :2]
    want = x @ axis
    assert np.abs(got) == pytest.approx(np.abs(want), abs=1e-6)


def test_topics_are_shares(spark):
    rows = [(i, *((9.0, 0.0) if i % 2 else (0.0, 9.0))) for i in range(40)]
    df = clusters.features(frame(spark, rows, "id long, a double, b double"), ["a", "b"])
    got = clusters.topics(df, 2, ["id"]).toPandas().set_index("id").topics
    assert all(abs(sum(t) - 1) < 1e-9 and min(t) >= 0 for t in got)
    main = got.map(np.argmax)
    assert main[main.index % 2 == 1].nunique() == 1 and main.nunique() == 2


def test_difference_rows(spark):
    df = frame(spark, [(1, 1, 0, 0), (1, 2, 0, 3), (1, 3, 9, 0)], "fov long, label long, cy long, cx long")
    rows = sorted(map(tuple, cells.difference_rows(cells.spanning_tree(df)).collect()))
    assert rows == [(1, 1, 1, 1), (1, 1, 2, -1), (1, 2, 1, 1), (1, 2, 3, -1)]


def test_fovs_may_be_names(spark):
    mask = frame(spark, [("f", y, x, 1) for y in range(4) for x in range(4)], "fov string, y long, x long, label long")
    assert cells.hull_features(mask).first().fov == "f"
    spots = frame(spark, [("f", 1, 0, 0), ("f", 2, 0, 3)], "fov string, label long, cy long, cx long")
    assert cells.spanning_tree(spots).first().fov == "f"
