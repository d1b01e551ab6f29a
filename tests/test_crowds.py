"""Queries over one fov in which very many cells share few places: the rows of a small copy, scaled, and no work per pair of cells."""

import time

import duckdb
import pandas as pd
import pytest

from tissuelake.operators import clusters, spatial
from tissuelake.plans import registry
from tissuelake.plans.masks import TYPES

KEYS, COPIES, SECONDS = 48, 400, 40


def table(path, copies):
    """KEYS cells, ``copies`` times at their places (keys 512 apart have one place)."""
    path.mkdir()
    keys = [k + 512 * i for i in range(copies) for k in range(KEYS)]
    rows = pd.DataFrame({"c_custkey": keys, "c_nationkey": 3, "c_mktsegment": [TYPES[k % 512 % 5] for k in keys]})
    rows.astype({"c_nationkey": "int32"}).to_parquet(path / "customer.parquet")
    return str(path)


#: name -> (copies of the small table, the power of the number of copies by which a column grows)
CASES = {
    "neighborhood_counts": (1, {"n": 1}),
    "neighborhood_freqs": (1, {}),
    "self_neighbor_counts": (1, {"n": 1}),
    "self_neighbor_freqs": (1, {}),
    "shannon_diversity": (1, {}),
    "knn_from_pairs": (2, {}),
    "cell_ratios": (1, {}),
    "mixing_populations": (1, {"n": 1}),
    "neighborhood_matrix": (1, dict.fromkeys(TYPES, 1)),
    "cluster_markers": (1, {}),
    "cluster_types": (1, dict.fromkeys(TYPES, 1)),
    "neighborhood_write_back": (1, {}),
    "profile_zscores": (1, {}),
    "featurize_count": (1, {"n": 1}),
    "featurize_avg_marker": (1, {}),
    "featurize_cluster": (1, dict.fromkeys(TYPES, 1)),
    "featurize_marker": (1, {"cy": 1, "cx": 1}),
    "marker_contacts": (1, {"n": 2}),
    "near_anchor": (1, {}),
    "close_cell_pairs": (1, {"n": 2}),
    "mean_knn_distance": (5, {}),
}


@pytest.mark.parametrize("name", CASES)
def test_crowd(spark, tmp_path, name):
    few, power = CASES[name]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{table(tmp_path / 'few', few)}/customer.parquet'")
    want, many = con.execute(registry.ORACLES[name]).df(), table(tmp_path / "many", COPIES)
    began = time.time()
    got = registry.QUERIES[name](spark, many).toPandas()
    assert time.time() - began < SECONDS
    key = [c for c in ("fov", "label", "cell_type", "nb_type", "type_a", "type_b", "cluster") if c in want.columns and c not in power]
    if "label" in key:
        assert len(got) == len(want) * COPIES // few
        got = got[got["label"] < 512 * few]
    got, want = (x.sort_values(key).reset_index(drop=True) for x in (got, want))
    for c, p in power.items():
        want[c] = want[c] * (COPIES // few) ** p
    pd.testing.assert_frame_equal(got[want.columns], want, check_dtype=False, atol=1.01e-6, rtol=0)


def blobs(spark, copies):
    rows = spark.range(60 * copies).selectExpr("id", "cast(id % 60 div 15 * 50 + id % 60 % 15 % 4 as double) a", "cast(id % 60 div 15 % 2 * 80 + id % 60 % 15 div 4 as double) b")
    return clusters.features(rows, ["a", "b"])


def test_kmeans_takes_equal_rows_once(spark):
    points = clusters.weighted(blobs(spark, 500))
    assert (points.count(), points.rdd.getNumPartitions(), points.groupBy().sum("weight").first()[0]) == (60, 1, 30_000)
    few, many = (clusters.best_kmeans(blobs(spark, n), 4) for n in (1, 500))
    assert many.summary.trainingCost == pytest.approx(500 * few.summary.trainingCost)
    made = clusters.neighborhood_clusters(blobs(spark, 500), 4, ["id"]).selectExpr("id % 60 div 15 g", "cluster").distinct()
    assert made.count() == made.select("cluster").distinct().count() == 4


def test_scan_of_equal_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(clusters, "weighted", lambda v, real=clusters.weighted: seen.append(real(v)) or seen[-1])
    (k, one, s), (k2, many, s2) = (clusters.kmeans_scan(blobs(spark, n), range(4, 5)).first() for n in (1, 500))
    assert k == k2 == 4 and many == pytest.approx(500 * one) and [p.count() for p in seen] == [60, 60]
    assert 0.9 < s < s2 < 1


def test_topics_of_equal_rows(spark, monkeypatch):
    """Every row has its topics, and a vector that 500 rows share is inferred once."""
    seen = []

    class Watched(clusters.LDA):
        def fit(self, rows):
            model = super().fit(rows)
            transform = model.transform
            model.transform = lambda v: seen.append(v.count()) or transform(v)
            return model

    monkeypatch.setattr(clusters, "LDA", Watched)
    made = clusters.topics(blobs(spark, 500), 3, ["id"]).selectExpr("id % 60 g", "topics").groupBy("g").agg({"topics": "count"})
    assert {tuple(r) for r in made.collect()} == {(g, 500) for g in range(60)} and seen == [60]


#: learned and all-pairs queries over the neighbour matrix
OVER_MATRIX = ["pair_distance_sums", "within_cluster_sums", "pca"]


@pytest.mark.parametrize("name", OVER_MATRIX)
def test_no_pairs_of_cells(spark, monkeypatch, name):
    monkeypatch.setattr(spatial, "pairs", None)
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
