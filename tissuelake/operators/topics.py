"""Choosing a number of neighbourhood topics: formatted cells, gap statistic and the table of candidates' figures."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clusters import features, silhouette
from .distances import pair_sums

FEATURIZATIONS = ("cluster", "marker", "avg_marker", "count")


def check_arguments(cells: DataFrame, markers: list[str] | None, clusters: list[str] | None, featurization: str | None = None, radius: int | None = None) -> None:
    """Raises ValueError for arguments that the functions here cannot work with."""
    if markers is None and clusters is None:
        raise ValueError("markers or clusters must be given")
    for c in ("fov", "label", "cell_type", "cy", "cx", *(markers or [])):
        if c not in cells.columns:
            raise ValueError(f"column {c} is not in the cell table")
    if clusters is not None:
        held = {r[0] for r in cells.filter(F.col("cell_type").isin(clusters)).select("cell_type").distinct().collect()}
        if set(clusters) - held:
            raise ValueError(f"no cells of types {sorted(set(clusters) - held)}")
    if featurization is not None and featurization not in FEATURIZATIONS:
        raise ValueError(f"featurization must be one of {FEATURIZATIONS}")
    if featurization in ("marker", "avg_marker") and not markers:
        raise ValueError(f"{featurization} needs markers")
    if radius is not None and radius < 25:
        raise ValueError("radius must be at least 25")


def format_cells(cells: DataFrame, markers: list[str] | None = None, clusters: list[str] | None = None) -> DataFrame:
    """The columns that topics need: fov, label, cluster, y, x, markers, and a flag for reference cells; chosen types alone."""
    check_arguments(cells, markers, clusters)
    rows = cells if clusters is None else cells.filter(F.col("cell_type").isin(clusters))
    return rows.select("fov", "label", F.col("cell_type").alias("cluster"), F.col("cy").alias("y"), F.col("cx").alias("x"), *(markers or []), F.lit(True).alias("is_index"))


def within_cluster_sums(rows: DataFrame, cluster: str, columns: list[str]) -> DataFrame:
    """One row: over clusters, the sum of distances between a cluster's rows over twice their number."""
    sums = pair_sums(rows, cluster, columns)
    return sums.agg(F.round(F.sum(F.col("distance_sum") / (2 * F.col("n"))), 6).alias("within"))


def _clustered(rows: DataFrame, columns: list[str], k: int, seed: int) -> tuple[DataFrame, float]:
    vectors = features(rows.select(*[F.col(c).cast("double").alias(c) for c in columns]), columns)
    model = KMeans(k=k, seed=seed).fit(vectors)
    parts = vector_to_array("features")
    return model.transform(vectors).select(*[parts[i].alias(c) for i, c in enumerate(columns)], F.col("prediction").alias("cluster")), float(model.summary.trainingCost)


def uniform_like(rows: DataFrame, columns: list[str], seed: int) -> DataFrame:
    """As many rows as ``rows`` has, uniform over each column's range."""
    found = rows.agg(F.count(F.lit(1)).alias("n"), *[F.min(c).cast("double").alias(f"lo_{c}") for c in columns], *[F.max(c).cast("double").alias(f"hi_{c}") for c in columns]).first()
    draw = lambda i, c: (F.lit(found[f"lo_{c}"]) + F.rand(seed * 1000 + i) * F.lit(found[f"hi_{c}"] - found[f"lo_{c}"])).alias(c)
    return rows.sparkSession.range(found["n"]).select(*[draw(i, c) for i, c in enumerate(columns)])


def gap_statistic(rows: DataFrame, columns: list[str], k: int, within: float, boots: int = 25, seed: int = 42) -> tuple[float, float]:
    """Mean log within-cluster sum of ``boots`` uniform tables less that of the data, and its scaled deviation."""
    import numpy as np

    logs = []
    for b in range(boots):
        made, _ = _clustered(uniform_like(rows, columns, seed + b).persist(), columns, k, seed + b)
        logs.append(float(np.log(within_cluster_sums(made, "cluster", columns).first()[0])))
    return float(np.mean(logs) - np.log(within)), float(np.std(logs) * np.sqrt(1 + 1 / boots))


def topic_figures(rows: DataFrame, columns: list[str], topics: list[int], with_silhouette: bool = False, boots: int | None = None, seed: int = 42) -> DataFrame:
    """A row a candidate and cluster: k, inertia, silhouette, gap, gap_sd, cluster, and the sums of the features in it.

    Without ``boots`` there is no gap statistic; fewer than 25 are an error, as are candidates of 2 or less or beyond the
    rows.
    """
    if boots is not None and boots < 25:
        raise ValueError("at least 25 resamplings")
    n = rows.count()
    if min(topics) <= 2 or max(topics) >= n - 1:
        raise ValueError(f"topics must lie between 2 and {n - 1}")
    out = None
    for k in topics:
        made, inertia = _clustered(rows, columns, k, seed)
        made = made.persist()
        score = silhouette(made, columns, "cluster").first()[0] if with_silhouette else None
        gap = gap_statistic(rows, columns, k, within_cluster_sums(made, "cluster", columns).first()[0], boots, seed) if boots else (None, None)
        sums = made.groupBy("cluster").agg(*[F.sum(c).alias(c) for c in columns])
        figure = lambda v: F.lit(v).cast("double")
        part = sums.select(F.lit(k).alias("k"), figure(inertia).alias("inertia"), figure(score).alias("silhouette"), figure(gap[0]).alias("gap"), figure(gap[1]).alias("gap_sd"), "cluster", *columns)
        out = part if out is None else out.unionByName(part)
    return out
