"""Clustering summaries on small feature tables: K-means scans, silhouette, PCA, SOM and topics."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml.clustering import LDA, KMeans, KMeansModel
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .distances import cluster_sums


def features(rows: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features").transform(rows)


def weighted(vectors: DataFrame) -> DataFrame:
    """Distinct feature vectors with their numbers of rows as weights, which K-means takes for the rows themselves.

    Some 20,000 to a partition, in a fixed order: a fit is a few hundred small jobs, so few tasks each, and starts alike.
    """
    found = vectors.select(vector_to_array("features").alias("v")).groupBy("v").agg(F.count(F.lit(1)).cast("double").alias("weight")).persist()
    parts = -(-found.count() // 20_000) or 1
    return found.repartition(parts, "v").sortWithinPartitions("v").select(array_to_vector("v").alias("features"), "weight").persist()


def best_kmeans(vectors: DataFrame, k: int, starts: int = 10, seed: int = 42) -> KMeansModel:
    """The model of least cost among ``starts`` seeds over all rows; the fits run side by side on persisted points."""
    points = weighted(vectors)
    try:
        with ThreadPoolExecutor(min(starts, 4)) as pool:
            models = list(pool.map(lambda s: KMeans(k=k, seed=s, weightCol="weight").fit(points), range(seed, seed + starts)))
    finally:
        points.unpersist()
    return min(models, key=lambda m: m.summary.trainingCost)


def silhouette(rows: DataFrame, columns: list[str], cluster: str, subsample: int | None = None, seed: int = 42) -> DataFrame:
    """One row: the mean Euclidean silhouette over rows, from exact distances between all of them.

    ``subsample`` takes that many rows of every cluster (all of smaller ones), chosen by a hash. Rows alone in their
    cluster score 0; with one cluster the result is null.
    """
    if subsample is not None:
        v = F.array(*[F.col(c).cast("double") for c in columns])
        order = Window.partitionBy(cluster).orderBy(F.xxhash64(F.lit(seed), v), v)
        rows = rows.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= subsample).drop("__r")
    own, other = F.col("g") == F.col("h"), F.col("g") != F.col("h")
    each = cluster_sums(rows, cluster, columns).groupBy("b", "i", "g", "n").agg(
        F.max(F.when(own & (F.col("m") > 1), F.col("s") / (F.col("m") - 1))).alias("near"), F.min(F.when(other, F.col("s") / F.col("m"))).alias("far")
    )
    score = F.when(F.col("far").isNull(), None).when(F.col("near").isNull() | (F.greatest("near", "far") == 0), 0.0).otherwise((F.col("far") - F.col("near")) / F.greatest("near", "far"))
    return each.agg(F.round(F.sum(score * F.col("n")) / F.sum(F.when(score.isNotNull(), F.col("n"))), 6).alias("silhouette"))


def kmeans_scan(vectors: DataFrame, ks: range, seed: int = 42, columns: list[str] | None = None, subsample: int | None = None) -> DataFrame:
    """Inertia and Euclidean silhouette for each k, fitted side by side on persisted vectors."""
    vectors = vectors.persist()
    columns, points = columns or [f"f{i}" for i in range(len(vectors.first()["features"]))], weighted(vectors)
    parts = vector_to_array("features")

    def one(k: int) -> tuple[int, float, float]:
        model = KMeans(k=k, seed=seed, weightCol="weight").fit(points)
        made = model.transform(vectors).select(*[parts[i].alias(c) for i, c in enumerate(columns)], "prediction")
        return k, float(model.summary.trainingCost), silhouette(made, columns, "prediction", subsample, seed).first()[0]

    with ThreadPoolExecutor(4) as pool:
        out = list(pool.map(one, ks))
    points.unpersist()
    vectors.unpersist()
    return vectors.sparkSession.createDataFrame(out, "k int, inertia double, silhouette double")


def pca(vectors: DataFrame, k: int, keep: list[str]) -> DataFrame:
    made = PCA(k=k, inputCol="features", outputCol="pcs").fit(vectors).transform(vectors)
    return made.select(*keep, *[vector_to_array("pcs")[i].alias(f"pc{i + 1}") for i in range(k)])


def _node_sums(rows: DataFrame, column: str, nodes: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Over all rows, each node's weighted sum of vectors and sum of weights; a task sends its sums alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, mass = np.zeros_like(nodes), np.zeros(len(nodes))
        for batch in batches:
            x = np.stack(batch[column].to_numpy()).astype(float) if len(batch) else np.zeros((0, nodes.shape[1]))
            w = weight[nearest_nodes(x, nodes)]
            total, mass = total + w.T @ x, mass + w.sum(0)
        yield pd.DataFrame({"node": range(len(nodes)), "total": list(total), "mass": mass})

    parts = rows.select(column).mapInPandas(run, "node int, total array<double>, mass double")
    sums = parts.groupBy("node").agg(F.array(*[F.sum(F.col("total")[i]) for i in range(nodes.shape[1])]).alias("total"), F.sum("mass").alias("mass")).orderBy("node").collect()  # a row a node
    return np.array([r["total"] for r in sums]), np.array([r["mass"] for r in sums])


def nearest_nodes(x: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The nearest node of every row, ties to the first."""
    out = np.zeros(len(x), int)
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = ((x[i : i + 4096, None] - nodes[None]) ** 2).sum(2).argmin(1)
    return out


def som(vectors: DataFrame, column: str, keep: list[str], side: int = 4, seed: int = 42, epochs: int = 10) -> DataFrame:
    """Self-organising map by batch epochs over all rows; every row gets its nearest node, from 1.

    Rows with a null vector or component take no part; an empty table gives no rows. First nodes are the rows of least hash.
    """
    rows = vectors.filter(F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull()))
    first = rows.select(F.col(column).alias("v")).distinct().orderBy(F.xxhash64(F.lit(seed), "v"), "v").limit(side * side).collect()
    if not first:
        return rows.select(*keep, F.lit(None).cast("int").alias("node"))
    x = np.array([r["v"] for r in first], float)
    nodes = x[np.arange(side * side) % len(x)]
    grid = np.stack(np.unravel_index(np.arange(side * side), (side, side)), 1)
    apart = ((grid[:, None] - grid[None]) ** 2).sum(2)
    for e in range(epochs):
        width = max(0.5, side / 2 * (1 - e / epochs))
        total, mass = _node_sums(rows, column, nodes, np.exp(-apart / (2 * width**2)))
        nodes = np.where(mass[:, None] > 1e-12, total / np.maximum(mass[:, None], 1e-12), nodes)
    return assign_nodes(rows, column, nodes, "node", keep)


def assign_nodes(rows: DataFrame, column: str, nodes: np.ndarray, name: str, keep: list[str]) -> DataFrame:
    """``keep`` and the number, from 1, of the node nearest to ``column``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.stack(batch[column].to_numpy()).astype(float) if len(batch) else np.zeros((0, nodes.shape[1]))
            yield batch[keep].assign(**{name: nearest_nodes(x, nodes) + 1})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"`{name}` int"])
    return rows.select(*dict.fromkeys([*keep, column])).mapInPandas(run, schema)


def topics(vectors: DataFrame, k: int, keep: list[str], seed: int = 42) -> DataFrame:
    """Every row's topics by LDA over all rows, which are persisted for the fit's passes; equal rows have equal topics, inferred once."""
    vectors = vectors.persist()
    v = vector_to_array("features")
    model = LDA(k=k, seed=seed, maxIter=10).fit(vectors)
    each = model.transform(vectors.select(v.alias("v")).distinct().select("v", array_to_vector("v").alias("features")))
    each = each.select("v", vector_to_array("topicDistribution").alias("topics"))
    return vectors.withColumn("v", v).join(each, "v").select(*keep, "topics")


def as_vector(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn("features", array_to_vector(F.col(column).cast("array<double>")))


def ward(points: np.ndarray, k: int) -> np.ndarray:
    """Labels 1..k by agglomeration that adds least to the summed squares; numbered by first member."""
    size, centre = np.ones(len(points)), points.astype(float).copy()
    member = np.arange(len(points))
    alive = list(range(len(points)))
    while len(alive) > k:
        c, n = centre[alive], size[alive]
        cost = ((c[:, None] - c[None]) ** 2).sum(2) * (n[:, None] * n[None]) / (n[:, None] + n[None])
        cost[np.tril_indices(len(alive))] = np.inf
        i, j = (alive[v] for v in np.unravel_index(cost.argmin(), cost.shape))
        centre[i] = (size[i] * centre[i] + size[j] * centre[j]) / (size[i] + size[j])
        size[i] += size[j]
        member[member == j] = i
        alive.remove(j)
    return np.searchsorted(np.array(alive), member) + 1


def meta_clusters(means: DataFrame, cluster: str, columns: list[str], k: int, cap: float = 3.0) -> DataFrame:
    """Meta cluster of every cluster, from its z-scored (population deviation), clipped channel means.

    ``means`` has a row a SOM node (a few hundred at most), so it is gathered on the driver.
    """
    rows = means.select(cluster, *columns).orderBy(cluster).collect()
    x = np.array([r[1:] for r in rows], float).reshape(len(rows), len(columns))
    spread = x.std(0) if len(x) else np.ones(len(columns))
    z = np.clip((x - x.mean(0)) / np.where(spread > 0, spread, 1), -cap, cap) if len(x) else x
    kind = means.schema[cluster].dataType.simpleString()
    return means.sparkSession.createDataFrame([(r[0], int(m)) for r, m in zip(rows, ward(z, k), strict=True)], f"{cluster} {kind}, meta long")


def neighborhood_clusters(vectors: DataFrame, k: int, keep: list[str], seed: int = 42, starts: int = 10) -> DataFrame:
    """K-means over neighbourhood vectors, the best of ``starts``; ids start at 1."""
    if k < 2:
        raise ValueError("at least two clusters")
    made = best_kmeans(vectors, k, starts, seed).transform(vectors)
    return made.select(*keep, (F.col("prediction") + 1).alias("cluster"))


def cluster_profile(cells: DataFrame, labels: DataFrame, types: list[str], markers: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells with their neighbourhood cluster; per cluster, cells of each type; per cluster, the markers' means."""
    joined = cells.join(labels.select("fov", "label", "cluster"), ["fov", "label"])
    name = F.concat(F.lit("Cluster"), F.col("cluster"))
    counts = joined.groupBy(name.alias("cluster")).agg(*[F.count_if(F.col("cell_type") == t).alias(t) for t in types])
    return joined, counts, joined.groupBy(name.alias("cluster")).agg(*[F.round(F.avg(m), 6).alias(m) for m in markers])


def profile_zscores(means: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Every column's z-score (population deviation) over the rows of a small table; a constant column gives null."""
    stats = means.agg(*[F.avg(c).alias(f"__a_{c}") for c in columns], *[F.stddev_pop(c).alias(f"__s_{c}") for c in columns])
    z = lambda c: F.round(F.try_divide(F.col(c) - F.col(f"__a_{c}"), F.col(f"__s_{c}")), 6)
    return means.crossJoin(F.broadcast(stats)).select(key, *[z(c).alias(c) for c in columns])  # the statistics are one row
