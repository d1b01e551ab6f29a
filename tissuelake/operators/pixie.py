"""Pixel matrices, self-organising maps with kept weights, and consensus clustering of their nodes."""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .clusters import assign_nodes, ward
from .images import blur, per_image


def _row_sum(channels: list[str]):
    return sum((F.col(c) for c in channels), F.lit(0.0))


def pixel_matrix(pixels: DataFrame, channels: list[str], threshold: float = 0.0) -> DataFrame:
    """Pixels whose channels sum to more than ``threshold`` and are not all zero, each row divided by its sum."""
    some = F.lit(False)
    for c in channels:
        some = some | (F.coalesce(F.col(c), F.lit(0.0)) != 0)
    kept = pixels.filter((_row_sum(channels) > threshold) & some)
    total = _row_sum(channels)
    return kept.select(*[c for c in pixels.columns if c not in channels], *[F.try_divide(F.col(c), total).alias(c) for c in channels])


def training_rows(rows: DataFrame, share: float, order: list[str], seed: int = 42) -> DataFrame:
    """The share of each fov's rows that comes first by a hash: the same rows on every run."""
    place = F.row_number().over(Window.partitionBy("fov").orderBy(F.xxhash64(F.lit(seed), *order), *order))
    size = F.count(F.lit(1)).over(Window.partitionBy("fov"))
    return rows.withColumns({"__r": place, "__n": size}).filter(F.col("__r") <= F.bround(F.col("__n") * share)).drop("__r", "__n")


def divided(rows: DataFrame, norms: dict[str, float]) -> DataFrame:
    """Columns divided by their norm; a column without a row is an error."""
    gone = [c for c in norms if c not in rows.columns]
    if gone:
        raise ValueError(f"columns not in the table: {gone}")
    return rows.withColumns({c: F.try_divide(F.col(c).cast("double"), F.lit(float(v))) for c, v in norms.items()})


def nonzero_quantiles(rows: DataFrame, columns: list[str], q: float = 0.999) -> dict[str, float]:
    """Each column's quantile over all rows, zeros left out; one for a column of zeros."""
    made = rows.agg(*[F.percentile(F.nullif(F.col(c).cast("double"), F.lit(0.0)), F.lit(q)).alias(c) for c in columns]).first()
    return {c: made[c] if made[c] is not None else 1.0 for c in columns}


def image_pixels(images: DataFrame, channels: list[str], norms: dict[str, float], sigma: float = 2.0, mask: DataFrame | None = None) -> DataFrame:
    """Images (fov, channel, y, x, value) as a row a pixel: channels divided by their norms and blurred, with the mask's label."""
    gone = set(channels) - {r[0] for r in images.select("channel").distinct().collect()}  # a row a channel
    if gone:
        raise ValueError(f"channels without an image: {sorted(gone)}")
    table = F.create_map(*[x for c in channels for x in (F.lit(c), F.lit(float(norms.get(c, 1.0))))])
    scaled = images.filter(F.col("channel").isin(channels)).withColumn("value", F.col("value") / table[F.col("channel")])
    smooth = per_image(scaled, ["fov", "channel"], "value", "value", "double", lambda i: blur(i, sigma)) if sigma else scaled
    wide = smooth.groupBy("fov", "y", "x").pivot("channel", channels).agg(F.first("value"))
    if mask is None:
        return wide
    return wide.join(mask.select("fov", "y", "x", "label"), ["fov", "y", "x"], "left").na.fill(0, ["label"])


def save_pixel_matrix(spark: SparkSession, images: DataFrame, channels: list[str], path: str, norms: dict[str, float], sigma: float = 2.0, threshold: float = 0.0, share: float = 0.1, seed: int = 42, mask: DataFrame | None = None) -> list:
    """Writes the pixel matrix and its training share below ``path``, for the fovs that are not there yet; names them.

    Another list of channels than the one kept in ``path`` starts again from nothing.
    """
    kept = read_json(spark, f"{path}/channels")
    fresh = kept != sorted(channels)
    wanted = images.select("fov").distinct()
    if not fresh:
        wanted = wanted.join(spark.read.schema(images.select("fov").schema).parquet(f"{path}/pixels").distinct(), "fov", "left_anti")
    elif kept is not None:
        warnings.warn("another list of channels: all fovs are processed again", stacklevel=2)
    todo = [r[0] for r in wanted.orderBy("fov").collect()]  # a row a fov
    if not todo:
        return []
    some = images.filter(F.col("fov").isin(todo))
    rows = pixel_matrix(image_pixels(some, channels, norms, sigma, mask), channels, threshold)
    mode = "overwrite" if fresh else "append"
    rows.write.mode(mode).partitionBy("fov").parquet(f"{path}/pixels")
    back = spark.read.schema(rows.schema).parquet(f"{path}/pixels").filter(F.col("fov").isin(todo))
    training_rows(back, share, ["y", "x"], seed).write.mode(mode).partitionBy("fov").parquet(f"{path}/training")
    write_json(spark, sorted(channels), f"{path}/channels")
    return todo


def write_json(spark: SparkSession, value, path: str) -> None:
    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str):
    """What ``write_json`` wrote, or None where nothing is."""
    try:
        return json.loads("".join(r[0] for r in spark.read.text(path).collect()) or "null")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def without_column(spark: SparkSession, paths: dict[str, str], column: str) -> list[str]:
    """Names of tables (name -> path) that lack a column or cannot be read."""
    out = []
    for name, path in sorted(paths.items()):
        try:
            if column not in spark.read.parquet(path).columns:
                out.append(name)
        except Exception:  # noqa: BLE001 - an unreadable table has to be made again
            out.append(name)
    return out


def modified_channels(chosen: list[str], present: list[str], endings: tuple[str, ...] = ("_smoothed", "_nuc_include", "_nuc_exclude")) -> list[str]:
    """Present channels that are changed versions of chosen ones."""
    return [c + e for c in chosen for e in endings if c + e in present]


# -- self-organising map by the online rule


def train_nodes(x: np.ndarray, xdim: int, ydim: int, passes: int = 1, rates: tuple[float, float] = (0.05, 0.01), seed: int = 42) -> np.ndarray:
    """Nodes after ``passes`` times len(x) draws of a row.

    A draw moves the nearest node and those within the radius (in steps on the grid, diagonals count one) towards the
    row. The rate falls from the first to the second in a straight line, the radius from the 67 % quantile of the nodes'
    distances to zero; below one only the nearest node moves.
    """
    rng = np.random.default_rng(seed)
    grid = np.stack(np.unravel_index(np.arange(xdim * ydim), (xdim, ydim)), 1)
    apart = np.abs(grid[:, None] - grid[None]).max(2)
    nodes = x[rng.choice(len(x), xdim * ydim, replace=len(x) < xdim * ydim)].astype(float)
    draws = rng.integers(0, len(x), passes * len(x))
    start = float(np.quantile(apart, 0.67))
    for i, row in enumerate(draws):
        radius = start * (1 - i / len(draws))
        near = int(((nodes - x[row]) ** 2).sum(1).argmin())
        moved = apart[near] <= (radius if radius >= 1 else 0.5)
        nodes[moved] += (rates[0] - (rates[0] - rates[1]) * i / len(draws)) * (x[row] - nodes[moved])
    return nodes


@dataclass
class SomCluster:
    """A map over ``columns`` whose weights are a table at ``path``.

    The online rule goes row by row, so it runs on the driver over the training rows, about ``most`` of them at most
    (chosen by a hash); assignment goes over all rows on the executors.
    """

    spark: SparkSession
    path: str
    columns: list[str]
    xdim: int = 10
    ydim: int = 10
    passes: int = 1
    rates: tuple[float, float] = (0.05, 0.01)
    seed: int = 42
    most: int = 1_000_000
    weights: pd.DataFrame | None = field(default=None, init=False)

    def __post_init__(self) -> None:
        try:
            self.weights = self.spark.read.parquet(self.path).orderBy("node").toPandas().drop(columns="node")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise

    def train(self, rows: DataFrame, overwrite: bool = False) -> bool:
        """Trains unless weights for the same columns are there; tells whether it did."""
        if overwrite:
            warnings.warn("overwrite: the map is trained again", stacklevel=2)
        elif self.weights is not None:
            if set(self.weights.columns) == set(self.columns):
                warnings.warn("the map is trained on these columns already", stacklevel=2)
                return False
            warnings.warn("other columns: the map is trained again", stacklevel=2)
        self._need(rows, self.columns)
        data = rows.select(*[F.col(c).cast("double").alias(c) for c in self.columns]).dropna()
        n = data.count()
        if n > self.most:
            data = data.filter(F.pmod(F.xxhash64(F.lit(self.seed), *self.columns), F.lit(1 << 30)) < self.most / n * (1 << 30))
        x = data.orderBy(*self.columns).toPandas().to_numpy()
        if not len(x):
            raise ValueError("no rows to train on")
        nodes = train_nodes(x, self.xdim, self.ydim, self.passes, self.rates, self.seed)
        self.weights = pd.DataFrame(nodes, columns=self.columns)
        table = self.weights.rename_axis("node").reset_index()
        self.spark.createDataFrame(table).coalesce(1).write.mode("overwrite").parquet(self.path)
        return True

    def _need(self, rows: DataFrame, columns: list[str]) -> None:
        gone = [c for c in columns if c not in rows.columns]
        if gone:
            raise ValueError(f"columns not in the table: {gone}")

    def assign(self, rows: DataFrame, name: str = "som_cluster") -> DataFrame:
        """``rows`` with the number, from 1, of the nearest node; the weights' columns must be there, in any order."""
        if self.weights is None:
            raise ValueError("the map is not trained")
        names = list(self.weights.columns)
        self._need(rows, names)
        keep = [c for c in rows.columns if c != name]
        vector = rows.select(*keep, F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names]).alias("__v"))
        return assign_nodes(vector, "__v", self.weights.to_numpy(), name, keep)


# -- consensus clustering


class Ward:
    """A clusterer: any class that takes ``n_clusters`` and labels rows by ``fit_predict`` can stand in its place."""

    def __init__(self, n_clusters: int):
        self.n_clusters = n_clusters

    def fit_predict(self, x: np.ndarray) -> np.ndarray:
        return ward(np.asarray(x, float), self.n_clusters) - 1


class ConsensusCluster:
    """How often two rows fall together when shares of the rows are clustered into k, for k from ``low`` below ``high``.

    ``agreement[k]`` holds the share of the resamplings with both rows that put them together; ``area[k]`` the area under
    its distribution function, ``gain`` the growth of the areas, and ``best`` the k of largest growth. It works on
    the few hundred nodes of a map, in memory.
    """

    def __init__(self, cluster: Callable = Ward, low: int = 2, high: int = 10, times: int = 10, share: float = 0.8, seed: int = 42):
        if not 0 <= share <= 1:
            raise ValueError("share has to be between 0 and 1")
        self.cluster, self.low, self.high, self.times, self.share, self.seed = cluster, low, high, times, share, seed
        self.agreement: dict[int, np.ndarray] = {}
        self.area: dict[int, float] = {}
        self.gain: np.ndarray = np.zeros(0)
        self.best: int | None = None

    def fit(self, x: np.ndarray) -> ConsensusCluster:
        rng, n = np.random.default_rng(self.seed), len(x)
        for k in range(self.low, self.high):
            together, drawn = np.zeros((n, n)), np.zeros((n, n))
            for _ in range(self.times):
                some = rng.choice(n, int(n * self.share), replace=False)
                label = np.asarray(self.cluster(n_clusters=k).fit_predict(x[some]))
                drawn[np.ix_(some, some)] += 1
                together[np.ix_(some, some)] += label[:, None] == label[None]
            share = together / (drawn + 1e-8)
            np.fill_diagonal(share, 1)
            self.agreement[k] = share
            height, edge = np.histogram(share, density=True)
            self.area[k] = float((np.cumsum(height) * np.diff(edge)).sum())
        a = np.array([self.area[k] for k in range(self.low, self.high)])
        # the first areas count as they are, later ones by their relative growth
        self.gain = np.array([(b - c) / c if k > 2 else c for b, c, k in zip(a[1:], a[:-1], range(self.low, self.high - 1), strict=False)])
        self.best = self.low + int(self.gain.argmax()) if len(self.gain) else self.low
        return self

    def predict(self) -> np.ndarray:
        """Labels by clustering the distances 1 - agreement at the best k."""
        return self.cluster(n_clusters=self._fitted()).fit_predict(1 - self.agreement[self._fitted()])

    def predict_data(self, x: np.ndarray) -> np.ndarray:
        """Labels by clustering the rows themselves into the best k."""
        return self.cluster(n_clusters=self._fitted()).fit_predict(x)

    def _fitted(self) -> int:
        if self.best is None:
            raise ValueError("not fitted")
        return self.best


def scaled(x: np.ndarray, cap: float = 3.0) -> np.ndarray:
    """Columns as z-scores (population deviation) within +-cap; constant ones become zero."""
    spread = x.std(0) if len(x) else 1.0
    return np.clip((x - (x.mean(0) if len(x) else 0)) / np.where(spread > 0, spread, 1), -cap, cap)


def consensus_map(means: DataFrame, node: str, columns: list[str], meta: str, k: int = 20, cap: float = 3.0, cluster: Callable = Ward) -> DataFrame:
    """(node, meta): every map node's meta cluster, from 1, by its scaled means; a row a node, so a small table."""
    rows = means.select(node, *columns).orderBy(node).toPandas()
    found = ConsensusCluster(cluster, k, k).fit(scaled(rows[columns].to_numpy(float)))
    label = found.predict_data(scaled(rows[columns].to_numpy(float))) + 1
    kind = means.schema[node].dataType.simpleString()
    pairs = [(a, int(b)) for a, b in zip(rows[node].tolist(), label, strict=True)]
    return means.sparkSession.createDataFrame(pairs, f"`{node}` {kind}, `{meta}` int")


def remapped(rows: DataFrame, mapping: DataFrame, node: str, meta: str, name: str) -> DataFrame:
    """``rows`` with the mapping's meta cluster and its name.

    Every node of ``rows`` must be in the mapping, and a name must belong to one meta cluster; else it is an error.
    """
    two = mapping.groupBy(name).agg(F.countDistinct(meta).alias("n")).filter("n > 1").limit(5).collect()
    if two:
        raise ValueError(f"names of several meta clusters: {sorted(r[name] for r in two)}")
    lost = rows.select(node).distinct().join(mapping, node, "left_anti").limit(5).collect()
    if lost:
        raise ValueError(f"nodes without a meta cluster: {sorted(r[0] for r in lost)}")
    return rows.drop(meta, name).join(mapping.select(node, meta, name), node, "left")


def averages(rows: DataFrame, by: str, columns: list[str], fovs: int | None = None, seed: int = 42, keep_count: bool = True) -> DataFrame:
    """Means per cluster, over ``fovs`` fovs chosen by a hash or over all."""
    if fovs is not None:
        some = rows.select("fov").distinct().orderBy(F.xxhash64(F.lit(seed), "fov"), "fov").limit(fovs)
        rows = rows.join(some, "fov", "left_semi")
    made = rows.groupBy(by).agg(*[F.round(F.avg(c), 6).alias(c) for c in columns], F.count(F.lit(1)).alias("count"))
    return made if keep_count else made.drop("count")

