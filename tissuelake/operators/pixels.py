"""Pixel maths and cell quantification: percentiles, normalisation, cluster means, counts per cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def channel_percentiles(pixels: DataFrame, channels: list[str], q: float) -> DataFrame:
    """Per channel, the mean over fovs of the fov's exact non-zero quantile."""
    each = pixels.groupBy("fov").agg(*[F.percentile(F.nullif(F.col(c), F.lit(0.0)), F.lit(q)).alias(c) for c in channels])
    return each.agg(*[F.round(F.avg(c), 6).alias(c) for c in channels])


def intensity_threshold(pixels: DataFrame, scale: dict[str, float], q: float) -> DataFrame:
    """Mean over fovs of the quantile of the summed, scaled channels."""
    total = sum((F.col(c) / F.lit(v) for c, v in scale.items()), F.lit(0.0))
    return pixels.groupBy("fov").agg(F.percentile(total, F.lit(q)).alias("v")).agg(F.round(F.avg("v"), 6).alias("threshold"))


def normalize_rows(pixels: DataFrame, channels: list[str], keep: list[str]) -> DataFrame:
    total = sum((F.col(c) for c in channels), F.lit(0.0))
    return pixels.select(*keep, *[F.round(F.try_divide(F.col(c), total), 6).alias(c) for c in channels])


def cluster_means(rows: DataFrame, cluster: str, channels: list[str]) -> DataFrame:
    return rows.groupBy(cluster).agg(*[F.round(F.avg(c), 6).alias(c) for c in channels], F.count(F.lit(1)).alias("n"))


def c2pc(pixels: DataFrame, clusters: list[str], normalize: bool = False) -> DataFrame:
    """Pixels per cell and cluster; ``normalize`` divides by the cell's pixels."""
    wide = pixels.groupBy("fov", "label").pivot("cluster", clusters).agg(F.count(F.lit(1))).na.fill(0, clusters)
    size = sum((F.col(c) for c in clusters), F.lit(0))
    return wide.select("fov", "label", *[(F.round(F.col(c) / size, 6) if normalize else F.col(c)).alias(c) for c in clusters])


def weighted_channels(pixels: DataFrame, channels: list[str]) -> DataFrame:
    """Per cell, the cluster means of its pixels weighted by their numbers, over its size."""
    means = pixels.groupBy("cluster").agg(*[F.avg(c).alias(f"m_{c}") for c in channels])
    counts = pixels.groupBy("fov", "label", "cluster").agg(F.count(F.lit(1)).alias("n"))
    joined = counts.join(means, "cluster")
    return joined.groupBy("fov", "label").agg(*[F.round(F.sum(F.col("n") * F.col(f"m_{c}")) / F.sum("n"), 6).alias(c) for c in channels])


def zscore_clip(rows: DataFrame, channels: list[str], cap: float, keep: list[str]) -> DataFrame:
    """Population z-scores clipped to +-cap; the statistics are one row, joined to all."""
    stats = rows.agg(*[F.avg(c).alias(f"a_{c}") for c in channels], *[F.stddev_pop(c).alias(f"s_{c}") for c in channels])
    z = lambda c: F.try_divide(F.col(c) - F.col(f"a_{c}"), F.col(f"s_{c}"))
    return rows.crossJoin(F.broadcast(stats)).select(*keep, *[F.round(F.greatest(F.least(z(c), F.lit(cap)), F.lit(-cap)), 6).alias(c) for c in channels])


def cell_table(pixels: DataFrame, channels: list[str], mode: str = "total_intensity", threshold: float = 0.0) -> DataFrame:
    """cell_size and channels per (fov, label); modes: total_intensity, positive_pixel (pixels above threshold)."""
    signal = {"total_intensity": lambda c: F.round(F.sum(c), 6), "positive_pixel": lambda c: F.count_if(F.col(c) > threshold)}[mode]
    return pixels.groupBy("fov", "label").agg(F.count(F.lit(1)).alias("cell_size"), *[signal(c).alias(c) for c in channels])


def transform_expression(cells: DataFrame, channels: list[str], transform: str) -> DataFrame:
    change = {"size_norm": lambda c: F.when(F.col("cell_size") > 0, F.col(c) / F.col("cell_size")), "arcsinh": lambda c: F.asinh(F.col(c) * 100)}[transform]
    return cells.select("fov", "label", "cell_size", *[F.round(change(c), 6).alias(c) for c in channels])


def histogram(rows: DataFrame, column: str, lo: float, hi: float, bins: int) -> DataFrame:
    at = F.least(F.floor((F.col(column) - lo) / F.lit((hi - lo) / bins)), F.lit(bins - 1))
    return rows.filter(F.col(column).between(lo, hi)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def order_by_count(rows: DataFrame, column: str) -> DataFrame:
    n = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), column)))  # a row a category
