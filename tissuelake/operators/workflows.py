"""Whole passes over a cohort: from pixel matrices to pixel clusters, from their counts to cell clusters, and cell tables.

Every step keeps its result below ``base`` and continues there: fovs that are done are left alone, so a stopped run is
taken up again. Means and maps of clusters are small tables.
"""

from __future__ import annotations

import re
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from . import cells as cell_ops
from . import labels, masks, pixels, pixie

NODE, META, NAME = "pixel_som_cluster", "pixel_meta_cluster", "pixel_meta_cluster_rename"


def train_pixel_som(spark: SparkSession, base: str, channels: list[str], fovs: list | None = None, overwrite: bool = False, **options) -> tuple[pixie.SomCluster, dict[str, float]]:
    """A map over the training rows in ``base``, divided by their channels' quantiles, which are kept too."""
    rows = spark.read.parquet(f"{base}/training")
    if fovs is not None:
        gone = labels.missing(fovs, rows, "fov")
        if gone:
            raise ValueError(f"no pixels of {gone}")
        rows = rows.filter(F.col("fov").isin(fovs))
    norms = pixie.read_json(spark, f"{base}/norms")
    if overwrite or norms is None or set(norms) != set(channels):
        norms = pixie.nonzero_quantiles(rows, channels)
        pixie.write_json(spark, norms, f"{base}/norms")
    som = pixie.SomCluster(spark, f"{base}/pixel_weights", channels, **options)
    som.train(pixie.divided(rows, norms), overwrite)
    return som, norms


def cluster_pixels(spark: SparkSession, base: str, som: pixie.SomCluster, norms: dict[str, float], overwrite: bool = False) -> list:
    """Writes the pixel matrix with each pixel's node to ``base``/clustered, for fovs not yet there; names them."""
    rows, target = spark.read.parquet(f"{base}/pixels"), f"{base}/clustered"
    there = not overwrite and files.exists(spark, target)
    todo = rows.select("fov").distinct()
    if there:
        todo = todo.join(spark.read.schema(rows.select("fov").schema).parquet(target).distinct(), "fov", "left_anti")
    names = [r[0] for r in todo.orderBy("fov").collect()]  # a row a fov
    if names:
        made = som.assign(pixie.divided(rows.filter(F.col("fov").isin(names)), norms), NODE)
        made.write.mode("append" if there else "overwrite").partitionBy("fov").parquet(target)
    return names


def pixel_averages(spark: SparkSession, base: str, channels: list[str], by: str = NODE, fovs: int | None = 100, expected: int | None = None) -> DataFrame:
    """Channel means and counts of the pixel clusters over some fovs; fewer than ``expected`` clusters are an error."""
    made = files.keep_or_make(spark, f"{base}/averages_{by}", lambda: pixie.averages(_mapped(spark, base), by, channels, fovs))
    if expected is not None and made.count() < expected:
        raise ValueError(f"{expected - made.count()} clusters without a pixel in the fovs chosen; take more of them")
    return made


def _mapped(spark: SparkSession, base: str) -> DataFrame:
    """Clustered pixels, with meta clusters if there is a map."""
    rows = spark.read.parquet(f"{base}/clustered")
    if not files.exists(spark, f"{base}/pixel_map"):
        return rows
    return rows.join(spark.read.parquet(f"{base}/pixel_map"), NODE, "left")  # a row a node


def pixel_consensus(spark: SparkSession, base: str, channels: list[str], k: int = 20, cap: float = 3.0) -> DataFrame:
    """The map from nodes to meta clusters, kept in ``base``/pixel_map, with the meta cluster's number as its name."""
    found = pixie.consensus_map(pixel_averages(spark, base, channels), NODE, channels, META, k, cap)
    found.withColumn(NAME, F.col(META).cast("string")).write.mode("overwrite").parquet(f"{base}/pixel_map")
    return spark.read.parquet(f"{base}/pixel_map")


def rename_pixel_meta(spark: SparkSession, base: str, mapping: DataFrame) -> DataFrame:
    """Another map (node, meta, name), checked against the pixels and kept; gives the pixels under it."""
    rows = spark.read.parquet(f"{base}/clustered")
    pixie.remapped(rows, mapping, NODE, META, NAME)
    kept = files.replace(mapping.select(NODE, META, NAME), f"{base}/pixel_map")  # the map may come from that table
    return pixie.remapped(rows, kept, NODE, META, NAME)


def cell_counts(clustered: DataFrame, cells: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """Pixels of each cluster in every cell of both tables: counts, and counts over cell_size; columns <by>_<cluster>.

    Cells in ``cells`` (fov, label, cell_size) alone and pixels outside of cells do not count.
    """
    names = sorted((r[0] for r in clustered.filter(F.col(by).isNotNull()).select(by).distinct().collect()), key=str)  # a row a cluster
    kept = cells.select("fov", F.col("label").cast("long").alias("label"), "cell_size")
    wide = clustered.filter(F.col(by).isNotNull()).groupBy("fov", "label").pivot(by, names).agg(F.count(F.lit(1))).na.fill(0)
    wide = wide.select("fov", F.col("label").cast("long").alias("label"), *[F.col(f"`{n}`").alias(f"{by}_{n}") for n in names])
    counts = kept.join(wide, ["fov", "label"])
    lost = set(f"{by}_{n}" for n in names) - set(labels.nonzero_columns(counts, [f"{by}_{n}" for n in names]).columns)
    if lost:
        warnings.warn(f"clusters without a pixel in any cell: {sorted(lost)}", stacklevel=2)
    columns = [f"{by}_{n}" for n in names if f"{by}_{n}" not in lost]
    return counts.select("fov", "label", "cell_size", *columns), counts.select("fov", "label", "cell_size", *[F.try_divide(F.col(c), F.col("cell_size")).alias(c) for c in columns])


def cluster_cells(spark: SparkSession, base: str, rows: DataFrame, columns: list[str], normalise: bool = True, overwrite: bool = False, **options) -> DataFrame:
    """Cells (fov, label, columns) with their node of a map over ``columns``, divided by their quantiles; kept in ``base``."""
    gone = [c for c in ["fov", "label", *columns] if c not in rows.columns]
    if gone:
        raise ValueError(f"columns not in the table: {gone}")
    norm = pixie.divided(rows, pixie.nonzero_quantiles(rows, columns)) if normalise else rows
    som = pixie.SomCluster(spark, f"{base}/cell_weights", columns, **options)
    som.train(norm, overwrite)
    return files.keep_or_make(spark, f"{base}/cells", lambda: som.assign(norm, "cell_som_cluster"), overwrite)


def cell_consensus(spark: SparkSession, base: str, columns: list[str], k: int = 20, cap: float = 3.0) -> DataFrame:
    """Cells with node and meta cluster, from the means of ``columns`` over all cells; the map is kept in ``base``/cell_map."""
    rows = spark.read.parquet(f"{base}/cells")
    means = files.keep_or_make(spark, f"{base}/averages_cell_som_cluster", lambda: pixie.averages(rows, "cell_som_cluster", columns))
    found = pixie.consensus_map(means, "cell_som_cluster", columns, "cell_meta_cluster", k, cap)
    found.write.mode("overwrite").parquet(f"{base}/cell_map")
    return rows.join(spark.read.parquet(f"{base}/cell_map"), "cell_som_cluster", "left")


def label_cells(cells: DataFrame, clustered: DataFrame, column: str = "cell_meta_cluster", none: str = "Unassigned") -> DataFrame:
    """The full cell table with the cells' cluster; ``none`` for cells that were not clustered."""
    found = clustered.select("fov", "label", F.col(column).cast("string").alias(column))
    return cells.drop(column).join(found, ["fov", "label"], "left").withColumn(column, F.coalesce(column, F.lit(none)))


def weighted_averages(cells: DataFrame, counts: DataFrame, means: DataFrame, by: str, columns: list[str], channels: list[str]) -> DataFrame:
    """Per cell cluster ``by``, the mean of its cells' channels: pixel cluster means weighted by the cell's counts, over its size."""
    long = counts.unpivot(["fov", "label", "cell_size"], columns, "cluster", "n").filter("n > 0")
    weight = lambda c: F.sum(F.col("n") * F.col(f"m_{c}")) / F.max("cell_size")
    each = long.join(means.select("cluster", *[F.col(c).alias(f"m_{c}") for c in channels]), "cluster").groupBy("fov", "label").agg(*[weight(c).alias(c) for c in channels])
    joined = cells.select("fov", "label", by).join(each, ["fov", "label"])
    return joined.groupBy(by).agg(*[F.round(F.avg(c), 6).alias(c) for c in channels], F.count(F.lit(1)).alias("count"))


def save_cluster_masks(mask: DataFrame, cells: DataFrame, column: str, path: str, ending: str = "") -> DataFrame:
    """A label image a fov with every cell's cluster number; gives the numbers of the names."""
    made = masks.cluster_mask(mask, cells, column).withColumnRenamed("cluster_id", "label")
    files.write_masks(made, path, ending)
    names = cells.filter(F.col(column).isNotNull()).select(column)
    return labels.dense_ids(names, column)


def cell_tables(signal: dict[str, DataFrame], channels: list[str], nuclei: DataFrame | None = None, mode: str = "total_intensity") -> tuple[DataFrame, DataFrame]:
    """Cell tables of several masks (name -> pixels with label and channels): channels over the cell's size, and asinh of
    100 times that; with ``nuclei``, nuclear columns too. Column mask_type tells the mask."""
    by_size, by_asinh = None, None
    for name, rows in signal.items():
        if nuclei is not None:
            made = cell_ops.compartment_table(rows, nuclei, channels, mode).withColumnRenamed("area", "cell_size")
        else:
            made = pixels.cell_table(rows.filter("label > 0"), channels, mode)
        sizes = {c: "cell_size" for c in channels} | ({f"{c}_nuclear": "area_nuclear" for c in channels} if nuclei is not None else {})
        made = made.withColumn("mask_type", F.lit(name))
        one = made.withColumns({c: F.round(F.coalesce(F.try_divide(F.col(c), F.col(s)), F.lit(0.0)), 6) for c, s in sizes.items()})
        two = one.withColumns({c: F.round(F.asinh(F.col(c) * 100), 6) for c in sizes})
        by_size, by_asinh = (one, two) if by_size is None else (by_size.unionByName(one), by_asinh.unionByName(two))
    return by_size, by_asinh


def mask_types(fovs: list[str], names: list[str]) -> list[str]:
    """What follows the fov in the names of mask files, once each: the parts of a fov's name must all be in the mask's."""
    parts = lambda s: {p for p in re.split(r"[^A-Za-z0-9]", s) if p}
    bare = [re.sub(r"\.tiff?$", "", n) for n in names]
    return sorted({n[len(f) :].lstrip("_") for f in fovs for n in bare if parts(f) <= parts(n)})


def copy_files(spark: SparkSession, source: str, pattern: str, target: str) -> list[str]:
    """Copies the files below ``source`` whose names match a glob; names the copies."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(source)
    return files.copy_rows(rows.select("path", "content"), target)


def save_outlines(mask: DataFrame, path: str, ending: str = "_outlines") -> list[str]:
    """A label image a fov that holds the labels' edge pixels alone."""
    rim = masks.edge(mask).select("fov", "y", "x", F.when(F.col("edge"), F.col("label")).otherwise(0).alias("label"))
    return files.write_masks(rim, path, ending)
