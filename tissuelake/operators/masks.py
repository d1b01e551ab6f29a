"""Masks as long tables (fov, y, x, label), label 0 being background: erosion, merging, composites, stitching.

Pixels meet by their coordinates, so an image of any size is spread over many tasks; rows with null coordinates match
nothing and stay out of the results of joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIXEL = ["fov", "y", "x"]


def edge(mask: DataFrame, height: int | None = None, width: int | None = None) -> DataFrame:
    """The mask with a flag for pixels that differ from one of their four neighbours; the image's rim is no edge.

    Pixels that are not given are background. The image is ``height`` by ``width`` from (0, 0), else the frame of the
    fov's given pixels.
    """
    frame = mask.groupBy("fov").agg(F.min("y").alias("__y0"), F.max("y").alias("__y1"), F.min("x").alias("__x0"), F.max("x").alias("__x1"))  # a row a fov
    if height is not None and width is not None:
        frame = frame.select("fov", F.lit(0).alias("__y0"), F.lit(height - 1).alias("__y1"), F.lit(0).alias("__x0"), F.lit(width - 1).alias("__x1"))
    rows, differs = mask.join(frame, "fov"), F.lit(False)
    for line, along in (("y", "x"), ("x", "y")):
        window = Window.partitionBy("fov", line).orderBy(along)
        for step, take, rim in ((-1, F.lag, f"__{along}0"), (1, F.lead, f"__{along}1")):
            touching = take(along).over(window) == F.col(along) + step
            near = F.when(touching, take("label").over(window)).otherwise(F.lit(0))
            differs = differs | ((F.col(along) != F.col(rim)) & (F.coalesce(near, F.lit(0)) != F.coalesce("label", F.lit(0))))
    return rows.withColumn("edge", differs).drop("__y0", "__y1", "__x0", "__x1")


def erode(mask: DataFrame, height: int | None = None, width: int | None = None) -> DataFrame:
    """Edge pixels become background."""
    return edge(mask, height, width).select(*PIXEL, F.when(F.col("edge"), F.lit(0)).otherwise(F.col("label")).cast("long").alias("label"))


def boxes(mask: DataFrame) -> DataFrame:
    """Closed bounding box, area and centroid of every label."""
    at = [F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1")]
    return mask.filter("label > 0").groupBy("fov", "label").agg(*at, F.count(F.lit(1)).alias("area"), F.avg("y").alias("cy"), F.avg("x").alias("cx"))


def best_cells(objects: DataFrame, cells: DataFrame, percent: float, expand: float) -> DataFrame:
    """Each object's cell of largest overlap: (fov, object, cell, overlap).

    The cell's centroid lies in the object's box, grown by ``expand`` pixels, and more than ``percent`` of the cell is
    covered. Ties go to the smaller cell label.
    """
    o = objects.filter("label > 0").select(*PIXEL, F.col("label").alias("object"))
    c = cells.filter("label > 0").select(*PIXEL, F.col("label").alias("cell"))
    overlap = o.join(c, PIXEL).groupBy("fov", "object", "cell").agg(F.count(F.lit(1)).alias("overlap"))
    box = boxes(objects).select("fov", F.col("label").alias("object"), "y0", "y1", "x0", "x1")
    place = boxes(cells).select("fov", F.col("label").alias("cell"), "area", "cy", "cx")
    inside = F.col("cy").between(F.col("y0") - expand, F.col("y1") + expand) & F.col("cx").between(F.col("x0") - expand, F.col("x1") + expand)
    fits = overlap.join(box, ["fov", "object"]).join(place, ["fov", "cell"]).filter(inside & (F.col("overlap") * 100 > F.col("area") * percent))
    first = F.row_number().over(Window.partitionBy("fov", "object").orderBy(F.desc("overlap"), "cell"))
    return fits.withColumn("r", first).filter("r = 1").select("fov", "object", "cell", "overlap")


def merge(objects: DataFrame, cells: DataFrame, percent: float = 10, expand: float = 0) -> DataFrame:
    """Objects joined with their best cells: (fov, y, x, merged, remaining).

    ``merged`` is the object's label, over the whole area of a cell that it took (of several takers the largest label);
    ``remaining`` is the label of a cell that no object took. Pixels where both are 0 are left out.
    """
    taken = best_cells(objects, cells, percent, expand).groupBy("fov", "cell").agg(F.max("object").alias("taker"))
    o = objects.filter("label > 0").select(*PIXEL, F.col("label").alias("object"))
    c = cells.filter("label > 0").select(*PIXEL, F.col("label").alias("cell")).join(taken, ["fov", "cell"], "left")
    both = o.join(c, PIXEL, "full")
    merged, remaining = F.coalesce("taker", "object", F.lit(0)), F.when(F.col("taker").isNull(), F.coalesce("cell", F.lit(0))).otherwise(0)
    return both.select(*PIXEL, merged.cast("long").alias("merged"), remaining.cast("long").alias("remaining")).filter("merged > 0 or remaining > 0")


def composite(images: DataFrame, add: list, subtract: list, image_type: str = "signal", method: str = "total") -> DataFrame:
    """Sum of some channels less others, per pixel of (fov, y, x, channel, value): (fov, y, x, value).

    ``binary`` and pixel-cluster images are capped at 1 after the addition. A binary signal is 0 wherever a subtracted
    channel is positive; any other result is a difference, not below 0.
    """
    if image_type not in ("signal", "pixel_cluster") or method not in ("total", "binary"):
        raise ValueError(f"unknown composite: {image_type}, {method}")
    total = lambda names: F.sum(F.when(F.col("channel").isin(names), F.col("value")).otherwise(0.0)) if names else F.lit(0.0)
    sums = images.filter(F.col("channel").isin(add + subtract)).groupBy(*PIXEL).agg(total(add).alias("plus"), total(subtract).alias("minus"))
    plus, minus = F.col("plus"), F.col("minus")
    if image_type == "pixel_cluster" or method == "binary":
        plus = F.least(plus, F.lit(1.0))
    if not subtract:
        value = plus
    elif image_type == "signal" and method == "binary":
        value = F.when(minus > 0, 0.0).otherwise(plus)
    else:
        value = F.greatest(plus - minus, F.lit(0.0))
    return sums.select(*PIXEL, F.round(value, 6).alias("value"))


def tile_place(name: Column) -> tuple[Column, Column, Column]:
    """Prefix, row and column of a tile's name of the form prefix_RnCm; null where the name has another form."""
    form = r"^(.*?)_?R\+?(\d+)C\+?(\d+)"
    part = lambda i: F.nullif(F.regexp_extract(name, form, i), F.lit(""))
    row, column = part(2).cast("int"), part(3).cast("int")
    return F.when(row.isNotNull(), F.coalesce(part(1), F.lit("unnamed_tile"))), row, column


def stitch(images: DataFrame, height: int, width: int) -> DataFrame:
    """Tiles moved into one frame per prefix; the least row and column of a prefix come first, missing tiles are absent.

    Pixels of tiles whose name has no row and column are rejected: the job fails, naming one such tile.
    """
    prefix, row, column = tile_place(F.col("fov"))
    wrong = F.raise_error(F.concat(F.lit("not a tile name: "), F.coalesce("fov", F.lit("null")))).cast("string")
    placed = images.withColumns({"prefix": F.coalesce(prefix, wrong), "row": row, "column": column})
    least = placed.groupBy("prefix").agg(F.min("row").alias("row0"), F.min("column").alias("column0"))  # a row a mosaic
    moved = placed.join(least, "prefix")
    y, x = F.col("y") + (F.col("row") - F.col("row0")) * height, F.col("x") + (F.col("column") - F.col("column0")) * width
    return moved.select("prefix", "channel", y.cast("long").alias("y"), x.cast("long").alias("x"), "value")


def nuclear_filter(images: DataFrame, nuclei: DataFrame, channel, exclude: bool = True) -> DataFrame:
    """One channel with its pixels inside nuclei (``exclude``) or outside them set to 0."""
    inside = nuclei.filter("label > 0").select(*PIXEL, F.lit(True).alias("nuclear")).distinct()
    drop = F.coalesce("nuclear", F.lit(False)) == F.lit(exclude)
    return images.filter(F.col("channel") == channel).join(inside, PIXEL, "left").select(*PIXEL, F.when(drop, 0.0).otherwise(F.col("value")).alias("value"))


def cluster_ids(cells: DataFrame, cluster: str) -> DataFrame:
    """Ids 1..n by sorted cluster name, null (unassigned) last: (cluster, cluster_id)."""
    names = cells.select(F.col(cluster).alias("cluster")).distinct()
    return names.withColumn("cluster_id", F.dense_rank().over(Window.orderBy(F.col("cluster").asc_nulls_last())).cast("long"))  # a row a name


def cluster_mask(mask: DataFrame, cells: DataFrame, cluster: str) -> DataFrame:
    """Labels replaced by their cell's cluster id; background is 0, cells missing from the table get the largest id + 1."""
    ids = cluster_ids(cells, cluster)
    of = cells.join(ids, cells[cluster].eqNullSafe(ids["cluster"])).select("fov", "label", "cluster_id")
    rest = ids.agg((F.coalesce(F.max("cluster_id"), F.lit(0)) + 1).alias("rest"))  # one row
    value = F.when(F.col("label") == 0, F.lit(0)).otherwise(F.coalesce("cluster_id", "rest"))
    return mask.join(of, ["fov", "label"], "left").join(F.broadcast(rest)).select(*PIXEL, value.cast("long").alias("cluster_id"))


def pixel_cluster_mask(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """A full image per fov from sparse (fov, y, x, cluster) pixels; 0 where there is none."""
    line = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    grid = pixels.select("fov").distinct().withColumn("y", line(height)).withColumn("x", line(width))
    return grid.join(pixels.select(*PIXEL, "cluster"), PIXEL, "left").select(*PIXEL, F.coalesce("cluster", F.lit(0)).cast("long").alias("cluster"))


def type_mask(mask: DataFrame, cells: DataFrame, types: list[str]) -> DataFrame:
    """Pixels of cells of the given types."""
    return mask.join(cells.filter(F.col("cell_type").isin(types)).select("fov", "label"), ["fov", "label"], "left_semi").select(*PIXEL, "label")
