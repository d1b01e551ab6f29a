"""Cell morphology and compartments over masks (fov, y, x, label), and per-fov cell summaries."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.registry import EXTRACTION
from .images import components
from .labels import max_overlap
from .masks import PIXEL

HULL = "fov long, label long, convex_area long, convex_hull_resid double, centroid_dif double, num_concavities long, perimeter double, perim_square_over_area double"
#: Lengths that border patterns add to a perimeter; the index is 10 per diagonal, 2 per side neighbour, 1 for the pixel.
PERIMETER = {5: 1.0, 7: 1.0, 15: 1.0, 17: 1.0, 25: 1.0, 27: 1.0, 21: math.sqrt(2), 33: math.sqrt(2), 13: (1 + math.sqrt(2)) / 2, 23: (1 + math.sqrt(2)) / 2}


def axes(mask: DataFrame) -> DataFrame:
    """Axes of the ellipse with the cell's second moments and their ratios, as one aggregate; null for a zero divisor."""
    var_y, var_x = F.col("vy"), F.col("vx")
    root = F.sqrt(4 * F.col("c") * F.col("c") + (var_y - var_x) * (var_y - var_x))
    moments = mask.filter("label > 0").groupBy("fov", "label").agg(F.count(F.lit(1)).alias("area"), F.var_pop("y").alias("vy"), F.var_pop("x").alias("vx"), F.covar_pop("y", "x").alias("c"))
    made = moments.withColumns({"major": 4 * F.sqrt((var_y + var_x + root) / 2), "minor": 4 * F.sqrt(F.greatest((var_y + var_x - root) / 2, F.lit(0.0))), "diameter": F.sqrt(4 * F.col("area") / math.pi)})
    out = {
        "major_axis_length": F.col("major"), "minor_axis_length": F.col("minor"), "equivalent_diameter": F.col("diameter"),
        "eccentricity": F.sqrt(1 - F.try_divide(F.col("minor") * F.col("minor"), F.col("major") * F.col("major"))),
        "major_minor_axis_ratio": F.when(F.col("minor") > 1e-9, F.col("major") / F.col("minor")), "major_axis_equiv_diam_ratio": F.col("major") / F.col("diameter"),
    }
    return made.select("fov", "label", "area", *[F.round(v, 6).alias(k) for k, v in out.items()])


def hull_image(image: np.ndarray) -> np.ndarray:
    """Pixels whose centre lies in the convex hull of the set pixels' edge midpoints."""
    at = 2 * np.argwhere(image)  # doubled, so that edge midpoints are integers and the turns exact
    points = np.unique(np.concatenate([at + s for s in ((1, 0), (-1, 0), (0, 1), (0, -1))]), axis=0)
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    chains = []
    for order in (points, points[::-1]):
        chain: list = []
        for p in order.tolist():
            while len(chain) > 1 and turn(chain[-2], chain[-1], p) <= 0:
                chain.pop()
            chain.append(p)
        chains += chain[:-1]
    y, x = 2 * np.indices(image.shape)
    inside = np.ones(image.shape, bool)
    for a, b in zip(chains, chains[1:] + chains[:1], strict=True):
        inside &= (b[0] - a[0]) * (x - a[1]) - (b[1] - a[1]) * (y - a[0]) >= 0
    return inside


def perimeter(image: np.ndarray) -> float:
    """Length of the line through the border pixels' centres."""
    wide = np.pad(image, 1)
    inner = wide & np.roll(wide, 1, 0) & np.roll(wide, -1, 0) & np.roll(wide, 1, 1) & np.roll(wide, -1, 1)
    border = np.pad(wide & ~inner, 1).astype(int)
    code = border + sum((10 if dy and dx else 2) * np.roll(border, (dy, dx), (0, 1)) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx)
    return float(sum(length * ((code == pattern) & (border > 0)).sum() for pattern, length in PERIMETER.items()))


def concavities(gap: np.ndarray, small: int, compact: float, large: int) -> int:
    """Parts of hull less cell that are compact and above ``small`` pixels, or above ``large``."""
    parts, n = components(gap, corners=False), 0
    for i in range(1, int(parts.max(initial=0)) + 1):
        area = int((parts == i).sum())
        n += area > large or (area > small and perimeter(parts == i) ** 2 / area < compact)
    return n


def hull_features(mask: DataFrame, small: int = 10, compact: float = 60, large: int = 150) -> DataFrame:
    """Convex hull and perimeter features of every cell; a cell's pixels are one row, so cells are dealt one by one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for fov, label, ys, xs in rows.itertuples(index=False):
                y, x = np.asarray(ys), np.asarray(xs)
                image = np.zeros((y.max() - y.min() + 1, x.max() - x.min() + 1), bool)
                image[y - y.min(), x - x.min()] = True
                hull, area, length = hull_image(image), int(image.sum()), perimeter(image)
                shift = float(np.linalg.norm(np.argwhere(image).mean(0) - np.argwhere(hull).mean(0))) / math.sqrt(area)
                full = int(hull.sum())
                out.append((fov, label, full, round((full - area) / full, 6), round(shift, 6), concavities(hull & ~image, small, compact, large), round(length, 6), round(length * length / area, 6)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in HULL.split(", ")])

    pixels = F.collect_list(F.struct("y", "x"))
    cells = mask.filter("label > 0").groupBy("fov", "label").agg(pixels.alias("p")).select("fov", "label", "p.y", "p.x")
    return cells.mapInPandas(run, HULL.replace("fov long", f"fov {mask.schema['fov'].dataType.simpleString()}", 1))


def center_weighting(signal: DataFrame, channel: str) -> DataFrame:
    """Per cell of (fov, label, y, x, channel...), the channel weighted by nearness to the centroid.

    A pixel weighs 1 - d / (D + 1): d its Chebyshev distance to the centroid, D the cell's largest.
    """
    cell = Window.partitionBy("fov", "label")
    at = lambda c: F.abs(F.col(c) - F.avg(c).over(cell))
    d = signal.filter("label > 0").withColumn("d", F.greatest(at("y"), at("x")))
    weight = 1 - F.col("d") / (F.max("d").over(cell) + 1)
    return d.withColumn("w", weight).groupBy("fov", "label").agg(F.round(F.sum(F.col("w") * F.col(channel)), 6).alias(channel))


def nc_ratio(cells: DataFrame, nuclei: DataFrame) -> DataFrame:
    """Area of each cell's main nucleus over the cell's; 0 without a nucleus."""
    size = lambda m: m.filter("label > 0").groupBy("fov", "label").agg(F.count(F.lit(1)).alias("area"))
    own = max_overlap(cells, nuclei).select("fov", F.col("a").alias("label"), F.col("b").alias("nucleus"))
    inner = own.join(size(nuclei).select("fov", F.col("label").alias("nucleus"), F.col("area").alias("nuclear_area")), ["fov", "nucleus"])
    return size(cells).join(inner, ["fov", "label"], "left").select("fov", "label", F.round(F.coalesce(F.col("nuclear_area") / F.col("area"), F.lit(0.0)), 6).alias("nc_ratio"))


def split_large_nuclei(cells: DataFrame, nuclei: DataFrame, outside: int = 15, least: int = 5) -> DataFrame:
    """The nuclear mask, where a nucleus with more than ``outside`` pixels beyond its cell leaves its part in the cell.

    The part inside gets a new id above all of the fov's; labels of fewer than ``least`` pixels become background.
    """
    total = nuclei.filter("label > 0").groupBy("fov", F.col("label").alias("b")).agg(F.count(F.lit(1)).alias("total"))
    top = nuclei.groupBy("fov").agg(F.max("label").alias("top"))  # a row a fov
    wide = max_overlap(cells, nuclei).join(total, ["fov", "b"]).filter(F.col("total") - F.col("n") > outside).join(top, "fov")
    new = wide.select("fov", F.col("a").alias("cell"), F.col("b").alias("label"), (F.col("top") + F.row_number().over(Window.partitionBy("fov").orderBy("a"))).alias("new"))
    both = nuclei.join(cells.select(*PIXEL, F.col("label").alias("cell")), PIXEL, "left").join(new, ["fov", "cell", "label"], "left")
    named = both.select(*PIXEL, F.coalesce("new", "label").alias("label"))
    few = F.count(F.lit(1)).over(Window.partitionBy("fov", "label")) < least
    return named.select(*PIXEL, F.when(few, 0).otherwise(F.col("label")).cast("long").alias("label"))


def fov_cell_stats(cells: DataFrame, pixels: int) -> DataFrame:
    """Per fov: mean cell size, share of the image that cells cover, and cells."""
    return cells.groupBy("fov").agg(F.round(F.avg("cell_size"), 6).alias("avg_size"), F.round(F.sum("cell_size") / F.lit(float(pixels)), 6).alias("density"), F.count(F.lit(1)).alias("n"))


def distance_features(cells: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Each distance column as a pseudo cell per fov: (cells and pseudo cells, their distances in both directions).

    Labels of pseudo cells follow the fov's largest label, in the order of ``columns``; their type is the column's name.
    """
    base = ["fov", "label", "cell_type"]
    top = cells.groupBy("fov").agg(F.max("label").alias("top"))  # a row a fov
    named = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(c).alias("cell_type")) for i, c in enumerate(columns)]))
    pseudo = top.withColumn("p", named).select("fov", (F.col("top") + F.col("p.i")).alias("label"), "p.cell_type")
    far = cells.unpivot(["fov", "label"], columns, "cell_type", "distance").withColumnRenamed("label", "cell").join(pseudo, ["fov", "cell_type"])
    out = far.select("fov", F.col("cell").alias("label"), F.col("label").alias("nb_label"), "distance")
    return cells.select(*base).unionByName(pseudo), out.unionByName(out.select("fov", F.col("nb_label").alias("label"), F.col("label").alias("nb_label"), "distance"))


def spanning_tree(cells: DataFrame) -> DataFrame:
    """Euclidean minimum spanning tree of each fov's cells: (fov, a, b, d2), a < b; ties go to smaller labels.

    Prim's algorithm holds one line of distances at a time, so a task's memory is linear in the fov's cells.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("label")
        y, x, name = rows["cy"].to_numpy(), rows["cx"].to_numpy(), rows["label"].to_numpy()
        far = lambda i: (y - y[i]) ** 2 + (x - x[i]) ** 2
        open_, best, via, out = np.ones(len(y), bool), far(0).astype(float), np.zeros(len(y), int), []
        open_[0] = False
        for _ in range(len(y) - 1):
            i = int(np.where(open_, best, np.inf).argmin())
            out.append((rows["fov"].iloc[0], min(name[i], name[via[i]]), max(name[i], name[via[i]]), float(best[i])))
            open_[i] = False
            d = far(i)
            via = np.where(d < best, i, via)
            best = np.minimum(best, d)
        return pd.DataFrame(out, columns=["fov", "a", "b", "d2"])

    kind = cells.schema["fov"].dataType.simpleString()
    return cells.select("fov", "label", "cy", "cx").groupBy("fov").applyInPandas(run, f"fov {kind}, a long, b long, d2 double")


def compartment_table(signal: DataFrame, nuclei: DataFrame, channels: list[str], mode: str = "total_intensity", threshold: float = 0.0) -> DataFrame:
    """The cell table of both compartments in one row a cell: features of the whole cell, and of its main nucleus as
    ``<name>_nuclear`` (0 without a nucleus), with nc_ratio.

    ``signal`` holds a row a pixel (fov, y, x, label, channels), ``nuclei`` the nuclear mask. Modes as in the registry.
    """
    build = EXTRACTION[mode]
    extract = (lambda c: build(c, threshold)) if mode == "positive_pixel" else build
    shape = [F.count(F.lit(1)).alias("area"), F.avg("y").alias("centroid-0"), F.avg("x").alias("centroid-1")]

    def table(rows: DataFrame) -> DataFrame:
        rows = rows.filter("label > 0")
        if mode == "center_weighting":
            made = rows.groupBy("fov", "label").agg(*shape)
            for c in channels:
                made = made.join(center_weighting(rows, c), ["fov", "label"])
            return made
        return rows.groupBy("fov", "label").agg(*shape, *[F.round(extract(c), 6).alias(c) for c in channels])

    names = ["area", "centroid-0", "centroid-1", *channels]
    own = max_overlap(signal.select(*PIXEL, "label"), nuclei).select("fov", F.col("a").alias("label"), F.col("b").alias("nucleus"))
    inside = table(signal.drop("label").join(nuclei.select(*PIXEL, "label"), PIXEL)).select("fov", F.col("label").alias("nucleus"), *[F.col(f"`{c}`").alias(f"{c}_nuclear") for c in names])
    both = table(signal).join(own, ["fov", "label"], "left").join(inside, ["fov", "nucleus"], "left")
    rounded = lambda c: F.round(F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)), 6).alias(c)
    ratio = F.round(F.coalesce(F.col("area_nuclear") / F.col("area"), F.lit(0.0)), 6).alias("nc_ratio")
    return both.select("fov", "label", *[rounded(c) for c in names], *[rounded(f"{c}_nuclear") for c in names], ratio)


def difference_rows(tree: DataFrame) -> DataFrame:
    """The difference matrix of a tree's edges as rows (fov, edge, label, sign): +1 for one end, -1 for the other."""
    edge = F.row_number().over(Window.partitionBy("fov").orderBy("a", "b"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("label"), F.lit(1).alias("sign")), F.struct(F.col("b").alias("label"), F.lit(-1).alias("sign"))))
    return tree.withColumn("edge", edge).select("fov", "edge", ends.alias("e")).select("fov", "edge", "e.label", "e.sign")
