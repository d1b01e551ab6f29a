"""Named column builders that callers can extend: signal extraction and morphology of cells."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EXTRACTION: dict[str, Callable[..., Column] | None] = {
    "total_intensity": lambda c: F.sum(c),
    "positive_pixel": lambda c, threshold=0.0: F.count_if(F.col(c) > threshold),
    "mean_intensity": lambda c: F.avg(c),
    "center_weighting": None,  # weighs pixels by their cell's centroid: operators.cells.center_weighting
}

#: Moments of a cell's pixels (y, x).
MORPHOLOGY: dict[str, Callable[[], Column]] = {
    "area": lambda: F.count(F.lit(1)),
    "centroid-0": lambda: F.avg("y"),
    "centroid-1": lambda: F.avg("x"),
    "orientation": lambda: F.atan2(2 * F.covar_pop("y", "x"), F.var_pop("y") - F.var_pop("x")) / 2,
    "bbox_height": lambda: F.max("y") - F.min("y") + 1,
    "bbox_width": lambda: F.max("x") - F.min("x") + 1,
}
