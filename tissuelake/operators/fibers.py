"""Fibres in images: local contrast, ridges, watershed, and the table of the fibres found.

The kernels follow published definitions (adaptive histogram equalisation, the vesselness filter, exact Euclidean
distances, multi-level Otsu thresholds, flooding from markers). A task takes one image.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.registry import MORPHOLOGY
from .cells import axes
from .images import blur, components, per_image
from .spatial import fiber_alignment


def equalised(image: np.ndarray, side: float, clip: float = 0.01, bins: int = 256) -> np.ndarray:
    """An image of 0 to 1 with its contrast evened out in tiles of about ``side`` pixels.

    Every tile's histogram, cut at ``clip`` of the tile's pixels a bin with the rest spread evenly, gives a mapping; a
    pixel's value is interpolated between the mappings of the four nearest tiles.
    """
    height, width = image.shape
    ny, nx = max(1, round(height / max(side, 1))), max(1, round(width / max(side, 1)))
    span = image.max() - image.min()
    level = np.clip(((image - image.min()) / (span or 1) * (bins - 1)).round().astype(int), 0, bins - 1)
    ys, xs = np.linspace(0, height, ny + 1).astype(int), np.linspace(0, width, nx + 1).astype(int)
    maps = np.zeros((ny, nx, bins))
    for i, j in product(range(ny), range(nx)):
        tile = level[ys[i] : ys[i + 1], xs[j] : xs[j + 1]]
        count = np.bincount(tile.ravel(), minlength=bins).astype(float)
        most = max(1.0, clip * tile.size)
        over = np.maximum(count - most, 0).sum()
        maps[i, j] = np.cumsum(np.minimum(count, most) + over / bins) / max(tile.size, 1)

    def around(at: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        middle = (edges[:-1] + edges[1:] - 1) / 2
        low = np.clip(np.searchsorted(middle, at, "right") - 1, 0, len(middle) - 1)
        high = np.minimum(low + 1, len(middle) - 1)
        gap = np.where(high > low, middle[high] - middle[low], 1)
        return low, high, np.clip((at - middle[low]) / gap, 0, 1)

    (a, b, v), (c, d, u) = around(np.arange(height), ys), around(np.arange(width), xs)
    v, u = v[:, None], u[None]
    take = lambda i, j: maps[i[:, None], j[None], level]
    return (1 - v) * ((1 - u) * take(a, c) + u * take(a, d)) + v * ((1 - u) * take(b, c) + u * take(b, d))


def vesselness(image: np.ndarray, sigmas: tuple[float, ...], beta: float = 0.5) -> np.ndarray:
    """How much each pixel lies on a bright line, the largest over the scales.

    From the eigenvalues of the Hessian of the blurred image, the smaller in size over the larger tells blobs from lines,
    their norm lines from background; half its maximum is the scale.
    """
    best = np.zeros(image.shape)
    for sigma in sigmas:
        smooth = blur(image.astype(float), sigma)
        gy, gx = np.gradient(smooth)
        (yy, yx), (_, xx) = np.gradient(gy), np.gradient(gx)
        yy, yx, xx = yy * sigma**2, yx * sigma**2, xx * sigma**2
        mean, apart = (yy + xx) / 2, np.sqrt(((yy - xx) / 2) ** 2 + yx**2)
        one, two = mean - apart, mean + apart
        large, small = np.where(np.abs(one) >= np.abs(two), one, two), np.where(np.abs(one) >= np.abs(two), two, one)
        size = np.sqrt(one**2 + two**2)
        scale = size.max() / 2
        if scale > 0:
            value = np.exp(-((small / np.where(large == 0, 1, large)) ** 2) / (2 * beta**2)) * (1 - np.exp(-(size**2) / (2 * scale**2)))
            best = np.maximum(best, np.where(large < 0, value, 0))
    return best


def distances(mask: np.ndarray) -> np.ndarray:
    """Each true pixel's exact distance to the nearest false one; 0 outside, infinite without any."""
    height, width = mask.shape
    far = float(height + width)
    down, row = np.full((height, width), far), np.full(width, far)
    for y in range(height):
        row = np.where(mask[y], row + 1, 0)
        down[y] = row
    row = np.full(width, far)
    for y in reversed(range(height)):
        row = np.where(mask[y], row + 1, 0)
        down[y] = np.minimum(down[y], row)
    square = np.where(down >= far, np.inf, down**2)
    out = square.copy()
    for step in range(1, width):
        reachable = out[np.isfinite(out)]
        if len(reachable) == out.size and step * step >= reachable.max():
            break
        out[:, step:] = np.minimum(out[:, step:], square[:, :-step] + step * step)
        out[:, :-step] = np.minimum(out[:, :-step], square[:, step:] + step * step)
    return np.sqrt(out)


def two_thresholds(image: np.ndarray, bins: int = 256) -> tuple[float, float]:
    """The two levels between three classes with the most variance between them; of equal ones the lowest."""
    count, edges = np.histogram(image, bins)
    middle = (edges[:-1] + edges[1:]) / 2
    weight, moment = np.append(0, np.cumsum(count / count.sum())), np.append(0, np.cumsum(count / count.sum() * middle))
    part = lambda i, j: np.where(weight[j] > weight[i], (moment[j] - moment[i]) ** 2 / np.where(weight[j] > weight[i], weight[j] - weight[i], 1), 0)
    i, j = np.triu_indices(bins - 1, 1)
    i, j = i + 1, j + 1
    score = part(np.zeros_like(i), i) + part(i, j) + part(j, np.full_like(i, bins))
    best = int(score.argmax())
    return float(middle[i[best] - 1]), float(middle[j[best] - 1])


def slope(image: np.ndarray) -> np.ndarray:
    """Size of the gradient by 3 x 3 Sobel kernels."""
    wide = np.pad(image.astype(float), 1, mode="symmetric")
    y = wide[2:] - wide[:-2]
    x = wide[:, 2:] - wide[:, :-2]
    across = (y[:, :-2] + 2 * y[:, 1:-1] + y[:, 2:]) / 8
    along = (x[:-2] + 2 * x[1:-1] + x[2:]) / 8
    return np.sqrt((across**2 + along**2) / 2)


def flooded(height: np.ndarray, markers: np.ndarray) -> np.ndarray:
    """Markers grown over the image from low to high, through sides; of equal heights, what was reached first comes first."""
    out = markers.copy()
    heap = [(height[y, x], 0, y, x) for y, x in np.argwhere(markers > 0)]
    heapq.heapify(heap)
    age = 0
    while heap:
        _, _, y, x = heapq.heappop(heap)
        for b, a in ((y - 1, x), (y, x - 1), (y, x + 1), (y + 1, x)):
            if 0 <= b < out.shape[0] and 0 <= a < out.shape[1] and out[b, a] == 0:
                age += 1
                out[b, a] = out[y, x]
                heapq.heappush(heap, (max(height[b, a], height[y, x]), age, b, a))
    return out


def find_fibers(image: np.ndarray, sigma: float = 2, divisor: int = 128, widths: tuple[float, ...] = (1, 3, 5, 7, 9), cutoff: float = 0.1, edge_sigma: float = 1, least: int = 15) -> np.ndarray:
    """Labels of fibres; touching parts (through sides) below ``least`` pixels are dropped."""
    smooth = blur(image.astype(float), sigma)
    if smooth.max() <= 0:
        return np.zeros(image.shape, int)
    lines = vesselness(equalised(smooth / smooth.max(), image.shape[0] / divisor), widths) * 10_000
    inside = lines > cutoff
    if inside.all() or not inside.any():
        return np.zeros(image.shape, int)
    depth = blur(distances(inside), 1)
    low, high = two_thresholds(depth)
    markers = np.where(depth < low, 1, np.where(depth > high, 2, 0))
    found = flooded(slope(blur(depth, edge_sigma)).astype(int), markers) == 2
    labels = components(found, corners=False)
    size = np.bincount(labels.ravel())
    return np.where(size[labels] >= least, labels, 0)


def segment_fibers(images: DataFrame, channel, **options) -> DataFrame:
    """Fibre labels (fov, y, x, label) of one channel of (fov, channel, y, x, value)."""
    one = images.filter(F.col("channel") == channel)
    return per_image(one, ["fov"], "value", "label", "long", lambda i: find_fibers(i, **options))


def euler(image: np.ndarray) -> int:
    """Parts less holes, parts joined through corners too, from the numbers of 2 x 2 patterns."""
    w = np.pad(image.astype(int), 1)
    a, b, c, d = w[:-1, :-1], w[:-1, 1:], w[1:, :-1], w[1:, 1:]
    n = a + b + c + d
    return int(((n == 1).sum() - (n == 3).sum() - 2 * ((n == 2) & (a == d)).sum()) // 4)


def fiber_table(labels: DataFrame) -> DataFrame:
    """Per fibre of (fov, y, x, label): axes, eccentricity, orientation, centroid, area and Euler number."""
    kind = labels.schema["fov"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for fov, label, ys, xs in rows.itertuples(index=False):
                y, x = np.asarray(ys), np.asarray(xs)
                image = np.zeros((y.max() - y.min() + 1, x.max() - x.min() + 1), bool)
                image[y - y.min(), x - x.min()] = True
                out.append((fov, label, euler(image)))
            yield pd.DataFrame(out, columns=["fov", "label", "euler_number"])

    some = labels.filter("label > 0")
    made = some.groupBy("fov", "label").agg(F.collect_list(F.struct("y", "x")).alias("p")).select("fov", "label", "p.y", "p.x")
    numbers = made.mapInPandas(run, f"fov {kind}, label long, euler_number long")
    place = some.groupBy("fov", "label").agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.round(MORPHOLOGY["orientation"](), 6).alias("orientation"))
    shape = axes(some).select("fov", "label", "area", F.col("major_axis_length").alias("major"), F.col("minor_axis_length").alias("minor"), "eccentricity")
    return shape.join(place, ["fov", "label"]).join(numbers, ["fov", "label"])


def run_fibers(images: DataFrame, channel, k: int = 4, ratio: int = 2, **options) -> tuple[DataFrame, DataFrame]:
    """Labels and the table of fibres with their alignment to the k nearest long ones."""
    labels = segment_fibers(images, channel, **options)
    table = fiber_table(labels)
    return labels, table.join(fiber_alignment(table, k, ratio), ["fov", "label"])
