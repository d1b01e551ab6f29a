"""Image kernels: Gaussian blur, connected components and object masks.

A task takes whole images, one at a time. An image is bounded by the camera's frame (a few million pixels), not by the
data; the number of images is what grows. Pixels that are not given count as 0; an image without pixels has no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _dense(rows: pd.DataFrame, value: str) -> np.ndarray:
    out = np.zeros((int(rows["y"].max()) + 1, int(rows["x"].max()) + 1))
    out[rows["y"].to_numpy(), rows["x"].to_numpy()] = rows[value].fillna(0).to_numpy()
    return out


def per_image(images: DataFrame, keys: list[str], value: str, out: str, kind: str, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``kernel`` over each image, given as (keys, y, x, value); the result holds every pixel of the image's frame."""
    types = {f.name: f.dataType.simpleString() for f in images.schema.fields}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + f", y long, x long, {out} {kind}"

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        made = kernel(_dense(rows, value))
        y, x = np.indices(made.shape).reshape(2, -1)
        return pd.DataFrame({**dict(zip(keys, key, strict=True)), "y": y, "x": x, out: made.ravel()})

    given = images.select(*keys, "y", "x", value).filter("y is not null and x is not null")
    return given.groupBy(*keys).applyInPandas(run, schema)


def blur(image: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian, cut at four sigmas, the image mirrored at its rim; the image itself without a width."""
    if sigma <= 0:
        return image
    reach = int(4 * sigma + 0.5)
    taps = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    taps /= taps.sum()
    for axis in (0, 1):
        wide = np.pad(image, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        n = image.shape[axis]
        image = sum(t * np.take(wide, range(j, j + n), axis) for j, t in enumerate(taps))
    return image


def components(mask: np.ndarray, corners: bool = True) -> np.ndarray:
    """Labels 1..n of touching pixels, in raster order of first pixels; ``corners`` joins diagonal neighbours too.

    Every pixel takes its neighbourhood's least index, then the index's own index, until nothing changes.
    """
    height, width = mask.shape
    none = height * width
    own = np.where(mask, np.arange(none).reshape(mask.shape), none)
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if corners else [])
    while True:
        wide, new = np.pad(own, 1, constant_values=none), own
        for dy, dx in steps:
            new = np.minimum(new, wide[1 + dy : 1 + dy + height, 1 + dx : 1 + dx + width])
        new = np.where(mask, new, none)
        root = np.append(new.ravel(), none)
        np.minimum.at(root, own.ravel(), new.ravel())  # the old root hears of the smaller one too
        root[-1] = none
        new = root[root[new]]
        if (new == own).all():
            break
        own = new
    names = np.unique(own[mask])
    return np.where(mask, np.searchsorted(names, own) + 1, 0)


def block_size(kind: str, fov_dim: int, side: int) -> int:
    """Pixels for small holes (``small_holes``), or the odd width of a window of about ten micrometres (``local_thresh``)."""
    pixel = fov_dim / side
    if kind == "small_holes":
        return round((np.pi * 5) ** 2 / pixel)
    if kind != "local_thresh":
        raise ValueError(f"unknown block: {kind}")
    n = round(10 / pixel)
    return n + 1 - n % 2


def ridges(image: np.ndarray, sigmas: tuple[float, ...] = (1, 2, 3, 4)) -> np.ndarray:
    """Brightness of bright ridges, 0 to 1: the strongest negative curvature across them over the scales.

    Curvatures are eigenvalues of the Hessian of the blurred image, mixed so that a line's own direction weighs a third.
    """
    best = np.zeros(image.shape)
    for sigma in sigmas:
        smooth = blur(image.astype(float), sigma)
        gy, gx = np.gradient(smooth)
        (yy, yx), (_, xx) = np.gradient(gy), np.gradient(gx)
        mean, apart = (yy + xx) / 2, np.sqrt(((yy - xx) / 2) ** 2 + yx**2)
        low, high = mean - apart, mean + apart
        big, small = np.where(np.abs(low) > np.abs(high), low, high), np.where(np.abs(low) > np.abs(high), high, low)
        value = np.maximum(-(big + small / 3), 0) * sigma**2
        if value.max() > 0:
            best = np.maximum(best, value / value.max())
    return best


def objects(image: np.ndarray, sigma: float, percentile: float | str | None, hole: int | str | None, least: int, most: int, shape: str = "blob", fov_dim: int = 400) -> np.ndarray:
    """Blur, threshold, fill holes, label, filter by area.

    ``percentile`` of the positive pixels must be exceeded; ``auto`` compares with a Gaussian mean of the surroundings
    (about ten micrometres of a fov of ``fov_dim``); None keeps what is positive. Holes below ``hole`` pixels are filled
    (``auto``: by the fov's size; None: none). A ``projection`` keeps ridges. Areas from ``least`` to ``most`` stay, with
    the labels that they had before the filter.
    """
    if shape not in ("blob", "projection"):
        raise ValueError(f"unknown shape: {shape}")
    smooth = blur(image, sigma) if sigma else image
    if percentile == "auto":
        mask = smooth > blur(smooth, (block_size("local_thresh", fov_dim, len(image)) - 1) / 6)
    elif percentile is None:
        mask = smooth > 0
    elif isinstance(percentile, (int, float)):
        positive = smooth[smooth > 0]
        mask = smooth > (np.percentile(positive, percentile) if len(positive) else 0)
    else:
        raise ValueError(f"unknown threshold: {percentile}")
    if hole is not None:
        gaps = components(~mask, corners=False)
        mask = mask | (gaps > 0) & (np.bincount(gaps.ravel())[gaps] < (block_size("small_holes", fov_dim, len(image)) if hole == "auto" else hole))
    labels = components(ridges(mask) > 0 if shape == "projection" else mask)
    area = np.bincount(labels.ravel())
    return np.where((area[labels] >= least) & (area[labels] <= most), labels, 0)


def smooth_channels(images: DataFrame, sigma: float) -> DataFrame:
    return per_image(images, ["fov", "channel"], "value", "value", "double", lambda i: np.round(blur(i, sigma), 6))


def label_components(mask: DataFrame, corners: bool = True) -> DataFrame:
    """Pixels of positive ``label`` get the number of the component that they are in."""
    return per_image(mask, ["fov"], "label", "label", "long", lambda i: components(i > 0, corners))


def object_masks(images: DataFrame, channel, sigma: float = 1.0, percentile: float | str | None = 80.0, hole: int | str | None = 20, least: int = 5, most: int = 100_000, shape: str = "blob", fov_dim: int = 400) -> DataFrame:
    one = images.filter(images["channel"] == channel)
    return per_image(one, ["fov"], "value", "label", "long", lambda i: objects(i, sigma, percentile, hole, least, most, shape, fov_dim))


def signal_masks(images: DataFrame, channels: list, sigma: float = 1.0, percentile: float | str | None = 80.0, hole: int | str | None = 20, least: int = 5, most: int = 100_000) -> DataFrame:
    """Object masks of several channels: (fov, channel, y, x, label)."""
    some = images.filter(images["channel"].isin(channels))
    return per_image(some, ["fov", "channel"], "value", "label", "long", lambda i: objects(i, sigma, percentile, hole, least, most))


def smooth_mask(mask: DataFrame, sigma: float = 10.0, level: float = 0.0005, hole: int = 0, least: int = 0) -> DataFrame:
    """A mask (fov, y, x, label) as areas: the blurred presence of labels above ``level``, holes below ``hole`` pixels
    filled, areas below ``least`` pixels dropped; 1 inside."""

    def kernel(image: np.ndarray) -> np.ndarray:
        inside = blur((image > 0).astype(float), sigma) > level if sigma else image > 0
        gaps = components(~inside, corners=False)
        inside |= (gaps > 0) & (np.bincount(gaps.ravel())[gaps] < hole)
        parts = components(inside, corners=False)
        return (inside & (np.bincount(parts.ravel())[parts] >= least)).astype(np.int64)

    return per_image(mask, ["fov"], "label", "label", "long", kernel)
