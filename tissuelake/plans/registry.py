"""Queries of the reference's operators, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.registry import EXTRACTION, MORPHOLOGY
from ..operators import clusters, labels, pixels, spatial
from ..sources import tables
from . import masks, more

RADIUS = 100
TYPES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
CLUSTERS = ["AF", "AO", "NF", "NO", "RF", "RO"]
T, R = "BUILDING", "MACHINERY"

CELLS = "cells AS (SELECT CAST(c_nationkey AS BIGINT) fov, CAST(c_custkey AS BIGINT) AS label, c_mktsegment cell_type, CAST((c_custkey * 7919) % 512 AS BIGINT) cy, CAST((CAST(c_custkey AS BIGINT) * 104729) % 512 AS BIGINT) cx FROM customer)"
PIXELS = "pixels AS (SELECT CAST(c_nationkey AS BIGINT) fov, CAST(o_custkey AS BIGINT) AS label, CAST(l_quantity AS DOUBLE) q, CAST(l_extendedprice AS DOUBLE) / 1000 p, round(CAST(l_discount AS DOUBLE) * 100) d, round(CAST(l_tax AS DOUBLE) * 100) t, l_returnflag || l_linestatus AS cluster FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"
FIBERS = f"{CELLS}, fibers AS (SELECT *, major * minor AS area FROM (SELECT fov, label, cy, cx, label * 37 % 180 AS orientation, label * 13 % 50 + 1 AS major, label * 7 % 20 + 1 AS minor FROM cells))"
D2 = "(a.cy - b.cy) * (a.cy - b.cy) + (a.cx - b.cx) * (a.cx - b.cx)"
PAIRS = f"{CELLS}, pairs AS (SELECT a.fov, a.label, a.cell_type, b.label nb_label, b.cell_type nb_type, {D2} d2 FROM cells a JOIN cells b ON a.fov = b.fov AND {D2} > 0 AND {D2} < {RADIUS * RADIUS})"
COUNTS = f"{PAIRS}, counts AS (SELECT fov, label, nb_type, count(*) n FROM pairs GROUP BY ALL)"
Z4 = ("q", "p", "d", "t")


def _masks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    side, grid = 64, spark.range(64 * 64).select(F.lit(0).alias("fov"), F.expr("id div 64").alias("y"), (F.col("id") % 64).alias("x"))
    a = grid.withColumn("label", F.when((F.col("y") % 8 < 6) & (F.col("x") % 8 < 6), F.expr("(y div 8) * 8 + x div 8 + 1")).otherwise(0))
    b = grid.withColumn("label", F.when((F.col("y") % 5 < 4) & (F.col("x") % 7 < 5), F.expr("(y div 5) * 10 + x div 7 + 1")).otherwise(0))
    return a, b


MASKS = """g AS (SELECT 0 fov, i // 64 y, i % 64 x FROM range(4096) r(i)), ma AS (SELECT fov, y, x, (y // 8) * 8 + x // 8 + 1 AS label FROM g WHERE y % 8 < 6 AND x % 8 < 6),
mb AS (SELECT fov, y, x, (y // 5) * 10 + x // 7 + 1 AS label FROM g WHERE y % 5 < 4 AND x % 7 < 5)"""


def _mapping(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, f"meta_{i // 2}") for i, c in enumerate(CLUSTERS[:4])], "cluster string, meta string")


def _steps(spark: SparkSession) -> DataFrame:
    return spark.range(0, 40).select((F.col("id") * 37 + 5).alias("step"), (F.col("id") * F.col("id")).alias("meta"))


MAP = "m(cluster, meta) AS (VALUES ('AF', 'meta_0'), ('AO', 'meta_0'), ('NF', 'meta_1'), ('NO', 'meta_1'))"
_c, _p, _f = tables.cells, tables.pixels, tables.fibers


def _neighbour_vectors(s: SparkSession, d: str) -> DataFrame:
    return clusters.features(spatial.neighborhood_matrix(_c(s, d), RADIUS, TYPES), TYPES)


def _morphology(s: SparkSession, d: str) -> DataFrame:
    a = _masks(s, d)[0].filter("label > 0")
    return a.groupBy("label").agg(*[F.round(build().cast("double"), 6).alias(name.replace("-", "_")) for name, build in MORPHOLOGY.items() if name != "orientation"])


def _wide(expr: str) -> str:
    return ", ".join(expr.format(c=c) for c in Z4)


#: name -> (query, SQL or None)
_ALL: dict = {
    "neighborhood_counts": (lambda s, d: spatial.neighborhood_counts(_c(s, d), RADIUS), f"WITH {COUNTS} SELECT * FROM counts"),
    "neighborhood_freqs": (lambda s, d: spatial.neighborhood_freqs(_c(s, d), RADIUS), f"WITH {COUNTS} SELECT fov, label, nb_type, round(n / sum(n) OVER (PARTITION BY fov, label), 6) freq FROM counts"),
    "neighborhood_matrix": (lambda s, d: spatial.neighborhood_matrix(_c(s, d), RADIUS, TYPES), f"WITH {PAIRS} SELECT fov, label, cell_type, " + ", ".join(f"count(*) FILTER (nb_type = '{t}') AS \"{t}\"" for t in TYPES) + " FROM pairs GROUP BY ALL"),
    "close_cell_pairs": (lambda s, d: spatial.close_cell_pairs(_c(s, d), RADIUS), f"WITH {PAIRS} SELECT cell_type type_a, nb_type type_b, count(*) n FROM pairs GROUP BY ALL"),
    "shannon_diversity": (lambda s, d: spatial.diversity(_c(s, d), RADIUS), f"WITH {COUNTS}, s AS (SELECT *, n / sum(n) OVER (PARTITION BY fov, label) s FROM counts) SELECT fov, label, round(-sum(s * log2(s)), 6) diversity FROM s GROUP BY ALL"),
    "mixing_scores": (
        lambda s, d: spatial.mixing_scores(_c(s, d), RADIUS, [T], [R], 5, 10),
        f"""WITH {PAIRS}, m AS (SELECT fov, label, cell_type, count(*) FILTER (nb_type = '{T}') t, count(*) FILTER (nb_type = '{R}') r FROM pairs GROUP BY ALL),
        g AS (SELECT fov, count(*) FILTER (cell_type = '{T}') nt, count(*) FILTER (cell_type = '{R}') nr, sum(t) FILTER (cell_type = '{T}') tt, sum(r) FILTER (cell_type = '{T}') tr, sum(r) FILTER (cell_type = '{R}') rr FROM m GROUP BY fov),
        j AS (SELECT f.fov, nt + nr >= 10 AND nt > 0 AND nr > 0 AND nt <= 5 * nr AND nr <= 5 * nt ok, tt, tr, rr, coalesce(nt + nr, 0) n FROM (SELECT DISTINCT fov FROM cells) f LEFT JOIN g ON f.fov = g.fov)
        SELECT fov, CASE WHEN ok THEN round(tr / nullif(CAST(tr + tt AS DOUBLE), 0), 6) END percent, CASE WHEN ok THEN round(tr / nullif(CAST(tt + rr AS DOUBLE), 0), 6) END homogeneous, n FROM j""",
    ),
    "cell_ratios": (lambda s, d: spatial.cell_ratios(_c(s, d), RADIUS, [T], [R]), f"WITH {PAIRS}, c AS (SELECT DISTINCT fov, label, cell_type FROM pairs), n AS (SELECT f.fov, count(*) FILTER (cell_type = '{T}') t, count(*) FILTER (cell_type = '{R}') r FROM (SELECT DISTINCT fov FROM cells) f LEFT JOIN c ON f.fov = c.fov GROUP BY f.fov) SELECT fov, CASE WHEN t > 0 AND r > 0 THEN round(t / CAST(r AS DOUBLE), 6) END cell_ratio, CASE WHEN t > 0 AND r > 0 THEN round(r / CAST(t AS DOUBLE), 6) END reverse_ratio FROM n"),
    "mean_knn_distance": (
        lambda s, d: spatial.mean_knn_distance(_c(s, d), 5),
        f"WITH {CELLS}, n AS (SELECT a.fov, a.label, b.cell_type nb_type, {D2} d2, row_number() OVER (PARTITION BY a.fov, a.label, b.cell_type ORDER BY {D2}, b.label) r FROM cells a JOIN cells b ON a.fov = b.fov AND {D2} > 0) SELECT fov, label, nb_type, CASE WHEN count(*) = 5 THEN round(avg(sqrt(d2)), 6) END mean_distance FROM n WHERE r <= 5 GROUP BY ALL",
    ),
    "fov_density": (lambda s, d: spatial.fov_density(_c(s, d), 512 * 512), f"WITH {CELLS} SELECT fov, cell_type, round(count(*) * 100 / 262144.0::DOUBLE, 6) density FROM cells GROUP BY ALL"),
    "crosstab": (lambda s, d: spatial.crosstab(_c(s, d)), f"WITH {CELLS}, n AS (SELECT fov, cell_type, count(*) n FROM cells GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY fov), 6) AS share FROM n"),
    "fiber_alignment": (
        lambda s, d: spatial.fiber_alignment(_f(s, d)),
        f"WITH {FIBERS}, l AS (SELECT * FROM fibers WHERE major >= 2 * minor), n AS (SELECT a.fov, a.label, (a.orientation - b.orientation) * (a.orientation - b.orientation) o, row_number() OVER (PARTITION BY a.fov, a.label ORDER BY {D2}, b.label) r FROM l a JOIN l b ON a.fov = b.fov AND a.label <> b.label), s AS (SELECT fov, label, round(sqrt(sum(o)) / 4, 6) alignment FROM n WHERE r <= 4 GROUP BY ALL) SELECT f.fov, f.label, s.alignment FROM fibers f LEFT JOIN s ON f.fov = s.fov AND f.label = s.label",
    ),
    "fiber_density": (lambda s, d: spatial.fiber_density(_f(s, d), 512 * 512), f"WITH {FIBERS} SELECT fov, round(100 * sum(area) / 262144.0::DOUBLE, 6) pixel_density, round(100 * count(DISTINCT label) / 262144.0::DOUBLE, 6) fiber_density FROM fibers GROUP BY fov"),
    "tile_stats": (
        lambda s, d: spatial.tile_stats(_f(s, d), 512, 64, 2),
        f"WITH {FIBERS}, g AS (SELECT fov, y.i ty, x.i tx FROM (SELECT DISTINCT fov FROM fibers), range(8) y(i), range(8) x(i)), m AS (SELECT fov, cy // 64 ty, cx // 64 tx, count(*) n, avg(area) a, avg(major) m FROM fibers GROUP BY ALL) SELECT g.fov, g.ty, g.tx, coalesce(n, 0) n, CASE WHEN n >= 2 THEN round(a, 6) END avg_area, CASE WHEN n >= 2 THEN round(m, 6) END avg_major FROM g LEFT JOIN m ON g.fov = m.fov AND g.ty = m.ty AND g.tx = m.tx",
    ),
    "channel_percentiles": (lambda s, d: pixels.channel_percentiles(_p(s, d), list(Z4), 0.999), f"WITH {PIXELS}, e AS (SELECT fov, {_wide('quantile_cont(nullif({c}, 0), 0.999) {c}')} FROM pixels GROUP BY fov) SELECT {_wide('round(avg({c}), 6) {c}')} FROM e"),
    "intensity_threshold": (lambda s, d: pixels.intensity_threshold(_p(s, d), {"q": 50.0, "p": 100.0}, 0.05), f"WITH {PIXELS}, e AS (SELECT fov, quantile_cont(q / 50.0::DOUBLE + p / 100.0::DOUBLE, 0.05) v FROM pixels GROUP BY fov) SELECT round(avg(v), 6) threshold FROM e"),
    "normalize_rows": (lambda s, d: pixels.normalize_rows(_p(s, d), list(Z4), ["fov", "label"]), f"WITH {PIXELS} SELECT fov, label, {_wide('round({c} / nullif(q + p + d + t, 0), 6) {c}')} FROM pixels"),
    "pixel_cluster_means": (lambda s, d: pixels.cluster_means(_p(s, d), "cluster", list(Z4)), f"WITH {PIXELS} SELECT cluster, {_wide('round(avg({c}), 6) {c}')}, count(*) n FROM pixels GROUP BY cluster"),
    "c2pc_counts": (lambda s, d: pixels.c2pc(_p(s, d), CLUSTERS), f"WITH {PIXELS} SELECT fov, label, " + ", ".join(f"count(*) FILTER (cluster = '{c}') AS \"{c}\"" for c in CLUSTERS) + " FROM pixels GROUP BY fov, label"),
    "c2pc_normalized": (lambda s, d: pixels.c2pc(_p(s, d), CLUSTERS, True), f"WITH {PIXELS} SELECT fov, label, " + ", ".join(f"round(count(*) FILTER (cluster = '{c}') / count(*), 6) AS \"{c}\"" for c in CLUSTERS) + " FROM pixels GROUP BY fov, label"),
    "weighted_channels": (lambda s, d: pixels.weighted_channels(_p(s, d), list(Z4)), f"WITH {PIXELS}, m AS (SELECT cluster, {_wide('avg({c}) {c}')} FROM pixels GROUP BY cluster), n AS (SELECT fov, label, cluster, count(*) n FROM pixels GROUP BY ALL) SELECT fov, label, {_wide('round(sum(n * {c}) / sum(n), 6) {c}')} FROM n JOIN m ON n.cluster = m.cluster GROUP BY fov, label"),
    "zscore_clip": (lambda s, d: pixels.zscore_clip(pixels.cell_table(_p(s, d), list(Z4)), list(Z4), 3.0, ["fov", "label"]), f"WITH {PIXELS}, t AS (SELECT fov, label, {_wide('round(sum({c}), 6) {c}')} FROM pixels GROUP BY fov, label), s AS (SELECT {_wide('avg({c}) a_{c}, stddev_pop({c}) s_{c}')} FROM t) SELECT fov, label, {_wide('round(greatest(least(({c} - a_{c}) / s_{c}, 3.0::DOUBLE), -3.0::DOUBLE), 6) {c}')} FROM t, s"),
    "cell_table": (lambda s, d: pixels.cell_table(_p(s, d), list(Z4)), f"WITH {PIXELS} SELECT fov, label, count(*) cell_size, {_wide('round(sum({c}), 6) {c}')} FROM pixels GROUP BY fov, label"),
    "cell_table_positive": (lambda s, d: pixels.cell_table(_p(s, d), list(Z4), "positive_pixel", 4.0), f"WITH {PIXELS} SELECT fov, label, count(*) cell_size, {_wide('count(*) FILTER ({c} > 4) {c}')} FROM pixels GROUP BY fov, label"),
    "extraction_registry": (lambda s, d: _p(s, d).groupBy("fov").agg(F.round(EXTRACTION["mean_intensity"]("q"), 6).alias("q")), f"WITH {PIXELS} SELECT fov, round(avg(q), 6) q FROM pixels GROUP BY fov"),
    "size_norm": (lambda s, d: pixels.transform_expression(pixels.cell_table(_p(s, d), list(Z4)), list(Z4), "size_norm"), f"WITH {PIXELS}, t AS (SELECT fov, label, count(*) cell_size, {_wide('round(sum({c}), 6) {c}')} FROM pixels GROUP BY fov, label) SELECT fov, label, cell_size, {_wide('round({c} / cell_size, 6) {c}')} FROM t"),
    "arcsinh": (lambda s, d: pixels.transform_expression(pixels.cell_table(_p(s, d), list(Z4)), list(Z4), "arcsinh"), f"WITH {PIXELS}, t AS (SELECT fov, label, count(*) cell_size, {_wide('round(sum({c}), 6) {c}')} FROM pixels GROUP BY fov, label) SELECT fov, label, cell_size, {_wide('round(asinh({c} * 100), 6) {c}')} FROM t"),
    "histogram": (lambda s, d: pixels.histogram(_p(s, d), "q", 0.0, 50.0, 10), f"WITH {PIXELS} SELECT CAST(least(floor(q / 5), 9) AS BIGINT) bin, count(*) n FROM pixels WHERE q BETWEEN 0 AND 50 GROUP BY 1"),
    "cluster_order": (lambda s, d: pixels.order_by_count(_p(s, d), "cluster"), f"WITH {PIXELS}, n AS (SELECT cluster, count(*) n FROM pixels GROUP BY 1) SELECT *, CAST(row_number() OVER (ORDER BY n DESC, cluster) AS INT) AS place FROM n"),
    "remap": (lambda s, d: labels.remap(_p(s, d), _mapping(s), "cluster").groupBy("fov", "meta").agg(F.count(F.lit(1)).alias("n")), f"WITH {PIXELS}, {MAP} SELECT fov, meta, count(*) n FROM pixels LEFT JOIN m ON pixels.cluster = m.cluster GROUP BY ALL"),
    "remap_default": (lambda s, d: labels.remap(_p(s, d), _mapping(s), "cluster", "unassigned").groupBy("fov", "meta").agg(F.count(F.lit(1)).alias("n")), f"WITH {PIXELS}, {MAP} SELECT fov, coalesce(meta, 'unassigned') meta, count(*) n FROM pixels LEFT JOIN m ON pixels.cluster = m.cluster GROUP BY ALL"),
    "as_of": (lambda s, d: labels.as_of(_c(s, d).select("label"), _steps(s), "label", "step", "meta"), f"WITH {CELLS}, s AS (SELECT i * 37 + 5 step, i * i meta FROM range(40) r(i)) SELECT label, meta FROM cells ASOF LEFT JOIN s ON cells.label >= s.step"),
    "uncovered_clusters": (lambda s, d: labels.uncovered(_p(s, d), _mapping(s), "cluster"), f"WITH {PIXELS}, {MAP} SELECT DISTINCT cluster FROM pixels WHERE cluster NOT IN (SELECT cluster FROM m)"),
    "shared_fovs": (lambda s, d: labels.shared(_c(s, d), _p(s, d), "fov"), f"WITH {CELLS}, {PIXELS} SELECT fov FROM cells INTERSECT SELECT fov FROM pixels"),
    "dense_ids": (lambda s, d: labels.dense_ids(_c(s, d), "cell_type"), f"WITH {CELLS} SELECT cell_type, CAST(dense_rank() OVER (ORDER BY cell_type) AS INT) id FROM (SELECT DISTINCT cell_type FROM cells)"),
    "renumber": (lambda s, d: labels.renumber(_c(s, d)), f"WITH {CELLS} SELECT fov, label, row_number() OVER (ORDER BY fov, label) global_label FROM cells"),
    "positive_cells": (lambda s, d: labels.positive(_c(s, d), "cy", 256).select("fov", "label"), f"WITH {CELLS} SELECT fov, label FROM cells WHERE cy > 256"),
    "reassign": (lambda s, d: labels.reassign(_c(s, d), T, "HIGH", "cy", 256), f"WITH {CELLS} SELECT fov, label, CASE WHEN cell_type = '{T}' AND cy > 256 THEN 'HIGH' ELSE cell_type END cell_type, cy, cx, cy >= 256 cy_threshold FROM cells"),
    "max_overlap": (lambda s, d: labels.max_overlap(*_masks(s, d)), f"WITH {MASKS}, o AS (SELECT ma.fov, ma.label a, mb.label b, count(*) n FROM ma JOIN mb USING (fov, y, x) GROUP BY ALL) SELECT fov, a, b, n FROM (SELECT *, row_number() OVER (PARTITION BY fov, a ORDER BY n DESC, b) r FROM o) WHERE r = 1"),
    "mask_morphology": (_morphology, f"WITH {MASKS} SELECT label, CAST(count(*) AS DOUBLE) area, round(avg(y), 6) centroid_0, round(avg(x), 6) centroid_1, CAST(max(y) - min(y) + 1 AS DOUBLE) bbox_height, CAST(max(x) - min(x) + 1 AS DOUBLE) bbox_width FROM ma GROUP BY label"),
    "kmeans_scan": (lambda s, d: clusters.kmeans_scan(_neighbour_vectors(s, d), range(2, 5)), None),
    "pca": (lambda s, d: clusters.pca(_neighbour_vectors(s, d), 2, ["fov", "label"]), None),
    "som": (lambda s, d: clusters.som(tables.table(s, d, "embeddings"), "embedding", ["vec_id"]), None),
    "topics": (lambda s, d: clusters.topics(_neighbour_vectors(s, d), 3, ["fov", "label"]), None),
}

QUERIES = {k: v[0] for k, v in _ALL.items()} | masks.QUERIES | more.QUERIES
ORACLES: dict[str, str] = {k: v[1] for k, v in _ALL.items() if v[1]} | masks.ORACLES | more.ORACLES
