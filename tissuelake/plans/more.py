"""Queries of the pixel matrix, map, consensus, topic, fibre and set operators, with the SQL that must give the same rows.

Where a result is learned, the query's labels come from a column, so that SQL can follow what is computed from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.registry import EXTRACTION, MORPHOLOGY
from ..operators import cells, clusters, distances, fibers, labels, masks, pixels, pixie, spatial, topics
from ..sources import tables
from .masks import CELLS, D2, RADIUS, TYPES, _images

CHANNELS = ["q", "p", "d", "t"]
PIXELS = "pixels AS (SELECT CAST(c_nationkey AS BIGINT) fov, CAST(o_custkey AS BIGINT) AS label, CAST(l_quantity AS DOUBLE) q, CAST(l_extendedprice AS DOUBLE) / 1000 p, round(CAST(l_discount AS DOUBLE) * 100) d, round(CAST(l_tax AS DOUBLE) * 100) t, l_returnflag || l_linestatus AS cluster FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"
NEAR = f"{CELLS}, near AS (SELECT a.fov, a.label, a.cell_type, b.label nb_label, b.cell_type nb_type, {D2} d2 FROM cells a JOIN cells b ON a.fov = b.fov AND {D2} < {RADIUS * RADIUS})"
MATRIX = f"{NEAR}, matrix AS (SELECT fov, label, cell_type, " + ", ".join(f"count(*) FILTER (nb_type = '{t}') AS {t}" for t in TYPES) + " FROM near WHERE d2 > 0 GROUP BY ALL)"
VECTOR = ", ".join(f"CAST({t} AS DOUBLE)" for t in TYPES)
_c, _p = tables.cells, tables.pixels

#: Masks over the cell table, so that they grow with it: a disc of radius 3 around each cell, the larger label on top;
#: nuclei are discs of radius 1 set off by a pixel.
DISCS = f"{CELLS}, spots AS (SELECT fov, label + 1 AS label, cy + dy.i y, cx + dx.i x FROM cells, range(-3, 4) dy(i), range(-3, 4) dx(i) WHERE dy.i * dy.i + dx.i * dx.i <= 9), disc AS (SELECT fov, y, x, max(label) AS label FROM spots GROUP BY ALL), kern AS (SELECT fov, y, x, max(label) AS label FROM (SELECT fov, label + 1000001 AS label, cy + 1 + dy.i y, cx + dx.i x FROM cells, range(-1, 2) dy(i), range(-1, 2) dx(i)) GROUP BY ALL)"


def _disc(s: SparkSession, d: str, reach: int = 3, shift: int = 0, offset: int = 0) -> DataFrame:
    steps = F.sequence(F.lit(-reach).cast("long"), F.lit(reach).cast("long"))
    rows = _c(s, d).withColumn("dy", F.explode(steps)).withColumn("dx", F.explode(steps))
    if reach == 3:
        rows = rows.filter("dy * dy + dx * dx <= 9")
    spots = rows.select("fov", (F.col("cy") + shift + F.col("dy")).alias("y"), (F.col("cx") + F.col("dx")).alias("x"), (F.col("label") + 1 + offset).alias("label"))
    return spots.groupBy("fov", "y", "x").agg(F.max("label").alias("label"))


def _kern(s: SparkSession, d: str) -> DataFrame:
    return _disc(s, d, 1, 1, 1_000_000)


def _signal(s: SparkSession, d: str) -> DataFrame:
    return _disc(s, d).withColumns({"a": F.expr("cast((y * 31 + x * 17) % 23 as double)"), "b": F.expr("cast(greatest((y * 7 - x * 5) % 11, 0) as double)")})


def _matrix(s: SparkSession, d: str) -> DataFrame:
    return spatial.neighborhood_matrix(_c(s, d), RADIUS, TYPES)


def _fibers(s: SparkSession, d: str) -> DataFrame:
    return tables.fibers(s, d).withColumns({"eccentricity": F.expr("(label % 97) / 97.0D"), "euler_number": F.expr("label % 3 - 1"), "alignment_score": F.expr("CASE WHEN label % 4 > 0 THEN (label % 31) * 1.0D END")})


FIBERS = f"{CELLS}, fibers AS (SELECT *, major * minor AS area, (label % 97) / 97.0::DOUBLE eccentricity, label % 3 - 1 euler_number, CASE WHEN label % 4 > 0 THEN CAST(label % 31 AS DOUBLE) END alignment_score FROM (SELECT fov, label, cy, cx, label * 37 % 180 AS orientation, label * 13 % 50 + 1 AS major, label * 7 % 20 + 1 AS minor FROM cells))"
PROPERTIES = ["major", "minor", "orientation", "area", "eccentricity", "euler_number", "alignment_score"]


def _profile(s: SparkSession, d: str, part: int) -> DataFrame:
    """Clusters are fixed by the label here, so that SQL can follow."""
    rows = _matrix(s, d).select("fov", "label", (F.col("label") % 4 + 1).alias("cluster"))
    return clusters.cluster_profile(_c(s, d), rows, TYPES, ["cy", "cx"])[part]


def _nodes(s: SparkSession, d: str) -> DataFrame:
    """Cells with the nearest of nine fixed nodes by position."""
    import numpy as np

    nodes = np.array([[y, x] for y in (85.0, 256.0, 427.0) for x in (85.0, 256.0, 427.0)])
    rows = _c(s, d).select("fov", "label", F.array(F.col("cy").cast("double"), F.col("cx").cast("double")).alias("v"))
    return clusters.assign_nodes(rows, "v", nodes, "node", ["fov", "label"])


def _consensus(s: SparkSession, d: str) -> DataFrame:
    return pixie.consensus_map(pixie.averages(_p(s, d), "cluster", CHANNELS), "cluster", CHANNELS, "meta", 3)


def _small(s: SparkSession, d: str) -> DataFrame:
    return _matrix(s, d).filter("fov < 5")


_B = ", ".join(f"b.{t}" for t in TYPES)
FAR = "sqrt(" + " + ".join(f"(a.{t} - b.{t}) * (a.{t} - b.{t})" for t in TYPES) + ")"
_HALF = "CASE WHEN coalesce(q, 0) <> 0 OR coalesce(p, 0) <> 0 OR coalesce(d, 0) <> 0 OR coalesce(t, 0) <> 0 THEN true ELSE false END"

#: name -> (query, SQL or None)
_ALL: dict = {
    "self_neighbor_counts": (lambda s, d: spatial.neighborhood_counts(_c(s, d), RADIUS, True), f"WITH {NEAR} SELECT fov, label, nb_type, count(*) n FROM near GROUP BY ALL"),
    "self_neighbor_freqs": (lambda s, d: spatial.neighborhood_freqs(_c(s, d), RADIUS, True), f"WITH {NEAR}, n AS (SELECT fov, label, nb_type, count(*) n FROM near GROUP BY ALL) SELECT fov, label, nb_type, round(n / sum(n) OVER (PARTITION BY fov, label), 6) freq FROM n"),
    "mixing_populations": (
        lambda s, d: spatial.mixing_scores(_c(s, d), RADIUS, ["BUILDING", "FURNITURE"], ["MACHINERY", "HOUSEHOLD"], 5, 20),
        f"""WITH {MATRIX}, m AS (SELECT fov, cell_type IN ('BUILDING', 'FURNITURE') ist, cell_type IN ('MACHINERY', 'HOUSEHOLD') isr, BUILDING + FURNITURE t, MACHINERY + HOUSEHOLD r FROM matrix),
        g AS (SELECT fov, count(*) FILTER (ist) nt, count(*) FILTER (isr) nr, sum(t) FILTER (ist) tt, sum(r) FILTER (ist) tr, sum(r) FILTER (isr) rr FROM m GROUP BY fov)
        SELECT f.fov, CASE WHEN nt + nr >= 20 AND nt > 0 AND nr > 0 AND nt <= 5 * nr AND nr <= 5 * nt THEN round(tr / nullif(CAST(tr + tt AS DOUBLE), 0), 6) END percent,
        CASE WHEN nt + nr >= 20 AND nt > 0 AND nr > 0 AND nt <= 5 * nr AND nr <= 5 * nt THEN round(tr / nullif(CAST(tt + rr AS DOUBLE), 0), 6) END homogeneous, coalesce(nt + nr, 0) n FROM (SELECT DISTINCT fov FROM cells) f LEFT JOIN g ON g.fov = f.fov""",
    ),
    "near_anchor": (lambda s, d: spatial.anchored(_c(s, d), RADIUS, "BUILDING").select("fov", "label", "near_anchor"), f"WITH {NEAR} SELECT fov, label, bool_or(nb_type = 'BUILDING') near_anchor FROM near GROUP BY fov, label"),
    "marker_contacts": (lambda s, d: spatial.cluster_contacts(_c(s, d), RADIUS, "cy", 256), f"WITH {CELLS} SELECT a.fov, count(*) n FROM cells a JOIN cells b ON a.fov = b.fov AND a.label < b.label AND a.cy > 256 AND b.cy > 256 AND {D2} > 0 AND {D2} < {RADIUS * RADIUS} GROUP BY a.fov"),
    "within_cluster_sums": (lambda s, d: topics.within_cluster_sums(_matrix(s, d), "cell_type", TYPES), f"WITH {MATRIX}, p AS (SELECT a.cell_type, sum({FAR}) / 2 s FROM matrix a JOIN matrix b ON a.cell_type = b.cell_type GROUP BY 1), n AS (SELECT cell_type, count(*) n FROM matrix GROUP BY 1) SELECT round(sum(s / (2 * n)), 6) \"within\" FROM p JOIN n USING (cell_type)"),
    "silhouette": (
        lambda s, d: clusters.silhouette(_small(s, d), TYPES, "cell_type"),
        f"""WITH {MATRIX}, m AS (SELECT * FROM matrix WHERE fov < 5), p AS (SELECT a.fov, a.label, a.cell_type g, b.cell_type h, sum({FAR}) s, count(*) n FROM m a, m b GROUP BY ALL),
        e AS (SELECT fov, label, max(s / (n - 1)) FILTER (g = h AND n > 1) a, min(s / n) FILTER (g <> h) b FROM p GROUP BY fov, label, g)
        SELECT round(avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) silhouette FROM e""",
    ),
    "pair_distance_sums": (lambda s, d: distances.pair_sums(_matrix(s, d), "fov", TYPES).withColumn("distance_sum", F.round("distance_sum", 4)), f"WITH {MATRIX} SELECT a.fov, round(sum({FAR}) / 2, 4) distance_sum, CAST(sqrt(count(*)) AS BIGINT) n FROM matrix a JOIN matrix b ON a.fov = b.fov GROUP BY a.fov"),
    "cluster_types": (lambda s, d: _profile(s, d, 1), f"WITH {MATRIX} SELECT 'Cluster' || (label % 4 + 1) AS cluster, " + ", ".join(f"count(*) FILTER (cell_type = '{t}') AS \"{t}\"" for t in TYPES) + " FROM matrix GROUP BY 1"),
    "cluster_markers": (lambda s, d: _profile(s, d, 2), f"WITH {MATRIX} SELECT 'Cluster' || (m.label % 4 + 1) AS cluster, round(avg(cy), 6) cy, round(avg(cx), 6) cx FROM matrix m JOIN cells c ON c.fov = m.fov AND c.label = m.label GROUP BY 1"),
    "profile_zscores": (lambda s, d: clusters.profile_zscores(_profile(s, d, 2), ["cy", "cx"], "cluster"), f"WITH {MATRIX}, m AS (SELECT 'Cluster' || (m.label % 4 + 1) AS cluster, round(avg(cy), 6) cy, round(avg(cx), 6) cx FROM matrix m JOIN cells c ON c.fov = m.fov AND c.label = m.label GROUP BY 1) SELECT cluster, round((cy - (SELECT avg(cy) FROM m)) / (SELECT stddev_pop(cy) FROM m), 6) cy, round((cx - (SELECT avg(cx) FROM m)) / (SELECT stddev_pop(cx) FROM m), 6) cx FROM m"),
    "neighborhood_write_back": (lambda s, d: _c(s, d).select("fov", "label", "cell_type").join(_profile(s, d, 0).select("fov", "label", "cluster"), ["fov", "label"], "left"), f"WITH {MATRIX} SELECT c.fov, c.label, c.cell_type, CASE WHEN m.label IS NOT NULL THEN c.label % 4 + 1 END AS cluster FROM cells c LEFT JOIN matrix m ON c.fov = m.fov AND c.label = m.label"),
    "format_cells": (lambda s, d: topics.format_cells(_c(s, d), clusters=TYPES[:2]), f"WITH {CELLS} SELECT fov, label, cell_type AS cluster, cy y, cx x, true is_index FROM cells WHERE cell_type IN ('AUTOMOBILE', 'BUILDING')"),
    "pixel_matrix": (
        lambda s, d: pixie.pixel_matrix(_p(s, d), CHANNELS, 40.0).select("fov", "label", "cluster", *[F.round(c, 6).alias(c) for c in CHANNELS]),
        f"WITH {PIXELS} SELECT fov, label, cluster, " + ", ".join(f"round({c} / (q + p + d + t), 6) {c}" for c in CHANNELS) + f" FROM pixels WHERE q + p + d + t > 40 AND {_HALF}",
    ),
    "pixel_training_rows": (lambda s, d: pixie.training_rows(_p(s, d), 0.1, ["label", *CHANNELS, "cluster"]).groupBy("fov").agg(F.count(F.lit(1)).alias("n")), f"WITH {PIXELS} SELECT fov, CAST(round_even(count(*) * 0.1, 0) AS BIGINT) n FROM pixels GROUP BY fov"),
    "pixel_norms": (lambda s, d: pixie.divided(_p(s, d).select("fov", "label", "q", "p"), {"q": 25.0, "p": 50.0}).select("fov", "label", F.round("q", 6).alias("q"), F.round("p", 6).alias("p")), f"WITH {PIXELS} SELECT fov, label, round(q / 25, 6) q, round(p / 50, 6) p FROM pixels"),
    "cell_norms": (lambda s, d: s.createDataFrame([tuple(round(v, 6) for v in pixie.nonzero_quantiles(pixels.c2pc(_p(s, d), ["AF", "NO"]), ["AF", "NO"]).values())], "af double, no double"), f"WITH {PIXELS}, t AS (SELECT fov, label, count(*) FILTER (cluster = 'AF') af, count(*) FILTER (cluster = 'NO') no FROM pixels GROUP BY ALL) SELECT round(quantile_cont(nullif(af, 0)::DOUBLE, 0.999), 6) af, round(quantile_cont(nullif(no, 0)::DOUBLE, 0.999), 6) no FROM t"),
    "nearest_nodes": (
        _nodes,
        f"WITH {CELLS}, nodes AS (SELECT y.i * 3 + x.i + 1 node, [85.0, 256, 427][y.i + 1] ny, [85.0, 256, 427][x.i + 1] nx FROM range(3) y(i), range(3) x(i)), r AS (SELECT fov, label, node, row_number() OVER (PARTITION BY fov, label ORDER BY (cy - ny) * (cy - ny) + (cx - nx) * (cx - nx), node) r FROM cells, nodes) SELECT fov, label, CAST(node AS INTEGER) node FROM r WHERE r = 1",
    ),
    "consensus_map": (_consensus, None),
    "remapped_pixels": (
        lambda s, d: pixie.remapped(_p(s, d), s.createDataFrame([(c, i // 2 + 1, f"meta{i // 2 + 1}") for i, c in enumerate(["AF", "AO", "NF", "NO", "RF", "RO"])], "cluster string, meta int, name string"), "cluster", "meta", "name").groupBy("meta", "name").agg(F.count(F.lit(1)).alias("n")),
        f"WITH {PIXELS}, m AS (SELECT cluster, CASE WHEN cluster IN ('AF', 'AO') THEN 1 WHEN cluster IN ('NF', 'NO') THEN 2 ELSE 3 END meta, count(*) n FROM pixels GROUP BY cluster) SELECT meta, 'meta' || meta AS name, CAST(sum(n) AS BIGINT) n FROM m GROUP BY meta",
    ),
    "meta_averages": (lambda s, d: pixie.averages(_p(s, d), "cluster", CHANNELS), f"WITH {PIXELS} SELECT cluster, " + ", ".join(f"round(avg({c}), 6) {c}" for c in CHANNELS) + ", count(*) count FROM pixels GROUP BY cluster"),
    "segment_fibers": (lambda s, d: fibers.segment_fibers(_images(s), 1, sigma=1, divisor=4, widths=(1, 2), least=3), None),
    "fiber_table": (
        lambda s, d: fibers.fiber_table(_disc(s, d)).select("fov", "label", "area", F.round("major", 4).alias("major"), F.round("cy", 6).alias("cy"), F.round("cx", 6).alias("cx")),
        f"WITH {DISCS}, m AS (SELECT fov, label, count(*) area, avg(y) cy, avg(x) cx, var_pop(y) vy, var_pop(x) vx, covar_pop(y, x) c FROM disc GROUP BY ALL) SELECT fov, label, area, round(4 * sqrt((vy + vx + sqrt(4 * c * c + (vy - vx) * (vy - vx))) / 2), 4) major, round(cy, 6) cy, round(cx, 6) cx FROM m",
    ),
    "fiber_summary": (lambda s, d: spatial.fiber_summary(_fibers(s, d), 512, PROPERTIES), f"WITH {FIBERS} SELECT fov, round(100 * sum(area) / 262144.0::DOUBLE, 6) pixel_density, round(100 * count(DISTINCT label) / 262144.0::DOUBLE, 6) fiber_density, " + ", ".join(f"round(avg({p}), 6) avg_{p}" for p in PROPERTIES) + " FROM fibers GROUP BY fov"),
    "tile_summary": (
        lambda s, d: spatial.tile_summary(_fibers(s, d), 512, 64, 2, PROPERTIES),
        f"WITH {FIBERS}, g AS (SELECT fov, y.i ty, x.i tx FROM (SELECT DISTINCT fov FROM fibers), range(8) y(i), range(8) x(i)), m AS (SELECT fov, cy // 64 ty, cx // 64 tx, count(*) n, round(100 * sum(area) / 4096.0::DOUBLE, 6) pd, round(100 * count(DISTINCT label) / 4096.0::DOUBLE, 6) fd, " + ", ".join(f"avg({p}) a_{p}" for p in PROPERTIES) + " FROM fibers GROUP BY ALL) SELECT g.fov, g.ty, g.tx, coalesce(n, 0) n, coalesce(pd, 0) pixel_density, coalesce(fd, 0) fiber_density, " + ", ".join(f"CASE WHEN n >= 2 THEN round(a_{p}, 6) END avg_{p}" for p in PROPERTIES) + " FROM g LEFT JOIN m ON g.fov = m.fov AND g.ty = m.ty AND g.tx = m.tx",
    ),
    "compartment_table": (
        lambda s, d: cells.compartment_table(_signal(s, d), _kern(s, d), ["a", "b"]).withColumnsRenamed({f"centroid-{i}{e}": f"centroid_{i}{e}" for i in (0, 1) for e in ("", "_nuclear")}),
        f"""WITH {DISCS}, sig AS (SELECT *, CAST((y * 31 + x * 17) % 23 AS DOUBLE) a, CAST(greatest((y * 7 - x * 5) % 11, 0) AS DOUBLE) b FROM disc),
        o AS (SELECT s.fov, s.label, k.label nucleus, count(*) n FROM sig s JOIN kern k ON s.fov = k.fov AND s.y = k.y AND s.x = k.x GROUP BY ALL), own AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY fov, label ORDER BY n DESC, nucleus) = 1),
        w AS (SELECT fov, label, count(*) area, avg(y) c0, avg(x) c1, sum(a) a, sum(b) b FROM sig GROUP BY ALL), nu AS (SELECT k.fov, k.label, count(*) area, avg(k.y) c0, avg(k.x) c1, sum(a) a, sum(b) b FROM kern k JOIN sig s ON s.fov = k.fov AND s.y = k.y AND s.x = k.x GROUP BY ALL)
        SELECT w.fov, w.label, CAST(w.area AS DOUBLE) area, round(w.c0, 6) centroid_0, round(w.c1, 6) centroid_1, round(w.a, 6) a, round(w.b, 6) b, CAST(coalesce(nu.area, 0) AS DOUBLE) area_nuclear, round(coalesce(nu.c0, 0), 6) centroid_0_nuclear, round(coalesce(nu.c1, 0), 6) centroid_1_nuclear, round(coalesce(nu.a, 0), 6) a_nuclear, round(coalesce(nu.b, 0), 6) b_nuclear, round(coalesce(nu.area / CAST(w.area AS DOUBLE), 0), 6) nc_ratio
        FROM w LEFT JOIN own ON own.fov = w.fov AND own.label = w.label LEFT JOIN nu ON nu.fov = own.fov AND nu.label = own.nucleus""",
    ),
    "extraction_modes": (
        lambda s, d: _p(s, d).groupBy("fov", "label").agg(F.round(EXTRACTION["mean_intensity"]("q"), 6).alias("mean_q"), F.round(EXTRACTION["total_intensity"]("q"), 6).alias("total_q"), EXTRACTION["positive_pixel"]("d", 4.0).alias("positive_d")),
        f"WITH {PIXELS} SELECT fov, label, round(avg(q), 6) mean_q, round(sum(q), 6) total_q, count(*) FILTER (d > 4) positive_d FROM pixels GROUP BY fov, label",
    ),
    "cell_orientation": (
        lambda s, d: _disc(s, d).groupBy("fov", "label").agg(F.round(MORPHOLOGY["orientation"](), 6).alias("orientation"), F.covar_pop("y", "x").alias("c")).filter("abs(c) > 0.001").drop("c"),
        f"WITH {DISCS} SELECT fov, label, round(atan2(2 * covar_pop(y, x), var_pop(y) - var_pop(x)) / 2, 6) orientation FROM disc GROUP BY fov, label HAVING abs(covar_pop(y, x)) > 0.001",
    ),
    "center_weighted_cells": (
        lambda s, d: cells.center_weighting(_signal(s, d), "a"),
        f"WITH {DISCS}, c AS (SELECT fov, label, avg(y) cy, avg(x) cx FROM disc GROUP BY fov, label), d AS (SELECT s.fov, s.label, (y * 31 + x * 17) % 23 v, greatest(abs(y - cy), abs(x - cx)) d FROM disc s JOIN c ON s.fov = c.fov AND s.label = c.label), m AS (SELECT fov, label, max(d) m FROM d GROUP BY fov, label) SELECT d.fov, d.label, round(sum(v * (1 - d / (m + 1))), 6) a FROM d JOIN m ON d.fov = m.fov AND d.label = m.label GROUP BY d.fov, d.label",
    ),
    "erode_cells": (
        lambda s, d: masks.erode(_disc(s, d), 515, 515).groupBy("fov", "label").agg(F.count(F.lit(1)).alias("n")),
        f"""WITH {DISCS}, n AS (SELECT a.fov, a.y, a.x, a.label, bool_or(coalesce(b.label, 0) <> a.label) e FROM disc a CROSS JOIN (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) v(dy, dx) LEFT JOIN disc b ON b.fov = a.fov AND b.y = a.y + v.dy AND b.x = a.x + v.dx
        WHERE a.y + v.dy BETWEEN CASE WHEN v.dy = -1 THEN 0 ELSE -9 END AND CASE WHEN v.dy = 1 THEN 514 ELSE 999 END AND a.x + v.dx BETWEEN CASE WHEN v.dx = -1 THEN 0 ELSE -9 END AND CASE WHEN v.dx = 1 THEN 514 ELSE 999 END OR (v.dy = -1 AND a.y <> 0 AND a.y + v.dy < 0) OR (v.dx = -1 AND a.x <> 0 AND a.x + v.dx < 0) GROUP BY ALL)
        SELECT fov, CASE WHEN e THEN 0 ELSE label END AS label, count(*) n FROM n GROUP BY 1, 2""",
    ),
    "cell_boxes": (lambda s, d: masks.boxes(_disc(s, d)).select("fov", "label", "y0", "y1", "x0", "x1", "area"), f"WITH {DISCS} SELECT fov, label, min(y) y0, max(y) y1, min(x) x0, max(x) x1, count(*) area FROM disc GROUP BY fov, label"),
    "nuclei_of_cells": (lambda s, d: labels.max_overlap(_disc(s, d), _kern(s, d)), f"WITH {DISCS}, o AS (SELECT a.fov, a.label a, b.label b, count(*) n FROM disc a JOIN kern b ON a.fov = b.fov AND a.y = b.y AND a.x = b.x GROUP BY ALL) SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY fov, a ORDER BY n DESC, b) = 1"),
    "appearance_ids": (lambda s, d: labels.appearance_ids(_c(s, d), "cell_type", "label"), f"WITH {CELLS}, f AS (SELECT cell_type, min(label) m FROM cells GROUP BY 1) SELECT cell_type, CAST(row_number() OVER (ORDER BY m, cell_type) AS INTEGER) id FROM f"),
    "union_distinct": (lambda s, d: labels.union_distinct(_c(s, d).filter("label % 3 = 0"), _p(s, d), "label"), f"WITH {CELLS}, {PIXELS} SELECT label FROM cells WHERE label % 3 = 0 UNION SELECT label FROM pixels"),
    "set_relation": (lambda s, d: labels.set_relation(_p(s, d), _c(s, d), "label"), f"WITH {CELLS}, {PIXELS}, a AS (SELECT label FROM pixels EXCEPT SELECT label FROM cells), b AS (SELECT label FROM cells EXCEPT SELECT label FROM pixels) SELECT (SELECT count(*) FROM a) + (SELECT count(*) FROM b) = 0 same, (SELECT count(*) FROM a) = 0 AS \"within\", (SELECT count(*) FROM a) only_a, (SELECT count(*) FROM b) only_b"),
    "complete_rows": (lambda s, d: labels.drop_incomplete(_c(s, d).withColumn("v", F.expr("CASE label % 3 WHEN 0 THEN null WHEN 1 THEN double('nan') ELSE 1.0D END")), ["v", "cell_type"]).select("fov", "label"), f"WITH {CELLS} SELECT fov, label FROM cells WHERE label % 3 = 2"),
    "nan_to_null": (lambda s, d: tables.nan_to_null(_c(s, d).withColumn("v", F.expr("CASE WHEN label % 3 = 1 THEN double('nan') ELSE cast(cy as double) END"))).groupBy("fov").agg(F.round(F.avg("v"), 6).alias("v"), F.count("v").alias("n")), f"WITH {CELLS} SELECT fov, round(avg(cy) FILTER (label % 3 <> 1), 6) v, count(*) FILTER (label % 3 <> 1) n FROM cells GROUP BY fov"),
    "threshold_flags": (lambda s, d: labels.threshold_flags(_c(s, d), {"cy": 256, "cx": 100}).select("fov", "label", "cy_positive", "cx_positive"), f"WITH {CELLS} SELECT fov, label, cy >= 256 cy_positive, cx >= 100 cx_positive FROM cells"),
    "split_cluster": (lambda s, d: labels.split_cluster(_c(s, d), "BUILDING", "cy", 256, "LOW", "HIGH").groupBy("cell_type").agg(F.count(F.lit(1)).alias("n")), f"WITH {CELLS} SELECT CASE WHEN cell_type <> 'BUILDING' THEN cell_type WHEN cy > 256 THEN 'HIGH' ELSE 'LOW' END cell_type, count(*) n FROM cells GROUP BY 1"),
    "renamed_columns": (lambda s, d: labels.renamed(_c(s, d).select("fov", "label", "cy", "cx"), ["cy", "cx"], "raw_", "_px"), f"WITH {CELLS} SELECT fov, label, cy raw_cy_px, cx raw_cx_px FROM cells"),
    "tidy_names": (lambda s, d: labels.tidy_names(_c(s, d).select(F.concat(F.lit(" fov"), "fov", F.lit("_mask.tiff ")).alias("name")), "name", ".tiff", 12), f"WITH {CELLS}, n AS (SELECT DISTINCT ' fov' || fov || '_mask.tiff ' AS name FROM cells) SELECT name, trim(replace(name, '.tiff', '')) bare, split_part(trim(replace(name, '.tiff', '')), '_', 1) head, lpad(trim(replace(name, '.tiff', '')), 12, '0') padded FROM n"),
    "row_norms": (lambda s, d: spatial.row_norms(_p(s, d), CHANNELS, ["fov", "label"]), f"WITH {PIXELS} SELECT fov, label, round(q + p + d + t, 6) total, round(sqrt(q * q + p * p + d * d + t * t), 6) l2, round(greatest(abs(q), abs(p), abs(d), abs(t)), 6) linf FROM pixels"),
    "marker_subset": (lambda s, d: _c(s, d).select("fov", "label", *labels.columns_like(_c(s, d), "c[xy]$")), f"WITH {CELLS} SELECT fov, label, cx, cy FROM cells"),
}

QUERIES = {k: v[0] for k, v in _ALL.items()}
ORACLES: dict[str, str] = {k: v[1] for k, v in _ALL.items() if v[1]}
