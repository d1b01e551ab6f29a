"""A cohort from images to cell clusters, continued and repeated."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tissuelake.operators import pixie, workflows
from tissuelake.sources import files

CHANNELS = ["red", "green"]


def cohort(spark, fovs):
    """Cells of two kinds on a grid: one red, one green."""
    rows = []
    for f in fovs:
        rng = np.random.default_rng(f)
        for y in range(16):
            for x in range(16):
                kind = (y // 4 + x // 4) % 2
                inside = y % 4 < 3 and x % 4 < 3
                for c, name in enumerate(CHANNELS):
                    rows.append((f"fov{f}", name, y, x, float(inside * (9 if c == kind else 1) * rng.uniform(0.9, 1.1))))
    return spark.createDataFrame(rows, "fov string, channel string, y long, x long, value double")


def mask(spark, fovs):
    rows = [(f"fov{f}", y, x, y // 4 * 4 + x // 4 + 1 if y % 4 < 3 and x % 4 < 3 else 0) for f in fovs for y in range(16) for x in range(16)]
    return spark.createDataFrame(rows, "fov string, y long, x long, label long")


def test_from_images_to_cells(spark, tmp_path):
    base = f"{tmp_path}/run"
    save = lambda fovs: pixie.save_pixel_matrix(spark, cohort(spark, fovs), CHANNELS, base, {}, 0, 0.5, 0.5, mask=mask(spark, fovs))
    assert save([1, 2]) == ["fov1", "fov2"]
    som, norms = workflows.train_pixel_som(spark, base, CHANNELS, xdim=2, ydim=2, passes=3)
    assert set(norms) == set(CHANNELS) and workflows.cluster_pixels(spark, base, som, norms) == ["fov1", "fov2"]
    assert workflows.cluster_pixels(spark, base, som, norms) == [] and save([1, 2, 3]) == ["fov3"]
    assert workflows.cluster_pixels(spark, base, som, norms) == ["fov3"]
    with pytest.raises(ValueError, match="no pixels"):
        workflows.train_pixel_som(spark, base, CHANNELS, fovs=["none"])
    with pytest.raises(ValueError, match="without a pixel"):
        workflows.pixel_averages(spark, base, CHANNELS, expected=5)
    found = workflows.pixel_consensus(spark, base, CHANNELS, k=2)
    rows = spark.read.parquet(f"{base}/clustered").join(found, workflows.NODE)
    kinds = rows.groupBy(((F.floor(F.col("y") / 4) + F.floor(F.col("x") / 4)) % 2).alias("kind")).agg(F.countDistinct(workflows.META).alias("n"), F.min(workflows.META).alias("meta")).collect()
    assert sorted(r.n for r in kinds) == [1, 1] and {r.meta for r in kinds} == {1, 2}
    named = found.withColumn(workflows.NAME, F.when(F.col(workflows.META) == 1, "a").otherwise("b"))
    clustered = workflows.rename_pixel_meta(spark, base, named)
    assert {r[0] for r in clustered.select(workflows.NAME).distinct().collect()} == {"a", "b"}

    cells = mask(spark, [1, 2, 3]).filter("label > 0").groupBy("fov", "label").agg(F.count(F.lit(1)).alias("cell_size"))
    cells = cells.unionByName(spark.createDataFrame([("fov1", 99, 9)], "fov string, label long, cell_size long"))
    counts, shares = workflows.cell_counts(clustered, cells, workflows.NAME)
    assert counts.count() == 48 and {tuple(r)[3:] for r in counts.collect()} == {(9, 0), (0, 9)}
    assert {tuple(r)[3:] for r in shares.collect()} == {(1.0, 0.0), (0.0, 1.0)}
    columns = [c for c in shares.columns if c.startswith(workflows.NAME)]
    made = workflows.cluster_cells(spark, base, shares, columns, xdim=2, ydim=1, passes=20)
    assert made.count() == 48 and made.select("cell_som_cluster").distinct().count() == 2
    meta = workflows.cell_consensus(spark, base, columns, k=2)
    full = workflows.label_cells(cells, meta)
    assert full.count() == 49 and full.filter("cell_meta_cluster = 'Unassigned'").count() == 1
    means = pixie.averages(clustered, workflows.NAME, CHANNELS).withColumn("cluster", F.concat(F.lit(workflows.NAME + "_"), F.col(workflows.NAME)))
    weighted = workflows.weighted_averages(meta, counts, means, "cell_meta_cluster", columns, CHANNELS).toPandas()
    assert len(weighted) == 2 and weighted["count"].sum() == 48 and sorted(weighted.red > weighted.green) == [False, True]
    names = workflows.save_cluster_masks(mask(spark, [1, 2, 3]), full.filter("label < 99"), "cell_meta_cluster", f"{base}/masks", "_cells")
    assert names.count() == 2
    back = files.read_masks(spark, f"{base}/masks", "_cells")
    assert {r[0] for r in back.select("label").distinct().collect()} == {0, 1, 2}
    with pytest.raises(ValueError, match="not in the table"):
        workflows.cluster_cells(spark, base, shares, ["none"])


def test_cell_tables_of_several_masks(spark):
    wide = pixie.image_pixels(cohort(spark, [1]), CHANNELS, {}, 0, mask(spark, [1]))
    half = wide.withColumn("label", F.when(F.col("label") % 2 == 1, F.col("label")).otherwise(0))
    nuclei = mask(spark, [1]).filter("y % 4 = 1 and x % 4 = 1 and label < 9")
    size, asinh = workflows.cell_tables({"whole_cell": wide, "odd": half}, CHANNELS, nuclei)
    rows = {(r.mask_type, r.label): r for r in size.collect()}
    assert len(rows) == 24 and rows["whole_cell", 1].nc_ratio == pytest.approx(1 / 9, abs=1e-6) and rows["whole_cell", 12].area_nuclear == 0
    sums = wide.filter("label = 3").agg(F.sum("red"), F.count(F.lit(1))).first()
    assert rows["odd", 3].red == pytest.approx(sums[0] / sums[1], abs=1e-6)
    changed = {(r.mask_type, r.label): r for r in asinh.collect()}
    assert all(changed[k].red == pytest.approx(np.arcsinh(100 * r.red), abs=2e-4) for k, r in rows.items())
    plain = workflows.cell_tables({"whole_cell": wide}, CHANNELS)[0]
    assert plain.count() == 16 and plain.columns == ["fov", "label", "cell_size", *CHANNELS, "mask_type"]


def test_names_and_copies(spark, tmp_path):
    assert workflows.mask_types(["fov1", "fov_2"], ["fov1_whole_cell.tiff", "fov1_nuclear.tif", "fov_2_whole_cell.tiff", "fov3_x.tiff"]) == ["nuclear", "whole_cell"]
    files.write_masks(mask(spark, [1, 2]), f"{tmp_path}/m", "_whole_cell")
    copies = workflows.copy_files(spark, f"{tmp_path}/m", "fov1*", f"{tmp_path}/copy")
    assert [c.rsplit("/", 1)[1] for c in copies] == ["fov1_whole_cell.tiff"]
    assert files.read_masks(spark, f"{tmp_path}/copy", "_whole_cell").count() == 256


def test_outlines(spark, tmp_path):
    workflows.save_outlines(mask(spark, [1]), f"{tmp_path}/o")
    rows = files.read_masks(spark, f"{tmp_path}/o", "_outlines").filter("label = 6")
    assert {(r.y, r.x) for r in rows.collect()} == {(4 + i, 4 + j) for i in range(3) for j in range(3)} - {(5, 5)}
