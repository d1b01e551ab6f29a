"""Neighbourhoods, distances, diversity, mixing and tiles, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pairs(cells: DataFrame, radius: int, anchors: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Ordered pairs of cells of one fov with 0 < distance < radius: fov, label, cell_type, nb_label, nb_type, d2.

    ``anchors`` keeps pairs at distance 0, so a cell meets itself; ``carry`` adds the neighbour's columns as nb_<name>.

    A grid of cells of the radius' size gives the join three equality keys, so a large fov is spread over many tasks
    and a cell meets the nine grid cells around it only.
    """
    grid = lambda c: F.floor(F.col(c) / radius)
    left = cells.withColumns({"gy": F.explode(F.sequence(grid("cy") - 1, grid("cy") + 1))}).withColumn("gx", F.explode(F.sequence(grid("cx") - 1, grid("cx") + 1)))
    right = cells.select("fov", F.col("label").alias("nb_label"), F.col("cell_type").alias("nb_type"), F.col("cy").alias("ny"), F.col("cx").alias("nx"), grid("cy").alias("gy"), grid("cx").alias("gx"), *[F.col(c).alias(f"nb_{c}") for c in carry])
    d2 = (F.col("cy") - F.col("ny")) * (F.col("cy") - F.col("ny")) + (F.col("cx") - F.col("nx")) * (F.col("cx") - F.col("nx"))
    return left.join(right, ["fov", "gy", "gx"]).withColumn("d2", d2).filter(((F.col("d2") > 0) | F.lit(anchors)) & (F.col("d2") < radius * radius)).select("fov", "label", "cell_type", "nb_label", "nb_type", "d2", *[f"nb_{c}" for c in carry])


PLACE = ["fov", "cy", "cx"]


def place_pairs(places: DataFrame, held: DataFrame, radius: int, anchors: bool = False) -> DataFrame:
    """``places`` (fov, cy, cx), each once, with the rows of ``held`` (fov, cy, cx, more) at less than the radius: fov, cy, cx, d2, more.

    As in ``pairs`` distance 0 counts with ``anchors`` only. Cells of one place have the same neighbours, so what is held
    is one row a place (and type, say), and no pair of cells is ever made: the work follows the number of places, which
    the frame bounds, and not the square of the cells.
    """
    grid = lambda c: F.floor(F.col(c) / radius)
    left = places.withColumn("gy", F.explode(F.sequence(grid("cy") - 1, grid("cy") + 1))).withColumn("gx", F.explode(F.sequence(grid("cx") - 1, grid("cx") + 1)))
    right = held.withColumns({"gy": grid("cy"), "gx": grid("cx")}).withColumnsRenamed({"cy": "ny", "cx": "nx"})
    d2 = (F.col("cy") - F.col("ny")) * (F.col("cy") - F.col("ny")) + (F.col("cx") - F.col("nx")) * (F.col("cx") - F.col("nx"))
    met = left.join(right, ["fov", "gy", "gx"]).withColumn("d2", d2)
    return met.filter(((F.col("d2") > 0) | F.lit(anchors)) & (F.col("d2") < radius * radius)).drop("gy", "gx", "ny", "nx")


def around(cells: DataFrame, radius: int, sums: dict[str, Column], anchors: bool = False, by_type: bool = False) -> DataFrame:
    """Per place of a cell, the totals of ``sums`` (aggregates that add up) over the cells around it, as sum_<name>.

    ``by_type`` splits them by the neighbours' type, nb_type. Places without neighbours are left out.
    """
    kind = ["nb_type"] if by_type else []
    held = cells.withColumn("nb_type", F.col("cell_type")).groupBy(*PLACE, *kind).agg(*[v.alias(f"sum_{c}") for c, v in sums.items()])
    met = place_pairs(cells.select(*PLACE).distinct(), held, radius, anchors)
    return met.groupBy(*PLACE, *kind).agg(*[F.sum(f"`sum_{c}`").alias(f"sum_{c}") for c in sums])


def of_cells(cells: DataFrame, met: DataFrame, key: list[str], sums: list[str]) -> DataFrame:
    """The totals of ``around`` for every ``key`` of cells; rows of one key in several places add up."""
    return cells.select(*dict.fromkeys([*PLACE, *[c for c in key if c in cells.columns]])).join(met, PLACE).groupBy(*key).agg(*[F.sum(f"`sum_{c}`").alias(c) for c in sums])


def neighborhood_counts(cells: DataFrame, radius: int, self_neighbor: bool = False) -> DataFrame:
    """Neighbours of every type; with ``self_neighbor`` cells at distance 0 count, the cell itself included."""
    met = around(cells, radius, {"n": F.count(F.lit(1))}, self_neighbor, by_type=True)
    return of_cells(cells, met, ["fov", "label", "nb_type"], ["n"])


def neighborhood_freqs(cells: DataFrame, radius: int, self_neighbor: bool = False) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy("fov", "label"))
    return neighborhood_counts(cells, radius, self_neighbor).select("fov", "label", "nb_type", F.round(F.col("n") / total, 6).alias("freq"))


def neighborhood_matrix(cells: DataFrame, radius: int, types: list[str], self_neighbor: bool = False) -> DataFrame:
    """Wide counts; cells without neighbours are dropped."""
    met = around(cells, radius, {t: F.count_if(F.col("cell_type") == t) for t in types}, self_neighbor)
    return of_cells(cells, met, ["fov", "label", "cell_type"], types)


def close_cell_pairs(cells: DataFrame, radius: int) -> DataFrame:
    met = around(cells, radius, {"n": F.count(F.lit(1))}, by_type=True)
    own = cells.groupBy(*PLACE, F.col("cell_type").alias("type_a")).agg(F.count(F.lit(1)).alias("m"))
    return own.join(met, PLACE).groupBy("type_a", F.col("nb_type").alias("type_b")).agg(F.sum(F.col("m") * F.col("sum_n")).alias("n"))


def diversity(cells: DataFrame, radius: int) -> DataFrame:
    """Shannon entropy (base 2) of each cell's neighbour types."""
    share = F.col("n") / F.sum("n").over(Window.partitionBy("fov", "label"))
    return neighborhood_counts(cells, radius).withColumn("s", share).groupBy("fov", "label").agg(F.round(-F.sum(F.col("s") * F.log2("s")), 6).alias("diversity"))


def _populations(cells: DataFrame, radius: int, targets: list[str], references: list[str], self_neighbor: bool) -> DataFrame:
    """Per fov, over cells that have a neighbour: cells of both populations and contacts within and between them."""
    both = set(targets) & set(references)
    if both:
        raise ValueError(f"types in both populations: {sorted(both)}")
    contact = lambda names: F.count_if(F.col("cell_type").isin(names))
    met = around(cells, radius, {"t": contact(targets), "r": contact(references)}, self_neighbor)
    rows = of_cells(cells, met, ["fov", "label", "cell_type"], ["t", "r"])
    is_t, is_r = F.col("cell_type").isin(targets), F.col("cell_type").isin(references)
    seen = rows.groupBy("fov").agg(F.count_if(is_t).alias("nt"), F.count_if(is_r).alias("nr"), F.sum(F.when(is_t, F.col("t"))).alias("tt"), F.sum(F.when(is_t, F.col("r"))).alias("tr"), F.sum(F.when(is_r, F.col("r"))).alias("rr"))
    return cells.select("fov").distinct().join(seen, "fov", "left").na.fill(0)


def mixing_scores(cells: DataFrame, radius: int, targets: list[str], references: list[str], ratio: int = 5, least: int = 200, self_neighbor: bool = False) -> DataFrame:
    """Percent and homogeneous mixing of two populations per fov, and how many cells they have.

    Cells without any neighbour do not count. Null for fewer than ``least`` cells, an empty population or a ratio above
    ``ratio``.
    """
    n = _populations(cells, radius, targets, references, self_neighbor)
    nt, nr, tt, tr, rr = (F.col(c) for c in ("nt", "nr", "tt", "tr", "rr"))
    ok = (nt + nr >= least) & (nt > 0) & (nr > 0) & (nt <= ratio * nr) & (nr <= ratio * nt)
    score = lambda rest: F.round(F.when(ok, F.try_divide(tr.cast("double"), rest)), 6)
    return n.select("fov", score(tr + tt).alias("percent"), score(tt + rr).alias("homogeneous"), (nt + nr).alias("n"))


def cell_ratios(cells: DataFrame, radius: int, targets: list[str], references: list[str]) -> DataFrame:
    """Targets per reference cell and the reverse, among cells with a neighbour; null where a population is empty."""
    n, some = _populations(cells, radius, targets, references, False), (F.col("nt") > 0) & (F.col("nr") > 0)
    return n.select("fov", F.round(F.when(some, F.col("nt") / F.col("nr")), 6).alias("cell_ratio"), F.round(F.when(some, F.col("nr") / F.col("nt")), 6).alias("reverse_ratio"))


def nearest(queries: DataFrame, targets: DataFrame, k: int, apart: Column) -> DataFrame:
    """The k nearest ``targets`` (fov, kind, nb, ny, nx, more) of each kind for ``queries`` (fov, label, cy, cx).

    ``apart`` tells which pairs count. Rows (fov, label, kind, nb, d2, r, more): rank r from 1, ties by nb. Every fov and
    kind has a grid of its own, fine enough that nine of its squares hold some nine (k + 1) targets. A query looks at the
    squares around its own; only if its k-th neighbour is not nearer than what it has not seen, at 81 squares, and then
    at all targets of its fov and kind. Kinds with few targets in a fov have one square. As ``apart`` leaves out a nb or a
    place, the rows of the k + 1 first nb of a place are all that can be among the nearest; a place holds no others.
    """
    at_place = F.dense_rank().over(Window.partitionBy("fov", "kind", "ny", "nx").orderBy("nb"))
    targets = targets.withColumn("__p", at_place).filter(F.col("__p") <= k + 1).drop("__p").persist()
    edge = F.sqrt((F.max("ny") - F.min("ny") + 1.0) * (F.max("nx") - F.min("nx") + 1.0) * (k + 1) / F.count(F.lit(1)))
    reach = F.greatest(F.max("ny") - F.min("ny"), F.max("nx") - F.min("nx")) + 1.0
    bounds = [F.min("ny").alias("y0"), F.max("ny").alias("y1"), F.min("nx").alias("x0"), F.max("nx").alias("x1")]
    grid = targets.groupBy("fov", "kind").agg(F.when(F.count(F.lit(1)) > 8 * (k + 1), edge).otherwise(reach).alias("side"), *bounds)  # a row a fov and kind
    at = lambda c: F.floor((F.col(c) - F.col(f"{c[1]}0")) / F.col("side"))
    last = lambda c: F.floor((F.col(f"{c}1") - F.col(f"{c}0")) / F.col("side"))
    placed = targets.join(grid.select("fov", "kind", "side", "y0", "x0"), ["fov", "kind"]).withColumns({"gy": at("ny"), "gx": at("nx")}).drop("side", "y0", "x0")
    todo = queries.join(grid, "fov").withColumns({"qy": at("cy"), "qx": at("cx"), "my": last("y"), "mx": last("x")})
    key, out = ["fov", "label", "kind"], None
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("d2", "nb"))
    d2 = (F.col("cy") - F.col("ny")) * (F.col("cy") - F.col("ny")) + (F.col("cx") - F.col("nx")) * (F.col("cx") - F.col("nx"))
    for ring in (1, 4, None):
        if ring is None:
            met = todo.select(*key, "cy", "cx").join(placed.drop("gy", "gx"), ["fov", "kind"])
        else:
            lo, hi = (lambda c: F.greatest(F.col(f"q{c}") - ring, F.lit(0))), (lambda c: F.least(F.col(f"q{c}") + ring, F.col(f"m{c}")))  # noqa: B023
            inside = todo.filter((lo("y") <= hi("y")) & (lo("x") <= hi("x")))
            spread = inside.withColumn("gy", F.explode(F.sequence(lo("y"), hi("y")))).withColumn("gx", F.explode(F.sequence(lo("x"), hi("x"))))
            met = spread.select(*key, "cy", "cx", "gy", "gx").join(placed, ["fov", "kind", "gy", "gx"]).drop("gy", "gx")
        best = met.withColumn("d2", d2).filter(apart).withColumn("r", rank).filter(F.col("r") <= k).drop("cy", "cx", "ny", "nx")
        if ring is None:
            return best if out is None else out.unionByName(best)
        best = best.persist()
        kth = best.filter(F.col("r") == k).select(*key, F.col("d2").alias("kth"))
        all_seen = (F.col("qy") <= ring) & (F.col("qx") <= ring) & (F.col("my") - F.col("qy") <= ring) & (F.col("mx") - F.col("qx") <= ring)
        sure = all_seen | F.coalesce(F.col("kth") < (ring * F.col("side")) * (ring * F.col("side")), F.lit(False))
        state = todo.join(kth, key, "left").withColumn("done", sure).persist()
        left = state.filter("not done").count()
        ready = best.join(state.filter("done").select(*key), key, "left_semi") if left else best
        out = ready if out is None else out.unionByName(ready)
        if not left:
            return out
        todo = state.filter("not done").drop("kth", "done")


def mean_knn_distance(cells: DataFrame, k: int) -> DataFrame:
    """Per cell and type, mean distance to the k nearest other-placed cells of the type; null with fewer than k."""
    targets = cells.select("fov", F.col("cell_type").alias("kind"), F.col("label").alias("nb"), F.col("cy").alias("ny"), F.col("cx").alias("nx"))
    spots = cells.select(*PLACE).distinct().withColumn("label", F.struct("cy", "cx"))  # cells of one place have the same neighbours
    near = nearest(spots, targets, k, F.col("d2") > 0).groupBy("fov", "label", "kind").agg(F.collect_list("d2").alias("d2"))
    met = near.select("fov", "label.cy", "label.cx", F.col("kind").alias("nb_type"), "d2")
    rows = cells.select("label", *PLACE).join(met, PLACE).groupBy("fov", "label", "nb_type").agg(F.collect_list("d2").alias("d2"))
    best = F.slice(F.array_sort(F.flatten("d2")), 1, k)
    mean = F.aggregate(best, F.lit(0.0), lambda a, x: a + F.sqrt(x)) / k
    return rows.select("fov", "label", "nb_type", F.round(F.when(F.size(best) == k, mean), 6).alias("mean_distance"))


def nearest_pairs(cells: DataFrame, radius: int, k: int) -> DataFrame:
    """Of ``pairs`` those with the k nearest cells of every type, ties by nb_label: fov, label, nb_label, nb_type, d2."""
    first = F.row_number().over(Window.partitionBy(*PLACE, "cell_type").orderBy("label"))
    held = cells.withColumn("r", first).filter(F.col("r") <= k).select(*PLACE, F.col("label").alias("nb_label"), F.col("cell_type").alias("nb_type"))
    rank = F.row_number().over(Window.partitionBy(*PLACE, "nb_type").orderBy("d2", "nb_label"))
    met = place_pairs(cells.select(*PLACE).distinct(), held, radius).withColumn("r", rank).filter(F.col("r") <= k).drop("r")
    return cells.select("label", *PLACE).join(met, PLACE).select("fov", "label", "nb_label", "nb_type", "d2")


def fov_density(cells: DataFrame, pixels: int) -> DataFrame:
    return cells.groupBy("fov", "cell_type").agg(F.round(F.count(F.lit(1)) * 100 / F.lit(float(pixels)), 6).alias("density"))


def crosstab(cells: DataFrame) -> DataFrame:
    """Counts per fov and type with their share of the fov."""
    n = cells.groupBy("fov", "cell_type").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("fov")), 6))


def fiber_alignment(fibers: DataFrame, k: int = 4, least_ratio: int = 2) -> DataFrame:
    """Root of the summed squared orientation differences to the k nearest long fibres, over k; null for short ones."""
    long = fibers.filter(F.col("major") >= least_ratio * F.col("minor"))
    other = long.select("fov", F.lit(0).alias("kind"), F.col("label").alias("nb"), F.col("cy").alias("ny"), F.col("cx").alias("nx"), F.col("orientation").alias("no"))
    near = nearest(long.select("fov", "label", "cy", "cx"), other, k, F.col("label") != F.col("nb")).join(long.select("fov", "label", "orientation"), ["fov", "label"])
    score = near.groupBy("fov", "label").agg(F.round(F.sqrt(F.sum((F.col("orientation") - F.col("no")) * (F.col("orientation") - F.col("no")))) / k, 6).alias("alignment"))
    return fibers.select("fov", "label").join(score, ["fov", "label"], "left")


def fiber_density(fibers: DataFrame, pixels: int) -> DataFrame:
    return fibers.groupBy("fov").agg(F.round(100 * F.sum("area") / F.lit(float(pixels)), 6).alias("pixel_density"), F.round(100 * F.countDistinct("label") / F.lit(float(pixels)), 6).alias("fiber_density"))


def tile_stats(fibers: DataFrame, side: int, tile: int, least: int) -> DataFrame:
    """Every tile of the fov's grid with its number of fibres and, from ``least`` fibres on, their means."""
    n = side // tile
    at = lambda c: F.floor(F.col(c) / tile)
    grid = fibers.select("fov").distinct().withColumn("ty", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).withColumn("tx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    made = fibers.groupBy("fov", at("cy").alias("ty"), at("cx").alias("tx")).agg(F.count(F.lit(1)).alias("n"), F.avg("area").alias("a"), F.avg("major").alias("m"))
    enough = lambda c: F.round(F.when(F.col("n") >= least, F.col(c)), 6)
    return grid.join(made, ["fov", "ty", "tx"], "left").select("fov", "ty", "tx", F.coalesce("n", F.lit(0)).alias("n"), enough("a").alias("avg_area"), enough("m").alias("avg_major"))


def featurize(cells: DataFrame, radius: int, kind: str, names: list[str] = ()) -> DataFrame:
    """Topic-model features of each cell's neighbourhood, itself included.

    ``cluster``: cells of each type in ``names``; ``marker``: cells whose marker exceeds 0.5; ``avg_marker``: the
    marker's mean; ``count``: cells.
    """
    number = lambda c: F.col(c).cast("double")
    features = {
        "cluster": {n: F.count_if(F.col("cell_type") == n) for n in names},
        "marker": {n: F.count_if(F.col(n) > 0.5) for n in names if kind == "marker"},
        "avg_marker": {f"{part}_{n}": total(number(n)) for n in names if kind == "avg_marker" for part, total in (("sum", F.sum), ("count", F.count))},
        "count": {"n": F.count(F.lit(1))},
    }
    if kind not in features:
        raise ValueError(f"unknown featurization: {kind}")
    made = of_cells(cells, around(cells, radius, features[kind], anchors=True), ["fov", "label"], list(features[kind]))
    if kind == "avg_marker":
        return made.select("fov", "label", *[F.round(F.try_divide(f"sum_{n}", f"count_{n}"), 6).alias(n) for n in names])
    return made


def mean_knn_from_pairs(distances: DataFrame, k: int) -> DataFrame:
    """``mean_knn_distance`` over a given table (fov, label, nb_label, nb_type, distance), which need not be symmetric."""
    near = distances.filter("distance > 0").withColumn("r", F.row_number().over(Window.partitionBy("fov", "label", "nb_type").orderBy("distance", "nb_label"))).filter(F.col("r") <= k)
    return near.groupBy("fov", "label", "nb_type").agg(F.round(F.when(F.count(F.lit(1)) == k, F.avg("distance")), 6).alias("mean_distance"))


def fiber_summary(fibers: DataFrame, side: int, properties: list[str]) -> DataFrame:
    """Per fov the two densities of ``fiber_density`` and the mean of every property (nulls left out)."""
    means = fibers.groupBy("fov").agg(*[F.round(F.avg(p), 6).alias(f"avg_{p}") for p in properties])
    return fiber_density(fibers, side * side).join(means, "fov")


def tile_summary(fibers: DataFrame, side: int, tile: int, least: int, properties: list[str]) -> DataFrame:
    """Every tile of the fov's grid: densities of its fibres (0 without any), and from ``least`` fibres on their means."""
    if 1024 % tile:
        raise ValueError("the tile's side must divide 1024")
    n, at = side // tile, lambda c: F.floor(F.col(c) / tile)
    line = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    grid = fibers.select("fov").distinct().withColumn("ty", line).withColumn("tx", line)
    share = lambda c: F.round(100 * c / F.lit(float(tile * tile)), 6)
    made = fibers.groupBy("fov", at("cy").alias("ty"), at("cx").alias("tx")).agg(F.count(F.lit(1)).alias("n"), share(F.sum("area")).alias("pixel_density"), share(F.countDistinct("label")).alias("fiber_density"), *[F.avg(p).alias(f"avg_{p}") for p in properties])
    enough = lambda c: F.round(F.when(F.col("n") >= least, F.col(c)), 6).alias(c)
    rest = grid.join(made, ["fov", "ty", "tx"], "left").na.fill(0, ["n", "pixel_density", "fiber_density"])
    return rest.select("fov", "ty", "tx", "n", "pixel_density", "fiber_density", *[enough(f"avg_{p}") for p in properties])


def anchored(cells: DataFrame, radius: int, anchor: str) -> DataFrame:
    """Cells with a flag that tells whether a cell of type ``anchor`` lies within ``radius`` (itself included)."""
    met = around(cells, radius, {"n": F.count_if(F.col("cell_type") == anchor)}, anchors=True)
    near = of_cells(cells, met, ["fov", "label"], ["n"]).select("fov", "label", (F.col("n") > 0).alias("near_anchor"))
    return cells.join(near, ["fov", "label"], "left").withColumn("near_anchor", F.coalesce("near_anchor", F.lit(False)))


def cluster_contacts(cells: DataFrame, radius: int, marker: str, limit: float) -> DataFrame:
    """Per fov, contacts between cells with the marker above a limit, each pair once."""
    hot = cells.filter((F.col(marker) > limit) & F.col("label").isNotNull())
    met = around(hot, radius, {"n": F.count(F.lit(1))})
    every = hot.select(*PLACE).join(met, PLACE).groupBy("fov").agg(F.sum("sum_n").alias("n"))  # both ways, and between rows of one label
    spots = hot.groupBy("label", *PLACE).agg(F.count(F.lit(1)).alias("m"))
    met = spots.join(spots.select("fov", "label", F.col("cy").alias("ny"), F.col("cx").alias("nx"), F.col("m").alias("m2")), ["fov", "label"])
    d2 = (F.col("cy") - F.col("ny")) * (F.col("cy") - F.col("ny")) + (F.col("cx") - F.col("nx")) * (F.col("cx") - F.col("nx"))
    same = met.filter((d2 > 0) & (d2 < radius * radius)).groupBy("fov").agg(F.sum(F.col("m") * F.col("m2")).alias("same"))
    return every.join(same, "fov", "left").select("fov", F.expr("(n - coalesce(same, 0)) div 2").alias("n")).filter("n > 0")


def row_norms(rows: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """Sum, Euclidean norm and largest absolute value of the columns of each row."""
    total = sum((F.col(c) for c in columns), F.lit(0.0))
    square = sum((F.col(c) * F.col(c) for c in columns), F.lit(0.0))
    return rows.select(*keep, F.round(total, 6).alias("total"), F.round(F.sqrt(square), 6).alias("l2"), F.round(F.greatest(*[F.abs(c).cast("double") for c in columns], F.lit(0.0)), 6).alias("linf"))
