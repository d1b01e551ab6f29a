"""Label plumbing: maps, as-of lookup, dense ids, renumbering, set checks, thresholds and mask overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def remap(rows: DataFrame, mapping: DataFrame, key: str, default: str | None = None) -> DataFrame:
    """Left lookup; a miss gives null, or ``default``."""
    out = rows.join(mapping, key, "left")
    return out if default is None else out.withColumn("meta", F.coalesce("meta", F.lit(default)))


def as_of(rows: DataFrame, steps: DataFrame, key: str, step: str, value: str) -> DataFrame:
    """The value of the last step at or before each key; of steps at one place the one of largest value.

    Only distinct keys are sorted, in blocks of 1024 key values, so rows of one key never come together; blocks are
    linked by a row each, and the rows get their value by a join on the key.
    """
    keys = rows.select(F.col(key).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(steps.schema[value].dataType).alias("__v")).filter("__at is not null").distinct()
    marks = steps.groupBy(F.col(step).alias("__at")).agg(F.max(value).alias("__v")).select("__at", F.lit(0).alias("__side"), "__v")
    both = keys.unionByName(marks).withColumn("__b", F.floor(F.col("__at") / 1024))
    inside = Window.partitionBy("__b").orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = both.withColumn("__seen", F.last("__v", ignorenulls=True).over(inside))
    marked = F.col("__side") == 0
    blocks = got.groupBy("__b").agg(F.max_by(F.when(marked, F.col("__v")), F.when(marked, F.col("__at"))).alias("__last"))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # a row a block of 1024 key values
    carry = blocks.select("__b", F.last("__last", ignorenulls=True).over(before).alias("__carry"))
    found = got.filter("__side = 1").join(carry, "__b").select(F.col("__at").alias("__key"), F.coalesce("__seen", "__carry").alias(value))
    return rows.join(found, F.col(key) == F.col("__key"), "left").select(*rows.columns, value)


def dense_ids(rows: DataFrame, column: str) -> DataFrame:
    names = rows.select(column).distinct()
    return names.withColumn("id", F.dense_rank().over(Window.orderBy(column)))  # a row a name


def renumber(cells: DataFrame) -> DataFrame:
    """Labels made unique over fovs: own rank plus the cells of earlier fovs."""
    size = cells.groupBy("fov").agg(F.count(F.lit(1)).alias("n"))
    before = size.select("fov", F.coalesce(F.sum("n").over(Window.orderBy("fov").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))  # a row a fov
    return cells.withColumn("r", F.row_number().over(Window.partitionBy("fov").orderBy("label"))).join(before, "fov").select("fov", "label", (F.col("r") + F.col("offset")).alias("global_label"))


def uncovered(rows: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    return rows.select(key).distinct().join(mapping, key, "left_anti")


def shared(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def positive(rows: DataFrame, marker: str, threshold: float) -> DataFrame:
    return rows.filter(F.col(marker) > threshold)


def reassign(cells: DataFrame, old: str, new: str, marker: str, threshold: float) -> DataFrame:
    """Cells of a type above a marker threshold get another type; a flag column tells who reaches the threshold."""
    return cells.withColumns({"cell_type": F.when((F.col("cell_type") == old) & (F.col(marker) > threshold), new).otherwise(F.col("cell_type")), f"{marker}_threshold": F.col(marker) >= threshold})


def max_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of two masks (fov, y, x, label), each first label's most overlapping second label; ties to the smaller one."""
    both = a.filter("label > 0").withColumnRenamed("label", "a").join(b.filter("label > 0").withColumnRenamed("label", "b"), ["fov", "y", "x"]).groupBy("fov", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    return both.withColumn("r", F.row_number().over(Window.partitionBy("fov", "a").orderBy(F.desc("n"), "b"))).filter("r = 1").drop("r")


def ambiguous_names(mapping: DataFrame, name: str, meta: str) -> DataFrame:
    """Names that stand for more than one meta cluster."""
    return mapping.groupBy(name).agg(F.countDistinct(meta).alias("n")).filter("n > 1")


def combine_first(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """All keys of both sides; the left value where it is not null, else the right one."""
    r = right.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    return left.select(*keys, *columns).join(r, keys, "full").select(*keys, *[F.coalesce(c, f"__{c}").alias(c) for c in columns])


def box_stats(cells: DataFrame, column: str, split: str, values: list[str]) -> DataFrame:
    """Quartiles and extremes of a column for some values of another."""
    q = lambda p: F.round(F.percentile(column, F.lit(p)), 6)
    return cells.filter(F.col(split).isin(values)).groupBy(split).agg(F.min(column).alias("low"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.max(column).alias("high"))


def natural_order(rows: DataFrame, name: str) -> DataFrame:
    """Distinct names with their place in natural order: text before the last digits, then the number."""
    head, number = F.regexp_extract(name, r"^(.*?)(\d*)$", 1), F.expr(f"try_cast(regexp_extract({name}, '(\\\\d*)$', 1) as bigint)")
    return rows.select(name).distinct().withColumn("place", F.row_number().over(Window.orderBy(head, number, name)))  # a row a name


def nonzero_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The table without those of ``columns`` that are zero or null in every row."""
    largest = rows.agg(*[F.max(F.abs(c)).alias(c) for c in columns]).first()
    return rows.drop(*[c for c in columns if not largest[c]])


def train_split(cells: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Flags the first ``fraction`` of every fov's cells in a seeded random order."""
    order = F.row_number().over(Window.partitionBy("fov").orderBy(F.xxhash64(F.lit(seed), "fov", "label"), "label"))
    return cells.withColumn("train", order <= F.floor(F.count(F.lit(1)).over(Window.partitionBy("fov")) * fraction))


def appearance_ids(rows: DataFrame, column: str, order: str) -> DataFrame:
    """Values with ids from 1 in the order in which they first appear by ``order``."""
    first = rows.groupBy(column).agg(F.min(order).alias("first"))
    return first.select(column, F.row_number().over(Window.orderBy("first", column)).alias("id"))  # a row a value


def union_distinct(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).union(b.select(key)).distinct()


def set_relation(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: whether the keys of ``a`` equal those of ``b``, lie within them, and how many are in one alone."""
    sides = a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).union(b.select(key, F.lit(0), F.lit(1))).groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    only_a, only_b = F.count_if(F.col("b") == 0), F.count_if(F.col("a") == 0)
    return sides.agg((only_a + only_b == 0).alias("same"), (only_a == 0).alias("within"), only_a.alias("only_a"), only_b.alias("only_b"))


def missing(required: list[str], given: DataFrame, key: str) -> list[str]:
    """Those of a short list of names that are no value of ``key``."""
    held = {r[0] for r in given.select(key).filter(F.col(key).isin(required)).distinct().collect()}
    return [n for n in required if n not in held]


def drop_incomplete(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without null or NaN in ``columns``."""
    kinds = {f.name: f.dataType.typeName() for f in rows.schema.fields}
    keep = F.lit(True)
    for c in columns:
        keep = keep & F.col(c).isNotNull() & (~F.isnan(c) if kinds[c] in ("double", "float") else F.lit(True))
    return rows.filter(keep)


def threshold_flags(rows: DataFrame, limits: dict[str, float]) -> DataFrame:
    """A column <name>_positive for each limited one: at the limit or above."""
    return rows.withColumns({f"{c}_positive": F.col(c) >= v for c, v in limits.items()})


def split_cluster(cells: DataFrame, cluster: str, column: str, limit: float, low: str, high: str) -> DataFrame:
    """Cells of one type divided into two by a limit; the rest as they are."""
    return cells.withColumn("cell_type", F.when(F.col("cell_type") != cluster, F.col("cell_type")).when(F.col(column) > limit, high).otherwise(low))


def columns_like(rows: DataFrame, pattern: str) -> list[str]:
    """Names of columns that a regular expression matches from their start, in natural order."""
    import re

    key = lambda name: [int(p) if p.isdigit() else p for p in re.split(r"(\d+)", name)]
    return sorted((c for c in rows.columns if re.match(pattern, c)), key=key)


def renamed(rows: DataFrame, columns: list[str], prefix: str = "", suffix: str = "") -> DataFrame:
    """``columns`` with ``prefix`` and ``suffix`` around their names."""
    return rows.withColumnsRenamed({c: f"{prefix}{c}{suffix}" for c in columns})


def tidy_names(rows: DataFrame, name: str, drop: str, width: int) -> DataFrame:
    """Distinct names in parts: without ``drop``, blanks trimmed, the text before the first underscore, padded with zeros."""
    bare = F.trim(F.replace(F.col(name), F.lit(drop), F.lit("")))
    return rows.select(name).distinct().select(name, bare.alias("bare"), F.split_part(bare, F.lit("_"), F.lit(1)).alias("head"), F.lpad(bare, width, "0").alias("padded"))
