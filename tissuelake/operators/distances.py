"""Sums over the distances of all pairs of rows, block against block.

Equal rows are one point with a number. Points are dealt into blocks of about ``SIZE`` by a hash; every two blocks of a
group meet in one row, whose distances are one matrix. So a group of any size is spread over many rows, and a task holds
two blocks at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 2048


def points(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Distinct rows (g, v: their numbers, n: how many)."""
    vector = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    return rows.select(F.col(group).alias("g"), vector.alias("v")).groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))


def block_pairs(rows: DataFrame, within: bool, width: int, kernel: Callable[[dict, dict, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """What ``kernel(left, right, distances)`` makes of every two blocks of ``points``, of one group each if ``within``.

    A side is a dictionary: g (groups as text), n (numbers), b (the block) and i (places in it).
    """
    most = rows.groupBy("g").count().agg(F.max("count")).first()[0] if within else rows.count()
    parts = max(1, -(-(most or 0) // SIZE))
    key = ["g"] if within else []
    dealt = rows.withColumn("b", F.pmod(F.xxhash64("v"), F.lit(parts)))
    held = dealt.groupBy(*key, "b").agg(F.array_sort(F.collect_list(F.struct(F.col("g").cast("string").alias("name"), "v", "n"))).alias("p"))
    held = held.select(*key, "b", "p.name", F.flatten("p.v").alias("v"), "p.n")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    left = held.withColumn("c", every)
    right = held.select(*key, F.col("b").alias("c"), F.col("name").alias("name2"), F.col("v").alias("v2"), F.col("n").alias("n2")).withColumn("b", every)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                x, y = (np.asarray(row[c], float).reshape(-1, width) for c in ("v", "v2"))
                square = np.zeros((len(x), len(y)))
                for k in range(width):
                    square += (x[:, k, None] - y[None, :, k]) ** 2
                sides = [{"g": np.asarray(row[a]), "n": np.asarray(row[m], float), "b": row[b]} for a, m, b in (("name", "n", "b"), ("name2", "n2", "c"))]
                yield kernel(*sides, np.sqrt(square))

    # few bytes but much work in a row: as many tasks as there are pairs, not as few as their bytes would make
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, min(parts * parts, 4096))
    return left.join(right, [*key, "b", "c"]).repartition(tasks).drop(*key).mapInPandas(run, schema)


def pair_sums(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Per group the sum of Euclidean distances over its unordered pairs of rows, and its number of rows."""
    some = points(rows, group, columns)

    def kernel(left: dict, right: dict, far: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"name": [left["g"][0]], "s": [float(left["n"] @ far @ right["n"]) / 2]})

    sums = block_pairs(some, True, len(columns), kernel, "name string, s double").groupBy("name").agg(F.sum("s").alias("s"))
    size = some.groupBy("g").agg(F.sum("n").alias("n")).withColumn("name", F.col("g").cast("string"))
    return size.join(sums, "name").select(F.col("g").alias(group), F.col("s").alias("distance_sum"), "n")


def cluster_sums(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Per point (b, i; g, n) and cluster h: the sum of its distances to the cluster's rows, and their number."""

    def kernel(left: dict, right: dict, far: np.ndarray) -> pd.DataFrame:
        out, size = [], len(far)
        for h in np.unique(right["g"]):
            here = right["g"] == h
            out.append(pd.DataFrame({"b": left["b"], "i": np.arange(size), "g": left["g"], "n": left["n"].astype(int), "h": h, "s": far[:, here] @ right["n"][here], "m": int(right["n"][here].sum())}))
        return pd.concat(out)

    schema = "b long, i int, g string, n long, h string, s double, m long"
    made = block_pairs(points(rows, group, columns), False, len(columns), kernel, schema)
    return made.groupBy("b", "i", "g", "n", "h").agg(F.sum("s").alias("s"), F.sum("m").alias("m"))
