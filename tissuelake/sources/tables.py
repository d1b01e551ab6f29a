"""Cell, pixel and fibre tables as views over the test tables, and general table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN stands for a missing value in image tables; SQL aggregates skip NULL only."""
    floats = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def cells(spark: SparkSession, path: str) -> DataFrame:
    key = F.col("c_custkey").cast("long")
    at = lambda k: ((key * k) % 512).cast("long")
    return table(spark, path, "customer").select(F.col("c_nationkey").cast("long").alias("fov"), key.alias("label"), F.col("c_mktsegment").alias("cell_type"), at(7919).alias("cy"), at(104729).alias("cx"))


def pixels(spark: SparkSession, path: str) -> DataFrame:
    """One row a pixel; the joins are on keys of the big tables and left to the planner."""
    line = table(spark, path, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    orders = table(spark, path, "orders").select("o_orderkey", "o_custkey")
    cell = table(spark, path, "customer").select("c_custkey", "c_nationkey")
    joined = line.join(orders, line.l_orderkey == orders.o_orderkey).join(cell, orders.o_custkey == cell.c_custkey)
    real = lambda c: F.col(c).cast("double")
    return joined.select(
        F.col("c_nationkey").cast("long").alias("fov"), F.col("o_custkey").cast("long").alias("label"), real("l_quantity").alias("q"), (real("l_extendedprice") / 1000).alias("p"),
        F.round(real("l_discount") * 100).alias("d"), F.round(real("l_tax") * 100).alias("t"), F.concat("l_returnflag", "l_linestatus").alias("cluster"),
    )


def fibers(spark: SparkSession, path: str) -> DataFrame:
    label = F.col("label")
    return cells(spark, path).select("fov", "label", "cy", "cx", (label * 37 % 180).alias("orientation"), (label * 13 % 50 + 1).alias("major"), (label * 7 % 20 + 1).alias("minor")).withColumn("area", F.col("major") * F.col("minor"))


def write_split(df: DataFrame, path: str, column: str, fmt: str = "parquet") -> None:
    """One folder per distinct value of ``column``."""
    df.write.mode("overwrite").partitionBy(column).format(fmt).save(path)
