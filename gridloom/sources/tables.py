"""Reading tables, and the grids and samples that stand on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of the bands.
BANDS = ["radar", "height", "emissivity", "slope", "reflectivity"]
COLUMNS_WIDE = 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filled cells of the grid, five integer bands: users down, days of the month across."""
    e = table(spark, sf_dir, "events")
    cents = F.round(F.col("value") * 100).cast("long")
    k = F.get_json_object("props", "$.k").cast("long")
    return (
        e.select(F.col("user_id").cast("int").alias("row"), (F.dayofmonth("ts") - 1).cast("int").alias("col"), cents.alias("cents"), k.alias("k"))
        .where(F.col("col") < COLUMNS_WIDE)
        .groupBy("row", "col")
        .agg(F.sum("cents").alias("radar"), F.max("cents").alias("height"), F.min("cents").alias("emissivity"), F.count("*").alias("slope"), F.sum("k").alias("reflectivity"))
    )


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell of the grid; bands are null where there is no data."""
    own = cells(spark, sf_dir)
    rows = own.select("row").distinct().withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(COLUMNS_WIDE - 1))))
    return rows.join(own, ["row", "col"], "left")


def cluster_of(slope: str = "slope") -> Column:
    """A categorical band with the values 0 to 3, null where there is no data."""
    return F.when(F.col(slope).isNotNull(), F.least(F.col(slope) - 1, F.lit(3))).cast("int")


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, col, cluster) of every cell, null for no data."""
    return grid(spark, sf_dir).select("row", "col", cluster_of().alias("cluster"))


def vectors(spark: SparkSession, sf_dir: str, dims: int = 5) -> DataFrame:
    """(id, label, x: array<double>) from the embeddings' first components."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "label", F.transform(F.slice("embedding", 1, dims), lambda v: v.cast("double")).alias("x"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five numeric features of each order line with a unique key."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("size"))
    return table(spark, sf_dir, "lineitem").join(part, "l_partkey").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("size").cast("double").alias("size"),
    )
