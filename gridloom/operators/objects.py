"""Connected objects of equal cluster (cells that touch, corners included)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.graphs import components


def runs(df: DataFrame) -> DataFrame:
    """(run, row, lo, hi, cluster): maximal horizontal stretches of one cluster; run numbers are unique."""
    line = Window.partitionBy("row", "cluster").orderBy("col")
    own = df.where("cluster is not null").withColumn("_g", F.col("col") - F.row_number().over(line))
    out = own.groupBy("row", "cluster", "_g").agg(F.min("col").alias("lo"), F.max("col").alias("hi")).drop("_g")
    return out.withColumn("run", F.shiftleft(F.col("row").cast("long"), 31) + F.col("lo"))


def labelled_runs(df: DataFrame) -> DataFrame:
    """(row, cluster, lo, hi, object): runs with the run number of their object's first cell.

    Runs of neighbouring rows that touch are linked, and links are followed by star contraction; a link joins on the
    row, so no cell is compared with all others.
    """
    own = runs(df)
    below = own.select((F.col("row") - 1).alias("row"), "cluster", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("run").alias("run2"))
    links = own.join(below, ["row", "cluster"]).where("lo <= hi2 + 1 and lo2 <= hi + 1").select(F.col("run").alias("a"), F.col("run2").alias("b"))
    named = components(links).withColumnRenamed("node", "run")
    full = own.join(named, "run", "left")
    return full.select("row", "cluster", "lo", "hi", F.coalesce("component", "run").alias("object"))


def labelled(df: DataFrame) -> DataFrame:
    """``df`` (row, col, cluster) of the cells with data, with object: the run number of the object's first cell."""
    return labelled_runs(df).select("row", "cluster", "object", F.explode(F.sequence("lo", "hi")).alias("col"))


def sizes(df: DataFrame) -> DataFrame:
    """(cluster, object, cells) of each object."""
    return labelled_runs(df).groupBy("cluster", "object").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("cells"))


def ring(own: DataFrame) -> DataFrame:
    """(object, row, col): cells that touch an object and are not part of it.  ``own``: the labelled runs.

    A run has its two ends beside it and stretches above and below that are one longer on both sides; what other runs of
    the object cover of them goes.
    """
    side = F.array((F.col("lo") - 1), (F.col("hi") + 1))
    beside = own.select("object", "row", F.explode(side).alias("col"))
    near = own.select("object", F.explode(F.array(F.col("row") - 1, F.col("row") + 1)).alias("row"), F.sequence(F.col("lo") - 1, F.col("hi") + 1).alias("cols")).select("object", "row", F.explode("cols").alias("col"))
    cells = own.select("object", "row", F.explode(F.sequence("lo", "hi")).alias("col"))
    return beside.unionByName(near).distinct().join(cells, ["object", "row", "col"], "left_anti")


def atlas(df: DataFrame, height: int, width: int, step_x: float, step_y: float, least: int) -> DataFrame:
    """One row an object of at least ``least`` cells: size, area, perimeter, box and centre; numbered by cluster and first cell."""
    own = labelled_runs(df).withColumn("n", (F.col("hi") - F.col("lo") + 1).cast("long"))
    big = own.groupBy("cluster", "object").agg(
        F.sum("n").alias("cells"), F.min("row").alias("row_min"), F.max("row").alias("row_max"), F.min("lo").alias("col_min"), F.max("hi").alias("col_max"),
        (F.sum(F.col("row") * F.col("n")) / F.sum("n")).alias("centroid_row"), (F.sum((F.col("lo") + F.col("hi")) * F.col("n")) / 2 / F.sum("n")).alias("centroid_col"),
    ).where(F.col("cells") >= least)
    inside = F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)
    rim = ring(own.join(big.select("object"), "object", "left_semi")).where(inside).groupBy("object").agg(F.count("*").alias("rim"))
    return big.join(rim, "object", "left").select(
        "cluster", "object", "cells", (F.col("cells") * step_x * step_y).alias("area_m2"), (F.coalesce("rim", F.lit(0)) * (step_x + step_y) / 2).alias("perimeter_m"),
        "row_min", "row_max", "col_min", "col_max", "centroid_row", "centroid_col",
    )
