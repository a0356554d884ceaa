"""Regions, polygons and statistics of a categorical grid inside them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.exprs import RADIUS, argmax, r6, ratio

K = 4


def located(df: DataFrame, height: int, width: int) -> DataFrame:
    """``df`` (row, col) with lon, lat of the cell's centre and its area on the sphere in km²."""
    step = 180.0 / height
    edge = lambda c: F.sin(F.radians(90 - step * c))
    km = RADIUS / 1000
    area = km * km * F.radians(F.lit(360.0 / width)) * F.abs(edge(F.col("row")) - edge(F.col("row") + 1))
    return df.withColumns({"lon": -180 + (360.0 / width) * (F.col("col") + 0.5), "lat": 90 - step * (F.col("row") + 0.5), "area": area})


def wrapped(lon: Column) -> Column:
    """Longitude in -180 .. 180."""
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def inside_box(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    """Within (lon_min, lon_max, lat_min, lat_max), bounds included; longitudes may be given as 0 to 360 or wrap."""
    west, east, south, north = box
    span = (east - west) % 360 if east - west < 360 else 360
    return (F.pmod(lon - west, F.lit(360.0)) <= span) & lat.between(south, north)


def in_rings(x: Column, y: Column, rings: list[list[tuple[float, float]]]) -> Column:
    """Even-odd rule over all rings; a point on the lower end of an edge counts, on the upper does not."""
    crossings = []
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
            if y1 != y2:
                crossings.append(F.when(((F.lit(y1) <= y) != (F.lit(y2) <= y)) & (x < x1 + (y - y1) * ((x2 - x1) / (y2 - y1))), 1).otherwise(0))
    return reduce(lambda a, b: a + b, crossings, F.lit(0)) % 2 == 1


def members(cells: DataFrame, polygons: list[tuple[int, list]]) -> DataFrame:
    """(feature, row, col, cluster): cells whose centre lies in a polygon; a box filter stands before the exact test.

    Polygons are literals of known size, so nothing is joined and the test is one pass over the cells.
    """
    x, y = F.col("col") + 0.5, F.col("row") + 0.5
    marks = []
    for feature, rings in polygons:
        xs, ys = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
        marks.append(F.when(x.between(min(xs), max(xs)) & y.between(min(ys), max(ys)) & in_rings(x, y, rings), F.lit(feature)))
    found = cells.withColumn("_f", F.filter(F.array(*marks), lambda v: v.isNotNull())).where(F.size("_f") > 0)
    return found.select("row", "col", "cluster", F.explode("_f").alias("feature"))


def histogram(df: DataFrame, *keys: str) -> DataFrame:
    """Per group: valid cells and cells of each cluster."""
    counts = [F.count(F.when(F.col("cluster") == c, 1)).alias(f"c{c}") for c in range(K)]
    return df.groupBy(*keys).agg(F.count("cluster").alias("valid"), *counts)


def shares(df: DataFrame) -> DataFrame:
    """``df`` (valid, c0..) with percentages, dominant cluster and purity; nulls where there is no valid cell."""
    df = df.withColumns({f"pct{c}": r6(ratio(100 * F.col(f"c{c}"), F.col("valid"))) for c in range(K)})
    name, top = argmax([str(c) for c in range(K)], [F.col(f"pct{c}") for c in range(K)])
    return df.withColumns({"dominant": name.cast("int"), "purity": top})


def polygons_table(spark: SparkSession, polygons: list[tuple[int, list]]) -> DataFrame:
    """(feature, part, seq, x, y): all vertices."""
    rows = [(f, i, j, float(x), float(y)) for f, rings in polygons for i, ring in enumerate(rings) for j, (x, y) in enumerate(ring)]
    return spark.createDataFrame(rows, "feature int, part int, seq int, x double, y double")


def representative_points(vertices: DataFrame) -> DataFrame:
    """(feature, x, y): a point for a label, the average of a feature's vertices (of a concave feature it may lie outside)."""
    return vertices.groupBy("feature").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def feature_counts(vertices: DataFrame) -> DataFrame:
    """(geometry, features): how many features of one part and of several."""
    parts = vertices.groupBy("feature").agg(F.count_distinct("part").alias("parts"))
    return parts.groupBy(F.when(F.col("parts") > 1, "MultiPolygon").otherwise("Polygon").alias("geometry")).agg(F.count("*").alias("features"))
