"""Grids written as raster files and read again: windows, profiles, both sample types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.exprs import r6
from gridloom.functions.graphs import shared_path
from gridloom.operators.polygons import extent_of
from gridloom.registry import query
from gridloom.sources.raster import raster_profile, read_raster, write_raster
from gridloom.sources.tables import cells, clusters


def written_clusters(spark: SparkSession, sf_dir: str, block: int = 512) -> str:
    """Path of the clusters as bytes, 255 for no data; the raster says where on the sphere its cells lie."""
    own, path = clusters(spark, sf_dir), shared_path(spark, "clusters-raster")
    _, bottom, _, right = extent_of(own)
    shape = (bottom + 1, right + 1)
    write_raster(own, path, "cluster", shape, block=block, tile=64, step_x=360.0 / shape[1], step_y=180.0 / shape[0], origin_x=-180.0, origin_y=90.0)
    return path


@query("raster_window_read", 'SELECT "row", col, cluster FROM clusters WHERE "row" >= 20 AND "row" < 90 AND col >= 4 AND col <= 17')
def raster_window_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of a written raster; only the tiles it meets are read."""
    own = read_raster(spark, written_clusters(spark, sf_dir, 64), "cluster")
    return own.where((F.col("row") >= 20) & (F.col("row") < 90) & (F.col("col") >= 4) & (F.col("col") <= 17)).select("row", "col", F.col("cluster").cast("int").alias("cluster"))


@query("raster_file_counts", "SELECT cluster, CAST(count(*) AS BIGINT) AS cells FROM clusters GROUP BY cluster")
def raster_file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of each value of a whole raster, no data among them."""
    return read_raster(spark, written_clusters(spark, sf_dir), "cluster").groupBy(F.col("cluster").cast("int").alias("cluster")).agg(F.count("*").alias("cells"))


@query("raster_float_read", """SELECT "row", col, round(CAST(radar / 100.0 AS FLOAT)::DOUBLE, 6) AS radar FROM grid""")
def raster_float_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A band in single precision, -9999 for no data."""
    own, path = cells(spark, sf_dir), shared_path(spark, "radar-raster")
    _, bottom, _, _ = extent_of(own)
    write_raster(own.withColumn("radar", F.col("radar") / 100), path, "radar", (bottom + 1, 30), "float32", -9999, block=64, tile=32)
    rows = own.select("row").distinct()
    return read_raster(spark, path, "radar").join(rows, "row").select("row", "col", r6("radar").alias("radar"))


@query("raster_header", """SELECT CAST(max("row") + 1 AS INTEGER) AS height, CAST(max(col) + 1 AS INTEGER) AS width, 'uint8' AS dtype, 255.0::DOUBLE AS nodata, 12.0::DOUBLE AS step_x, round(180.0::DOUBLE / (max("row") + 1), 9) AS step_y, -180.0::DOUBLE AS origin_x, 90.0::DOUBLE AS origin_y FROM clusters""")
def raster_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape, sample type, no-data value, resolution and corner as the files state them."""
    own = raster_profile(spark, written_clusters(spark, sf_dir))
    return own.select("height", "width", "dtype", "nodata", "step_x", F.round("step_y", 9).alias("step_y"), "origin_x", "origin_y")
