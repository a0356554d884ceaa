"""Cells on the sphere: areas, bands, weighted and circular means, regions, coordinate transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.exprs import RADIUS, r6, ratio
from gridloom.operators.zones import feature_counts, inside_box, located, representative_points
from gridloom.plans.polygons import POLY, vertices
from gridloom.registry import query
from gridloom.sources.tables import COLUMNS_WIDE, clusters, table

#: name, class, (lon_min, lon_max, lat_min, lat_max); one is given in 0 .. 360.
REGIONS = [
    ("north plain", "plain", (-60.0, 0.0, 20.0, 60.0)), ("north rise", "highland", (30.0, 90.0, 10.0, 50.0)), ("equator west", "plain", (-170.0, -110.0, -15.0, 15.0)),
    ("equator east", "highland", (100.0, 160.0, -20.0, 10.0)), ("south", "plain", (-45.0, 45.0, -80.0, -40.0)), ("meridian", "highland", (330.0, 360.0, -30.0, 30.0)),
]


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clusters(spark, sf_dir)
    return located(c, c.agg(F.max("row")).first()[0] + 1, COLUMNS_WIDE)


@query("pixel_geo", """SELECT "row", col, round(lon, 6) AS lon, round(lat, 6) AS lat, round(area, 6) AS area FROM geo""")
def pixel_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo(spark, sf_dir).select("row", "col", r6("lon").alias("lon"), r6("lat").alias("lat"), r6("area").alias("area"))


@query("area_summary", "SELECT cluster, CAST(count(*) AS BIGINT) AS cells, round(sum(area), 3) AS area_km2, round(100 * sum(area) / sum(sum(area)) OVER (), 6) AS classified_pct, round(100 * sum(area) / (4 * pi() * 6051.0 * 6051.0), 6) AS sphere_pct FROM geo WHERE cluster IS NOT NULL GROUP BY cluster")
def area_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = geo(spark, sf_dir).where("cluster is not null").groupBy("cluster").agg(F.count("*").alias("cells"), F.sum("area").alias("a"))
    sphere = 4 * F.pi() * (RADIUS / 1000) ** 2
    return a.select("cluster", "cells", F.round("a", 3).alias("area_km2"), r6(100 * F.col("a") / F.sum("a").over(Window.partitionBy())).alias("classified_pct"), r6(100 * F.col("a") / sphere).alias("sphere_pct"))


@query("weighted_latitude", "SELECT cluster, round(sum(area * lat) / sum(area), 6) AS mean_lat, round(sqrt(greatest(sum(area * lat * lat) / sum(area) - (sum(area * lat) / sum(area)) * (sum(area * lat) / sum(area)), 0)), 6) AS std_lat, round(min(lat), 6) AS min_lat, round(max(lat), 6) AS max_lat FROM geo WHERE cluster IS NOT NULL GROUP BY cluster")
def weighted_latitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.sum("area")
    mean = F.sum(F.col("area") * F.col("lat")) / w
    var = F.sum(F.col("area") * F.col("lat") * F.col("lat")) / w - mean * mean
    return geo(spark, sf_dir).where("cluster is not null").groupBy("cluster").agg(r6(mean).alias("mean_lat"), r6(F.sqrt(F.greatest(var, F.lit(0.0)))).alias("std_lat"), r6(F.min("lat")).alias("min_lat"), r6(F.max("lat")).alias("max_lat"))


@query("circular_longitude", "SELECT cluster, round(degrees(atan2(sum(area * sin(radians(lon))), sum(area * cos(radians(lon))))), 6) AS mean_lon, round(sqrt(pow(sum(area * sin(radians(lon))) / sum(area), 2) + pow(sum(area * cos(radians(lon))) / sum(area), 2)), 6) AS resultant FROM geo WHERE cluster IS NOT NULL GROUP BY cluster")
def circular_longitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c, w = F.sum(F.col("area") * F.sin(F.radians("lon"))), F.sum(F.col("area") * F.cos(F.radians("lon"))), F.sum("area")
    return geo(spark, sf_dir).where("cluster is not null").groupBy("cluster").agg(r6(F.degrees(F.atan2(s, c))).alias("mean_lon"), r6(F.sqrt((s / w) * (s / w) + (c / w) * (c / w))).alias("resultant"))


def _bands(spark: SparkSession, sf_dir: str, c: str, low: float, n: int) -> DataFrame:
    g = geo(spark, sf_dir).where("cluster is not null")
    band = F.least(F.floor((F.col(c) - low + 1e-9) / 10), F.lit(n - 1))
    return g.groupBy((low + 10 * band).cast("double").alias("band")).agg(F.count("*").alias("cells"), *[F.count(F.when(F.col("cluster") == k, 1)).alias(f"c{k}") for k in range(4)])


def _band_sql(c: str, low: int, n: int) -> str:
    return f"SELECT CAST({low} + 10 * least(floor(({c} - ({low}) + 1e-9) / 10), {n - 1}) AS DOUBLE) AS band, CAST(count(*) AS BIGINT) AS cells, " + ", ".join(f"CAST(count(*) FILTER (cluster = {k}) AS BIGINT) AS c{k}" for k in range(4)) + " FROM geo WHERE cluster IS NOT NULL GROUP BY 1"


@query("lat_band_mix", _band_sql("lat", -90, 18))
def lat_band_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bands(spark, sf_dir, "lat", -90.0, 18)


@query("lon_band_mix", _band_sql("lon", -180, 36))
def lon_band_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bands(spark, sf_dir, "lon", -180.0, 36)


REGION_ROWS = ", ".join(f"('{n}', '{k}', {b[0]}::DOUBLE, {(b[1] - b[0]) % 360}::DOUBLE, {b[2]}::DOUBLE, {b[3]}::DOUBLE)" for n, k, b in REGIONS)
IN_REGION = f"r(region, class, west, span, south, north) AS (VALUES {REGION_ROWS}), m AS (SELECT r.*, g.* FROM r JOIN geo g ON ((g.lon - west) % 360 + 360) % 360 <= span AND g.lat BETWEEN south AND north WHERE g.cluster IS NOT NULL)"


def in_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells once for each region that holds them; the boxes are literals, so nothing is joined."""
    marks = [F.when(inside_box(F.col("lon"), F.col("lat"), b), F.struct(F.lit(n).alias("region"), F.lit(k).alias("class"))) for n, k, b in REGIONS]
    g = geo(spark, sf_dir).where("cluster is not null").withColumn("_r", F.filter(F.array(*marks), lambda v: v.isNotNull()))
    return g.withColumn("_r", F.explode("_r")).select("row", "col", "cluster", "lon", "lat", "area", F.col("_r.region").alias("region"), F.col("_r.class").alias("class"))


_PCT = ", ".join(f"round(100 * coalesce(sum(area) FILTER (cluster = {k}), 0) / sum(area), 6) AS pct{k}" for k in range(4))


@query("region_mix", f"WITH {IN_REGION} SELECT region, CAST(count(*) AS BIGINT) AS cells, round(sum(area), 3) AS area_km2, {_PCT} FROM m GROUP BY region")
def region_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    pct = lambda k: r6(100 * F.coalesce(F.sum(F.when(F.col("cluster") == k, F.col("area"))), F.lit(0.0)) / F.sum("area")).alias(f"pct{k}")
    return in_regions(spark, sf_dir).groupBy("region").agg(F.count("*").alias("cells"), F.round(F.sum("area"), 3).alias("area_km2"), *map(pct, range(4)))


SHARES = ", ".join(f"100 * coalesce(sum(area) FILTER (cluster = {c}), 0) / sum(area) AS p{c}" for c in range(4))


def region_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region, class, n, a: area, p0 .. p3: percentage of the area) of each region."""
    share = lambda c: 100 * F.coalesce(F.sum(F.when(F.col("cluster") == c, F.col("area"))), F.lit(0.0)) / F.sum("area")
    return in_regions(spark, sf_dir).groupBy("region", "class").agg(F.count("*").alias("n"), F.sum("area").alias("a"), *[share(c).alias(f"p{c}") for c in range(4)])


@query("context_weighted_mean", f"WITH {IN_REGION}, p AS (SELECT region, class, sum(area) AS a, {SHARES} FROM m GROUP BY 1, 2) SELECT class, {', '.join(f'round(sum(a * p{c}) / sum(a), 6) AS pct{c}' for c in range(4))} FROM p GROUP BY class")
def context_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area-weighted mean of the regions' percentages by class."""
    return region_shares(spark, sf_dir).groupBy("class").agg(*[r6(F.sum(F.col("a") * F.col(f"p{c}")) / F.sum("a")).alias(f"pct{c}") for c in range(4)])


@query("region_cells_wide", f"WITH {IN_REGION}, t AS (SELECT cluster, sum(area) AS ca, (SELECT sum(area) FROM geo WHERE cluster IS NOT NULL) AS al FROM geo WHERE cluster IS NOT NULL GROUP BY cluster) SELECT region, cluster, CAST(count(*) AS BIGINT) AS cells, round(sum(area), 3) AS area_km2, round(100 * sum(area) / sum(sum(area)) OVER (PARTITION BY region), 6) AS area_pct, round((sum(area) / sum(sum(area)) OVER (PARTITION BY region)) / (any_value(ca) / any_value(al)), 6) AS enrichment FROM m JOIN t USING (cluster) GROUP BY region, cluster")
def region_cells_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells, area, share and enrichment over the whole map of each cluster in each region."""
    m = in_regions(spark, sf_dir).where("cluster is not null").groupBy("region", "cluster").agg(F.count("*").alias("cells"), F.sum("area").alias("area"))
    whole = geo(spark, sf_dir).where("cluster is not null").groupBy("cluster").agg(F.sum("area").alias("ca"))
    share = F.col("area") / F.sum("area").over(Window.partitionBy("region"))
    expected = F.col("ca") / F.sum("ca").over(Window.partitionBy())  # a row a cluster
    both = m.join(F.broadcast(whole.withColumn("expected", expected)), "cluster")
    return both.select("region", "cluster", "cells", F.round("area", 3).alias("area_km2"), r6(100 * share).alias("area_pct"), r6(share / F.col("expected")).alias("enrichment"))


@query("window_clamped", """WITH b AS (SELECT max("row") + 1 AS h FROM clusters), w AS (SELECT greatest(0, CAST(floor((90 - 80.0::DOUBLE) / (180.0 / h)) AS INTEGER)) AS r0, least(h, CAST(floor((90 + 100.0::DOUBLE) / (180.0 / h)) AS INTEGER)) AS r1, greatest(0, CAST(floor((-200.0::DOUBLE + 180) / 12) AS INTEGER)) AS c0, least(30, CAST(floor((-60.0::DOUBLE + 180) / 12) AS INTEGER)) AS c1 FROM b) SELECT "row", col, cluster FROM clusters, w WHERE "row" >= r0 AND "row" < r1 AND col >= c0 AND col < c1""")
def window_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells from the cell of the upper left corner up to, without it, that of the lower right one; both kept inside the grid."""
    return geographic_window(clusters(spark, sf_dir), -200.0, -100.0, -60.0, 80.0, rounded=False)


@query("window_rounded", """WITH b AS (SELECT max("row") + 1 AS h FROM clusters), w AS (SELECT CAST(floor((90 - 30.0::DOUBLE) / (180.0 / h) + 0.5) AS INTEGER) AS r0, CAST(floor(60.0::DOUBLE / (180.0 / h) + 0.5) AS INTEGER) AS n, CAST(floor((-60.0::DOUBLE + 180) / 12 + 0.5) AS INTEGER) AS c0, CAST(floor(120.0::DOUBLE / 12 + 0.5) AS INTEGER) AS k FROM b) SELECT "row", col, cluster FROM clusters, w WHERE "row" >= r0 AND "row" < r0 + n AND col >= c0 AND col < c0 + k""")
def window_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offset and size of the box in cells, each rounded."""
    return geographic_window(clusters(spark, sf_dir), -60.0, -30.0, 60.0, 30.0, rounded=True)


def geographic_window(cells: DataFrame, west: float, south: float, east: float, north: float, rounded: bool) -> DataFrame:
    """Cells of a box in degrees: offset and size rounded to cells, or both corners' cells, clamped and without the last."""
    shape = F.broadcast(cells.agg((F.max("row") + 1).alias("_h"), (F.max("col") + 1).alias("_w")))  # one row
    tall, wide = 180.0 / F.col("_h"), 360.0 / F.col("_w")
    if rounded:
        r0, c0 = F.floor((90 - north) / tall + 0.5), F.floor((west + 180) / wide + 0.5)
        r1, c1 = r0 + F.floor((north - south) / tall + 0.5), c0 + F.floor((east - west) / wide + 0.5)
    else:
        r0, c0 = F.greatest(F.lit(0), F.floor((90 - north) / tall)), F.greatest(F.lit(0), F.floor((west + 180) / wide))
        r1, c1 = F.least(F.col("_h"), F.floor((90 - south) / tall)), F.least(F.col("_w"), F.floor((east + 180) / wide))
    inside = (F.col("row") >= r0) & (F.col("row") < r1) & (F.col("col") >= c0) & (F.col("col") < c1)
    return cells.crossJoin(shape).where(inside).select(*cells.columns)


@query("window_extract", """SELECT "row", col, cluster FROM geo WHERE lon BETWEEN -60 AND 60 AND lat BETWEEN -30 AND 30""")
def window_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo(spark, sf_dir).where(F.col("lon").between(-60, 60) & F.col("lat").between(-30, 30)).select("row", "col", "cluster")


@query("ns_split", "SELECT CASE WHEN lat >= -12.5 THEN 'north' ELSE 'south' END AS part, cluster, CAST(count(*) AS BIGINT) AS cells FROM geo WHERE cluster IS NOT NULL GROUP BY 1, 2")
def ns_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo(spark, sf_dir).where("cluster is not null").groupBy(F.when(F.col("lat") >= -12.5, "north").otherwise("south").alias("part"), "cluster").agg(F.count("*").alias("cells"))


@query("region_range_summary", f"WITH {IN_REGION}, p AS (SELECT region, class, count(*) AS n, {SHARES} FROM m GROUP BY 1, 2) SELECT class, CAST(count(*) AS BIGINT) AS n, {', '.join(f'round(avg(p{c}), 6) AS mean_pct{c}, round(max(p{c}), 6) AS max_pct{c}' for c in range(4))} FROM p GROUP BY class")
def region_range_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, mean and largest value of each cluster's percentage by class."""
    return region_shares(spark, sf_dir).groupBy("class").agg(F.count("*").alias("n"), *[f for c in range(4) for f in (r6(F.avg(f"p{c}")).alias(f"mean_pct{c}"), r6(F.max(f"p{c}")).alias(f"max_pct{c}"))])


@query("geo_transforms", """SELECT "row", col, round(6051000.0 * radians(lon), 3) AS x, round(6051000.0 * radians(lat), 3) AS y, round(degrees(6051000.0 * radians(lon) / 6051000.0), 6) AS lon_back, round(degrees(2 * atan(exp(6051000.0 * radians(lat) / 6051800.0)) - pi() / 2), 6) AS mercator_lat, round(((lon % 360) + 360) % 360, 6) AS lon_360 FROM geo""")
def geo_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equirectangular forward and back, Mercator latitude, and longitude in 0 .. 360."""
    x, y = RADIUS * F.radians("lon"), RADIUS * F.radians("lat")
    mercator = F.degrees(2 * F.atan(F.exp(y / 6_051_800.0)) - F.pi() / 2)
    return geo(spark, sf_dir).select("row", "col", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), r6(F.degrees(x / RADIUS)).alias("lon_back"), r6(mercator).alias("mercator_lat"), r6(F.pmod("lon", F.lit(360.0))).alias("lon_360"))


@query("vertex_extent", f"WITH {POLY} SELECT feature, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM v GROUP BY feature")
def vertex_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of each polygon's vertices."""
    v = vertices(spark, sf_dir)
    return v.groupBy("feature").agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))


@query("customers_by_region_area", "SELECT r_name, CAST(count(*) AS BIGINT) AS customers, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name")
def customers_by_region_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n = c.groupBy("r_name").agg(F.count("*").alias("customers"))
    return n.withColumn("share", r6(ratio("customers", F.sum("customers").over(Window.partitionBy()))))


@query("representative_point", f"WITH {POLY} SELECT feature, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM v GROUP BY feature")
def representative_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return representative_points(vertices(spark, sf_dir)).select("feature", r6("x").alias("x"), r6("y").alias("y"))


@query("vector_feature_counts", f"WITH {POLY} SELECT CASE WHEN parts > 1 THEN 'MultiPolygon' ELSE 'Polygon' END AS geometry, CAST(count(*) AS BIGINT) AS features FROM (SELECT feature, count(DISTINCT part) AS parts FROM v GROUP BY feature) GROUP BY 1")
def vector_feature_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_counts(vertices(spark, sf_dir))


@query("raster_shape", """SELECT CAST(max("row") + 1 AS INTEGER) AS height, 30 AS width, 12.0::DOUBLE AS step_x, round(-180.0::DOUBLE / (max("row") + 1), 9) AS step_y, -180.0::DOUBLE AS origin_x, 90.0::DOUBLE AS origin_y, CAST(count(*) AS BIGINT) AS cells FROM grid""")
def raster_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape, resolution and upper left corner of the grid, as a profile states them."""
    height = F.max("row") + 1
    one = clusters(spark, sf_dir).agg(height.cast("int").alias("height"), F.count("*").alias("cells"))
    return one.select("height", F.lit(COLUMNS_WIDE).alias("width"), F.lit(360.0 / COLUMNS_WIDE).alias("step_x"), F.round(-180.0 / F.col("height"), 9).alias("step_y"), F.lit(-180.0).alias("origin_x"), F.lit(90.0).alias("origin_y"), "cells")
