"""Polygon tables joined with the grid: ten thousand polygons and more, one derived from each order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.graphs import shared_path
from gridloom.operators.polygons import covered_cells, extent_of, last_features, meeting, validation
from gridloom.operators.zones import histogram
from gridloom.registry import query
from gridloom.sources.tables import clusters, table
from gridloom.sources.vectors import layer_profile, read_shapes, shape_attributes, write_shapes

#: Polygons are small beside the grid; a fifth of them have a second ring, many cross themselves.
EIGHTHS, RINGS = 8, 5

POLY = """h AS (SELECT max("row") + 1 AS h FROM clusters), o AS (SELECT o_orderkey AS feature, o_orderpriority AS unit, o_orderstatus AS category, h, 3 + o_orderkey % 4 AS k FROM orders, h),
  r AS (SELECT *, unnest(range(0, CASE WHEN feature % 5 = 0 THEN 2 ELSE 1 END)) AS part FROM o), s AS (SELECT *, unnest(range(0, k)) AS seq FROM r),
  v AS (SELECT feature, part, seq, (feature * 7919 % 240) / 8.0::DOUBLE + ((feature * (seq + 3) * 31 + part * 5) % 17 - 8) / 2.0::DOUBLE AS x,
    (feature * 104729 % (h * 8)) / 8.0::DOUBLE + ((feature * (seq + 5) * 37 + part * 3) % 13 - 6) / 2.0::DOUBLE AS y FROM s)"""
_MEET = """, e AS (SELECT feature, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM v WINDOW w AS (PARTITION BY feature, part ORDER BY seq)),
  z AS (SELECT DISTINCT "row" FROM clusters), q AS (SELECT feature, "row", x1 + ("row" + 0.5::DOUBLE - y1) * ((x2 - x1) / (y2 - y1)) AS x FROM e JOIN z ON (y1 <= "row" + 0.5) <> (y2 <= "row" + 0.5)),
  m AS (SELECT q.feature, c."row", c.col, any_value(c.cluster) AS cluster FROM clusters c JOIN q ON q."row" = c."row" AND c.col + 0.5 < q.x GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1)"""
_N = "CAST(count(cluster) AS BIGINT) AS valid, " + ", ".join(f"CAST(count(*) FILTER (cluster = {k}) AS BIGINT) AS c{k}" for k in range(4))
_SUM = "CAST(count(*) AS BIGINT) AS polygons, CAST(sum(valid) AS BIGINT) AS valid, " + ", ".join(f"CAST(sum(c{k}) AS BIGINT) AS c{k}" for k in range(4))
_FIGURES = (
    ", ".join(f"round(100.0::DOUBLE * c{k} / nullif(valid, 0), 6) AS pct{k}" for k in range(4))
    + ", CASE WHEN valid = 0 THEN NULL WHEN c0 = greatest(c0, c1, c2, c3) THEN 0 WHEN c1 = greatest(c0, c1, c2, c3) THEN 1 WHEN c2 = greatest(c0, c1, c2, c3) THEN 2 ELSE 3 END AS dominant, round(100.0::DOUBLE * greatest(c0, c1, c2, c3) / nullif(valid, 0), 6) AS purity, "
    + ", ".join(f"round((c{k}::DOUBLE / nullif(valid, 0)) / nullif(b{k}, 0), 6) AS enrichment{k}" for k in range(4))
)
_BASE = "b AS (SELECT " + ", ".join(f"count(*) FILTER (cluster = {k})::DOUBLE / nullif(count(cluster), 0) AS b{k}" for k in range(4)) + " FROM clusters)"
_COUNTED = f"WITH {POLY}{_MEET}, n AS (SELECT feature, unit, category, {_N} FROM m JOIN o USING (feature) GROUP BY 1, 2, 3 HAVING count(cluster) > 0), {_BASE}"
_OUT = "valid, c0, c1, c2, c3"


def order_polygons(spark: SparkSession, sf_dir: str, height: int) -> DataFrame:
    """(feature, part, seq, x, y): rings of three to six vertices around a spot of the grid, by arithmetic on the order's key."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("feature"))
    rings = o.withColumn("part", F.explode(F.sequence(F.lit(0), F.when(F.col("feature") % RINGS == 0, 1).otherwise(0))))
    v = rings.withColumn("seq", F.explode(F.sequence(F.lit(0), (2 + F.col("feature") % 4).cast("int"))))
    f, s, p = F.col("feature"), F.col("seq"), F.col("part")
    x = (f * 7919 % 240) / EIGHTHS + ((f * (s + 3) * 31 + p * 5) % 17 - 8) / 2
    y = (f * 104729 % (height * EIGHTHS)) / EIGHTHS + ((f * (s + 5) * 37 + p * 3) % 13 - 6) / 2
    return v.select("feature", "part", "seq", x.alias("x"), y.alias("y"))


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The polygons on the grid's own height."""
    return order_polygons(spark, sf_dir, extent_of(clusters(spark, sf_dir))[1] + 1)


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    cells = clusters(spark, sf_dir)
    attributes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("feature"), F.col("o_orderpriority").alias("unit"), F.col("o_orderstatus").alias("category"))
    return cells, order_polygons(spark, sf_dir, extent_of(cells)[1] + 1), attributes


@query("polygon_validation", f"{_COUNTED} SELECT feature, unit, category, {_OUT}, {_FIGURES} FROM n, b")
def polygon_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, shares, dominant cluster, purity and enrichment of every polygon that holds a valid cell."""
    return validation(*_inputs(spark, sf_dir))["polygons"]


@query("polygon_units", f"{_COUNTED}, u AS (SELECT unit, category, {_SUM} FROM n GROUP BY 1, 2) SELECT unit, category, polygons, {_OUT}, {_FIGURES} FROM u, b")
def polygon_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation(*_inputs(spark, sf_dir))["units"]


@query("polygon_categories", f"{_COUNTED}, u AS (SELECT category, {_SUM} FROM n GROUP BY 1) SELECT category, polygons, {_OUT}, {_FIGURES} FROM u, b")
def polygon_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation(*_inputs(spark, sf_dir))["categories"]


_MIXED = ", ".join(f"round(100.0::DOUBLE * sum(c{c}) / sum(valid), 6) AS weighted_pct{c}, round(avg(100.0::DOUBLE * c{c} / valid), 6) AS mean_pct{c}, round(max(100.0::DOUBLE * c{c} / valid), 6) AS max_pct{c}" for c in range(4))


@query("polygon_mixture", f"{_COUNTED} SELECT category, CAST(count(*) AS BIGINT) AS polygons, {_MIXED} FROM n GROUP BY category")
def polygon_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation(*_inputs(spark, sf_dir))["mixture"]


@query("polygon_pooled", f"{_COUNTED}, u AS (SELECT {_N} FROM m) SELECT {_OUT}, {_FIGURES} FROM u, b")
def polygon_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation(*_inputs(spark, sf_dir))["pooled"]


@query("polygon_dissolved", f'{_COUNTED}, u AS (SELECT {_N} FROM (SELECT DISTINCT "row", col, cluster FROM m)) SELECT {_OUT}, {_FIGURES} FROM u, b')
def polygon_dissolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation(*_inputs(spark, sf_dir))["dissolved"]


@query("polygon_coverage", f"{_COUNTED}, t AS (SELECT cluster, count(*) AS total, sum(count(*)) OVER () AS al FROM clusters WHERE cluster IS NOT NULL GROUP BY cluster), g AS (SELECT feature, cluster, count(*) AS cells, sum(count(*)) OVER (PARTITION BY feature) AS f FROM m WHERE cluster IS NOT NULL GROUP BY 1, 2) SELECT feature, cluster, CAST(cells AS BIGINT) AS cells, round(100.0::DOUBLE * cells / f, 6) AS purity, round(100.0::DOUBLE * cells / total, 6) AS coverage, round((cells::DOUBLE / f) / (total::DOUBLE / al), 6) AS enrichment FROM g JOIN t USING (cluster)")
def polygon_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation(*_inputs(spark, sf_dir))["coverage"]


@query("polygon_exclusive", f'{_COUNTED}, l AS (SELECT "row", col, max(feature) AS feature, any_value(cluster) AS cluster FROM m GROUP BY 1, 2) SELECT feature, {_N} FROM l GROUP BY feature')
def polygon_exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where polygons overlap, the later one has the cell."""
    cells, vertices, _ = _inputs(spark, sf_dir)
    return histogram(last_features(cells, vertices), "feature")


@query("polygon_masked", f'{_COUNTED} SELECT cluster, CAST(count(*) AS BIGINT) AS cells FROM clusters c WHERE cluster IS NOT NULL AND EXISTS (SELECT 1 FROM m WHERE m."row" = c."row" AND m.col = c.col) GROUP BY cluster')
def polygon_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid cells inside any polygon, by cluster."""
    cells, vertices, _ = _inputs(spark, sf_dir)
    return covered_cells(cells.where("cluster is not null"), vertices).groupBy("cluster").agg(F.count("*").alias("cells"))


@query("polygons_meeting_grid", f'WITH {POLY}, x AS (SELECT feature, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM v GROUP BY feature), g AS (SELECT min("row") AS t, max("row") + 1 AS b FROM clusters) SELECT feature, x0, x1, y0, y1 FROM x, g WHERE x0 <= 30 AND x1 >= 0 AND y0 <= b AND y1 >= t')
def polygons_meeting_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of the polygons that touch the grid at all."""
    cells, vertices, _ = _inputs(spark, sf_dir)
    return meeting(vertices, extent_of(cells))


@query("polygon_total_bounds", f"WITH {POLY} SELECT category, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM v JOIN o USING (feature) GROUP BY category")
def polygon_total_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extent of all vertices of a category."""
    _, vertices, attributes = _inputs(spark, sf_dir)
    return vertices.hint("merge").join(attributes, "feature").groupBy("category").agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))


def written_shapes(spark: SparkSession, sf_dir: str) -> str:
    """Path of the polygons as shapefiles."""
    path = shared_path(spark, "polygon-shapes")
    write_shapes(_inputs(spark, sf_dir)[1], path)
    return path


@query("shapefile_vertices", f"WITH {POLY} SELECT feature, CAST(part AS INTEGER) AS part, CAST(seq AS INTEGER) AS seq, x, y FROM v")
def shapefile_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings written as shapefiles and read again; records are named by the attribute table beside them."""
    path = written_shapes(spark, sf_dir)
    key = shape_attributes(spark, path).where("name = 'feature'").select("feature", F.col("value").cast("long").alias("key"))
    # neither side has a size that Spark could know
    return read_shapes(spark, path).hint("merge").join(key, "feature").select(F.col("key").alias("feature"), "part", "seq", "x", "y")


@query("shapefile_profile", f"WITH {POLY} SELECT CAST(count(DISTINCT feature) AS BIGINT) AS records, min(x) AS x_min, min(y) AS y_min, max(x) AS x_max, max(y) AS y_max FROM v")
def shapefile_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and extent as the files' heads state them."""
    own = layer_profile(spark, written_shapes(spark, sf_dir))
    return own.agg(F.sum("records").alias("records"), F.min("x_min").alias("x_min"), F.min("y_min").alias("y_min"), F.max("x_max").alias("x_max"), F.max("y_max").alias("y_max"))
