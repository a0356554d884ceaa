"""Polygon statistics: per feature, exclusive, pooled, dissolved, rolled up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.exprs import r6, ratio
from gridloom.operators.polygons import boxes
from gridloom.operators.zones import histogram, members, polygons_table, shares
from gridloom.plans.polygons import POLY, vertices
from gridloom.registry import query
from gridloom.sources.tables import clusters

#: feature, rings of (x = column, y = row): a box, a concave shape, two that overlap, one of two parts, one outside.
POLYGONS = [
    (1, [[(2.0, 1.0), (12.0, 1.0), (12.0, 9.0), (2.0, 9.0)]]),
    (2, [[(0.0, 0.0), (28.0, 0.0), (20.0, 14.0), (10.0, 6.0), (4.0, 13.0)]]),
    (3, [[(8.0, 2.0), (22.0, 3.0), (18.0, 12.0)]]),
    (4, [[(14.0, 8.0), (29.0, 8.0), (29.0, 15.0), (14.0, 15.0)]]),
    (5, [[(1.0, 10.0), (6.0, 10.0), (6.0, 14.0), (1.0, 14.0)], [(24.0, 1.0), (29.0, 1.0), (29.0, 5.0), (24.0, 5.0)]]),
    (6, [[(100.0, 100.0), (120.0, 100.0), (120.0, 110.0)]]),
]
#: feature -> (unit, category)
UNITS = {1: ("u1", "plain"), 2: ("u2", "highland"), 3: ("u1", "plain"), 4: ("u3", "highland"), 5: ("u2", "plain"), 6: ("u4", "plain")}


def _inside(rings) -> str:
    edges = [(a, b) for r in rings for a, b in zip(r, [*r[1:], r[0]]) if a[1] != b[1]]
    return "(" + " + ".join(f"CASE WHEN ({y1!r}::DOUBLE <= y) <> ({y2!r}::DOUBLE <= y) AND x < {x1!r}::DOUBLE + (y - {y1!r}::DOUBLE) * {(x2 - x1) / (y2 - y1)!r}::DOUBLE THEN 1 ELSE 0 END" for (x1, y1), (x2, y2) in edges) + ") % 2 = 1"


_UNIT = "CASE feature " + " ".join(f"WHEN {f} THEN '{u}'" for f, (u, _) in UNITS.items()) + " END"
_CAT = "CASE feature " + " ".join(f"WHEN {f} THEN '{c}'" for f, (_, c) in UNITS.items()) + " END"
MEMBERS = "xy AS (SELECT *, col + 0.5::DOUBLE AS x, \"row\" + 0.5::DOUBLE AS y FROM clusters), members AS (" + " UNION ALL ".join(f'SELECT {f} AS feature, "row", col, cluster FROM xy WHERE {_inside(r)}' for f, r in POLYGONS) + ")"
_COUNTS = "CAST(count(cluster) AS BIGINT) AS valid, " + ", ".join(f"CAST(count(*) FILTER (cluster = {k}) AS BIGINT) AS c{k}" for k in range(4))
_SHARES = ", ".join(f"round(100.0::DOUBLE * c{k} / nullif(valid, 0), 6) AS pct{k}" for k in range(4))
_DOM = "CASE WHEN valid = 0 THEN NULL WHEN c0 = greatest(c0, c1, c2, c3) THEN 0 WHEN c1 = greatest(c0, c1, c2, c3) THEN 1 WHEN c2 = greatest(c0, c1, c2, c3) THEN 2 ELSE 3 END AS dominant, round(100.0::DOUBLE * greatest(c0, c1, c2, c3) / nullif(valid, 0), 6) AS purity"


def zone_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members(clusters(spark, sf_dir), POLYGONS)


def with_units(df: DataFrame) -> DataFrame:
    look = lambda i: F.element_at(F.create_map(*[F.lit(x) for f, u in UNITS.items() for x in (f, u[i])]), F.col("feature"))
    return df.withColumns({"unit": look(0), "category": look(1)})


@query("zonal_histogram", f"WITH {MEMBERS}, h AS (SELECT feature, {_COUNTS} FROM members GROUP BY feature) SELECT *, {_SHARES}, {_DOM} FROM h")
def zonal_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(histogram(zone_members(spark, sf_dir), "feature"))


@query("zonal_enrichment", f"WITH {MEMBERS}, b AS (SELECT {', '.join(f'count(*) FILTER (cluster = {k})::DOUBLE / count(cluster) AS b{k}' for k in range(4))} FROM clusters), h AS (SELECT feature, {_COUNTS} FROM members GROUP BY feature) SELECT feature, {', '.join(f'round((c{k}::DOUBLE / nullif(valid, 0)) / nullif(b{k}, 0), 6) AS enrichment{k}' for k in range(4))} FROM h, b")
def zonal_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each cluster in a feature over its share in the whole window."""
    c = clusters(spark, sf_dir)
    base = c.agg(*[ratio(F.count(F.when(F.col("cluster") == k, 1)), F.count("cluster")).alias(f"b{k}") for k in range(4)])
    h = histogram(members(c, POLYGONS), "feature").crossJoin(F.broadcast(base))  # one row
    return h.select("feature", *[r6(F.try_divide(ratio(f"c{k}", "valid"), F.col(f"b{k}"))).alias(f"enrichment{k}") for k in range(4)])


@query("zonal_exclusive", f'WITH {MEMBERS}, last AS (SELECT "row", col, max(feature) AS feature, any_value(cluster) AS cluster FROM members GROUP BY 1, 2) SELECT feature, {_COUNTS} FROM last GROUP BY feature')
def zonal_exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where features overlap, the later one has the cell."""
    last = zone_members(spark, sf_dir).groupBy("row", "col").agg(F.max("feature").alias("feature"), F.first("cluster").alias("cluster"))
    return histogram(last, "feature")


@query("zonal_pooled", f"WITH {MEMBERS} SELECT {_COUNTS} FROM members")
def zonal_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features' cells together; overlaps count twice."""
    return histogram(zone_members(spark, sf_dir))


@query("pooled_union", f"WITH {MEMBERS} SELECT {_COUNTS} FROM (SELECT * FROM members WHERE feature = 1 UNION ALL SELECT * FROM members WHERE feature = 3)")
def pooled_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = zone_members(spark, sf_dir)
    return histogram(m.where("feature = 1").unionByName(m.where("feature = 3")))


@query("zonal_dissolved", f'WITH {MEMBERS} SELECT {_COUNTS} FROM (SELECT DISTINCT "row", col, cluster FROM members)')
def zonal_dissolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of all features; overlaps count once."""
    return histogram(zone_members(spark, sf_dir).dropDuplicates(["row", "col"]))


@query("zonal_mask_semi", f'WITH {MEMBERS} SELECT cluster, CAST(count(*) AS BIGINT) AS cells FROM clusters c WHERE cluster IS NOT NULL AND EXISTS (SELECT 1 FROM members m WHERE m."row" = c."row" AND m.col = c.col) GROUP BY cluster')
def zonal_mask_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clusters(spark, sf_dir)
    return c.where("cluster is not null").join(members(c, POLYGONS), ["row", "col"], "left_semi").groupBy("cluster").agg(F.count("*").alias("cells"))


@query("unit_rollup", f"WITH {MEMBERS}, h AS (SELECT {_UNIT} AS unit, CAST(count(DISTINCT feature) AS BIGINT) AS polygons, {_COUNTS} FROM members GROUP BY 1) SELECT *, {_SHARES}, {_DOM} FROM h")
def unit_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells are summed over a unit's polygons, then shares derived anew."""
    h = with_units(histogram(zone_members(spark, sf_dir), "feature")).groupBy("unit").agg(F.count("*").alias("polygons"), *[F.sum(c).alias(c) for c in ("valid", "c0", "c1", "c2", "c3")])
    return shares(h)


@query("category_rollup", f"WITH {MEMBERS}, h AS (SELECT {_CAT} AS category, CAST(count(DISTINCT feature) AS BIGINT) AS polygons, {_COUNTS} FROM members GROUP BY 1) SELECT *, {_SHARES}, {_DOM} FROM h")
def category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = with_units(histogram(zone_members(spark, sf_dir), "feature")).groupBy("category").agg(F.count("*").alias("polygons"), *[F.sum(c).alias(c) for c in ("valid", "c0", "c1", "c2", "c3")])
    return shares(h)


_MIX = ", ".join(f"round(100.0::DOUBLE * sum(c{c}) / sum(valid), 6) AS weighted_pct{c}, round(avg(p{c}), 6) AS mean_pct{c}, round(median(p{c}), 6) AS median_pct{c}, round(max(p{c}), 6) AS max_pct{c}" for c in range(4))
_P = ", ".join(f"100.0::DOUBLE * c{c} / nullif(valid, 0) AS p{c}" for c in range(4))


@query("category_mix_summary", f"WITH {MEMBERS}, h AS (SELECT feature, {_CAT} AS category, {_COUNTS} FROM members GROUP BY 1, 2), p AS (SELECT *, {_P} FROM h) SELECT category, {_MIX} FROM p GROUP BY category")
def category_mix_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cluster's share of a category: over all cells, and mean, median and largest of the features' shares."""
    p = with_units(histogram(zone_members(spark, sf_dir), "feature")).withColumns({f"p{c}": ratio(100 * F.col(f"c{c}"), F.col("valid")) for c in range(4)})
    measures = lambda c: (r6(ratio(100 * F.sum(f"c{c}"), F.sum("valid"))).alias(f"weighted_pct{c}"), r6(F.avg(f"p{c}")).alias(f"mean_pct{c}"), r6(F.median(f"p{c}")).alias(f"median_pct{c}"), r6(F.max(f"p{c}")).alias(f"max_pct{c}"))
    return p.groupBy("category").agg(*[m for c in range(4) for m in measures(c)])


@query("purity_coverage", f"WITH {MEMBERS}, t AS (SELECT cluster, count(*) AS total, sum(count(*)) OVER () AS al FROM clusters WHERE cluster IS NOT NULL GROUP BY cluster), n AS (SELECT feature, cluster, count(*) AS n, sum(count(*)) OVER (PARTITION BY feature) AS f FROM members WHERE cluster IS NOT NULL GROUP BY 1, 2) SELECT feature, cluster, CAST(n AS BIGINT) AS cells, round(100.0::DOUBLE * n / f, 6) AS purity, round(100.0::DOUBLE * n / total, 6) AS coverage, round((n::DOUBLE / f) / (total::DOUBLE / al), 6) AS enrichment FROM n JOIN t USING (cluster)")
def purity_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap over feature, over cluster total, and over what the cluster's share would give."""
    from pyspark.sql import Window

    c = clusters(spark, sf_dir)
    t = c.where("cluster is not null").groupBy("cluster").agg(F.count("*").alias("total")).withColumn("all", F.sum("total").over(Window.partitionBy()))
    n = members(c, POLYGONS).where("cluster is not null").groupBy("feature", "cluster").agg(F.count("*").alias("cells")).withColumn("f", F.sum("cells").over(Window.partitionBy("feature")))
    return n.join(F.broadcast(t), "cluster").select("feature", "cluster", "cells", r6(ratio(100 * F.col("cells"), F.col("f"))).alias("purity"), r6(ratio(100 * F.col("cells"), F.col("total"))).alias("coverage"), r6(F.try_divide(ratio("cells", "f"), ratio("total", "all"))).alias("enrichment"))


_WINDOWS = "b(feature, x0, x1, y0, y1) AS (VALUES " + ", ".join(f"({f}, {min(p[0] for q in r for p in q)}::DOUBLE, {max(p[0] for q in r for p in q)}::DOUBLE, {min(p[1] for q in r for p in q)}::DOUBLE, {max(p[1] for q in r for p in q)}::DOUBLE)" for f, r in POLYGONS) + ")"


@query("bbox_overlap_prefilter", f"WITH {POLY}, {_WINDOWS}, x AS (SELECT feature, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM v GROUP BY feature) SELECT CAST(b.feature AS INTEGER) AS a, x.feature AS b FROM x JOIN b ON x.x0 <= b.x1 AND b.x0 <= x.x1 AND x.y0 <= b.y1 AND b.y0 <= x.y1")
def bbox_overlap_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b): polygons b whose bounds meet window a; the few windows are broadcast."""
    windows = boxes(polygons_table(spark, POLYGONS)).select(F.col("feature").alias("a"), *[F.col(c).alias(f"w_{c}") for c in ("x0", "x1", "y0", "y1")])
    own = boxes(vertices(spark, sf_dir))
    meet = (F.col("x0") <= F.col("w_x1")) & (F.col("w_x0") <= F.col("x1")) & (F.col("y0") <= F.col("w_y1")) & (F.col("w_y0") <= F.col("y1"))
    return own.join(F.broadcast(windows), meet).select("a", F.col("feature").alias("b"))
