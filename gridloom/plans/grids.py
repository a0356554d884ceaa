"""Queries on the grid: neighbourhoods, resampling, windows, objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.exprs import r6, ratio
from gridloom.operators import focal, objects
from gridloom.registry import query
from gridloom.sources.tables import BANDS, COLUMNS_WIDE, cells, cluster_of, clusters, grid, table

RADIUS, STEP = 2, 2025.0

# every cell with each cell of its neighbourhood, edges repeated
AROUND = """around AS (SELECT g."row", g.col, n.radar, n.height, n.emissivity, n.slope, n.reflectivity FROM grid g CROSS JOIN (SELECT unnest(range(-2, 3)) AS dr) a CROSS JOIN (SELECT unnest(range(-2, 3)) AS dc) b
      CROSS JOIN (SELECT max("row") AS h FROM grid) m JOIN grid n ON n."row" = least(greatest(g."row" + dr, 0), h) AND n.col = least(greatest(g.col + dc, 0), 29))"""


def _std(b: str) -> str:
    return f"round(coalesce(sqrt(greatest(sum({b} * {b})::DOUBLE / nullif(count({b}), 0) - (sum({b})::DOUBLE / nullif(count({b}), 0)) * (sum({b})::DOUBLE / nullif(count({b}), 0)), 0)), 0), 6) AS {b}_local_std"


def _range(b: str) -> str:
    return f"CAST(coalesce(max({b}) - min({b}), 0) AS DOUBLE) AS {b}_local_range"


FILLED = """filled AS (SELECT g."row", g.col, coalesce(CAST(g.height AS DOUBLE), s.height, 0.0) AS height, coalesce(CAST(g.radar AS DOUBLE), s.radar, 0.0) AS radar
      FROM grid g JOIN (SELECT "row", col, sum(height)::DOUBLE / nullif(count(height), 0) AS height, sum(radar)::DOUBLE / nullif(count(radar), 0) AS radar FROM around GROUP BY 1, 2) s ON s."row" = g."row" AND s.col = g.col)"""


def _side(v: str, by: str, f: str) -> str:
    along = "col" if by == '"row"' else '"row"'
    return f"{f}({v}) OVER (PARTITION BY {by} ORDER BY {along})"


def _slope(v: str, by: str) -> str:
    a, b = _side(v, by, "lag"), _side(v, by, "lead")
    return f"(CASE WHEN {a} IS NULL THEN ({b} - {v}) / 2025.0::DOUBLE WHEN {b} IS NULL THEN ({v} - {a}) / 2025.0::DOUBLE ELSE ({b} - {a}) / 4050.0::DOUBLE END)"


def _gradient(v: str) -> str:
    x, y = _slope(v, '"row"'), _slope(v, "col")
    return f"round(sqrt({x} * {x} + {y} * {y}), 6)"


CURVATURE = f"""round((coalesce({_side("height", '"row"', "lag")}, height) + coalesce({_side("height", '"row"', "lead")}, height) + coalesce({_side("height", "col", "lag")}, height) + coalesce({_side("height", "col", "lead")}, height) - 4 * height) / (2025.0::DOUBLE * 2025.0), 6)"""


@query("focal_std", f"""WITH {AROUND} SELECT "row", col, {", ".join(map(_std, BANDS))} FROM around GROUP BY 1, 2""")
def focal_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = focal.local_std(grid(spark, sf_dir), BANDS, RADIUS)
    return out.select("row", "col", *[r6(f"{b}_local_std").alias(f"{b}_local_std") for b in BANDS])


@query("focal_range", f"""WITH {AROUND} SELECT "row", col, {", ".join(map(_range, ["radar", "height", "emissivity", "reflectivity"]))} FROM around GROUP BY 1, 2""")
def focal_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = ["radar", "height", "emissivity", "reflectivity"]
    return focal.local_range(grid(spark, sf_dir), bands, RADIUS).select("row", "col", *[f"{b}_local_range" for b in bands])


@query("hole_fill", f"""WITH {AROUND}, {FILLED} SELECT "row", col, round(height, 6) AS height_filled, round(radar, 6) AS radar_filled FROM filled""")
def hole_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = focal.filled(grid(spark, sf_dir), ["height", "radar"], RADIUS)
    return out.select("row", "col", r6("height_filled").alias("height_filled"), r6("radar_filled").alias("radar_filled"))


@query("gradient", f"""WITH {AROUND}, {FILLED} SELECT "row", col, {_gradient("height")} AS height_gradient, {_gradient("radar")} AS radar_gradient FROM filled""")
def gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = focal.filled(grid(spark, sf_dir), ["height", "radar"], RADIUS)
    out = focal.gradient(focal.gradient(out, "height_filled", "height_gradient", STEP, STEP), "radar_filled", "radar_gradient", STEP, STEP)
    return out.select("row", "col", r6("height_gradient").alias("height_gradient"), r6("radar_gradient").alias("radar_gradient"))


@query("curvature", f"""WITH {AROUND}, {FILLED} SELECT "row", col, {CURVATURE} AS height_curvature FROM filled""")
def curvature(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = focal.curvature(focal.filled(grid(spark, sf_dir), ["height"], RADIUS), "height_filled", "height_curvature", STEP, STEP)
    return out.select("row", "col", r6("height_curvature").alias("height_curvature"))


@query(
    "derived_features",
    f"""WITH {AROUND}, {FILLED}, spread AS (SELECT "row", col, {", ".join(map(_std, BANDS))}, {", ".join(map(_range, ["radar", "height", "emissivity", "reflectivity"]))} FROM around GROUP BY 1, 2),
    steep AS (SELECT "row", col, {CURVATURE} AS height_curvature, {_gradient("radar")} AS radar_gradient, {_gradient("height")} AS height_gradient FROM filled)
    SELECT * FROM spread JOIN steep USING ("row", col)""",
)
def derived_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = focal.derived(grid(spark, sf_dir), RADIUS, STEP, STEP)
    names = [c for c in out.columns if c.endswith(("_std", "_range", "_gradient", "_curvature"))]
    return out.select("row", "col", *[r6(c).alias(c) for c in names])


SMOOTHED = """votes AS (SELECT c."row", c.col, any_value(c.cluster) AS cluster, n.cluster AS v, count(*) AS k FROM clusters c JOIN clusters n ON abs(n."row" - c."row") <= 1 AND abs(n.col - c.col) <= 1 AND n.cluster IS NOT NULL AND c.cluster IS NOT NULL GROUP BY c."row", c.col, n.cluster),
    smooth AS (SELECT c."row", c.col, c.cluster, v.v AS smoothed FROM clusters c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY "row", col ORDER BY k DESC, v) AS i FROM votes) v ON v."row" = c."row" AND v.col = c.col AND v.i = 1)"""


@query("majority_smooth", f"""WITH {SMOOTHED} SELECT "row", col, cluster, smoothed FROM smooth""")
def majority_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return focal.majority(clusters(spark, sf_dir))


@query("smoothing_change_pct", f"""WITH {SMOOTHED} SELECT count(*) AS both_valid, CAST(sum(CAST(cluster <> smoothed AS INTEGER)) AS BIGINT) AS changed, round(100.0::DOUBLE * sum(CAST(cluster <> smoothed AS INTEGER)) / count(*), 6) AS changed_pct FROM smooth WHERE cluster IS NOT NULL AND smoothed IS NOT NULL""")
def smoothing_change_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = focal.majority(clusters(spark, sf_dir)).where("cluster is not null and smoothed is not null")
    changed = F.sum((F.col("cluster") != F.col("smoothed")).cast("int")).cast("long")
    return both.agg(F.count("*").alias("both_valid"), changed.alias("changed"), r6(ratio(100 * changed, F.count("*"))).alias("changed_pct"))


@query("raw_vs_smoothed", f"""WITH {SMOOTHED} SELECT cluster, CAST(count(*) AS BIGINT) AS raw_cells, CAST(sum(CAST(smoothed = cluster AS INTEGER)) AS BIGINT) AS unchanged FROM smooth WHERE cluster IS NOT NULL GROUP BY cluster""")
def raw_vs_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = focal.majority(clusters(spark, sf_dir)).where("cluster is not null")
    return out.groupBy("cluster").agg(F.count("*").alias("raw_cells"), F.sum((F.col("smoothed") == F.col("cluster")).cast("int")).alias("unchanged"))


@query("neighbour_join", """SELECT c."row", c.col, CAST(count(n.radar) AS BIGINT) AS n_valid, CAST(sum(n.radar) AS BIGINT) AS radar_sum FROM grid c JOIN grid n ON abs(n."row" - c."row") <= 1 AND abs(n.col - c.col) <= 1 GROUP BY 1, 2""")
def neighbour_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joined form of a neighbourhood sum: every cell offers its value to the nine cells around."""
    g = grid(spark, sf_dir).select("row", "col", "radar")
    steps = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    offered = g.select((F.col("row")).alias("r"), F.col("col").alias("c"), "radar", F.explode(steps).alias("s")).select((F.col("r") + F.col("s.dr")).alias("row"), (F.col("c") + F.col("s.dc")).alias("col"), "radar")
    sums = offered.groupBy("row", "col").agg(F.count("radar").alias("n_valid"), F.sum("radar").alias("radar_sum"))
    return g.select("row", "col").join(sums, ["row", "col"])


@query("decimate_nearest", """SELECT CAST("row" // 3 AS INTEGER) AS "row", CAST(col // 3 AS INTEGER) AS col, cluster FROM clusters WHERE "row" % 3 = 1 AND col % 3 = 1""")
def decimate_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third cell, the one at the middle of each 3 x 3 block."""
    c = clusters(spark, sf_dir).where("row % 3 = 1 and col % 3 = 1")
    return c.select(F.expr("int(row div 3)").alias("row"), F.expr("int(col div 3)").alias("col"), "cluster")


@query("decimate_mode", """SELECT "row", col, cluster FROM (SELECT CAST("row" // 5 AS INTEGER) AS "row", CAST(col // 5 AS INTEGER) AS col, cluster, row_number() OVER (PARTITION BY "row" // 5, col // 5 ORDER BY count(*) DESC, cluster) AS i FROM clusters WHERE cluster IS NOT NULL GROUP BY "row" // 5, col // 5, cluster) WHERE i = 1""")
def decimate_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent cluster of each 5 x 5 block, lowest on ties."""
    c = clusters(spark, sf_dir).where("cluster is not null").select(F.expr("int(row div 5)").alias("row"), F.expr("int(col div 5)").alias("col"), "cluster")
    votes = c.groupBy("row", "col", "cluster").count()
    best = Window.partitionBy("row", "col").orderBy(F.desc("count"), "cluster")
    return votes.withColumn("i", F.row_number().over(best)).where("i = 1").select("row", "col", "cluster")


@query("decimate_stride", """SELECT "row", col, cluster FROM clusters WHERE "row" % 4 = 0 AND col % 4 = 0""")
def decimate_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(spark, sf_dir).where("row % 4 = 0 and col % 4 = 0")


@query(
    "bilinear_resample",
    """WITH target AS (SELECT DISTINCT "row" AS tr, col AS tc, ("row" + 0.5::DOUBLE) * 0.8 - 0.5 AS sr, (col + 0.5::DOUBLE) * 0.8 - 0.5 AS sc FROM grid),
    near AS (SELECT tr, tc, CAST(floor(sr) AS INTEGER) + a AS "row", CAST(floor(sc) AS INTEGER) + b AS col, (1 - abs(sr - (floor(sr) + a))) * (1 - abs(sc - (floor(sc) + b))) AS w FROM target CROSS JOIN (SELECT unnest([0, 1]) AS a) CROSS JOIN (SELECT unnest([0, 1]) AS b))
    SELECT tr AS "row", tc AS col, round(sum(w * height) / nullif(sum(CASE WHEN height IS NOT NULL THEN w END), 0), 6) AS height FROM near LEFT JOIN grid g ON g."row" = near."row" AND g.col = near.col GROUP BY tr, tc""",
)
def bilinear_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Height on a grid of 1.25 times the resolution; weights of missing cells are left out."""
    g = grid(spark, sf_dir).select("row", "col", "height")
    at = lambda c: (F.col(c) + 0.5) * 0.8 - 0.5
    target = g.select(F.col("row").alias("tr"), F.col("col").alias("tc"), at("row").alias("sr"), at("col").alias("sc"))
    corners = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    near = target.withColumn("k", F.explode(corners)).select(
        "tr", "tc", (F.floor("sr") + F.col("k.a")).cast("int").alias("row"), (F.floor("sc") + F.col("k.b")).cast("int").alias("col"),
        ((1 - F.abs(F.col("sr") - (F.floor("sr") + F.col("k.a")))) * (1 - F.abs(F.col("sc") - (F.floor("sc") + F.col("k.b"))))).alias("w"),
    )
    found = near.join(g, ["row", "col"], "left").groupBy("tr", "tc").agg(F.sum(F.col("w") * F.col("height")).alias("s"), F.sum(F.when(F.col("height").isNotNull(), F.col("w"))).alias("w"))
    return found.select(F.col("tr").alias("row"), F.col("tc").alias("col"), r6(F.try_divide("s", "w")).alias("height"))


@query("block_assignment", """SELECT CAST("row" // 16 AS INTEGER) AS block_r, CAST(col // 8 AS INTEGER) AS block_c, CAST(count(*) AS BIGINT) AS cells, CAST(count(radar) AS BIGINT) AS valid FROM grid GROUP BY 1, 2""")
def block_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir).withColumns({"block_r": F.expr("int(row div 16)"), "block_c": F.expr("int(col div 8)")})
    return g.groupBy("block_r", "block_c").agg(F.count("*").alias("cells"), F.count("radar").alias("valid"))


@query("band_alignment_join", """SELECT a."row", a.col, a.radar, b.height, CAST(a.radar - b.height AS BIGINT) AS difference FROM cells a JOIN cells b ON a."row" = b."row" AND a.col = b.col""")
def band_alignment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    return c.select("row", "col", "radar").join(c.select("row", "col", "height"), ["row", "col"]).withColumn("difference", F.col("radar") - F.col("height"))


@query("scatter_to_full_grid", """SELECT "row", col, CASE WHEN height IS NULL THEN 255 ELSE least(slope - 1, 3) END::INTEGER AS cluster, coalesce(CAST(height AS DOUBLE) / 100, -9999.0) AS product FROM grid""")
def scatter_to_full_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results back on the whole grid with no-data values, as raster files want them."""
    g = grid(spark, sf_dir)
    return g.select("row", "col", F.coalesce(cluster_of(), F.lit(255)).alias("cluster"), F.coalesce(F.col("height").cast("double") / 100, F.lit(-9999.0)).alias("product"))


OBJECTS = """starts AS (SELECT "row", cluster, min(col) AS lo, max(col) AS hi FROM (SELECT *, col - row_number() OVER (PARTITION BY "row", cluster ORDER BY col) AS g FROM clusters WHERE cluster IS NOT NULL) GROUP BY "row", cluster, g),
    runs AS (SELECT *, (CAST("row" AS BIGINT) << 31) + lo AS run FROM starts),
    links AS (SELECT a.run AS a, b.run AS b FROM runs a JOIN runs b ON b."row" = a."row" + 1 AND b.cluster = a.cluster AND a.lo <= b.hi + 1 AND b.lo <= a.hi + 1),
    two AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach AS (SELECT run AS node, run AS seen FROM runs UNION SELECT r.node, t.b FROM reach r JOIN two t ON t.a = r.seen),
    named AS (SELECT node AS run, min(seen) AS object FROM reach GROUP BY node),
    inside AS (SELECT "row", cluster, object, CAST(unnest(range(lo, hi + 1)) AS INTEGER) AS col FROM runs JOIN named USING (run))"""


@query("components", f"""WITH RECURSIVE {OBJECTS}, sized AS (SELECT cluster, object, count(*) AS cells FROM inside GROUP BY 1, 2)
    SELECT cluster, CAST(count(*) AS BIGINT) AS objects, CAST(max(cells) AS BIGINT) AS largest, CAST(min(cells) AS BIGINT) AS smallest, round(avg(cells), 6) AS mean_cells, round(median(cells), 6) AS median_cells, round(100.0::DOUBLE * max(cells) / sum(cells), 6) AS largest_pct FROM sized GROUP BY cluster""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = objects.sizes(clusters(spark, sf_dir))
    return s.groupBy("cluster").agg(
        F.count("*").alias("objects"), F.max("cells").alias("largest"), F.min("cells").alias("smallest"), r6(F.avg("cells")).alias("mean_cells"), r6(F.median("cells")).alias("median_cells"), r6(ratio(100 * F.max("cells"), F.sum("cells"))).alias("largest_pct")
    )


@query("component_topk", f"""WITH RECURSIVE {OBJECTS}, sized AS (SELECT cluster, object, count(*) AS cells FROM inside GROUP BY 1, 2)
    SELECT cluster, CAST(i AS INTEGER) AS rank, CAST(cells AS BIGINT) AS cells FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY cells DESC, object) AS i FROM sized) WHERE i <= 10""")
def component_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = Window.partitionBy("cluster").orderBy(F.desc("cells"), "object")
    return objects.sizes(clusters(spark, sf_dir)).withColumn("rank", F.row_number().over(best).cast("int")).where("rank <= 10").select("cluster", "rank", "cells")


RING = """ring AS (SELECT DISTINCT i.object, i."row" + a.d AS "row", i.col + b.d AS col FROM inside i CROSS JOIN (SELECT unnest([-1, 0, 1]) AS d) a CROSS JOIN (SELECT unnest([-1, 0, 1]) AS d) b
      WHERE NOT EXISTS (SELECT 1 FROM inside o WHERE o.object = i.object AND o."row" = i."row" + a.d AND o.col = i.col + b.d) AND i."row" + a.d BETWEEN 0 AND (SELECT max("row") FROM clusters) AND i.col + b.d BETWEEN 0 AND 29)"""


@query("object_atlas", f"""WITH RECURSIVE {OBJECTS}, {RING}, rims AS (SELECT object, count(*) AS rim FROM ring GROUP BY object)
    SELECT cluster, i.object, CAST(count(*) AS BIGINT) AS cells, CAST(count(*) * 2025.0 * 2025.0 AS DOUBLE) AS area_m2, CAST(coalesce(any_value(rim), 0) * 2025.0 AS DOUBLE) AS perimeter_m, min("row") AS row_min, max("row") AS row_max, min(col) AS col_min, max(col) AS col_max, round(avg("row"), 6) AS centroid_row, round(avg(col), 6) AS centroid_col
    FROM inside i LEFT JOIN rims r ON r.object = i.object GROUP BY cluster, i.object HAVING count(*) >= 8""")
def object_atlas(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clusters(spark, sf_dir)
    height = c.agg(F.max("row")).first()[0] + 1
    out = objects.atlas(c, height, COLUMNS_WIDE, STEP, STEP, 8)
    return out.withColumns({"centroid_row": r6("centroid_row"), "centroid_col": r6("centroid_col")})


@query("dilation_boundary", f"""WITH RECURSIVE {OBJECTS}, {RING} SELECT object, CAST(count(*) AS BIGINT) AS rim FROM ring GROUP BY object""")
def dilation_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clusters(spark, sf_dir)
    height = c.agg(F.max("row")).first()[0] + 1
    rim = objects.ring(objects.labelled_runs(c)).where(F.col("row").between(0, height - 1) & F.col("col").between(0, COLUMNS_WIDE - 1))
    return rim.groupBy("object").agg(F.count("*").alias("rim"))


@query("object_bbox_centroid", f"""WITH RECURSIVE {OBJECTS} SELECT cluster, object, CAST(count(*) AS BIGINT) AS cells, min("row") AS row_min, max("row") AS row_max, min(col) AS col_min, max(col) AS col_max, round(avg("row"), 6) AS centroid_row, round(avg(col), 6) AS centroid_col FROM inside GROUP BY 1, 2""")
def object_bbox_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects.labelled(clusters(spark, sf_dir)).groupBy("cluster", "object").agg(
        F.count("*").alias("cells"), F.min("row").alias("row_min"), F.max("row").alias("row_max"), F.min("col").alias("col_min"), F.max("col").alias("col_max"), r6(F.avg("row")).alias("centroid_row"), r6(F.avg("col")).alias("centroid_col")
    )


@query("point_lookup", """SELECT c_custkey, CASE WHEN g.col IS NULL THEN 'outside' WHEN g.cluster IS NULL THEN 'no data' ELSE 'found' END AS status, g.cluster FROM customer CROSS JOIN (SELECT max("row") AS h FROM clusters) LEFT JOIN clusters g ON g."row" = c_custkey % (h + 6) AND g.col = c_nationkey + 8""")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell under each point; points may lie outside the grid."""
    c = clusters(spark, sf_dir)
    height = c.agg(F.max("row")).first()[0] + 1
    points = table(spark, sf_dir, "customer").select("c_custkey", F.pmod("c_custkey", F.lit(height + 5)).cast("int").alias("row"), (F.col("c_nationkey") + 8).cast("int").alias("col"))
    found = points.join(c.withColumn("inside", F.lit(True)), ["row", "col"], "left")
    status = F.when(F.col("inside").isNull(), "outside").when(F.col("cluster").isNull(), "no data").otherwise("found")
    return found.select("c_custkey", status.alias("status"), "cluster")
