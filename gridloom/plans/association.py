"""Clusters against independent categories: purity, enrichment, harmonised tables, rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.exprs import argmax, r6, ratio
from gridloom.plans import workflows
from gridloom.registry import query
from gridloom.sources.files import resolve
from gridloom.sources.tables import table


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cluster, geology, count): orders by priority and nation."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return o.join(c, "o_custkey").join(n, "n_nationkey").groupBy(F.col("o_orderpriority").alias("cluster"), F.col("n_name").alias("geology")).agg(F.count("*").alias("count"))


def enrichment(long: DataFrame) -> DataFrame:
    """A long table (cluster, geology, count) with totals, purity, fraction and observed over expected."""
    n = long.withColumn("count", F.coalesce(F.col("count").try_cast("double"), F.lit(0.0)))
    total = lambda *by: F.sum("count").over(Window.partitionBy(*by))
    n = n.withColumns({"cluster_total": total("cluster"), "geology_total": total("geology"), "_all": total()})
    expected = F.try_divide(F.col("cluster_total") * F.col("geology_total"), F.col("_all"))
    return n.select(
        "cluster", "geology", "count", "cluster_total", "geology_total", r6(F.try_divide("count", "cluster_total")).alias("purity"),
        r6(F.try_divide("count", "geology_total")).alias("cluster_fraction_within_geology"), r6(F.try_divide("count", expected)).alias("enrichment"),
    )


E_SQL = """e AS (SELECT cluster, geology, CAST(n AS DOUBLE) AS "count", CAST(sum(n) OVER (PARTITION BY cluster) AS DOUBLE) AS cluster_total, CAST(sum(n) OVER (PARTITION BY geology) AS DOUBLE) AS geology_total, CAST(sum(n) OVER () AS DOUBLE) AS al FROM counts),
    rich AS (SELECT cluster, geology, "count", cluster_total, geology_total, round("count" / nullif(cluster_total, 0), 6) AS purity, round("count" / nullif(geology_total, 0), 6) AS cluster_fraction_within_geology, round("count" / nullif(cluster_total * geology_total / al, 0), 6) AS enrichment FROM e)"""


@query("enrichment_long", f"WITH {E_SQL} SELECT * FROM rich")
def enrichment_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment(counts(spark, sf_dir)).orderBy("cluster", F.desc_nulls_last("enrichment"))


@query("enrichment_topk", f"WITH {E_SQL} SELECT cluster, geology, enrichment FROM rich ORDER BY enrichment DESC NULLS LAST, cluster, geology LIMIT 20")
def enrichment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment(counts(spark, sf_dir)).select("cluster", "geology", "enrichment").orderBy(F.desc_nulls_last("enrichment"), "cluster", "geology").limit(20)


@query("robust_associations", f"WITH {E_SQL} SELECT cluster, geology, enrichment FROM rich WHERE enrichment > 1 AND \"count\" >= 20")
def robust_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment(counts(spark, sf_dir)).where((F.col("enrichment") > 1) & (F.col("count") >= 20)).select("cluster", "geology", "enrichment").orderBy(F.desc("enrichment"))


@query("best_feature_per_cluster", f"WITH {E_SQL} SELECT cluster, geology, enrichment FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY enrichment DESC, geology) AS i FROM rich) WHERE i = 1")
def best_feature_per_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = Window.partitionBy("cluster").orderBy(F.desc("enrichment"), "geology")
    return enrichment(counts(spark, sf_dir)).withColumn("i", F.row_number().over(best)).where("i = 1").select("cluster", "geology", "enrichment")


@query("grouping_sets_totals", "SELECT cluster, geology, CAST(sum(n) AS BIGINT) AS n, CAST(grouping(cluster) * 2 + grouping(geology) AS BIGINT) AS level FROM counts GROUP BY GROUPING SETS ((cluster), (geology), ())")
def grouping_sets_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = counts(spark, sf_dir)
    return n.groupingSets([["cluster"], ["geology"], []], "cluster", "geology").agg(F.sum("count").alias("n"), F.grouping_id().cast("long").alias("level"))


@query("alias_columns", "SELECT cluster, CAST(sum(n) AS BIGINT) AS n FROM counts GROUP BY cluster")
def alias_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns found by alias, whatever their case and surrounding blanks."""
    raw = counts(spark, sf_dir).toDF(" Cluster_ID ", "UNIT", "Pixels")
    c, n = resolve(raw.columns, ["cluster", "cluster_id", "ml_cluster"]), resolve(raw.columns, ["count", "pixels", "n", "pixel_count"])
    return raw.groupBy(F.col(f"`{c}`").alias("cluster")).agg(F.sum(F.col(f"`{n}`")).alias("n"))


PCT = [f"C{i}_pct" for i in range(4)]
#: What the study's rows are called in these tables: the reference rows, those without a class, one region, words of the names.
BASELINE, UNKNOWN, REGION, WORD, CLASS, LARGE = "BUILDING", "HOUSEHOLD", "EUROPE", "nation_1", "auto", 5
STUDY_SQL = """study AS (SELECT r_name AS region, n_name AS geology, c_mktsegment AS category, """ + ", ".join(f"nullif(round(100.0::DOUBLE * count(*) FILTER (left(o_orderpriority, 1) = '{i + 1}') / count(*), 6), 0) AS {c}" for i, c in enumerate(PCT)) + """, CAST(nullif(count(*), 1) AS DOUBLE) AS pixels
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2, 3)"""


def study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region, geology, category, C0_pct .. C3_pct, pixels): shares of the first four priorities among the orders of a region, nation and segment.

    With holes, as such tables have them: a share of nothing and the size of a single order are not known.
    """
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.left("o_orderpriority", F.lit(1)).alias("p"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("category"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("geology"), F.col("n_regionkey").alias("r_regionkey"))
    r = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("region"))
    own = o.join(c, "c_custkey").join(n, "n_nationkey").join(r, "r_regionkey")
    share = lambda i: F.nullif(F.round(100 * F.count(F.when(F.col("p") == str(i + 1), 1)) / F.count("*"), 6), F.lit(0.0))
    return own.groupBy("region", "geology", "category").agg(*[share(i).alias(c) for i, c in enumerate(PCT)], F.nullif(F.count("*"), F.lit(1)).cast("double").alias("pixels"))


@query("cross_region_means", f"WITH {STUDY_SQL} SELECT category, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in PCT) + " FROM study WHERE category <> '" + BASELINE + "' GROUP BY category")
def cross_region_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study(spark, sf_dir).where(F.col("category") != BASELINE).groupBy("category").agg(*[r6(F.avg(c)).alias(c) for c in PCT])


_G = "greatest(C0_pct, C1_pct, C2_pct, C3_pct)"


@query("dominant_cluster", f"WITH {STUDY_SQL} SELECT region, geology, CASE WHEN C0_pct = {_G} THEN 'C0' WHEN C1_pct = {_G} THEN 'C1' WHEN C2_pct = {_G} THEN 'C2' WHEN C3_pct = {_G} THEN 'C3' END AS dominant, {_G} AS purity FROM study")
def dominant_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, top = argmax([c.removesuffix("_pct") for c in PCT], [F.col(c) for c in PCT])
    return study(spark, sf_dir).select("region", "geology", name.alias("dominant"), top.alias("purity"))


@query("tessera_like_filter", f"WITH {STUDY_SQL} SELECT region, geology FROM study WHERE coalesce(contains(lower(geology), '{WORD}'), false) OR coalesce(contains(lower(category), '{CLASS}'), false)")
def tessera_like_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = lambda c, w: F.coalesce(F.lower(c).contains(w), F.lit(False))
    return study(spark, sf_dir).where(has("geology", WORD) | has("category", CLASS)).select("region", "geology")


@query("harmonise_union", f"WITH {STUDY_SQL} SELECT region, geology, 'study' AS source, pixels FROM study UNION ALL SELECT r_name, NULL, 'tables', CAST(count(*) AS DOUBLE) FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name")
def harmonise_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of different origin under one schema; what a table lacks is null."""
    a = study(spark, sf_dir).select("region", "geology", F.lit("study").alias("source"), "pixels")
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("region")).agg(F.count("*").cast("double").alias("pixels"))
    return a.unionByName(n.withColumn("source", F.lit("tables")), allowMissingColumns=True)


@query("figure_top_contexts", f"WITH {STUDY_SQL}, a AS (SELECT region, geology, {_G} AS purity FROM study WHERE category NOT IN ('{UNKNOWN}', '{BASELINE}') AND (pixels IS NULL OR pixels >= {LARGE})), b AS (SELECT region, geology, {_G} AS purity FROM study WHERE C0_pct IS NOT NULL AND C1_pct IS NOT NULL AND C2_pct IS NOT NULL AND C3_pct IS NOT NULL AND region = '{REGION}') SELECT region, geology, purity, region || ' — ' || geology AS label FROM (SELECT * FROM a UNION SELECT * FROM b) ORDER BY purity DESC, region, geology LIMIT 20")
def figure_top_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = study(spark, sf_dir).withColumn("purity", F.greatest(*PCT))
    a = s.where(~F.col("category").isin(UNKNOWN, BASELINE) & (F.col("pixels").isNull() | (F.col("pixels") >= LARGE)))
    b = s.dropna("any", subset=PCT).where(F.col("region") == REGION)
    both = a.select("region", "geology", "purity").unionByName(b.select("region", "geology", "purity")).distinct()
    return both.withColumn("label", F.concat(F.col("region"), F.lit(" — "), F.col("geology"))).orderBy(F.desc_nulls_last("purity"), "region", "geology").limit(20)


@query("key_associations", f"WITH {STUDY_SQL} SELECT region, geology, round(C0_pct / nullif(C0_pct + C1_pct + C2_pct + C3_pct, 0), 6) AS share0 FROM study WHERE pixels >= {LARGE}")
def key_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study(spark, sf_dir).where(F.col("pixels") >= LARGE).select("region", "geology", r6(ratio("C0_pct", F.col("C0_pct") + F.col("C1_pct") + F.col("C2_pct") + F.col("C3_pct"))).alias("share0"))


@query("harmonised_validation")
def harmonised_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of different layout in the canonical sixteen columns."""
    regions = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    counts = regions.groupBy(F.col("r_name").alias("Description")).agg(F.count("*").cast("string").alias("feature_pixels"), F.lit("12.5").alias("cluster_2_percentage"))
    return workflows.harmonised(study(spark, sf_dir), "study", "unit").unionByName(workflows.harmonised(counts, "tables", "category"))
