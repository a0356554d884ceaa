"""Counts, profiles, quantiles, histograms, correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.exprs import mapped, r6, ratio, valid
from gridloom.operators.profiles import DESCRIBE, long, profile, quantile_columns, quantiles, quantiles_by
from gridloom.registry import query
from gridloom.sources.tables import BANDS, cells, clusters, grid, items, table

FEATURES = ["quantity", "price", "discount", "tax", "size"]


def _union(one: str, names: list[str] = FEATURES) -> str:
    return " UNION ALL ".join(one.replace("{f}", f) for f in names)


@query("cluster_counts_zero_filled", """WITH k AS (SELECT CAST(unnest(range(5)) AS INTEGER) AS cluster), n AS (SELECT cluster, count(*) AS n FROM clusters WHERE cluster BETWEEN 0 AND 3 GROUP BY cluster)
    SELECT cluster, CAST(coalesce(n, 0) AS BIGINT) AS cells, round(100.0::DOUBLE * coalesce(n, 0) / (SELECT sum(n) FROM n), 6) AS pct FROM k LEFT JOIN n USING (cluster)""")
def cluster_counts_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = clusters(spark, sf_dir).where("cluster between 0 and 3").groupBy("cluster").agg(F.count("*").alias("cells"))
    k = spark.range(5).select(F.col("id").cast("int").alias("cluster"))
    all_ = k.join(n, "cluster", "left").withColumn("cells", F.coalesce("cells", F.lit(0)).cast("long"))
    return all_.withColumn("pct", r6(ratio(100 * F.col("cells"), F.sum("cells").over(Window.partitionBy()))))


@query("grid_validity_profile", "SELECT CAST(count(*) AS BIGINT) AS cells, CAST(count(radar) AS BIGINT) AS valid, CAST(count(*) - count(radar) AS BIGINT) AS nodata, round(100.0::DOUBLE * count(radar) / count(*), 6) AS valid_pct FROM grid")
def grid_validity_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, v = F.count("*"), F.count("radar")
    return grid(spark, sf_dir).agg(n.alias("cells"), v.alias("valid"), (n - v).alias("nodata"), r6(ratio(100 * v, n)).alias("valid_pct"))


@query("raster_inspect", _union("SELECT '{f}' AS band, CAST(count({f}) AS BIGINT) AS valid, CAST(min({f}) AS DOUBLE) AS lowest, CAST(max({f}) AS DOUBLE) AS highest, CAST(count(*) FILTER ({f} = 0) AS BIGINT) AS zeros, round(100.0::DOUBLE * count(*) FILTER ({f} = 0) / count({f}), 6) AS zero_pct FROM grid", BANDS))
def raster_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = lambda c: F.count(F.when(c == 0, 1))
    measures = {"valid": F.count, "lowest": lambda c: F.min(c).cast("double"), "highest": lambda c: F.max(c).cast("double"), "zeros": zero, "zero_pct": lambda c: r6(ratio(100 * zero(c), F.count(c)))}
    return profile(grid(spark, sf_dir), BANDS, measures).withColumnRenamed("feature", "band")


@query("value_counts_norm", "SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type")
def value_counts_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return n.withColumn("share", r6(ratio("n", F.sum("n").over(Window.partitionBy()))))


@query("group_stats", "SELECT event_type, round(avg(value), 6) AS mean, round(median(value), 6) AS middle, round(stddev_samp(value), 6) AS std FROM events GROUP BY event_type")
def group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", "value")
    middle = quantiles_by(e.withColumnRenamed("event_type", "feature"), [0.5]).select(F.col("feature").alias("of"), r6("value").alias("middle"))
    one = e.groupBy("event_type").agg(r6(F.avg("value")).alias("mean"), r6(F.stddev_samp("value")).alias("std"))
    return one.join(middle, F.col("event_type").eqNullSafe(F.col("of")), "left").select("event_type", "mean", "middle", "std")


@query("describe_exact", _union("SELECT '{f}' AS feature, CAST(count({f}) AS BIGINT) AS n, round(avg({f}), 8) AS mean, round(stddev_samp({f}), 6) AS std, min({f}) AS lowest, round(quantile_cont({f}, 0.25), 6) AS q25, round(quantile_cont({f}, 0.5), 6) AS q50, round(quantile_cont({f}, 0.75), 6) AS q75, max({f}) AS highest FROM items"))
def describe_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = items(spark, sf_dir)
    quarters = quantile_columns(df, FEATURES, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    one = profile(df, FEATURES, DESCRIBE).join(quarters, "feature")  # a row a feature
    return one.select("feature", "n", "mean", "std", "lowest", r6("q25").alias("q25"), r6("q50").alias("q50"), r6("q75").alias("q75"), "highest")


@query("quartiles_iqr", _union("SELECT '{f}' AS feature, round(quantile_cont({f}, 0.25), 6) AS q1, round(median({f}), 6) AS middle, round(quantile_cont({f}, 0.75), 6) AS q3, round(quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25), 6) AS iqr FROM items"))
def quartiles_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quantile_columns(items(spark, sf_dir), FEATURES, {"q1": 0.25, "middle": 0.5, "q3": 0.75})
    return q.select("feature", r6("q1").alias("q1"), r6("middle").alias("middle"), r6("q3").alias("q3"), r6(F.col("q3") - F.col("q1")).alias("iqr"))


@query("quantile_profile", _union("SELECT '{f}' AS feature, p / 10.0::DOUBLE AS p, round(q[p + 1], 6) AS value FROM (SELECT quantile_cont({f}, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM items), (SELECT unnest(range(11)) AS p)"))
def quantile_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles(items(spark, sf_dir), FEATURES, [i / 10 for i in range(11)]).select("feature", "p", r6("value").alias("value"))


@query("feature_quality", _union("SELECT '{f}' AS feature, CAST(count(*) - count({f}) AS BIGINT) AS missing, CAST(count(DISTINCT {f}) AS BIGINT) AS different, round(avg({f}), 6) AS mean, round(stddev_pop({f}), 6) AS std, CAST(min({f}) AS DOUBLE) AS lowest, CAST(max({f}) AS DOUBLE) AS highest, round((count(*) - count({f}))::DOUBLE / count(*), 6) AS missing_fraction FROM grid", BANDS))
def feature_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = lambda c: F.count("*") - F.count(c)
    return profile(
        grid(spark, sf_dir), BANDS,
        {"missing": missing, "different": F.count_distinct, "mean": lambda c: r6(F.avg(c)), "std": lambda c: r6(F.stddev_pop(c)), "lowest": lambda c: F.min(c).cast("double"), "highest": lambda c: F.max(c).cast("double"), "missing_fraction": lambda c: r6(ratio(missing(c), F.count("*")))},
    )


@query("quality_summary", f"WITH f AS ({_union('SELECT count(*) - count({f}) AS missing, stddev_pop({f}) AS std FROM grid', BANDS)}) SELECT CAST(count(*) FILTER (missing > 0) AS BIGINT) AS with_missing, CAST(count(*) FILTER (std = 0) AS BIGINT) AS constant FROM f")
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = profile(grid(spark, sf_dir), BANDS, {"missing": lambda c: F.count("*") - F.count(c), "std": F.stddev_pop})
    return f.agg(F.count(F.when(F.col("missing") > 0, 1)).alias("with_missing"), F.count(F.when(F.col("std") == 0, 1)).alias("constant"))


@query("correlation_long", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM grid" for a in BANDS for b in BANDS))
def correlation_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [(a, b) for a in BANDS for b in BANDS]
    one = grid(spark, sf_dir).agg(*[r6(F.corr(a, b)).alias(f"{a}__{b}") for a, b in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}__{b}").alias("r")) for a, b in pairs])).alias("s")).select("s.*")


@query("histogram_fixed", "WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT CAST(least(floor((value - lo) / ((hi - lo) / 40)), 39) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n FROM events, b GROUP BY 1")
def histogram_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty bins of equal width from the smallest to the largest value; the last is closed."""
    e = table(spark, sf_dir, "events").select("value")
    b = e.crossJoin(e.agg(F.min("value").alias("lo"), F.max("value").alias("hi")))  # one row of bounds
    return b.groupBy(F.least(F.floor((F.col("value") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 40)), F.lit(39)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query("histogram_edges", "SELECT CAST(least(floor((l_discount - 0.0) / 0.02::DOUBLE + 1e-9), 4) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_discount BETWEEN 0 AND 0.1 GROUP BY 1")
def histogram_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins between fixed edges, the last closed on the right; values outside do not count."""
    d = table(spark, sf_dir, "lineitem").where("l_discount between 0 and 0.1")
    return d.groupBy(F.least(F.floor(F.col("l_discount") / 0.02 + 1e-9), F.lit(4)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query("finite_check", "SELECT CAST(count(*) FILTER (value IS NULL OR NOT isfinite(value)) AS BIGINT) AS bad, count(*) FILTER (value IS NULL OR NOT isfinite(value)) = 0 AS all_finite FROM events")
def finite_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.count(F.when(valid("value").isNull(), 1))
    return table(spark, sf_dir, "events").agg(bad.alias("bad"), (bad == 0).alias("all_finite"))


@query("v1_validity_filter", """SELECT "row", col, radar FROM grid WHERE radar <> 0 AND height <> 100 AND least(slope - 1, 3) BETWEEN 0 AND 2""")
def v1_validity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir).where("radar <> 0 and height <> 100")
    return g.where(F.least(F.col("slope") - 1, F.lit(3)).between(0, 2)).select("row", "col", "radar")


@query("complete_case_filter", "SELECT CAST(count(*) AS BIGINT) AS cells, CAST(count(*) FILTER (radar IS NOT NULL OR height IS NOT NULL) AS BIGINT) AS any_valid, CAST(count(*) FILTER (radar IS NOT NULL AND height IS NOT NULL) AS BIGINT) AS all_valid FROM grid")
def complete_case_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    none, some = g["radar"].isNotNull() | g["height"].isNotNull(), g["radar"].isNotNull() & g["height"].isNotNull()
    return g.agg(F.count("*").alias("cells"), F.count(F.when(none, 1)).alias("any_valid"), F.count(F.when(some, 1)).alias("all_valid"))


@query("negated_membership_null_safe", """SELECT "row", col, cluster FROM clusters WHERE cluster NOT IN (1, 2) OR cluster IS NULL""")
def negated_membership_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(spark, sf_dir).where(~F.col("cluster").isin(1, 2) | F.col("cluster").isNull())


@query("numeric_coerce", "SELECT CAST(count(*) AS BIGINT) AS rows_in, CAST(count(TRY_CAST(substr(c_name, 10) AS DOUBLE)) AS BIGINT) AS numbers, CAST(sum(coalesce(TRY_CAST(c_mktsegment AS DOUBLE), 0)) AS DOUBLE) AS coerced FROM customer")
def numeric_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    number = F.substring("c_name", 10, 100).try_cast("double")
    return c.agg(F.count("*").alias("rows_in"), F.count(number).alias("numbers"), F.sum(F.coalesce(F.col("c_mktsegment").try_cast("double"), F.lit(0.0))).alias("coerced"))


@query("label_strings", "SELECT n_nationkey, trim(n_name) || ' — ' || lower(r_name) AS label, replace('C' || (n_regionkey % 4) || '_pct', '_pct', '') AS cluster_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def label_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    name = F.concat(F.lit("C"), (F.col("n_regionkey") % 4).cast("string"), F.lit("_pct"))
    return n.select("n_nationkey", F.concat_ws(" — ", F.trim("n_name"), F.lower("r_name")).alias("label"), F.replace(name, F.lit("_pct"), F.lit("")).alias("cluster_name"))


# A small table of codes; the second entry of a code repeated in the original list is the one that counts.
CODES = {0: "plain", 1: "highland", 2: "corona", 3: "impact crater"}


@query("code_category_map", "SELECT r_regionkey, CASE r_regionkey WHEN 0 THEN 'plain' WHEN 1 THEN 'highland' WHEN 2 THEN 'corona' WHEN 3 THEN 'impact crater' END AS category, coalesce(CASE r_regionkey WHEN 0 THEN 'plain' WHEN 1 THEN 'highland' WHEN 2 THEN 'corona' WHEN 3 THEN 'impact crater' END, 'Unknown') AS shown FROM region")
def code_category_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = mapped("r_regionkey", CODES)
    return table(spark, sf_dir, "region").select("r_regionkey", category.alias("category"), F.coalesce(category, F.lit("Unknown")).alias("shown"))


@query("unknown_codes", "SELECT DISTINCT r_regionkey AS code FROM region WHERE r_regionkey NOT IN (0, 1, 2, 3)")
def unknown_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([(k,) for k in CODES], "code int")
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("code")).distinct().join(known, "code", "left_anti")


@query("code_anti_semi", "SELECT 'with orders' AS kind, CAST(count(*) AS BIGINT) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'without orders', CAST(count(*) AS BIGINT) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def code_anti_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    kind = lambda how, name: c.join(o, "c_custkey", how).agg(F.lit(name).alias("kind"), F.count("*").alias("n"))
    return kind("left_semi", "with orders").unionByName(kind("left_anti", "without orders"))


@query("vector_profile_topk", "WITH v AS (SELECT 'c_mktsegment' AS name, c_mktsegment AS v FROM customer WHERE c_mktsegment IS NOT NULL UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_nationkey IS NOT NULL) SELECT name, v AS val, CAST(n AS BIGINT) AS n FROM (SELECT name, v, count(*) AS n, row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, v) AS i FROM v GROUP BY 1, 2) WHERE i <= 20")
def vector_profile_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty most frequent values of each attribute, as text."""
    names = ["c_mktsegment", "c_nationkey"]
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("val")) for n in names]))
    n = table(spark, sf_dir, "customer").select(pairs.alias("s")).select("s.*").where("val is not null").groupBy("name", "val").agg(F.count("*").alias("n"))
    best = Window.partitionBy("name").orderBy(F.desc("n"), "val")
    return n.withColumn("i", F.row_number().over(best)).where("i <= 20").drop("i")


@query("distinct_value_counts", "SELECT CAST(count(DISTINCT event_type) AS BIGINT) AS types, CAST(count(DISTINCT user_id) AS BIGINT) AS users FROM events")
def distinct_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").agg(F.count_distinct("event_type").alias("types"), F.count_distinct("user_id").alias("users"))


@query("metric_summary", "SELECT min(o_totalprice) AS lowest, round(avg(o_totalprice), 6) AS mean, round(median(o_totalprice), 6) AS middle, max(o_totalprice) AS highest FROM orders")
def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_totalprice")
    middle = quantiles(o, ["o_totalprice"], [0.5]).select(r6("value").alias("middle"))
    one = o.agg(F.min("o_totalprice").alias("lowest"), r6(F.avg("o_totalprice")).alias("mean"), F.max("o_totalprice").alias("highest"))
    return one.join(middle, F.lit(True), "left").select("lowest", "mean", "middle", "highest")  # one row each


@query("ambiguous_fraction", "SELECT round(avg(CAST(l_discount > 0.05 AS DOUBLE)), 6) AS fraction FROM lineitem")
def ambiguous_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").agg(r6(F.avg((F.col("l_discount") > 0.05).cast("double"))).alias("fraction"))


@query("cluster_size_shares", "WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT round(100.0::DOUBLE * max(n) / sum(n), 6) AS largest_pct, CAST(count(*) FILTER (n >= 0.01 * (SELECT sum(n) FROM n)) AS BIGINT) AS substantial FROM n")
def cluster_size_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n")).withColumn("all", F.sum("n").over(Window.partitionBy()))
    return n.agg(r6(ratio(100 * F.max("n"), F.max("all"))).alias("largest_pct"), F.count(F.when(F.col("n") >= 0.01 * F.col("all"), 1)).alias("substantial"))


@query("cumulative_share", "WITH n AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type) SELECT event_type, round(sum(n) OVER (ORDER BY n DESC, event_type ROWS UNBOUNDED PRECEDING)::DOUBLE / sum(n) OVER (), 6) AS share FROM n")
def cumulative_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))  # one row a type
    upto = Window.orderBy(F.desc("n"), "event_type").rowsBetween(Window.unboundedPreceding, 0)
    return n.select("event_type", r6(ratio(F.sum("n").over(upto), F.sum("n").over(Window.partitionBy()))).alias("share"))


@query("row_total_lookup", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_orderkey), 6) AS share FROM lineitem")
def row_total_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.sum("l_extendedprice").over(Window.partitionBy("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(F.col("l_extendedprice") / total).alias("share"))


@query("mixed_direction_sort_limit", "SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 30")
def mixed_direction_sort_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice").orderBy("o_orderpriority", F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(30)


@query("distinct_pairs", "WITH t AS (SELECT DISTINCT event_type AS t FROM events) SELECT a.t AS a, b.t AS b FROM t a JOIN t b ON a.t < b.t")
def distinct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").select(F.col("event_type").alias("a")).distinct()
    return t.join(t.select(F.col("a").alias("b")), F.col("a") < F.col("b"))


@query("long_values", "SELECT feature, CAST(count(value) AS BIGINT) AS n, round(sum(value), 3) AS total FROM (SELECT 'quantity' AS feature, quantity AS value FROM items UNION ALL SELECT 'size', size FROM items) GROUP BY feature")
def long_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(items(spark, sf_dir), ["quantity", "size"]).groupBy("feature").agg(F.count("value").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query("layer_listing", "SELECT table_name AS layer, column_name AS field FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer')")
def layer_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layers of a catalog and their fields; the driver's tables stand for a database of layers."""
    rows = []
    for name in ("region", "nation", "customer"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"layer_{name}")
        rows += [(name, c.name) for c in spark.catalog.listColumns(f"layer_{name}")]  # metadata only
        spark.catalog.dropTempView(f"layer_{name}")
    return spark.createDataFrame(rows, "layer string, field string")


@query("top_anomalies", """SELECT "row", col, round(s, 6) AS score FROM (SELECT "row", col, abs(height - avg(height) OVER ()) AS s FROM cells) ORDER BY s DESC, "row", col LIMIT 2500""")
def top_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,500 cells whose height is farthest from the mean."""
    c = cells(spark, sf_dir)
    mean = F.broadcast(c.agg(F.avg("height").alias("m")))  # one row
    return highest(c.crossJoin(mean).withColumn("score", F.abs(F.col("height") - F.col("m"))), "score").select("row", "col", r6("score").alias("score"))


def highest(df: DataFrame, score: str, n: int = 2_500) -> DataFrame:
    """The ``n`` rows of highest score with their row and col; without coordinates there is nothing to show and no row comes back."""
    return df.orderBy(F.desc(score), "row", "col").limit(n) if {"row", "col"} <= set(df.columns) else df.limit(0)
