"""Scaling, assignment, uncertainty, ranking, agreement and fitted models."""

from __future__ import annotations

import math

from dataclasses import replace

from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.exprs import entropy, id_hash, ordinal, r6, ratio, reference_share, softmax
from gridloom.functions.graphs import cut
from gridloom.operators import density, metrics, models
from gridloom.operators.profiles import quantiles
from gridloom.operators.samples import exact_sample
from gridloom.plans import workflows
from gridloom.registry import query
from gridloom.sources.files import Config
from gridloom.sources.tables import COLUMNS_WIDE, grid, items, table, vectors

DIMS = 5
#: Starting centres: axis-wise corners of the feature space.
CENTRES = [[0.1, 0.1, 0.0, 0.0, 0.0], [-0.1, 0.1, 0.0, 0.0, 0.0], [0.1, -0.1, 0.0, 0.0, 0.0], [-0.1, -0.1, 0.0, 0.0, 0.0]]
FEATURES = ["quantity", "price", "discount", "tax", "size"]

_D = ", ".join(f"sqrt(list_sum(list_transform(range(1, 6), lambda i: (x[i] - ({c!r}::DOUBLE[])[i]) * (x[i] - ({c!r}::DOUBLE[])[i]))))" for c in CENTRES)
DIST = f"dist AS (SELECT id, label, x, [{_D}] AS d FROM vec), near AS (SELECT *, list_position(d, list_min(d)) - 1 AS cluster, list_sort(d)[1] AS d1, list_sort(d)[2] AS d2 FROM dist)"


def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, x, d: distances to the centres, cluster, d1, d2)."""
    return workflows.distances(vectors(spark, sf_dir, DIMS), CENTRES)


@query("scaler_params", " UNION ALL ".join(f"SELECT '{f}' AS feature, round(avg({f}), 8) AS mean, round(CASE WHEN stddev_pop({f}) = 0 THEN 1 ELSE stddev_pop({f}) END, 6) AS scale FROM items" for f in FEATURES))
def scaler_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.operators.profiles import profile

    std = lambda c: r6(F.when(F.stddev_pop(c) == 0, 1.0).otherwise(F.stddev_pop(c)))
    return profile(items(spark, sf_dir), FEATURES, {"mean": lambda c: F.round(F.avg(c), 8), "scale": std})


KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("standardize", f"SELECT {', '.join(KEYS)}, " + ", ".join(f"round(({f} - avg({f}) OVER ()) / (CASE WHEN stddev_pop({f}) OVER () = 0 THEN 1 ELSE stddev_pop({f}) OVER () END), 6) AS z_{f}" for f in FEATURES) + " FROM items")
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns by their own scaler's rows."""
    i = items(spark, sf_dir)
    return models.scaled_columns(i, models.scaler(i, FEATURES), FEATURES).select(*KEYS, *[r6(f).alias(f"z_{f}") for f in FEATURES])


@query("inverse_standardize", f"SELECT {', '.join(KEYS)}, " + ", ".join(f"round({f}, 6) AS {f}" for f in FEATURES) + " FROM items")
def inverse_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """There and back over one scaler: the columns themselves."""
    i = items(spark, sf_dir)
    scaler = cut(models.scaler(i, FEATURES))
    back = models.scaled_columns(models.scaled_columns(i, scaler, FEATURES), scaler, FEATURES, inverse=True)
    return back.select(*KEYS, *[r6(f).alias(f) for f in FEATURES])


_SCALES = " UNION ALL ".join(f"SELECT '{f}' AS f, stddev_pop({f}) AS s FROM items" for f in FEATURES)
_APART = " + ".join(f"power((i.{f} - c.{f}) / (SELECT s FROM p WHERE f = '{f}'), 2)" for f in FEATURES)


@query("persisted_model", f"""WITH p AS ({_SCALES}), c AS (SELECT l_linenumber % 4 AS cluster, {", ".join(f"avg({f}) AS {f}" for f in FEATURES)} FROM items GROUP BY 1),
    d AS (SELECT {", ".join("i." + k for k in KEYS)}, sqrt({_APART}) AS d FROM items i, c) SELECT {", ".join(KEYS)}, round(min(d), 6) AS nearest FROM d GROUP BY {", ".join(KEYS)}""")
def persisted_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaler and centres written as tables, read again by name, and applied: distance to the nearest centre."""
    i = items(spark, sf_dir)
    scaler = cut(models.scaler(i, FEATURES).select("scale", "mean", "feature"))
    centres = cut(i.groupBy((F.col("l_linenumber") % 4).cast("int").alias("cluster")).agg(*[F.avg(f).alias(f) for f in reversed(FEATURES)]))
    keyed = i.withColumn("id", F.xxhash64(*KEYS))
    found = workflows.predicted(keyed, scaler, centres, FEATURES).groupBy("id").agg(F.min("d1").alias("d1"))
    return keyed.select(*KEYS, "id").distinct().join(found, "id").select(*KEYS, r6("d1").alias("nearest"))


@query("assign_centroids", f"WITH {DIST} SELECT id, CAST(cluster AS INTEGER) AS cluster, round(d1, 6) AS distance FROM near")
def assign_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distances(spark, sf_dir).select("id", "cluster", r6("d1").alias("distance"))


_P = "list_transform(d, lambda v: exp(-(v - list_min(d))))"
SOFT = f"soft AS (SELECT *, list_transform({_P}, lambda v: v / list_sum({_P})) AS p FROM near)"
_H = "(-list_sum(list_transform(p, lambda v: v * ln(greatest(v, 1e-12)))) / ln(4.0::DOUBLE))"


@query("distance_uncertainty", f"WITH {DIST}, {SOFT} SELECT id, CAST(cluster AS INTEGER) AS cluster, round(d1, 6) AS nearest, round(d2, 6) AS second, round(d2 - d1, 6) AS margin, round(1 - {_H}, 6) AS confidence, round({_H}, 6) AS entropy FROM soft")
def distance_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = distances(spark, sf_dir).withColumn("p", softmax(F.col("d")))
    h = entropy(F.col("p"), 4)
    return d.select("id", "cluster", r6("d1").alias("nearest"), r6("d2").alias("second"), r6(F.col("d2") - F.col("d1")).alias("margin"), r6(1 - h).alias("confidence"), r6(h).alias("entropy"))


@query("softmax_entropy", f"WITH {DIST}, {SOFT} SELECT id, round(p[1], 6) AS p0, round(p[2], 6) AS p1, round(p[3], 6) AS p2, round(p[4], 6) AS p3 FROM soft")
def softmax_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = distances(spark, sf_dir).withColumn("p", softmax(F.col("d")))
    return d.select("id", *[r6(F.col("p")[i]).alias(f"p{i}") for i in range(4)])


@query("percentile_rank_stable", "SELECT event_id, round((row_number() OVER (ORDER BY value, event_id) - 1)::DOUBLE / greatest(count(*) OVER () - 1, 1), 6) AS rank FROM events")
def percentile_rank_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinal rank over n - 1, ties by id; no window over all rows."""
    e = table(spark, sf_dir, "events").select("event_id", "value")
    n = e.agg(F.count("*").alias("n"))
    return ordinal(e, [F.col("value"), F.col("event_id")]).crossJoin(F.broadcast(n)).select("event_id", r6(ratio(F.col("ordinal") - 1, F.greatest(F.col("n") - 1, F.lit(1)))).alias("rank"))  # one row


@query("ecdf_reference", "SELECT event_id, round(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::DOUBLE / (SELECT count(*) FROM events WHERE event_type = 'click'), 6) AS share FROM events")
def ecdf_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the values of one kind of event at or below each event's value."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return reference_share(e, e.where("event_type = 'click'"), "value", "share").select("event_id", r6("share").alias("share"))


@query("anomaly_rank_centroid", f"WITH {DIST} SELECT id, round((row_number() OVER (ORDER BY round(d1, 9), id) - 1)::DOUBLE / greatest(count(*) OVER () - 1, 1), 6) AS centroid_percentile FROM near")
def anomaly_rank_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = distances(spark, sf_dir).select("id", F.round("d1", 9).alias("d1"))
    n = F.broadcast(d.agg(F.count("*").alias("n")))
    return ordinal(d, [F.col("d1"), F.col("id")]).crossJoin(n).select("id", r6(ratio(F.col("ordinal") - 1, F.greatest(F.col("n") - 1, F.lit(1)))).alias("centroid_percentile"))


@query("contingency", f"WITH {DIST} SELECT CAST(label % 4 AS INTEGER) AS a, CAST(cluster AS INTEGER) AS b, CAST(count(*) AS BIGINT) AS n FROM near GROUP BY 1, 2")
def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = distances(spark, sf_dir).select((F.col("label") % 4).cast("int").alias("l"), "cluster")
    return metrics.contingency(d, "l", "cluster")


TABLE = "t AS (SELECT l_suppkey % 4 AS a, l_partkey % 4 AS b, count(*) AS n FROM lineitem GROUP BY 1, 2)"


def supplier_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 4).cast("int").alias("s"), (F.col("l_partkey") % 4).cast("int").alias("p"))
    return metrics.contingency(d, "s", "p")


@query("ari_pairs", f"""WITH {TABLE}, s AS (SELECT sum(n * (n - 1) / 2.0::DOUBLE) AS s, sum(n) AS al FROM t), r AS (SELECT sum(n * (n - 1) / 2.0::DOUBLE) AS ra FROM (SELECT a, sum(n) AS n FROM t GROUP BY a)), c AS (SELECT sum(n * (n - 1) / 2.0::DOUBLE) AS cb FROM (SELECT b, sum(n) AS n FROM t GROUP BY b))
    SELECT round((s - ra * cb / (al * (al - 1) / 2.0::DOUBLE)) / ((ra + cb) / 2 - ra * cb / (al * (al - 1) / 2.0::DOUBLE)), 9) AS ari FROM s, r, c""")
def ari_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.adjusted_rand(supplier_part(spark, sf_dir)).select(F.round("ari", 9).alias("ari"))


@query("hungarian_align", f"""WITH {TABLE}, p AS (SELECT w, x, y, z FROM (SELECT unnest(range(4)) AS w), (SELECT unnest(range(4)) AS x), (SELECT unnest(range(4)) AS y), (SELECT unnest(range(4)) AS z) WHERE w <> x AND w <> y AND w <> z AND x <> y AND x <> z AND y <> z),
    scored AS (SELECT w, x, y, z, sum(CASE WHEN (a = 0 AND b = w) OR (a = 1 AND b = x) OR (a = 2 AND b = y) OR (a = 3 AND b = z) THEN n ELSE 0 END) AS score FROM p, t GROUP BY 1, 2, 3, 4),
    best AS (SELECT [w, x, y, z] AS q FROM scored ORDER BY score DESC, w, x, y, z LIMIT 1)
    SELECT CAST(unnest(q) AS INTEGER) AS candidate, CAST(unnest(range(4)) AS INTEGER) AS reference FROM best""")
def hungarian_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.aligned(supplier_part(spark, sf_dir), 4).select("candidate", "reference")


VOTES = "v AS (SELECT event_id, [user_id % 4, CAST(round(value * 100) AS BIGINT) % 4, event_id % 4, (user_id + event_id) % 4] AS l FROM events), n AS (SELECT event_id, list_transform(range(4), lambda c: len(list_filter(l, lambda y: y = c))) AS n FROM v)"


@query("consensus_vote", f"""WITH {VOTES} SELECT event_id, CAST(list_position(n, list_max(n)) - 1 AS INTEGER) AS consensus, list_max(n) / 4.0::DOUBLE AS agreement, round(-list_sum(list_transform(n, lambda k: (k / 4.0::DOUBLE) * ln(greatest(k / 4.0::DOUBLE, 1e-12)))) / ln(4.0::DOUBLE), 6) + 0.0 AS entropy FROM n""")
def consensus_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Majority of four labels (lowest on ties), agreement and normalised entropy."""
    e = table(spark, sf_dir, "events")
    labels = F.array(*[(c % 4).cast("int") for c in (F.col("user_id"), F.round(F.col("value") * 100).cast("long"), F.col("event_id"), F.col("user_id") + F.col("event_id"))])
    v = e.select("event_id", labels.alias("l")).withColumn("n", metrics.votes(F.col("l"), 4))
    share = F.transform("n", lambda k: k / F.lit(4.0))
    return v.select("event_id", (F.array_position("n", F.array_max("n")) - 1).cast("int").alias("consensus"), (F.array_max("n") / 4.0).alias("agreement"), (r6(entropy(share, 4)) + F.lit(0.0)).alias("entropy"))


@query("inertia", f"WITH {DIST} SELECT round(sum(d1 * d1), 6) AS inertia FROM near")
def inertia(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distances(spark, sf_dir).agg(r6(F.sum(F.col("d1") * F.col("d1"))).alias("inertia"))


_C = ", ".join(f"avg(x[{i}])" for i in range(1, 6))
_dist = lambda a, b: f"sqrt(list_sum(list_transform(range(1, 6), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i]))))"


@query("davies_bouldin", f"""WITH {DIST}, c AS (SELECT cluster, [{_C}] AS m FROM near GROUP BY cluster), s AS (SELECT cluster, avg({_dist("x", "m")}) AS s, any_value(m) AS m FROM near JOIN c USING (cluster) GROUP BY cluster),
    r AS (SELECT a.cluster, max((a.s + b.s) / {_dist("a.m", "b.m")}) AS r FROM s a JOIN s b ON a.cluster <> b.cluster GROUP BY a.cluster) SELECT round(avg(r), 6) AS davies_bouldin FROM r""")
def davies_bouldin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.davies_bouldin(distances(spark, sf_dir), "cluster", "x", DIMS).select(r6("davies_bouldin").alias("davies_bouldin"))


@query("silhouette_sample", f"""WITH {DIST}, m AS (SELECT a.id, a.cluster AS ca, b.cluster AS cb, avg({_dist("a.x", "b.x")}) AS d FROM near a JOIN near b ON a.id <> b.id GROUP BY 1, 2, 3),
    q AS (SELECT id, max(CASE WHEN ca = cb THEN d END) AS a, min(CASE WHEN ca <> cb THEN d END) AS b FROM m GROUP BY id) SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM q""")
def silhouette_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 2,000 rows, each against all; here they are all rows."""
    return metrics.silhouette(distances(spark, sf_dir), "cluster", "x").select(r6("silhouette").alias("silhouette"))


_AT = "[0.5, 0.75, 0.9, 0.95, 0.99, 1.0]"


@query("knn_kdist", f"""WITH {DIST}, r AS (SELECT a.id, {_dist("a.x", "b.x")} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {_dist("a.x", "b.x")}, b.id) AS k FROM near a JOIN near b ON true),
    q AS (SELECT quantile_cont(d, {_AT}) AS q FROM r WHERE k = 10) SELECT unnest({_AT}::DOUBLE[]) AS p, round(unnest(q), 6) AS value FROM q""")
def knn_kdist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of all rows' distance to their tenth neighbour (the row itself is the first)."""
    d = density.kth_distances(distances(spark, sf_dir).select("id", "x"), 10)
    return quantiles(d, ["distance"], [0.5, 0.75, 0.9, 0.95, 0.99, 1.0]).select("p", r6("value").alias("value"))


@query("dbscan_core_points", f"WITH n AS (SELECT a.id, count(*) AS n FROM vec a JOIN vec b ON {_dist('a.x', 'b.x')} <= 0.2 GROUP BY a.id) SELECT id, CAST(n AS BIGINT) AS n FROM n WHERE n >= 10")
def dbscan_core_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir, DIMS).select("id", "x")
    return density.core_counts(v, 0.2, 10, DIMS)


@query("lloyd_fixed_iters", f"""WITH {DIST}, c1 AS (SELECT cluster, [{_C}] AS m FROM near GROUP BY cluster), a2 AS (SELECT id, any_value(x) AS x, arg_min(c1.cluster, ({_dist("x", "m")}, c1.cluster)) AS cluster FROM vec, c1 GROUP BY id),
    c2 AS (SELECT cluster, count(*) AS n, [{_C}] AS m FROM a2 GROUP BY cluster) SELECT CAST(cluster AS INTEGER) AS cluster, {", ".join(f"round(m[{i + 1}], 6) AS x{i}" for i in range(DIMS))} FROM c2""")
def lloyd_fixed_iters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two steps from fixed centres."""
    c = models.lloyd(vectors(spark, sf_dir, DIMS), CENTRES, 2)
    return spark.createDataFrame([(i, *(round(x, 6) for x in v)) for i, v in enumerate(c)], "cluster int, " + ", ".join(f"x{i} double" for i in range(DIMS)))


#: What the named queries below run with; the workflows' own defaults are those of ``Config``.
SMALL = Config(kmeans_n_init=2, kmeans_max_iter=50, gmm_n_init=1, gmm_max_iter=50, isolation_estimators=100, minibatch_batch_size=256)


def scaled(spark: SparkSession, sf_dir: str, dims: int = 17) -> DataFrame:
    return models.standardised(vectors(spark, sf_dir, dims), dims)


@query("dbscan_full")
def dbscan_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.dbscan(vectors(spark, sf_dir, DIMS), 0.2, 10, DIMS)


@query("dbscan_sweep")
def dbscan_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide radii over standardised features, and quality of what is no noise."""
    return workflows.density_sweep(cut(scaled(spark, sf_dir, DIMS)), workflows.WIDE_RADII, DIMS)


@query("dbscan_compare")
def dbscan_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The narrow radii."""
    return workflows.density_sweep(cut(scaled(spark, sf_dir, DIMS)), workflows.NARROW_RADII, DIMS)


@query("kmeans_mllib")
def kmeans_mllib(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = scaled(spark, sf_dir)
    return workflows.fitted(v, SMALL).transform(models.with_vector(v)).select("id", F.col("prediction").alias("cluster"))


@query("kmeans_k2_profile")
def kmeans_k2_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two clusters of the standardised features; sizes, and centres in the features' own units."""
    v = vectors(spark, sf_dir, DIMS)
    z = models.standardised(v, DIMS)
    named = workflows.fitted(z, replace(SMALL, k=2)).transform(models.with_vector(z)).select("id", F.col("prediction").alias("cluster"))
    return v.join(named, "id").groupBy("cluster").agg(F.count("*").alias("n"), *[r6(F.avg(F.col("x")[i])).alias(f"x{i}") for i in range(DIMS)])


@query("kmeans_sweep")
def kmeans_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inertia, silhouette and Davies-Bouldin for 2 to 10 clusters, and which number each of the two prefers (one start each here)."""
    return workflows.k_sweep(cut(scaled(spark, sf_dir, DIMS)), DIMS, starts=1, rounds=30)


def runs_over_seeds(spark: SparkSession, sf_dir: str):
    return workflows.stability(cut(scaled(spark, sf_dir, DIMS)), SMALL)


@query("kmeans_stability")
def kmeans_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjusted Rand index of the 45 pairs of ten seeds' labels."""
    return runs_over_seeds(spark, sf_dir)[1]


@query("stability_inertia_series")
def stability_inertia_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inertia, cluster sizes and shares of each seed's run."""
    return runs_over_seeds(spark, sf_dir)[0]


@query("stability_centroids")
def stability_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_over_seeds(spark, sf_dir)[2]


@query("stability_verdict")
def stability_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mean and the least agreement with the run of seed 42 say."""
    a = runs_over_seeds(spark, sf_dir)[1].where("seed_a = 42 or seed_b = 42").agg(F.avg("ari").alias("mean_ari"), F.min("ari").alias("least_ari"))
    return a.withColumn("verdict", metrics.stability_verdict(F.col("mean_ari"), F.col("least_ari")))


@query("gmm")
def gmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = scaled(spark, sf_dir, DIMS)
    m = models.mixture(v, 4, SMALL.seeds(SMALL.gmm_n_init), SMALL.gmm_max_iter)
    bic, aic = models.information(m.summary.logLikelihood, v.count(), 4, DIMS)
    return m.transform(models.with_vector(v)).groupBy(F.col("prediction").alias("cluster")).agg(F.count("*").alias("n")).withColumns({"bic": F.lit(bic), "aic": F.lit(aic)})


@query("model_comparison")
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-means, mixture and Ward (of at most 3,000 rows) side by side, each with the quality of its labels."""
    v = cut(scaled(spark, sf_dir, DIMS))
    data, sample = models.with_vector(v), exact_sample(v.select("id", "x"), id_hash("id"), WARD_ROWS)
    a, b = workflows.fitted(v, SMALL), models.mixture(v, 4, SMALL.seeds(SMALL.gmm_n_init), SMALL.gmm_max_iter)
    labels = {"kmeans": a.transform(data).withColumnRenamed("prediction", "cluster"), "gmm": b.transform(data).withColumnRenamed("prediction", "cluster"), "ward": models.ward(sample, 4).join(sample, "id")}
    bic, aic = models.information(b.summary.logLikelihood, v.count(), 4, DIMS)
    more = {"kmeans": (float(a.summary.trainingCost), None, None), "gmm": (None, bic, aic), "ward": (None, None, None)}
    rows = []
    for name, df in labels.items():
        df = cut(df.select("id", "x", F.col("cluster").cast("int").alias("cluster")))
        rows.append((name, df.count(), metrics.silhouette(df, "cluster", "x").first()[0], metrics.davies_bouldin(df, "cluster", "x", DIMS).first()[0], *more[name]))
    return spark.createDataFrame(rows, "model string, samples long, silhouette double, davies_bouldin double, inertia double, bic double, aic double")


def principal(spark: SparkSession, sf_dir: str):
    data = models.with_vector(scaled(spark, sf_dir))
    return PCA(k=5, inputCol="features", outputCol="p").fit(data), data


@query("pca_variance")
def pca_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratios = [float(x) for x in principal(spark, sf_dir)[0].explainedVariance]
    return spark.createDataFrame([(i + 1, r, sum(ratios[: i + 1])) for i, r in enumerate(ratios)], "component int, ratio double, cumulative double")


@query("pca_loadings")
def pca_loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(component, feature, loading); of each component the largest loading is positive, for the sign is arbitrary."""
    pc = principal(spark, sf_dir)[0].pc.toArray()
    pc = pc * [1 if abs(c.max()) >= abs(c.min()) else -1 for c in pc.T]
    return spark.createDataFrame([(j + 1, i, float(pc[i, j])) for j in range(pc.shape[1]) for i in range(pc.shape[0])], "component int, feature int, loading double")


@query("pca_scores")
def pca_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's first two components and its cluster of two."""
    m, data = principal(spark, sf_dir)
    two = workflows.fitted(scaled(spark, sf_dir), replace(SMALL, k=2)).transform(data).select("id", F.col("prediction").alias("cluster"))
    return m.transform(data).withColumn("p", vector_to_array("p")).select("id", r6(F.col("p")[0]).alias("pc1"), r6(F.col("p")[1]).alias("pc2")).join(two, "id")


@query("diagnostics_summary")
def diagnostics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with missing values, constant features, and what one and two components explain."""
    from gridloom.plans.statistics import quality_summary

    ratios = [float(x) for x in principal(spark, sf_dir)[0].explainedVariance]
    return quality_summary(spark, sf_dir).withColumns({"pc1": F.lit(ratios[0]), "pc1_pc2": F.lit(ratios[0] + ratios[1])})


@query("minibatch_kmeans")
def minibatch_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir, DIMS)
    return models.assigned(v, models.minibatch(v, CENTRES, SMALL.minibatch_batch_size, 10)).groupBy("cluster").agg(F.count("*").alias("n"), F.sum("d2").alias("inertia"))


@query("birch")
def birch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.birch(scaled(spark, sf_dir, DIMS), 0.5, 4).groupBy("cluster").agg(F.count("*").alias("n"))


#: Rows Ward's method is run on at most.
WARD_ROWS = 3_000


def for_ward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_sample(distances(spark, sf_dir).select("id", "x"), id_hash("id"), WARD_ROWS)


@query("ward")
def ward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.ward(for_ward(spark, sf_dir), 4).groupBy("cluster").agg(F.count("*").alias("n"))


@query("kmeans_vs_ward")
def kmeans_vs_ward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both labels of each row of Ward's sample, and how far they agree."""
    s = cut(for_ward(spark, sf_dir))
    k = workflows.fitted(s, SMALL).transform(models.with_vector(s)).select("id", F.col("prediction").alias("kmeans"))
    both = cut(models.ward(s, 4).withColumnRenamed("cluster", "ward").join(k, "id"))
    return both.crossJoin(F.broadcast(metrics.adjusted_rand(metrics.contingency(both, "ward", "kmeans"))))  # one row


@query("isolation_forest")
def isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.isolation_scores(vectors(spark, sf_dir, 17), SMALL.isolation_estimators).select("id", r6("isolation").alias("isolation"))


def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflows.anomalies(vectors(spark, sf_dir, DIMS), CENTRES, SMALL)


@query("anomaly_combined")
def anomaly_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomalies(spark, sf_dir).select("id", "cluster", r6("centroid_percentile").alias("centroid_percentile"), r6("isolation_percentile").alias("isolation_percentile"), r6("combined").alias("combined"), "outlier").orderBy(F.desc("combined"), "id")


@query("consensus_4_models")
def consensus_4_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four models' labels, raw and aligned to the first, with majority, agreement and vote entropy."""
    return workflows.consensus(cut(scaled(spark, sf_dir, DIMS)), SMALL)[0]


@query("consensus_pairwise")
def consensus_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjusted Rand index of each pair of the four models."""
    return workflows.consensus(cut(scaled(spark, sf_dir, DIMS)), SMALL)[1].withColumnsRenamed({"a": "model_a", "b": "model_b"})


@query("fitted_uncertainty")
def fitted_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncertainty of all rows from a model fitted on the standardised features."""
    v = cut(scaled(spark, sf_dir))
    u = workflows.uncertainty(v, workflows.centres_of(workflows.fitted(v, SMALL)))
    return u.select("id", "cluster", *[r6(c).alias(c) for c in ("nearest", "second", "margin", "confidence", "entropy")], *[r6(F.col("p")[i]).alias(f"p_cluster_{i}") for i in range(4)])


@query("full_map_scores")
def full_map_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid cells scored on all 17 features: cluster, confidence, and the mean share of a sample's centre distances and isolation values at or below each cell's."""
    m = workflows.full_map(grid(spark, sf_dir), SMALL, 2025.0, 2025.0, COLUMNS_WIDE)
    return m.select("id", "cluster", r6("confidence").alias("confidence"), r6("anomaly").alias("anomaly"))


#: Models that are compared: the first two, three and four of the starting centres.
KS = (2, 3, 4)
_MODELS = f"""{DIST}, s AS (SELECT k, list_sort(d[1 : k]) AS e FROM dist, (SELECT unnest([2, 3, 4]) AS k)), q AS (SELECT CAST(k AS INTEGER) AS k, count(*) AS n, sum(e[1] * e[1]) AS inertia, round(avg(CASE WHEN e[2] > 0 THEN (e[2] - e[1]) / e[2] ELSE 0 END), 6) AS silhouette, round(avg(e[1]), 6) AS spread FROM s GROUP BY k),
    m AS (SELECT 'K' || k AS model, silhouette, spread FROM q)"""


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, n, inertia, silhouette, spread) of each model: simplified silhouette (of the two nearest centres) and mean distance to the nearest."""
    e = distances(spark, sf_dir).select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.array_sort(F.slice("d", 1, k)).alias("e")) for k in KS])).alias("m")).select("m.k", F.col("m.e")[0].alias("a"), F.col("m.e")[1].alias("b"))
    width = F.avg(F.when(F.col("b") > 0, (F.col("b") - F.col("a")) / F.col("b")).otherwise(0.0))
    return e.groupBy("k").agg(F.count("*").alias("n"), F.sum(F.col("a") * F.col("a")).alias("inertia"), r6(width).alias("silhouette"), r6(F.avg("a")).alias("spread"))


@query("model_verdict_table", f"WITH {_MODELS} SELECT model, silhouette, spread, silhouette = max(silhouette) OVER () AS best_silhouette, spread = min(spread) OVER () AS best_spread FROM m")
def model_verdict_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = compared(spark, sf_dir).select(F.concat(F.lit("K"), F.col("k")).alias("model"), "silhouette", "spread")
    all_ = Window.partitionBy()  # a row a model
    return m.withColumns({"best_silhouette": F.col("silhouette") == F.max("silhouette").over(all_), "best_spread": F.col("spread") == F.min("spread").over(all_)})


@query("winner_verdict", f"WITH {_MODELS}, a AS (SELECT * FROM m WHERE model = 'K2'), b AS (SELECT * FROM m WHERE model = 'K4') SELECT CASE WHEN a.silhouette > b.silhouette THEN 'K2' ELSE 'K4' END AS by_silhouette, CASE WHEN a.spread < b.spread THEN 'K2' ELSE 'K4' END AS by_spread FROM a, b")
def winner_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of two models is better by either measure."""
    of = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    return compared(spark, sf_dir).agg(F.when(of("silhouette", 2) > of("silhouette", 4), "K2").otherwise("K4").alias("by_silhouette"), F.when(of("spread", 2) < of("spread", 4), "K2").otherwise("K4").alias("by_spread"))


@query("bic_aic_from_params", f"""WITH {_MODELS}, l AS (SELECT k, n, k * 5 + k * 15 + k - 1 AS p, -(n * 5 / 2.0::DOUBLE) * (ln(2 * pi() * inertia / (n * 5)) + 1) AS ll FROM q) SELECT k, round(p * ln(n::DOUBLE) - 2 * ll, 4) AS bic, round(2.0::DOUBLE * p - 2 * ll, 4) AS aic FROM l""")
def bic_aic_from_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Criteria of each model from the likelihood of its rows under one spherical variance; a row a model reaches the driver."""
    rows = []
    for r in compared(spark, sf_dir).collect():
        likelihood = -(r["n"] * DIMS / 2) * (math.log(2 * math.pi * r["inertia"] / (r["n"] * DIMS)) + 1)
        rows.append((r["k"], *(round(v, 4) for v in models.information(likelihood, r["n"], r["k"], DIMS))))
    return spark.createDataFrame(rows, "k int, bic double, aic double")


_Z = ", ".join(f"round(coalesce((x{i} - avg(x{i}) OVER ()) / nullif(stddev_pop(x{i}) OVER (), 0), 0), 6) AS z{i}" for i in range(DIMS))


@query("centroid_zscore", f"""WITH {DIST}, c AS (SELECT cluster, {", ".join(f"avg(x[{i + 1}]) AS x{i}" for i in range(DIMS))} FROM near GROUP BY cluster) SELECT CAST(cluster AS INTEGER) AS cluster, {_Z} FROM c""")
def centroid_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cluster's mean of each feature against the clusters' means; 0 where they are all alike."""
    c = distances(spark, sf_dir).groupBy("cluster").agg(*[F.avg(F.col("x")[i]).alias(f"x{i}") for i in range(DIMS)])
    w = Window.partitionBy()  # a row a cluster
    z = lambda n: r6(F.coalesce(F.try_divide(F.col(n) - F.avg(n).over(w), F.stddev_pop(n).over(w)), F.lit(0.0)))
    return c.select("cluster", *[z(f"x{i}").alias(f"z{i}") for i in range(DIMS)])
