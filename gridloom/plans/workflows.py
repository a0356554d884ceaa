"""Workflows as functions of DataFrames and a configuration; the named queries call them with small parameters.

A sample has an id and named feature columns; results are DataFrames, written wherever the caller wants them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.exprs import entropy, id_hash, ordinal, ratio, reference_share, softmax
from gridloom.functions.graphs import cut
from gridloom.operators import density, focal, metrics, models, objects, samples
from gridloom.sources import files
from gridloom.sources.files import Config
from gridloom.sources.tables import BANDS

# Seeds of the stability runs and the radii of the two density sweeps.
SEEDS = (0, 1, 2, 3, 4, 5, 10, 20, 42, 100)
WIDE_RADII, NARROW_RADII = (0.90, 0.95, 1.00, 1.05, 1.10, 1.15, 1.20), (0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50)


def features(df: DataFrame, names: list[str]) -> DataFrame:
    """(id, x) of the rows whose features are all there."""
    complete = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])
    return df.where(complete).select(F.col("id").cast("long"), F.array(*[F.col(n).cast("double") for n in names]).alias("x"))


def distances(df: DataFrame, centres: list[list[float]]) -> DataFrame:
    """``df`` with d (distance to each centre), cluster (nearest, lowest on ties), d1 and d2 (the two smallest distances)."""
    d = df.withColumn("d", F.array(*[metrics.distance(F.col("x"), F.array(*map(F.lit, map(float, c)))) for c in centres]))
    return d.withColumns({"cluster": (F.array_position("d", F.array_min("d")) - 1).cast("int"), "d1": F.array_sort("d")[0], "d2": F.array_sort("d")[1]})


def fitted(v: DataFrame, config: Config):
    """k-means of the configured starts and rounds."""
    return models.kmeans(v, config.k, config.seeds(config.kmeans_n_init), config.kmeans_max_iter)


def centres_of(model) -> list[list[float]]:
    return [list(map(float, c)) for c in model.clusterCenters()]


def stability(v: DataFrame, config: Config, seeds=SEEDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs, pairs, centres) over seeds: inertia, sizes and shares of each run; the adjusted Rand index of each pair of runs; centres."""
    data, out, runs, centres = models.with_vector(v), v.select("id"), [], []
    for s in seeds:
        m = models.kmeans(v, config.k, (s,), config.kmeans_max_iter)
        sizes = [int(n) for n in m.summary.clusterSizes]
        runs.append((s, float(m.summary.trainingCost), sizes, [100.0 * n / max(1, sum(sizes)) for n in sizes]))
        centres += [(s, i, c) for i, c in enumerate(centres_of(m))]
        out = out.join(m.transform(data).select("id", F.col("prediction").alias(f"s{s}")), "id")
    spark = v.sparkSession
    pairs = metrics.rand_pairs(cut(out), [f"s{s}" for s in seeds])
    seed = lambda c: F.substring(c, 2, 20).cast("int")
    return (
        spark.createDataFrame(runs, "seed int, inertia double, sizes array<long>, percentages array<double>"),
        pairs.select(seed("a").alias("seed_a"), seed("b").alias("seed_b"), "ari"),
        spark.createDataFrame(centres, "seed int, cluster int, centre array<double>"),
    )


def k_sweep(v: DataFrame, dims: int, ks=range(2, 11), starts: int = 10, rounds: int = 300, rows: int = 2_000) -> DataFrame:
    """(k, inertia, silhouette, davies_bouldin, best_silhouette, best_davies_bouldin) for each number of clusters."""
    data, out = models.with_vector(v), []
    for k in ks:
        m = models.kmeans(v, k, tuple(range(42, 42 + starts)), rounds)
        p = cut(m.transform(data).select("id", "x", F.col("prediction").alias("cluster")))
        out.append((k, float(m.summary.trainingCost), metrics.silhouette(p, "cluster", "x", rows).first()[0], metrics.davies_bouldin(p, "cluster", "x", dims).first()[0]))
    by_s, by_d = max(out, key=lambda r: r[2] or -2)[0], min(out, key=lambda r: r[3])[0]
    return v.sparkSession.createDataFrame([(*r, r[0] == by_s, r[0] == by_d) for r in out], "k int, inertia double, silhouette double, davies_bouldin double, best_silhouette boolean, best_davies_bouldin boolean")


def density_sweep(v: DataFrame, radii, dims: int, least: int = 10, rows: int = 2_000) -> DataFrame:
    """A row for each radius: clusters, those of at least 1 % of the rows, noise, the largest cluster's share, silhouette and Davies-Bouldin of the rows without noise (null below two clusters)."""
    out, n, radii = [], v.count(), list(radii)
    for eps, labels in zip(radii, density.dbscans(v, radii, least, dims)):
        found = cut(v.select("id", "x").join(labels, "id"))
        kept = found.where("cluster >= 0")
        sizes = kept.groupBy("cluster").agg(F.count("*").alias("n"))
        many, large, inside, most = sizes.agg(F.count("*"), F.count_if(F.col("n") >= 0.01 * n), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        quality = (metrics.silhouette(kept, "cluster", "x", rows).first()[0], metrics.davies_bouldin(kept, "cluster", "x", dims).first()[0]) if many > 1 else (None, None)
        out.append((eps, many, large, n - inside, 100.0 * (n - inside) / max(1, n), 100.0 * most / max(1, n), *quality))
    return v.sparkSession.createDataFrame(out, "eps double, clusters int, substantial int, noise long, noise_pct double, largest_pct double, silhouette double, davies_bouldin double")


def consensus(v: DataFrame, config: Config) -> tuple[DataFrame, DataFrame, dict[str, dict[int, int]]]:
    """(labels, pairs, mappings) of four models: each row's raw and aligned labels, majority, agreement and vote entropy; the adjusted
    Rand index of each pair of models; how each model's labels were renamed to those of k-means."""
    data, k = models.with_vector(v), config.k
    main = fitted(v, config)
    start = centres_of(models.kmeans(v, k, config.seeds(min(10, config.kmeans_n_init)), 1))  # the best of several starts
    rounds = max(1, min(config.kmeans_max_iter, 100))
    raw = {
        "kmeans": main.transform(data).select("id", F.col("prediction").alias("kmeans")),
        "minibatch": models.assigned(v, models.minibatch(v, start, config.minibatch_batch_size, rounds)).select("id", F.col("cluster").alias("minibatch")),
        "gmm": models.mixture(v, k, config.seeds(config.gmm_n_init), config.gmm_max_iter).transform(data).select("id", F.col("prediction").alias("gmm")),
        "birch": models.birch(v, config.birch_threshold, k).select("id", F.col("cluster").alias("birch")),
    }
    labels = cut(reduce(lambda a, b: a.join(b, "id"), raw.values()))
    mappings = {"kmeans": {i: i for i in range(k)}}
    for name in ("minibatch", "gmm", "birch"):
        mappings[name] = {r["candidate"]: r["reference"] for r in metrics.aligned(metrics.contingency(labels, "kmeans", name), k).collect()}  # k rows
    renamed = {f"aligned_{n}": F.element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), F.col(n)) for n, m in mappings.items()}
    share = F.transform("_n", lambda c: c / F.lit(float(len(raw))))
    voted = labels.withColumns(renamed).withColumn("_n", metrics.votes(F.array(*renamed), k)).select(
        "id", *raw, *renamed, (F.array_position("_n", F.array_max("_n")) - 1).cast("int").alias("consensus"), (F.array_max("_n") / float(len(raw))).alias("agreement"), entropy(share, k).alias("entropy")
    )
    return voted, metrics.rand_pairs(labels, list(raw)), mappings


def uncertainty(v: DataFrame, centres: list[list[float]]) -> DataFrame:
    """(id, cluster, nearest, second, margin, confidence, entropy, p) of each row from a fitted model's centres."""
    d = distances(v, centres).withColumn("p", softmax(F.col("d")))
    h = entropy(F.col("p"), len(centres))
    return d.select("id", "cluster", F.col("d1").alias("nearest"), F.col("d2").alias("second"), (F.col("d2") - F.col("d1")).alias("margin"), (1 - h).alias("confidence"), h.alias("entropy"), "p")


def ranked(df: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with the row's position in the order of ``column`` (ties by id) over n - 1."""
    n = F.broadcast(df.agg(F.count("*").alias("_n")))  # one row
    return ordinal(df, [F.col(column), F.col("id")], "_o").crossJoin(n).withColumn(out, ratio(F.col("_o") - 1, F.greatest(F.col("_n") - 1, F.lit(1)))).drop("_o", "_n")


def anomalies(v: DataFrame, centres: list[list[float]], config: Config) -> DataFrame:
    """(id, cluster, d1, isolation, centroid_percentile, isolation_percentile, combined, outlier): both ranks halved; the share of rows that
    ``anomaly_contamination`` says lies above all others by isolation is marked."""
    d = distances(v, centres).select("id", "x", "cluster", "d1")
    s = cut(models.isolation_scores(d, config.isolation_estimators, config.anomaly_subset, config.random_state).drop("x"))
    both = ranked(ranked(s, "d1", "centroid_percentile"), "isolation", "isolation_percentile")
    return both.withColumns({"combined": (F.col("centroid_percentile") + F.col("isolation_percentile")) / 2, "outlier": F.col("isolation_percentile") > 1 - config.anomaly_contamination})


def full_map(grid: DataFrame, config: Config, step_x: float, step_y: float, width: int) -> DataFrame:
    """Grid cells (row, col, five bands) scored on all 17 features: cluster, confidence, and the mean share of a sample's centre
    distances and isolation values at or below each cell's."""
    local = focal.derived(grid, config.local_radius, step_x, step_y)
    names = [*BANDS, *[c for c in local.columns if c not in grid.columns]]
    cells = cut(features(local.withColumn("id", F.col("row").cast("long") * width + F.col("col")), names))
    sample = lambda df, n: samples.exact_sample(df, id_hash("id"), n)
    v = cut(models.standardised(cells, len(names), sample(cells, config.sample_size)))
    centres = centres_of(fitted(sample(v, config.sample_size), config))
    isolated = models.isolation_scores(v, config.isolation_estimators, fit=sample(v, config.anomaly_subset))
    d = distances(isolated, centres)
    h = entropy(softmax(F.col("d")), config.k)
    scored = cut(d.select("id", "cluster", (1 - h).alias("confidence"), F.round("d1", 9).alias("nearest"), F.round("isolation", 9).alias("isolation")))
    ref = sample(scored, config.sample_size)
    both = reference_share(reference_share(scored, ref, "nearest", "near_share"), ref, "isolation", "isolation_share")
    return both.select("id", "cluster", "confidence", ((F.col("near_share") + F.col("isolation_share")) / 2).alias("anomaly"))


def predicted(df: DataFrame, scaler: DataFrame, centroids: DataFrame, names: list[str], scaled_centres: bool = False) -> DataFrame:
    """``df`` (id and features) with the cluster of a persisted model: features scaled by the scaler's rows of their names, and
    centres given in their own units (or already scaled)."""
    centres = models.centroids(centroids, names)
    if not scaled_centres:
        own = models.parameters(scaler, names)
        centres = [[(c - m) / s for c, (m, s) in zip(row, own)] for row in centres]
    return distances(features(models.scaled_columns(df, scaler, names), names), centres).select("id", "cluster", "d1")


def atlas(clusters: DataFrame, config: Config, height: int, width: int, step_x: float, step_y: float, least: int) -> DataFrame:
    """The object atlas of a cluster grid, thinned to at most ``object_downsample_max_dim`` lines and columns, with a running object_id."""
    every = max(1, -(-max(height, width) // config.object_downsample_max_dim))
    if every > 1:
        clusters = clusters.where((F.col("row") % every == 0) & (F.col("col") % every == 0)).withColumns({"row": F.expr(f"int(row div {every})"), "col": F.expr(f"int(col div {every})")})
    found = objects.atlas(clusters, -(-height // every), -(-width // every), step_x * every, step_y * every, least)
    return ordinal(found, [F.col("cluster"), F.col("object")], "object_id")


def associations(spark, root: str) -> dict[str, DataFrame]:
    """For each CSV below a folder that has cluster, unit and count columns under any alias: its enrichment table."""
    out = {}
    for path in files.csv_below(spark, root):
        df = files.read_csv_or_none(spark, path)
        counts = files.counts_of(df) if df is not None else None
        if counts is not None:
            out[path] = enriched(counts.withColumn("count", F.col("count").try_cast("double")).where("count is not null"))
    return out


def enriched(counts: DataFrame) -> DataFrame:
    """(cluster, geology, count, cluster_total, geology_total, purity, cluster_fraction_within_geology, enrichment) of (cluster, geology, count)."""
    n = counts.groupBy("cluster", "geology").agg(F.sum("count").alias("count"))
    total = lambda key, name: n.groupBy(key).agg(F.sum("count").alias(name))
    all_ = F.broadcast(n.agg(F.sum("count").alias("_all")))  # one row
    both = n.join(total("cluster", "cluster_total"), "cluster").join(total("geology", "geology_total"), "geology").crossJoin(all_)
    both = both.withColumns({"purity": ratio("count", "geology_total"), "cluster_fraction_within_geology": ratio("count", "cluster_total"), "enrichment": ratio(ratio("count", "geology_total"), ratio("cluster_total", "_all"))})
    return both.select("cluster", "geology", "count", "cluster_total", "geology_total", "purity", "cluster_fraction_within_geology", "enrichment")


# The columns of the harmonised validation table and the names their sources use.
SHARES = {f"C{c}_pct": [f"C{c}_pct", f"cluster_{c}_percentage", f"cluster_{c}_pixel_percentage", f"cluster_{c}_pct"] for c in range(4)}
ENRICHED = {f"C{c}_enrichment": [f"C{c}_enrichment", f"cluster_{c}_enrichment", f"enrichment_{c}"] for c in range(4)}
NAMES = {"geology": ["geology", "description", "geological_feature", "unit", "usgs_type", "category"], "unit_code": ["unit_code", "usgs_type", "unit", "code"], "category": ["category", "feature_type"]}
PIXELS = ["valid_pixels", "feature_pixels", "total_valid_pixels", "sample_pixels"]


def harmonised(df: DataFrame, region: str, level: str) -> DataFrame:
    """A validation table of any layout in the canonical sixteen columns: region and level given, names and numbers from the first
    column found under a known name (null where there is none; text that is no number is null), dominant cluster and its share derived."""
    found = lambda names: (files.resolve(df.columns, names))
    text = lambda names: F.trim(F.col(f"`{c}`").cast("string")) if (c := found(names)) else F.lit(None).cast("string")
    number = lambda names: F.col(f"`{c}`").cast("string").try_cast("double") if (c := found(names)) else F.lit(None).cast("double")
    out = df.select(
        F.lit(region).alias("region"), F.lit(level).alias("validation_level"), *[text(names).alias(n) for n, names in NAMES.items()], number(PIXELS).alias("valid_pixels"),
        *[number(names).alias(n) for n, names in (SHARES | ENRICHED).items()],
    )
    best: Column = F.greatest(*SHARES)
    dominant = reduce(lambda rest, c: F.when(F.col(f"C{c}_pct") == best, F.lit(c)).otherwise(rest), range(3, -1, -1), F.lit(None).cast("int"))
    return out.withColumns({"dominant_cluster": dominant, "dominant_purity": best})
