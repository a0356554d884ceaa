"""Properties and small cases of the grid operators, and what has no SQL form."""

from __future__ import annotations

import json
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions.exprs import ordinal, reference_share, valid
from gridloom.functions.graphs import components
from gridloom.operators import density, focal, metrics, models, objects, profiles, samples, zones
from gridloom.plans import clustering, workflows
from gridloom.sources import files


def cells(spark, values):
    rows = [(r, c, v) for r, line in enumerate(values) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, "row int, col int, cluster int")


def test_alignment_recovers_a_permutation(spark):
    pairs = [(0, 1)] * 5 + [(1, 2)] * 3 + [(2, 0)] * 4 + [(0, 0), (2, 1), (7, 0), (1, 9)]
    df = spark.createDataFrame(pairs, "a int, b int")  # labels out of range count for nothing
    found = {r["candidate"]: r["reference"] for r in metrics.aligned(metrics.contingency(df, "a", "b"), 3).collect()}
    assert found == {1: 0, 2: 1, 0: 2}
    tied = spark.createDataFrame([(a, b) for a in range(3) for b in range(3)], "a int, b int")
    assert {r["candidate"]: r["reference"] for r in metrics.aligned(metrics.contingency(tied, "a", "b"), 3).collect()} == {0: 0, 1: 1, 2: 2}


def test_rand_index_of_a_relabelling_is_one(spark):
    df = spark.createDataFrame([(i % 3, (i + 1) % 3) for i in range(30)], "a int, b int")
    assert metrics.adjusted_rand(metrics.contingency(df, "a", "b")).first()[0] == pytest.approx(1)


def test_allocation_sums_to_the_total(spark):
    sizes = spark.createDataFrame([(i, n) for i, n in enumerate([5, 17, 3, 40, 35])], "block long, n long")
    assert samples.allocation(sizes, 23).agg(F.sum("take")).first()[0] == 23


def test_smoothing_keeps_a_constant_grid_and_no_data(spark):
    out = {(r["row"], r["col"]): r["smoothed"] for r in focal.majority(cells(spark, [[2, 2, None], [2, 2, 2]])).collect()}
    assert out == {(0, 0): 2, (0, 1): 2, (0, 2): None, (1, 0): 2, (1, 1): 2, (1, 2): 2}


def test_neighbourhood_features_with_missing_cells(spark):
    rng = np.random.default_rng(7)
    bands, height, width = ["radar", "height", "emissivity", "slope", "reflectivity"], 9, 14
    grids = {b: rng.integers(-50, 50, (height, width)).astype(float) for b in bands}
    gone = rng.random((height, width)) < 0.15
    cell = lambda b, r, c: None if gone[r, c] else int(grids[b][r, c])
    df = spark.createDataFrame([(r, c, *(cell(b, r, c) for b in bands)) for r in range(height) for c in range(width)], "row int, col int, " + ", ".join(f"{b} long" for b in bands))
    out = focal.derived(df, 2, 30.0, 20.0).toPandas().sort_values(["row", "col"])
    assert len(out) == height * width and sum(c.endswith(("_std", "_range", "_gradient", "_curvature")) for c in out.columns) == 12 and len(out.columns) == 19
    for g in grids.values():
        g[gone] = np.nan
    blocks = lambda b: np.lib.stride_tricks.sliding_window_view(np.pad(grids[b], 2, mode="edge"), (5, 5))
    got = lambda c: out[c].to_numpy().reshape(height, width)
    assert np.allclose(got("radar_local_std"), np.nan_to_num(np.nanstd(blocks("radar"), axis=(2, 3))))
    assert np.allclose(got("height_local_range"), np.nanmax(blocks("height"), axis=(2, 3)) - np.nanmin(blocks("height"), axis=(2, 3)))
    full = np.where(gone, np.nanmean(blocks("height"), axis=(2, 3)), grids["height"])
    gy, gx = np.gradient(full, 20.0, 30.0)
    assert np.allclose(got("height_gradient"), np.hypot(gx, gy))
    e = np.pad(full, 1, mode="edge")
    assert np.allclose(got("height_curvature"), (e[:-2, 1:-1] + e[2:, 1:-1] + e[1:-1, :-2] + e[1:-1, 2:] - 4 * full) / 625)


def test_objects_touch_by_corners_and_sizes_add_up(spark):
    df = cells(spark, [[1, 0, 1], [0, 1, 0], [1, None, 0]])
    sizes = {(r["cluster"], r["cells"]) for r in objects.sizes(df).collect()}
    assert sizes == {(1, 4), (0, 4)}
    rim = {tuple(r) for r in objects.ring(objects.labelled_runs(df).where("cluster = 1")).select("row", "col").collect()}
    own = {(0, 0), (0, 2), (1, 1), (2, 0)}
    assert rim == {(r + a, c + b) for r, c in own for a in (-1, 0, 1) for b in (-1, 0, 1)} - own


def test_atlas_is_thinned_and_numbered(spark):
    grid = cells(spark, [[(r // 4) * 2 + (c // 4) for c in range(8)] for r in range(8)])  # four squares of 4 x 4
    whole = workflows.atlas(grid, files.Config(), 8, 8, 10.0, 10.0, 1).orderBy("object_id").collect()
    assert [(r["object_id"], r["cluster"], r["cells"], r["area_m2"]) for r in whole] == [(i + 1, i, 16, 1600.0) for i in range(4)]
    assert (whole[0]["row_min"], whole[0]["col_max"], whole[0]["centroid_row"], whole[0]["perimeter_m"]) == (0, 3, 1.5, 90.0)
    thin = workflows.atlas(grid, replace(files.Config(), object_downsample_max_dim=4), 8, 8, 10.0, 10.0, 1).orderBy("object_id").collect()
    assert [(r["object_id"], r["cells"], r["area_m2"]) for r in thin] == [(i + 1, 4, 1600.0) for i in range(4)]


def test_allocation_of_more_than_there_is_fails(spark):
    with pytest.raises(Exception, match="23 rows asked for"):
        samples.allocation(spark.createDataFrame([(1, 5)], "block long, n long"), 23).collect()


def test_components_of_a_long_path(spark):
    df = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert components(df).select("component").distinct().collect()[0][0] == 0


def test_ordinal_numbers_all_rows_once(spark):
    """More rows than the borders of a range partitioning are drawn from, and columns beside the keys."""
    n = 300_000
    df = spark.range(n).select("id", (F.xxhash64("id") % 5000).alias("v"), F.rand(3).alias("other"), F.lit("x").alias("text"))
    out = ordinal(df, [F.col("v"), F.col("id")], parts=16).select("ordinal", "v", "id").toPandas().sort_values("ordinal")
    assert out.ordinal.tolist() == list(range(1, n + 1))
    assert (out.sort_values(["v", "id"]).id.to_numpy() == out.id.to_numpy()).all()


def test_reference_share_against_numpy(spark):
    df = spark.range(20_000).select("id", (F.xxhash64("id") % 900).alias("v"), F.rand(1).alias("other"))
    out = reference_share(df, df.where("id % 3 = 0"), "v", "share", parts=16).toPandas()
    ref = np.sort(out[out.id % 3 == 0].v)
    assert len(out) == 20_000 and np.allclose(out.share, np.searchsorted(ref, out.v, side="right") / len(ref))


def test_quantiles_against_numpy(spark):
    values = {"a": [3.0, None, 1.0, 1.0, 7.5, 2.0], "b": [5.0, 5.0, None, None, None, 6.0]}
    df = spark.createDataFrame(list(zip(*values.values())), "a double, b double")
    out = {(r["feature"], r["p"]): r["value"] for r in profiles.quantiles(df, ["a", "b"], [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    assert len(out) == 10 and all(v == pytest.approx(np.quantile([x for x in values[k] if x is not None], p)) for (k, p), v in out.items())


def test_box_polygon_is_between(spark):
    df = cells(spark, [[1] * 8 for _ in range(6)])
    got = {(r["row"], r["col"]) for r in zones.members(df, [(1, [[(1.0, 1.0), (5.0, 1.0), (5.0, 4.0), (1.0, 4.0)]])]).collect()}
    assert got == {(r, c) for r in range(1, 4) for c in range(1, 5)}


def test_validity(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (-9999.0,), (None,)], "v double")
    assert df.select(F.count(valid("v", -9999.0))).first()[0] == 1


def test_density_clusters(spark):
    points = [(i, [0.01 * i, 0.0]) for i in range(12)] + [(100 + i, [5.0 + 0.01 * i, 0.0]) for i in range(12)] + [(999, [50.0, 50.0])]
    out = dict(density.dbscan(spark.createDataFrame(points, "id long, x array<double>"), 0.2, 10, 2).collect())
    assert {out[i] for i in range(12)} == {0} and {out[100 + i] for i in range(12)} == {100} and out[999] == -1


def test_ward_and_isolation(spark):
    rng = np.random.default_rng(1)
    points = [(i, [float(v) for v in rng.normal((i % 3) * 10, 1, 2)]) for i in range(90)] + [(90, [200.0, 200.0])]
    df = spark.createDataFrame(points, "id long, x array<double>")
    label = dict(models.ward(df.where("id < 90"), 3).collect())
    assert all(label[i] == label[i % 3] for i in range(90)) and len(set(label.values())) == 3
    score = dict(models.isolation_scores(df, trees=25).select("id", "isolation").collect())
    assert max(score, key=score.get) == 90 and all(0 < v < 1 for v in score.values())


def test_configuration(spark, tmp_path):
    assert files.Config.from_json('{"k": 5, "birch_threshold": 0.7, "unknown": 1}') == replace(files.Config(), k=5, birch_threshold=0.7)
    files.write_json(spark, json.loads(files.Config(k=6).to_json()), str(tmp_path / "config"))
    assert files.Config.read(spark, str(tmp_path / "config")) == files.Config(k=6) and files.read_json(spark, str(tmp_path / "config"))["output_prefix"] == "v2"


def test_discovery_skips_what_is_no_table_of_counts(spark, tmp_path):
    files.write_csv(spark.createDataFrame([("0", "a", 3), ("0", "b", 1), ("1", "a", 4)], "Cluster_ID string, unit string, pixels int").coalesce(1), str(tmp_path / "in" / "deep" / "one"))
    files.write_csv(spark.createDataFrame([(1,)], "other int"), str(tmp_path / "in" / "two"))
    found = files.discovered_counts(spark, [str(tmp_path / "in" / n) for n in ("deep/one", "two", "none")])
    assert sorted(tuple(r)[:3] for r in found.collect()) == [("0", "a", "3"), ("0", "b", "1"), ("1", "a", "4")]
    tables = workflows.associations(spark, str(tmp_path / "in"))
    rows = {(r["cluster"], r["geology"]): r for t in tables.values() for r in t.collect()}
    assert len(rows) == 3 and rows["0", "a"]["purity"] == pytest.approx(3 / 7) and rows["0", "a"]["enrichment"] == pytest.approx((3 / 7) / (4 / 8))
    with pytest.raises(FileNotFoundError, match="none"):
        files.check_inputs(spark, [str(tmp_path / "in" / "two"), str(tmp_path / "none")])
    assert files.first_readable(spark, [str(tmp_path / "none"), str(tmp_path / "in" / "two")]).columns == ["other"]
    assert files.read_csv_or_none(spark, str(tmp_path / "none")) is None


def test_sinks(spark, tmp_path):
    grid = cells(spark, [[1, 2, 3], [4, 5, 6]])
    files.write_blocks(grid, str(tmp_path / "tiles"), 2)
    assert spark.read.parquet(str(tmp_path / "tiles")).where("block_c = 1").count() == 2
    assert "0.500000" in files.report("t", {"x": 0.5})
    files.write_report(spark, str(tmp_path / "report"), "stage", {"one": {"x": 0.25}, "two": {"n": 3}})
    text = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "report")).collect())
    assert "# stage" in text and "## one" in text and "- x: 0.250000" in text and "- n: 3" in text
    points = spark.createDataFrame([(i, [float(i % 2) * 9 + i / 100, float(i % 3)]) for i in range(60)], "id long, x array<double>")
    files.write_mixture(models.mixture(points, 2, rounds=5), str(tmp_path / "gmm"))
    kept = spark.read.parquet(str(tmp_path / "gmm")).collect()
    assert len(kept) == 2 and sum(r["weight"] for r in kept) == pytest.approx(1) and all(len(r["covariance"]) == 4 for r in kept)
    assert files.kept_columns(grid, ["cluster", "none", "row"]).columns == ["cluster", "row"]
    with pytest.raises(ValueError):
        files.require(grid, ["none"])


def test_persisted_scaler_and_centres(spark):
    df = spark.createDataFrame([(i, float(i), 5.0) for i in range(10)], "id long, a double, b double")
    scaler = models.scaler(df, ["b", "a"])
    assert {r["feature"]: r["scale"] for r in scaler.collect()} == {"a": pytest.approx(np.std(range(10))), "b": 1.0}
    back = models.scaled_columns(models.scaled_columns(df, scaler, ["a", "b"]), scaler, ["a", "b"], inverse=True)
    assert [r["a"] for r in back.orderBy("id").collect()] == pytest.approx(list(range(10)))
    centres = models.centroid_table(spark, [[1.0, 5.0], [8.0, 5.0]], ["a", "b"]).select("cluster", "b", "a")
    found = workflows.predicted(df, scaler, centres, ["a", "b"]).orderBy("id").collect()
    assert [r["cluster"] for r in found] == [0] * 5 + [1] * 5
    with pytest.raises(ValueError, match="c"):
        models.parameters(scaler, ["a", "c"])
    with pytest.raises(ValueError, match="scale 0"):
        models.parameters(scaler.withColumn("scale", F.lit(0.0)), ["a"])


def three_groups(spark, n=300):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 4)) + np.array([[0, 0, 0, 0], [9, 0, 0, 0], [0, 9, 9, 0]])[np.arange(n) % 3]
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>"), x


def test_models_find_three_groups_and_agree(spark):
    df, x = three_groups(spark)
    small = replace(files.Config(), k=3, kmeans_n_init=3, kmeans_max_iter=20, gmm_n_init=3, gmm_max_iter=30, minibatch_batch_size=100)
    labels, pairs, mappings = workflows.consensus(df, small)
    assert pairs.count() == 6 and pairs.agg(F.min("ari")).first()[0] > 0.97, pairs.collect()
    assert set(mappings) == {"kmeans", "minibatch", "gmm", "birch"}
    rows = labels.orderBy("id").collect()
    assert all(r["consensus"] == rows[i % 3]["consensus"] for i, r in enumerate(rows)) and all(0 <= r["entropy"] <= 1 for r in rows)
    runs, pairs, centres = workflows.stability(df, small, seeds=(0, 1, 42))
    assert runs.count() == 3 and pairs.count() == 3 and centres.count() == 9 and all(sum(r["sizes"]) == 300 for r in runs.collect())
    sweep = workflows.k_sweep(df, 4, ks=(2, 3, 4), starts=1, rounds=20).collect()
    assert [r["k"] for r in sweep if r["best_silhouette"]] == [3]
    u = workflows.uncertainty(df, workflows.centres_of(workflows.fitted(df, small))).collect()
    assert len(u) == 300 and 0 <= np.mean([r["confidence"] for r in u]) <= 1 and all(sum(r["p"]) == pytest.approx(1) for r in u)


def test_silhouette_and_tenth_neighbour_against_numpy(spark):
    df, x = three_groups(spark, 90)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    label = np.arange(90) % 3
    a = np.array([d[i][label == label[i]].sum() / (sum(label == label[i]) - 1) for i in range(90)])
    b = np.array([min(d[i][label == c].mean() for c in range(3) if c != label[i]) for i in range(90)])
    got = metrics.silhouette(df.withColumn("l", (F.col("id") % 3).cast("int")), "l", "x").first()[0]
    assert got == pytest.approx(((b - a) / np.maximum(a, b)).mean())
    found = dict(density.kth_distances(df, 10).collect())
    assert len(found) == 90 and np.allclose([found[i] for i in range(90)], np.sort(d, axis=1)[:, 9])


def test_density_clusters_by_brute_force(spark):
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(0, 0.1, (120, 3)), rng.normal(1, 0.1, (120, 3)), rng.uniform(-3, 3, (60, 3)), np.zeros((30, 3))])
    got = dict(density.dbscan(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, x array<double>"), 0.15, 8, 3).collect())
    close = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= 0.15
    core = close.sum(1) >= 8
    label = np.where(core, np.arange(len(x)), 10**6)
    for _ in range(60):
        label = np.array([min([label[i], *label[close[i] & core]]) if core[i] else 10**6 for i in range(len(x))])
    full = [label[i] if core[i] else min(label[close[i] & core], default=10**6) for i in range(len(x))]
    assert [got[i] for i in range(len(x))] == [-1 if v == 10**6 else v for v in full] and len(set(full)) > 2


def test_combined_anomaly_ranks_by_brute_force(spark):
    df, x = three_groups(spark, 150)
    out = workflows.anomalies(df, [[0.0] * 4, [9.0, 0, 0, 0]], replace(files.Config(), isolation_estimators=20)).toPandas().sort_values("id")
    for column, rank in (("d1", "centroid_percentile"), ("isolation", "isolation_percentile")):
        order = np.lexsort((out.id, out[column]))
        place = np.empty(150)
        place[order] = np.arange(150) / 149
        assert np.allclose(out[rank], place)
    assert np.allclose(out.combined, (out.centroid_percentile + out.isolation_percentile) / 2) and out.outlier.sum() == 2


def test_harmonised_tables(spark):
    a = spark.createDataFrame([("Pl", " plains ", "12", "80.5", "x")], "usgs_type string, description string, valid_pixels string, cluster_1_percentage string, other string")
    b = spark.createDataFrame([("Cr", 70.0, 10.0, 5.0, 15.0, "many")], "Geology string, C0_pct double, C1_pct double, C2_pct double, C3_pct double, feature_pixels string")
    both = workflows.harmonised(a, "north", "polygon").unionByName(workflows.harmonised(b, "south", "unit"))
    assert len(both.columns) == 16
    one, two = both.orderBy("region").collect()
    assert (one["geology"], one["unit_code"], one["valid_pixels"], one["C1_pct"], one["C0_pct"], one["dominant_cluster"]) == ("plains", "Pl", 12.0, 80.5, None, 1)
    assert (two["geology"], two["valid_pixels"], two["dominant_cluster"], two["dominant_purity"]) == ("Cr", None, 0, 70.0)


def test_map_scores_use_all_features_and_both_shares(spark, monkeypatch):
    seen = []

    def flat(df, *args, **kwargs):
        seen.append(len(df.first()["x"]))
        return df.withColumn("isolation", F.lit(0.5))

    monkeypatch.setattr(models, "isolation_scores", flat)
    share = 2 * clustering.full_map_scores(spark, "/root/testdata/sf0.001").toPandas()["anomaly"].to_numpy() - 1
    assert seen == [17] and np.allclose(share, np.searchsorted(np.sort(share), share + 1e-7) / len(share), atol=1e-5)
