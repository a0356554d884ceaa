"""The command line from rasters to written results."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from gridloom import cli
from gridloom.sources.files import read_json
from gridloom.sources.raster import read_raster, write_raster
from gridloom.sources.tables import BANDS


def test_missing_bands_stop_every_stage(spark, tmp_path, capsys):
    with pytest.raises(FileNotFoundError, match="radar"):
        cli.main(["core", "--input", str(tmp_path), "--output", f"{tmp_path}/out"])
    cli.main(["check", "--input", str(tmp_path), "--output", f"{tmp_path}/out"])
    assert "radar: missing" in capsys.readouterr().out


def test_all_stages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli.workflows, "SEEDS", (0, 1))
    monkeypatch.setattr(cli.workflows.stability, "__defaults__", ((0, 1),))
    monkeypatch.setattr(cli.workflows.k_sweep, "__defaults__", (range(2, 4), 1, 10, 200))
    cells = spark.range(30 * 24).select((F.col("id") / 24).cast("int").alias("row"), (F.col("id") % 24).cast("int").alias("col"))
    side = F.when(F.col("col") < 12, 0).otherwise(100)  # two halves far apart
    for i, b in enumerate(BANDS):
        noise = F.pmod(F.xxhash64("row", "col", F.lit(i)), F.lit(1000)) / 100
        write_raster(cells.withColumn("v", F.when((F.col("row") != 3) | (F.col("col") != 3), side + noise)), f"{tmp_path}/in/{b}", "v", (30, 24), "float32", -9999, block=16, tile=16)
    (tmp_path / "c.json").write_text(json.dumps({"k": 2, "sample_size": 200, "kmeans_n_init": 1, "kmeans_max_iter": 10, "gmm_n_init": 1, "gmm_max_iter": 10, "isolation_estimators": 10, "consensus_subset": 100, "block_size": 16, "local_radius": 1}))
    for stage in ("core", "discover", "interpret"):
        cli.main([stage, "--input", f"{tmp_path}/in", "--output", f"{tmp_path}/out", "--config", f"{tmp_path}/c.json"])
    out = f"{tmp_path}/out/v2"
    sample = spark.read.parquet(f"{out}_sample.parquet")
    assert sample.count() == 200 and len(sample.columns) == 3 + 17 and sample.where("row = 3 and col = 3").isEmpty()
    core = read_json(spark, f"{out}_core_summary.json")
    assert core["prepare"]["features"] == 17 and sum(core["kmeans"].values()) == 200 and core["evaluate-k"]["values of k"] == 2
    assert read_json(spark, f"{out}_discover_summary.json")["discover"]["mean agreement"] > 0.5
    found = read_json(spark, f"{out}_interpret_summary.json")["interpret"]
    assert found["cells"] > 600 and found["objects"] >= 2
    mapped = read_raster(spark, f"{out}_cluster", "cluster")
    assert mapped.where("cluster is not null").count() == found["cells"] and mapped.where("row = 3 and col = 3 and cluster is not null").isEmpty()
    left, right = (mapped.where(c).groupBy("cluster").count().orderBy(F.desc("count")).first()["cluster"] for c in ("col < 9 and cluster is not null", "col > 14 and cluster is not null"))
    assert left != right
    assert spark.read.option("header", True).csv(f"{out}_scaler.csv").count() == 17
