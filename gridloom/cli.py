"""Command line: from five band rasters to written results.

    python -m gridloom.cli STAGE --input FOLDER --output FOLDER [--config FILE.json]

The input folder holds a raster for each band (``radar.tif`` or a folder ``radar`` of blocks, and so on).  Stages: check (what is there),
prepare (training sample with all features), kmeans, evaluate-k, stability, core (these four in order), features (as prepare), discover
(consensus of four models, stability), interpret (uncertainty, anomalies, full maps, objects, associations), all (features, discover,
interpret).  A stage whose inputs are missing fails with their names before anything is computed.  Tables are CSV, samples
Parquet, maps rasters, summaries JSON and Markdown.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.exprs import id_hash
from gridloom.operators import focal, models, samples
from gridloom.plans import workflows
from gridloom.sources.files import Config, write_csv, write_json, write_report
from gridloom.sources.raster import files_of, raster_profile, read_raster, write_raster
from gridloom.sources.tables import BANDS

CORE, WHOLE = ("prepare", "kmeans", "evaluate-k", "stability"), ("features", "discover", "interpret")
STAGES = ("check", *CORE, "core", *WHOLE, "all")


class Run:
    """One run: where inputs lie, where results go, and the parameters."""

    def __init__(self, spark: SparkSession, source: str, target: str, config: Config) -> None:
        self.spark, self.source, self.target, self.config = spark, source.rstrip("/"), target.rstrip("/"), config
        self.prefix = f"{self.target}/{config.output_prefix}"

    def band(self, name: str) -> str | None:
        """The band's raster, or None."""
        for path in (f"{self.source}/{name}.tif", f"{self.source}/{name}"):
            try:
                if files_of(path):
                    return path
            except FileNotFoundError:
                continue
        return None

    def missing(self) -> list[str]:
        return [b for b in BANDS if self.band(b) is None]

    def require(self) -> None:
        if self.missing():
            raise FileNotFoundError(f"{self.source} has no raster of {self.missing()}")

    def sample(self) -> DataFrame:
        path = f"{self.prefix}_sample.parquet"
        try:
            return self.spark.read.parquet(path)
        except Exception as e:
            raise FileNotFoundError(f"{path} is missing: run the stage prepare first") from e

    def grid(self) -> DataFrame:
        """(row, col, five bands); cells must lie on the first band's grid."""
        out = None
        for b in BANDS:
            own = read_raster(self.spark, self.band(b), b)
            out = own if out is None else out.join(own, ["row", "col"], "left")
        return out

    def steps(self) -> tuple[float, float, int, int]:
        """(step_x, step_y, height, width) of the first band."""
        one = raster_profile(self.spark, self.band(BANDS[0])).first()
        return one["step_x"] or 1.0, one["step_y"] or 1.0, one["height"], one["width"]

    def standard(self) -> tuple[DataFrame, list[str]]:
        """The sample's standardised vectors and its features' names."""
        own = self.sample()
        names = [c for c in own.columns if c not in ("id", "row", "col")]
        return models.standardised(workflows.features(own, names), len(names)), names

    def model(self) -> list[list[float]]:
        v, _ = self.standard()
        return workflows.centres_of(workflows.fitted(v, self.config))


def check(run: Run) -> dict:
    return {b: run.band(b) or "missing" for b in BANDS}


def prepare(run: Run) -> dict:
    """As many valid cells of each block as its share of the sample, with all seventeen features."""
    run.require()
    step_x, step_y, _, width = run.steps()
    local = focal.derived(run.grid(), run.config.local_radius, step_x, step_y)
    valid = local.dropna("any").withColumn("id", F.col("row").cast("long") * width + F.col("col"))
    block = F.concat_ws("-", F.floor(F.col("row") / run.config.block_size), F.floor(F.col("col") / run.config.block_size))
    n = valid.count()
    own = valid if n <= run.config.sample_size else samples.stratified(valid.withColumn("block", block), run.config.sample_size, id_hash("id")).drop("block")
    own.write.mode("overwrite").parquet(f"{run.prefix}_sample.parquet")
    return {"valid cells": n, "sampled cells": min(n, run.config.sample_size), "features": len(local.columns) - 2}


def kmeans(run: Run) -> dict:
    own = run.sample()
    v, names = run.standard()
    scaler = models.scaler(own, names)
    centres = run.model()
    write_csv(scaler, f"{run.prefix}_scaler.csv")
    write_csv(models.centroid_table(run.spark, centres, names), f"{run.prefix}_centroids.csv")
    labels = models.assigned(v, centres)
    write_csv(labels.select("id", "cluster"), f"{run.prefix}_labels.csv")
    return {f"cluster {r['cluster']}": r["n"] for r in labels.groupBy("cluster").agg(F.count("*").alias("n")).orderBy("cluster").collect()}


def evaluate_k(run: Run) -> dict:
    v, names = run.standard()
    found = workflows.k_sweep(v, len(names), starts=run.config.kmeans_n_init, rounds=run.config.kmeans_max_iter)
    write_csv(found, f"{run.prefix}_k_sweep.csv")
    return {"values of k": found.count()}


def stability(run: Run) -> dict:
    v, _ = run.standard()
    runs, pairs, _ = workflows.stability(v, run.config)
    write_csv(runs.select("seed", "inertia"), f"{run.prefix}_stability_runs.csv")
    write_csv(pairs, f"{run.prefix}_stability_pairs.csv")
    one = pairs.agg(F.avg("ari"), F.min("ari")).first()
    return {"mean ARI": one[0], "lowest ARI": one[1]}


def discover(run: Run) -> dict:
    v, _ = run.standard()
    part = samples.exact_sample(v, id_hash("id"), run.config.consensus_subset)
    labels, pairs, mappings = workflows.consensus(part, run.config)
    write_csv(labels, f"{run.prefix}_consensus_labels.csv")
    write_csv(pairs, f"{run.prefix}_consensus_pairs.csv")
    write_json(run.spark, {n: {str(a): b for a, b in m.items()} for n, m in mappings.items()}, f"{run.prefix}_consensus_mappings.json")
    return {"mean agreement": labels.agg(F.avg("agreement")).first()[0], **{f"stability {k}": x for k, x in stability(run).items()}}


def interpret(run: Run) -> dict:
    run.require()
    v, _ = run.standard()
    centres = run.model()
    sure, odd = workflows.uncertainty(v, centres).drop("p"), workflows.anomalies(v, centres, run.config)
    write_csv(sure, f"{run.prefix}_uncertainty.csv")
    write_csv(odd, f"{run.prefix}_anomalies.csv")
    step_x, step_y, height, width = run.steps()
    scored = workflows.full_map(run.grid(), run.config, step_x, step_y, width)
    scored.write.mode("overwrite").parquet(f"{run.prefix}_full_map.parquet")
    cells = run.spark.read.parquet(f"{run.prefix}_full_map.parquet").withColumns({"row": F.expr(f"int(id div {width})"), "col": F.expr(f"int(id % {width})")})
    for column, dtype, nodata in (("cluster", "uint8", 255), ("confidence", "float32", -9999), ("anomaly", "float32", -9999)):
        write_raster(cells, f"{run.prefix}_{column}", column, (height, width), dtype, nodata, block=run.config.block_size, tile=16 * max(1, min(16, run.config.block_size // 16)), step_x=step_x, step_y=step_y)
    clusters = read_raster(run.spark, f"{run.prefix}_cluster", "cluster").withColumn("cluster", F.col("cluster").cast("int"))
    objects = workflows.atlas(clusters, run.config, height, width, step_x, step_y, 1)
    write_csv(objects, f"{run.prefix}_objects.csv")
    tables = workflows.associations(run.spark, run.source)
    for name, own in tables.items():
        write_csv(own, f"{run.prefix}_associations/{name.rstrip('/').rsplit('/', 1)[-1]}")
    return {"mean confidence": sure.agg(F.avg("confidence")).first()[0], "outliers": odd.where("outlier").count(), "cells": cells.count(), "objects": objects.count(), "association tables": len(tables)}


RUNS = {"check": check, "prepare": prepare, "features": prepare, "kmeans": kmeans, "evaluate-k": evaluate_k, "stability": stability, "discover": discover, "interpret": interpret}


def execute(run: Run, stage: str) -> dict[str, dict]:
    """The results of a stage, or of the stages it stands for, in order; written as a summary too."""
    if stage != "check":
        run.require()
    out = {name: RUNS[name](run) for name in {"core": CORE, "all": WHOLE}.get(stage, (stage,))}
    if stage != "check":
        write_json(run.spark, out, f"{run.prefix}_{stage}_summary.json")
        write_report(run.spark, f"{run.prefix}_{stage}_report.md", f"Stage {stage}", out)
    return out


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    parser.add_argument("stage", nargs="?", choices=STAGES, default="check")
    parser.add_argument("--input", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--config")
    given = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    config = Config.read(spark, given.config) if given.config else Config()
    for name, values in execute(Run(spark, given.input, given.output, config), given.stage).items():
        print(name, *[f"  {k}: {v}" for k, v in values.items()], sep="\n")


if __name__ == "__main__":
    main()
