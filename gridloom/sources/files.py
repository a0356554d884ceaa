"""Files: configuration, tolerant and discovered tables, alias columns, reports.  Spark reads and writes all data files."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass, fields

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.errors.exceptions.base import PySparkException as SparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Config:
    """Parameters of the workflows; JSON overlays them and unknown keys are dropped."""

    # The names and defaults of the pipeline's parameters.
    sample_size: int = 100_000
    sample_min_candidate_factor: float = 1.10
    sample_batch_factor: float = 1.5
    random_state: int = 42
    block_size: int = 512
    local_radius: int = 2
    k: int = 4
    consensus_subset: int = 20_000
    anomaly_subset: int = 50_000
    anomaly_contamination: float = 0.01
    isolation_estimators: int = 300
    kmeans_n_init: int = 20
    kmeans_max_iter: int = 500
    gmm_n_init: int = 3
    gmm_max_iter: int = 300
    birch_threshold: float = 0.5
    minibatch_batch_size: int = 2_048
    object_downsample_max_dim: int = 2_048
    output_prefix: str = "v2"

    @classmethod
    def from_json(cls, text: str) -> Config:
        """From JSON text."""
        given = json.loads(text)
        return cls(**{f.name: given[f.name] for f in fields(cls) if f.name in given})

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Config:
        """From a JSON file in any store Spark reads."""
        return cls.from_json(spark.read.text(path, wholetext=True).first()[0])

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)

    def seeds(self, n: int) -> tuple[int, ...]:
        """``n`` seeds from the configured one on."""
        return tuple(self.random_state + i for i in range(n))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark finds anything to read there."""
    try:
        spark.read.format("binaryFile").load(path).limit(0).collect()
        return True
    except AnalysisException:
        return False


def check_inputs(spark: SparkSession, paths: Iterable[str]) -> None:
    """Raises FileNotFoundError that names every path with nothing to read."""
    gone = [p for p in paths if not exists(spark, p)]
    if gone:
        raise FileNotFoundError(f"missing inputs: {gone}")


def kept_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Those of ``names`` that ``df`` has, in the order of ``names``."""
    return df.select(*[n for n in names if n in df.columns])


def resolve(columns: Iterable[str], candidates: list[str]) -> str | None:
    """The first candidate that is a column, blanks around and case aside."""
    own = {c.strip().lower(): c for c in columns}
    return next((own[c.strip().lower()] for c in candidates if c.strip().lower() in own), None)


def require(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_csv_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None where there is none to read: no such path, no columns, or a first row that does not parse."""
    try:
        df = read_csv(spark, path)
        df.limit(1).collect()
        return df if df.columns else None
    except (AnalysisException, SparkException, Py4JJavaError):
        return None


def first_readable(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    return next((df for df in (read_csv_or_none(spark, p) for p in paths) if df is not None), None)


# The names under which these columns are found.
CLUSTER, UNIT, COUNT = ["cluster", "cluster_id", "ml_cluster"], ["unit", "geology", "category", "geologic_unit"], ["count", "pixels", "n", "pixel_count"]


def counts_of(df: DataFrame) -> DataFrame | None:
    """(cluster, geology, count) of a table that has such columns under any alias, else None."""
    names = [resolve(df.columns, c) for c in (CLUSTER, UNIT, COUNT)]
    if not all(names):
        return None
    return df.select(*[F.col(f"`{n}`").cast("string").alias(a) for n, a in zip(names, ("cluster", "geology", "count"))])


def discovered_counts(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """(cluster, geology, count, source) of all tables that have such columns under any alias; others are skipped."""
    out = None
    for path in paths:
        df = read_csv_or_none(spark, path)
        one = counts_of(df) if df is not None else None
        if one is not None:
            one = one.withColumn("source", F.lit(path))
            out = one if out is None else out.unionByName(one)
    return out


def csv_below(spark: SparkSession, root: str) -> list[str]:
    """The CSV files anywhere below a folder, sorted."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(root)
    return sorted(r["path"] for r in found.select("path").collect())  # one row a file


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_blocks(df: DataFrame, path: str, block: int = 512) -> None:
    """A grid as Parquet, partitioned by tiles, for tile-wise reads."""
    df.withColumns({"block_r": F.expr(f"int(row div {block})"), "block_c": F.expr(f"int(col div {block})")}).write.mode("overwrite").partitionBy("block_r", "block_c").parquet(path)


def report(title: str, values: dict) -> str:
    """A short Markdown report; floats with six decimals."""
    line = lambda k, v: f"- {k}: {v:.6f}" if isinstance(v, float) else f"- {k}: {v}"
    return "\n".join([f"# {title}", "", *(line(k, v) for k, v in values.items()), ""])


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """A small JSON document (parameters, label mappings), indented, as one text file."""
    spark.createDataFrame([(json.dumps(value, indent=2),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def write_report(spark: SparkSession, path: str, title: str, sections: dict[str, dict]) -> None:
    """A Markdown report of a stage: a heading for each section and its values below."""
    text = "\n".join([f"# {title}", "", *(line for name, values in sections.items() for line in (*report(name, values).replace("# ", "## ", 1).split("\n"),))])
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_mixture(model, path: str) -> None:
    """A fitted Gaussian mixture as a parameter table: (component, weight, mean, covariance row by row)."""
    rows = [(i, float(w), [float(v) for v in r["mean"]], [float(v) for v in r["cov"].toArray().ravel()]) for i, (w, r) in enumerate(zip(model.weights, model.gaussiansDF.collect()))]
    model.gaussiansDF.sparkSession.createDataFrame(rows, "component int, weight double, mean array<double>, covariance array<double>").write.mode("overwrite").parquet(path)
