"""Connected components of a table of links, for the grid operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; in local mode, where it is unset, one in the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/gridloom"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read again from the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read again; smaller than ``cut`` where rows are many and narrow."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); a component is named by its smallest node.

    Each round every node takes the smallest label around it, then its label's label; rounds grow with the logarithm of
    the longest path, for labels jump.
    """
    both = cut(links.where("a <> b").select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        own = labels.join(around, "node").select("node", "label", F.least("label", "m").alias("low"))
        # hang the old label's node below the new one as well, then jump
        hung = own.select(F.col("label").alias("node"), "low").unionByName(own.select("node", "low")).groupBy("node").agg(F.min("low").alias("low"))
        jump = hung.select(F.col("node").alias("low"), F.col("low").alias("next"))
        new = cut(hung.join(jump, "low").select("node", F.col("next").alias("label")))
        if new.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").isEmpty():
            return new.select("node", F.col("label").alias("component"))
        labels = new
