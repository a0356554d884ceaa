"""Exact-size, stratified and top-share samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.exprs import id_hash, ordinal
from gridloom.operators.samples import allocation, exact_sample, stratified
from gridloom.registry import query
from gridloom.sources.tables import grid, table

BLOCKS = """blocks AS (SELECT CAST(("row" // 16) * 4 + col // 8 AS BIGINT) AS block, "row", col FROM grid WHERE radar IS NOT NULL),
    sized AS (SELECT block, CAST(count(*) AS BIGINT) AS n FROM blocks GROUP BY block),
    exact AS (SELECT block, n, n * 200.0::DOUBLE / (SELECT sum(n) FROM sized) AS e FROM sized),
    ranked AS (SELECT *, row_number() OVER (ORDER BY e - floor(e) DESC, block DESC) AS i FROM exact),
    allocated AS (SELECT block, n, CAST(floor(e) + CASE WHEN i <= 200 - (SELECT sum(floor(e)) FROM exact) THEN 1 ELSE 0 END AS BIGINT) AS take FROM ranked)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir).where("radar is not null").select(F.expr("(row div 16) * 4 + col div 8").cast("long").alias("block"), "row", "col")


@query("block_counts", f"WITH {BLOCKS} SELECT block, n FROM sized")
def block_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).groupBy("block").agg(F.count("*").alias("n"))


@query("allocation_largest_remainder", f"WITH {BLOCKS} SELECT block, n, take FROM allocated")
def allocation_largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return allocation(block_counts(spark, sf_dir), 200)


@query("allocation_order", f"WITH {BLOCKS} SELECT block, CAST(i AS INTEGER) AS position FROM ranked")
def allocation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = block_counts(spark, sf_dir)
    e = F.col("n") * 200.0 / F.col("total")
    out = n.crossJoin(n.agg(F.sum("n").alias("total"))).withColumn("e", e)  # one row of totals
    return out.select("block", F.row_number().over(Window.orderBy(F.desc(F.col("e") - F.floor("e")), F.desc("block"))).cast("int").alias("position"))


@query("stratified_sample", f"""WITH {BLOCKS} SELECT block, "row", col FROM (SELECT b.*, row_number() OVER (PARTITION BY block ORDER BY ((b."row" * 30 + b.col) * 2654435761) % 4294967296) AS i FROM blocks b) JOIN allocated USING (block) WHERE i <= take""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified(blocks(spark, sf_dir), 200, id_hash(F.col("row") * 30 + F.col("col"))).select("block", "row", "col")


@query("sample_exact_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY (o_orderkey * 2654435761) % 4294967296 LIMIT 500")
def sample_exact_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), id_hash("o_orderkey"), 500)


@query("exact_subset", "SELECT event_id FROM (SELECT event_id FROM events ORDER BY (event_id * 2654435761) % 4294967296 LIMIT 300)")
def exact_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_sample(table(spark, sf_dir, "events").select("event_id"), id_hash("event_id"), 300).orderBy("event_id")


@query("sample_then_valid", """WITH drawn AS (SELECT * FROM grid WHERE radar IS NOT NULL ORDER BY ("row" * 30 + col) * 2654435761 % 4294967296 LIMIT 150) SELECT "row", col, radar FROM drawn WHERE slope > 1""")
def sample_then_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn among valid cells of the first band; companions are tested afterwards, so fewer may stay."""
    g = grid(spark, sf_dir).where("radar is not null")
    return exact_sample(g, id_hash(F.col("row") * 30 + F.col("col")), 150).where("slope > 1").select("row", "col", "radar")


@query("top_percent", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT (SELECT greatest(1, CAST(round_even(0.01::DOUBLE * count(*), 0) AS BIGINT)) FROM events)")
def top_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top hundredth, one row at least."""
    e = table(spark, sf_dir, "events").select("event_id", "value")
    n = max(1, round(0.01 * e.count()))  # grows with the table, so rows are numbered along range partitions
    return ordinal(e, [F.desc("value"), F.col("event_id")]).where(F.col("ordinal") <= n).drop("ordinal")
