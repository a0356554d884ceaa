"""Profiles of columns: one pass, then one row a feature."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.exprs import r6, running


def long(df: DataFrame, names: list[str]) -> DataFrame:
    """(feature, value) of each row and column."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names])).alias("s")).select("s.feature", "s.value")


def wide_to_rows(one: DataFrame, names: list[str], measures: list[str]) -> DataFrame:
    """One row of feature__measure columns as a row for each feature."""
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), *[F.col(f"{n}__{m}").alias(m) for m in measures]) for n in names])).alias("s")).select("s.*")


def profile(df: DataFrame, names: list[str], measures: dict) -> DataFrame:
    """A row for each feature with each measure (name -> function of a column); a single aggregate over the input."""
    one = df.agg(*[f(F.col(n)).alias(f"{n}__{m}") for n in names for m, f in measures.items()])
    return wide_to_rows(one, names, list(measures))


def quantiles_by(rows: DataFrame, at: list[float]) -> DataFrame:
    """(feature, p, value): exact quantiles (linear between neighbours) of each feature of ``rows`` (feature, value); nulls do not count.

    Values are counted by distinct value and the counts summed along range partitions, so no task holds a whole column or
    group; the two values around each position are then picked out.
    """
    counted = rows.where("value is not null").groupBy("feature", "value").agg(F.count("*").alias("n"))
    upto = running(counted, [F.col("feature"), F.col("value")], F.col("n"), "upto").select("feature", "value", "n", "upto")
    totals = upto.groupBy("feature").agg((F.max("upto") - F.min(F.col("upto") - F.col("n"))).alias("all"), F.min(F.col("upto") - F.col("n")).alias("before"))  # a row a feature
    spots = totals.select("feature", "before", F.explode(F.array(*map(F.lit, at))).alias("p"), "all").withColumn("spot", F.col("p") * (F.col("all") - 1))
    spots = spots.withColumns({"low": F.floor("spot") + F.col("before"), "high": F.ceil("spot") + F.col("before")}).withColumnRenamed("feature", "of")
    holds = lambda c: (F.col("upto") - F.col("n") <= F.col(c)) & (F.col(c) < F.col("upto"))
    met = upto.join(spots, F.col("feature").eqNullSafe(F.col("of"))).where(holds("low") | holds("high"))
    one = met.groupBy("feature", "p", "spot").agg(F.max(F.when(holds("low"), F.col("value"))).alias("a"), F.max(F.when(holds("high"), F.col("value"))).alias("b"))
    part = F.col("spot") - F.floor("spot")
    return one.select("feature", "p", (F.col("a") * (1 - part) + F.col("b") * part).alias("value"))


def quantiles(df: DataFrame, names: list[str], at: list[float]) -> DataFrame:
    """(feature, p, value): exact quantiles of each of the columns ``names``."""
    return quantiles_by(long(df, names), at)


def quantile_columns(df: DataFrame, names: list[str], named: dict[str, float]) -> DataFrame:
    """A row for each feature with its quantiles as columns."""
    found = quantiles(df, names, list(named.values()))
    return found.groupBy("feature").agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(k) for k, p in named.items()])


#: Measures of an exact description, besides quantiles.
DESCRIBE = {"n": F.count, "mean": lambda c: F.round(F.avg(c), 8), "std": lambda c: r6(F.stddev_samp(c)), "lowest": lambda c: F.min(c).cast("double"), "highest": lambda c: F.max(c).cast("double")}
