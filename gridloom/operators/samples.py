"""Deterministic samples of exact size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Ranges into which draws are counted at once; draws are whole numbers below ``DRAWS``.
RANGES, DRAWS = 1 << 16, 1 << 32


def exact_sample(df: DataFrame, draw: Column, n: int) -> DataFrame:
    """The ``n`` rows with the smallest draw (whole numbers in 0 .. 2**32 - 1, null before all): exact and repeatable.

    Rows are first counted by range of their draw, again inside the range that holds the n-th one as long as that holds
    more than ``n`` rows; only rows up to its end are then ordered, so no task sees more than about twice ``n`` of them.
    """
    own = df.withColumn("_d", F.coalesce(draw.cast("long") + 1, F.lit(0).cast("long")))
    low, width, left = 0, 2 * DRAWS, n
    while True:
        step = max(1, width // RANGES)
        inside = own.where((F.col("_d") >= low) & (F.col("_d") < low + width))
        counts = sorted(tuple(r) for r in inside.groupBy(F.floor((F.col("_d") - low) / step).alias("i")).agg(F.count("*")).collect())  # a row a range
        for i, rows in counts:
            if rows >= left:
                break
            left -= rows
        else:
            return df.select(*df.columns)  # no more than ``n`` rows in all
        low, width = low + i * step, step
        if rows <= n or step == 1:
            return own.where(F.col("_d") < low + width).orderBy("_d").limit(n).drop("_d")


def allocation(sizes: DataFrame, total: int) -> DataFrame:
    """``sizes`` (block, n) with take: shares of ``total`` by largest remainder, later blocks first on equal remainders.

    The query fails if there are fewer rows than ``total``.
    """
    few = F.raise_error(F.concat(F.lit(f"{total} rows asked for, there are "), F.sum("n"))).cast("long")
    whole = sizes.agg(F.when(F.sum("n") >= total, F.sum("n")).otherwise(few).alias("_all"))
    exact = sizes.crossJoin(whole).withColumn("_e", F.col("n") * float(total) / F.col("_all"))  # one row of totals
    left = exact.agg((F.lit(total) - F.sum(F.floor("_e"))).alias("_left"))
    # one row a block, far fewer than cells
    order = F.row_number().over(Window.orderBy(F.desc(F.col("_e") - F.floor("_e")), F.desc("block")))
    out = exact.withColumn("_i", order).crossJoin(left)
    return out.select("block", "n", (F.floor("_e") + F.when(F.col("_i") <= F.col("_left"), 1).otherwise(0)).cast("long").alias("take"))


def stratified(df: DataFrame, total: int, draw: Column) -> DataFrame:
    """Rows of ``df`` (with a column block), as many of each block as its share of ``total``, by smallest draw."""
    take = allocation(df.groupBy("block").agg(F.count("*").alias("n")), total)
    ranked = df.withColumn("_i", F.row_number().over(Window.partitionBy("block").orderBy(draw)))
    return ranked.join(take, "block").where(F.col("_i") <= F.col("take")).drop("_i", "n", "take")
