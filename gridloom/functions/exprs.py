"""Column expressions used all over the engine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.graphs import cut

#: Radius of the sphere in metres.
RADIUS = 6_051_000.0


def r6(c) -> Column:
    """Rounded to six decimals, which evens out the last bits of different engines."""
    return F.round(c, 6)


def ratio(a, b) -> Column:
    """a / b as double, null for b = 0."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def valid(v, nodata: float | None = None) -> Column:
    """The value, or null where it is not finite or equals ``nodata`` (if that is finite itself)."""
    v = _c(v)
    bad = F.isnan(v) | (F.abs(v) == float("inf"))
    if nodata is not None and nodata == nodata and abs(nodata) != float("inf"):
        bad = bad | (v == nodata)
    return F.when(~bad, v)


def argmax(names: list[str], values: list[Column]) -> tuple[Column, Column]:
    """(name, value) of the largest value; nulls are skipped, the first of equal ones wins."""
    top = F.greatest(*values)
    name = reduce(lambda rest, nv: F.when(nv[1] == top, F.lit(nv[0])).otherwise(rest), list(zip(names, values))[::-1], F.lit(None))
    return name, top


def square_distance(xs: list[Column], centre: list[float]) -> Column:
    return reduce(lambda a, b: a + b, [(x - c) * (x - c) for x, c in zip(xs, centre)])


def nearest(distances: list[Column]) -> Column:
    """Number of the smallest distance, lowest first."""
    low = F.least(*distances)
    return reduce(lambda rest, i: F.when(distances[i] == low, F.lit(i)).otherwise(rest), range(len(distances) - 1, -1, -1), F.lit(None).cast("int"))


def softmax(distances: Column, temperature: float = 1.0) -> Column:
    """Probabilities exp(-d / T) over an array of distances, shifted by the smallest."""
    t = max(temperature, 1e-9)
    e = F.transform(distances, lambda d: F.exp(-(d - F.array_min(distances)) / t))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def entropy(p: Column, k: int) -> Column:
    """Entropy of an array of probabilities over the logarithm of ``k``."""
    return F.aggregate(p, F.lit(0.0), lambda s, x: s - x * F.ln(F.greatest(x, F.lit(1e-12)))) / F.ln(F.lit(float(k)))


def mapped(key, table: dict) -> Column:
    """A code looked up in a fixed table; null for unknown codes."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), _c(key))


def running(df: DataFrame, keys: list[Column], amount: Column, name: str, parts: int | None = None) -> DataFrame:
    """``df`` with the sum of ``amount`` over the rows up to and with each one in the order of ``keys`` (which must be unique).

    No window over all rows: range partitions (``parts``, or as many as the session's shuffles have) are summed inside and shifted by the sums of those before.  The partitions are
    written once, for the borders of a range partitioning are drawn anew whenever it is computed.
    """
    dealt = cut(df.repartitionByRange(*([parts] if parts else []), *keys).withColumns({"_p": F.spark_partition_id(), "_a": amount}))
    sizes = dealt.groupBy("_p").agg(F.sum("_a").alias("_n"))  # one row a partition
    shift = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = dealt.withColumn("_i", F.sum("_a").over(Window.partitionBy("_p").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)))
    return inside.join(F.broadcast(shift), "_p").withColumn(name, F.col("_i") + F.col("_before")).drop("_p", "_a", "_i", "_before")


def ordinal(df: DataFrame, keys: list[Column], name: str = "ordinal", parts: int | None = None) -> DataFrame:
    """``df`` with its 1-based position in the order of ``keys`` (which must be unique)."""
    return running(df, keys, F.lit(1).cast("long"), name, parts)


def reference_share(df: DataFrame, ref: DataFrame, c: str, out: str, parts: int | None = None) -> DataFrame:
    """``df`` with the share of ``ref``'s values of ``c`` at or below its own: a running count over distinct values."""
    own = ref.groupBy(F.col(c).alias("_v")).agg(F.count("*").alias("_n"))
    steps = own.unionByName(df.select(F.col(c).alias("_v")).distinct().withColumn("_n", F.lit(0).cast("long"))).groupBy("_v").agg(F.sum("_n").alias("_n"))
    upto = running(steps, [F.col("_v")], F.col("_n"), "_c", parts).select("_v", "_c")
    total = F.broadcast(ref.agg(F.count("*").alias("_all")))  # one row
    return df.join(upto, F.col(c) == F.col("_v")).crossJoin(total).withColumn(out, ratio("_c", "_all")).drop("_v", "_c", "_all")


def id_hash(c) -> Column:
    """A draw in 0 .. 2**32 - 1 that any engine can repeat."""
    return F.pmod(_c(c).cast("long") * F.lit(2654435761), F.lit(4294967296))
