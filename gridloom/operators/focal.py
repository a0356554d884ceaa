"""Neighbourhood operators on a dense grid (row, col, values; null = no data).

A square neighbourhood is two passes of window frames, along the columns of each row and then along the rows of each
column, so a cell is never joined with its neighbours.  Cells outside the grid repeat its edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _line(along: str):
    across = "row" if along == "col" else "col"
    return Window.partitionBy(across).orderBy(along)


def edge_pass(df: DataFrame, along: str, radius: int, sums: list[str] = (), low: list[str] = (), high: list[str] = ()) -> DataFrame:
    """``df`` with sums, minima and maxima along one axis, all over one sort of its lines; the edge repeats in sums."""
    line = _line(along)
    frame, whole = line.rowsBetween(-radius, radius), line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.greatest(F.lit(0), radius - (F.col(along) - F.min(along).over(whole)))
    after = F.greatest(F.lit(0), radius - (F.max(along).over(whole) - F.col(along)))
    out = {n: F.sum(n).over(frame) + before * F.first(n).over(whole) + after * F.last(n).over(whole) for n in sums}
    return df.withColumns(out | {n: F.min(n).over(frame) for n in low} | {n: F.max(n).over(frame) for n in high})


def edge_square(df: DataFrame, radius: int, sums: list[str] = (), low: list[str] = (), high: list[str] = ()) -> DataFrame:
    """``df`` with columns replaced by their sum, minimum or maximum over the (2 radius + 1)² neighbourhood: one exchange an axis."""
    return edge_pass(edge_pass(df, "col", radius, sums, low, high), "row", radius, sums, low, high)


def spread_terms(bands: list[str]) -> dict[str, Column]:
    """What local spread is summed from: valid cells, their values and squares."""
    own = {}
    for b in bands:
        own |= {f"_n_{b}": F.when(F.col(b).isNull(), 0).otherwise(1), f"_s_{b}": F.coalesce(F.col(b), F.lit(0)), f"_q_{b}": F.coalesce(F.col(b) * F.col(b), F.lit(0))}
    return own


def range_terms(bands: list[str]) -> dict[str, Column]:
    return {f"_{k}_{b}": F.col(b) for k in ("lo", "hi") for b in bands}


def spread_of(b: str) -> Column:
    """Deviation of the valid cells around from their summed terms, 0 where there is none."""
    mean = lambda k: F.col(f"_{k}_{b}") / F.col(f"_n_{b}")
    return F.when(F.col(f"_n_{b}") > 0, F.sqrt(F.greatest(mean("q") - mean("s") * mean("s"), F.lit(0.0)))).otherwise(0.0)


def range_of(b: str) -> Column:
    return F.coalesce(F.col(f"_hi_{b}") - F.col(f"_lo_{b}"), F.lit(0)).cast("double")


def filled_of(b: str) -> Column:
    """The value, else the mean of the valid cells around, else 0."""
    return F.coalesce(F.col(b).cast("double"), F.when(F.col(f"_n_{b}") > 0, F.col(f"_s_{b}") / F.col(f"_n_{b}")), F.lit(0.0))


def local_std(df: DataFrame, bands: list[str], radius: int) -> DataFrame:
    """``df`` with band_local_std: spread of the valid cells around, 0 where there is none."""
    own = spread_terms(bands)
    return edge_square(df.withColumns(own), radius, list(own)).withColumns({f"{b}_local_std": spread_of(b) for b in bands}).drop(*own)


def local_range(df: DataFrame, bands: list[str], radius: int) -> DataFrame:
    """``df`` with band_local_range: largest less smallest valid cell around, 0 where there is none."""
    own = range_terms(bands)
    df = edge_square(df.withColumns(own), radius, low=[f"_lo_{b}" for b in bands], high=[f"_hi_{b}" for b in bands])
    return df.withColumns({f"{b}_local_range": range_of(b) for b in bands}).drop(*own)


def filled(df: DataFrame, bands: list[str], radius: int) -> DataFrame:
    """``df`` with band_filled: the value, else the mean of the valid cells around, else 0."""
    own = {k: c for k, c in spread_terms(bands).items() if not k.startswith("_q_")}
    return edge_square(df.withColumns(own), radius, list(own)).withColumns({f"{b}_filled": filled_of(b) for b in bands}).drop(*own)


def _slope(v: str, along: str, step: float) -> Column:
    line = _line(along)
    before, after = F.lag(v).over(line), F.lead(v).over(line)
    return F.when(before.isNull(), (after - F.col(v)) / step).when(after.isNull(), (F.col(v) - before) / step).otherwise((after - before) / (2 * step))


def _length(x: str, y: str) -> Column:
    return F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y))


def _around(v: str, along: str) -> Column:
    """Sum of both neighbours along an axis, the cell itself beyond the edge."""
    return F.coalesce(F.lag(v).over(_line(along)), F.col(v)) + F.coalesce(F.lead(v).over(_line(along)), F.col(v))


def _square_step(step_x: float, step_y: float) -> float:
    return max((abs(step_x) + abs(step_y)) / 2, 1.0) ** 2


def gradient(df: DataFrame, v: str, out: str, step_x: float, step_y: float) -> DataFrame:
    """``df`` with the length of the gradient of ``v`` (no nulls): central differences, one-sided at the edge."""
    df = df.withColumn("_gy", _slope(v, "row", step_y)).withColumn("_gx", _slope(v, "col", step_x))
    return df.withColumn(out, _length("_gx", "_gy")).drop("_gx", "_gy")


def curvature(df: DataFrame, v: str, out: str, step_x: float, step_y: float) -> DataFrame:
    """``df`` with the five-point Laplacian of ``v`` over the squared mean step (1 at least)."""
    df = df.withColumn("_v", _around(v, "row")).withColumn("_h", _around(v, "col"))
    return df.withColumn(out, (F.col("_h") + F.col("_v") - 4 * F.col(v)) / _square_step(step_x, step_y)).drop("_h", "_v")


def derived(df: DataFrame, radius: int, step_x: float, step_y: float) -> DataFrame:
    """All twelve neighbourhood features of the five bands.

    Three exchanges of the grid: lines of rows, lines of columns (where the differences along columns follow at once), and
    lines of rows again for the other differences.
    """
    spread, extent, fill = ["radar", "height", "emissivity", "slope", "reflectivity"], ["radar", "height", "emissivity", "reflectivity"], ["height", "radar"]
    sums, ranges = spread_terms(spread), range_terms(extent)
    df = edge_square(df.withColumns(sums | ranges), radius, list(sums), [f"_lo_{b}" for b in extent], [f"_hi_{b}" for b in extent])
    df = df.withColumns({f"{b}_local_std": spread_of(b) for b in spread} | {f"{b}_local_range": range_of(b) for b in extent} | {f"_{b}": filled_of(b) for b in fill}).drop(*sums, *ranges)
    df = df.withColumns({"_v": _around("_height", "row")} | {f"_gy_{b}": _slope(f"_{b}", "row", step_y) for b in fill})
    df = df.withColumns({"_h": _around("_height", "col")} | {f"_gx_{b}": _slope(f"_{b}", "col", step_x) for b in fill})
    df = df.withColumn("height_curvature", (F.col("_h") + F.col("_v") - 4 * F.col("_height")) / _square_step(step_x, step_y))
    df = df.withColumns({f"{b}_gradient": _length(f"_gx_{b}", f"_gy_{b}") for b in ("radar", "height")})
    return df.drop("_h", "_v", *[f"_{k}{b}" for k in ("", "gx_", "gy_") for b in fill])


def majority(df: DataFrame, k: int = 4, out: str = "smoothed") -> DataFrame:
    """``df`` (row, col, cluster) with the most frequent cluster of the 3 x 3 cells; lowest wins ties, no data stays so."""
    names = [f"_c{i}" for i in range(k)]
    df = df.withColumns({n: F.when(F.col("cluster") == i, 1).otherwise(0) for i, n in enumerate(names)})
    for along in ("col", "row"):
        df = df.withColumns({n: F.sum(n).over(_line(along).rowsBetween(-1, 1)) for n in names})
    top = F.greatest(*names)
    best = F.lit(None).cast("int")
    for i in range(k - 1, -1, -1):
        best = F.when(F.col(names[i]) == top, F.lit(i)).otherwise(best)
    return df.withColumn(out, F.when(F.col("cluster").isNotNull(), best)).drop(*names)
