"""Agreement and quality of labellings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.exprs import id_hash, ratio
from gridloom.operators.samples import exact_sample


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def pairs_of(n: Column) -> Column:
    return n * (n - 1) / 2


def adjusted_rand(table: DataFrame) -> DataFrame:
    """One row ``ari`` from a contingency table (a, b, n); 1 where both labellings are trivial in the same way."""
    cells = table.agg(F.sum(pairs_of(F.col("n"))).alias("s"), F.sum("n").alias("all"))
    rows = table.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(pairs_of(F.col("n"))).alias("ra"))
    cols = table.groupBy("b").agg(F.sum("n").alias("n")).agg(F.sum(pairs_of(F.col("n"))).alias("cb"))
    expected = F.try_divide(F.col("ra") * F.col("cb"), pairs_of(F.col("all")))
    one = cells.crossJoin(rows).crossJoin(cols)  # one row each
    return one.select(F.coalesce(ratio(F.col("s") - expected, (F.col("ra") + F.col("cb")) / 2 - expected), F.lit(1.0)).alias("ari"))


def assignment(cost: list[list[int]]) -> list[int]:
    """The column of each row in an assignment of least cost (exact whole numbers, a square table); rows join one by one along shortest paths."""
    k = len(cost)
    of_column = [-1] * k  # row that holds a column
    row_price, column_price = [0] * k, [0] * k
    for row in range(k):
        least, back, done = [None] * k, [-1] * k, [False] * k
        at, column = row, -1
        while True:
            for j in range(k):
                if not done[j]:
                    slack = cost[at][j] - row_price[at] - column_price[j]
                    if least[j] is None or slack < least[j]:
                        least[j], back[j] = slack, column
            nearest_one = min((j for j in range(k) if not done[j]), key=lambda j: least[j])
            step = least[nearest_one]
            row_price[row] += step
            for j in range(k):
                if done[j]:
                    row_price[of_column[j]] += step
                    column_price[j] -= step
                else:
                    least[j] -= step
            column = nearest_one
            done[column] = True
            at = of_column[column]
            if at < 0:
                break
        while column >= 0:  # every row on the path moves one column on
            before = back[column]
            of_column[column] = of_column[before] if before >= 0 else row
            column = before
    out = [0] * k
    for j, i in enumerate(of_column):
        out[i] = j
    return out


def aligned(table: DataFrame, k: int) -> DataFrame:
    """(candidate, reference): the relabelling of b that keeps most rows on the diagonal.

    Of several best ones the first in order of the candidates of references 0, 1, ...: their numbers are a second part of the
    cost, below one row.  The k x k counts reach the driver.
    """
    found = {(r["a"], r["b"]): r["n"] for r in table.where(F.col("a").between(0, k - 1) & F.col("b").between(0, k - 1)).groupBy("a", "b").agg(F.sum("n").cast("long").alias("n")).collect()}
    one = k**k
    cost = [[c * k ** (k - 1 - r) - found.get((r, c), 0) * one for c in range(k)] for r in range(k)]
    return table.sparkSession.createDataFrame([(c, r) for r, c in enumerate(assignment(cost))], "candidate int, reference int")


def centres(df: DataFrame, label: str, x: str, dims: int) -> DataFrame:
    """(label, n, centre: array<double>): mean of each cluster."""
    return df.groupBy(F.col(label).alias("c")).agg(F.count("*").alias("n"), F.array(*[F.avg(F.col(x)[i]) for i in range(dims)]).alias("centre"))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))


def davies_bouldin(df: DataFrame, label: str, x: str, dims: int) -> DataFrame:
    """One row ``davies_bouldin``; centres are one row a cluster."""
    c = centres(df, label, x, dims)
    spread = df.join(F.broadcast(c), F.col(label) == F.col("c")).groupBy("c").agg(F.avg(distance(F.col(x), F.col("centre"))).alias("s"), F.first("centre").alias("centre"))
    other = spread.select(F.col("c").alias("c2"), F.col("s").alias("s2"), F.col("centre").alias("centre2"))
    worst = spread.join(other, F.col("c") != F.col("c2")).groupBy("c").agg(F.max((F.col("s") + F.col("s2")) / distance(F.col("centre"), F.col("centre2"))).alias("r"))
    return worst.agg(F.avg("r").alias("davies_bouldin"))


def silhouette(df: DataFrame, label: str, x: str, rows: int = 2_000) -> DataFrame:
    """One row ``silhouette`` (Euclidean) of (id, label, x): the mean over at most ``rows`` rows, drawn by a hash, each against all rows.

    The drawn rows are the stated queries; each task sums its rows' distances to them by cluster, so what is shuffled grows with
    the tasks.  A row alone in its cluster counts 0; null with fewer than two clusters.
    """
    drawn = exact_sample(df.select("id", F.col(label).alias("l"), F.col(x).alias("x")), id_hash("id"), rows).toPandas()
    asked, ids, labels = np.array(drawn["x"].tolist(), dtype=float), drawn["id"].tolist(), drawn["l"].tolist()

    def summed(batches):
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            own, of = np.array(pdf["x"].tolist(), dtype=float), pdf["l"].to_numpy()
            for c in np.unique(of):
                part, total[c] = own[of == c], total.get(c, np.zeros(len(asked)))
                for a in range(0, len(part), 1_000):
                    total[c] += np.sqrt(((asked[:, None] - part[None, a : a + 1_000]) ** 2).sum(2)).sum(1)
        for c, d in total.items():
            yield pd.DataFrame({"i": ids, "li": labels, "lj": c, "d": d})

    if not len(drawn):
        return df.sparkSession.createDataFrame([(None,)], "silhouette double")
    sums = df.select(F.col(label).alias("l"), F.col(x).alias("x")).mapInPandas(summed, "i long, li long, lj long, d double").groupBy("i", "li", "lj").agg(F.sum("d").alias("d"))
    sizes = F.broadcast(df.groupBy(F.col(label).cast("long").alias("lj")).agg(F.count("*").alias("n")))  # a row a cluster
    inside = F.col("li") == F.col("lj")
    both = sums.join(sizes, "lj").groupBy("i").agg(F.max(F.when(inside, F.try_divide("d", F.col("n") - 1))).alias("a"), F.max(F.when(inside, F.col("n"))).alias("own"), F.min(F.when(~inside, F.col("d") / F.col("n"))).alias("b"))
    return both.agg(F.avg(F.when(F.col("b").isNotNull(), F.when(F.col("own") == 1, 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))))).alias("silhouette"))


def rand_pairs(df: DataFrame, names: list[str]) -> DataFrame:
    """(a, b, ari) of each pair of label columns, all contingency tables in one pass."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    both = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")) for a, b in pairs]))
    n = df.select(both.alias("p")).select("p.*").groupBy("a", "b", "x", "y").agg(F.count("*").alias("n"))
    rows = n.groupBy("a", "b", "x").agg(F.sum("n").alias("n")).groupBy("a", "b").agg(F.sum(pairs_of(F.col("n"))).alias("ra"))
    cols = n.groupBy("a", "b", "y").agg(F.sum("n").alias("n")).groupBy("a", "b").agg(F.sum(pairs_of(F.col("n"))).alias("cb"))
    one = n.groupBy("a", "b").agg(F.sum(pairs_of(F.col("n"))).alias("s"), F.sum("n").alias("all")).join(rows, ["a", "b"]).join(cols, ["a", "b"])
    expected = F.try_divide(F.col("ra") * F.col("cb"), pairs_of(F.col("all")))
    return one.select("a", "b", F.coalesce(ratio(F.col("s") - expected, (F.col("ra") + F.col("cb")) / 2 - expected), F.lit(1.0)).alias("ari"))


def stability_verdict(mean: Column, low: Column) -> Column:
    """What agreement over seeds says about a clustering."""
    # The verdicts' words and limits.
    return F.when((mean >= 0.9) & (low >= 0.8), "VERY STRONG").when((mean >= 0.75) & (low >= 0.6), "GOOD").when(mean >= 0.5, "MODERATE").otherwise("WEAK")


def votes(labels: Column, k: int) -> Column:
    """How many models chose each label."""
    count = lambda c: F.size(F.filter(labels, lambda v: v == c))
    return F.array(*[count(c) for c in range(k)])

