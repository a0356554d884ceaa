"""Iterative models: k-means and its kin, mixtures, isolation forest, Ward."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.exprs import id_hash
from gridloom.functions.graphs import cut, shared_path

#: Entries of a tree's node; partitions whose subclusters are gathered at once.
BRANCHES, MERGED = 50, 8


def standardised(df: DataFrame, dims: int, of: DataFrame | None = None) -> DataFrame:
    """``df`` (id, x) with x scaled to mean 0 and population deviation 1 (0 counts as 1), its own or those ``of`` a sample."""
    one = (df if of is None else of).agg(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(dims)], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(dims)])
    scaled = F.array(*[(F.col("x")[i] - F.col(f"m{i}")) / F.when(F.col(f"s{i}") == 0, 1.0).otherwise(F.col(f"s{i}")) for i in range(dims)])
    return df.crossJoin(F.broadcast(one)).withColumn("x", scaled).select(*df.columns)  # one row of parameters


def scaler(df: DataFrame, names: list[str]) -> DataFrame:
    """(feature, mean, scale) of columns: population deviation, 1 where it is 0."""
    one = df.agg(*[f(F.col(n)).alias(f"{n}__{m}") for n in names for m, f in (("mean", F.avg), ("scale", F.stddev_pop))])
    rows = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"{n}__mean").alias("mean"), F.when(F.col(f"{n}__scale") == 0, 1.0).otherwise(F.col(f"{n}__scale")).alias("scale")) for n in names])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def parameters(table: DataFrame, names: list[str]) -> list[tuple[float, float]]:
    """(mean, scale) of each name from a persisted scaler, matched by name; raises for names it lacks and for scales of 0."""
    own = {r["feature"]: (r["mean"], r["scale"]) for r in table.where(F.col("feature").isin(names)).collect()}  # a row a feature
    missing = [n for n in names if n not in own]
    if missing:
        raise ValueError(f"the scaler has no {missing}")
    flat = [n for n in names if not own[n][1]]
    if flat:
        raise ValueError(f"scale 0 for {flat}")
    return [own[n] for n in names]


def scaled_columns(df: DataFrame, table: DataFrame, names: list[str], inverse: bool = False) -> DataFrame:
    """``df`` with each named column standardised by a persisted scaler, or put back into its own units."""
    put = {n: F.col(n) * s + m if inverse else (F.col(n) - m) / s for n, (m, s) in zip(names, parameters(table, names))}
    return df.withColumns(put)


def centroid_table(spark, centres: list[list[float]], names: list[str]) -> DataFrame:
    """(cluster, a column for each feature), the form in which centres are kept."""
    return spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(centres)], "cluster int, " + ", ".join(f"`{n}` double" for n in names))


def centroids(table: DataFrame, names: list[str]) -> list[list[float]]:
    """Centres in order of their cluster, features by name; the first column is the key, as in a table with an index."""
    key = table.columns[0]
    missing = [n for n in names if n not in table.columns]
    if missing:
        raise ValueError(f"the centroids have no {missing}")
    return [[float(r[n]) for n in names] for r in table.orderBy(key).collect()]  # k rows


def with_vector(df: DataFrame) -> DataFrame:
    """Ordered by id in a fixed number of partitions, so that a seed gives the same model again."""
    return df.repartitionByRange(4, "id").sortWithinPartitions("id").withColumn("features", array_to_vector("x"))


def kmeans(df: DataFrame, k: int, seeds=(42,), rounds: int = 50):
    """The model of least cost over ``seeds``."""
    data = with_vector(df).cache()
    try:
        fitted = [KMeans(k=k, seed=s, maxIter=rounds, initSteps=5).fit(data) for s in seeds]
    finally:
        data.unpersist()
    return min(fitted, key=lambda m: m.summary.trainingCost)


def mixture(df: DataFrame, k: int, seeds=(42,), rounds: int = 50):
    """Gaussian mixture with full covariances, of greatest likelihood over ``seeds``."""
    data = with_vector(df).cache()
    try:
        fitted = [GaussianMixture(k=k, seed=s, maxIter=rounds).fit(data) for s in seeds]
    finally:
        data.unpersist()
    return max(fitted, key=lambda m: m.summary.logLikelihood)


def information(log_likelihood: float, n: int, k: int, d: int) -> tuple[float, float]:
    """(BIC, AIC) of a full-covariance mixture."""
    p = k * d + k * d * (d + 1) // 2 + k - 1
    return p * math.log(n) - 2 * log_likelihood, 2 * p - 2 * log_likelihood


def assigned(df: DataFrame, centres: list[list[float]]) -> DataFrame:
    """``df`` (id, x) with cluster (nearest centre, lowest on ties) and its squared distance; centres are a k-row literal."""
    d = [F.aggregate(F.zip_with("x", F.array(*map(F.lit, map(float, c))), lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v) for c in centres]
    best = F.array_min(F.array(*[F.struct(v.alias("d"), F.lit(i).alias("c")) for i, v in enumerate(d)]))
    return df.withColumn("_b", best).withColumns({"cluster": F.col("_b.c"), "d2": F.col("_b.d")}).drop("_b")


def lloyd(df: DataFrame, centres: list[list[float]], rounds: int) -> list[list[float]]:
    """Centres after ``rounds`` steps from given ones; an empty cluster keeps its centre.  k rows reach the driver a step."""
    dims = len(centres[0])
    for _ in range(rounds):
        means = assigned(df, centres).groupBy("cluster").agg(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(dims)]).collect()
        for r in means:
            centres = [[r[f"m{i}"] for i in range(dims)] if c == r["cluster"] else own for c, own in enumerate(centres)]
    return centres


def minibatch(df: DataFrame, centres: list[list[float]], batch: int, rounds: int) -> list[list[float]]:
    """Mini-batch k-means: each step moves centres towards the means of a hash-drawn batch, at the rate of their share so far.

    All batches are dealt in one pass over the table and written by step, so a step reads its batch and nothing else.
    """
    n = df.count()
    limit = 4294967296 * min(1.0, batch / max(1, n))
    drawn = F.filter(F.sequence(F.lit(1), F.lit(rounds)), lambda step: id_hash(F.col("id") + 7919 * step) < limit)
    own, path = df.select("id", "x"), shared_path(df.sparkSession, "minibatch")
    own.withColumn("step", F.explode(drawn)).repartition("step").write.partitionBy("step").parquet(path)
    batches = df.sparkSession.read.schema(own.withColumn("step", F.lit(0)).schema).parquet(path)
    seen = [0] * len(centres)
    dims = len(centres[0])
    for step in range(1, rounds + 1):
        for r in assigned(batches.where(F.col("step") == step), centres).groupBy("cluster").agg(F.count("*").alias("n"), *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(dims)]).collect():
            c = r["cluster"]
            seen[c] += r["n"]
            rate = r["n"] / seen[c]
            centres = [[(1 - rate) * v + rate * r[f"m{i}"] for i, v in enumerate(own)] if k == c else own for k, own in enumerate(centres)]
    return centres


def spread_factor(n: int) -> float:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def isolation_tree(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple[int, float, int, int, float]]:
    """Nodes (feature or -1, cut, left, right, depth with the leaf's own factor)."""
    nodes: list[tuple[int, float, int, int, float]] = []

    def grow(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append((-1, 0.0, 0, 0, depth + spread_factor(len(rows))))
        low, high = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(1), np.zeros(1))
        open_ = np.flatnonzero(high > low)
        if depth < limit and len(rows) > 1 and len(open_):
            f = int(rng.choice(open_))
            cut = float(rng.uniform(low[f], high[f]))
            left = rows[:, f] < cut
            nodes[at] = (f, cut, grow(rows[left], depth + 1), grow(rows[~left], depth + 1), 0.0)
        return at

    grow(x, 0)
    return nodes


def isolation_scores(df: DataFrame, trees: int = 100, fit_rows: int = 50_000, seed: int = 42, fit: DataFrame | None = None) -> DataFrame:
    """``df`` (id, x) with isolation: 2 ** (-mean path / factor), larger = more isolated; trees of its own rows or of ``fit``.

    Each tree grows in a task of its own on at most 256 rows drawn by a hash; the forest, bounded by trees x 511 nodes,
    is broadcast and rows are scored in batches.
    """
    fit = df if fit is None else fit
    n = min(fit.count(), fit_rows)
    size = min(256, n)
    if not n:
        return df.withColumn("isolation", F.lit(None).cast("double"))
    base = fit.where(id_hash("id") < 4294967296 * min(1.0, fit_rows / max(n, 1))).select("id", "x")
    share = min(1.0, 2.0 * size / n)
    drawn = base.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).where(F.pmod(F.xxhash64("id", "tree", F.lit(seed)), F.lit(1_000_003)) < 1_000_003 * share)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rows = np.array(pdf.sort_values("id")["x"].tolist(), dtype=float)
        rng = np.random.default_rng([seed, tree])
        rows = rows[rng.permutation(len(rows))[:size]]
        nodes = isolation_tree(rows, rng, max(1, math.ceil(math.log2(max(2, size)))))
        return pd.DataFrame(nodes, columns=["feature", "cut", "left", "right", "depth"]).assign(tree=tree, node=range(len(nodes)))

    found = drawn.groupBy("tree").applyInPandas(build, "feature int, cut double, left int, right int, depth double, tree int, node int").orderBy("tree", "node").toPandas()
    forest = df.sparkSession.sparkContext.broadcast([g[["feature", "cut", "left", "right", "depth"]].to_numpy() for _, g in found.groupby("tree")])
    factor = max(spread_factor(size), 1e-9)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        rows = np.array(x.tolist(), dtype=float)
        total = np.zeros(len(rows))
        for nodes in forest.value:
            at = np.zeros(len(rows), int)
            while True:
                f = nodes[at, 0].astype(int)
                inner = np.flatnonzero(f >= 0)
                if not len(inner):
                    break
                go = rows[inner, f[inner]] < nodes[at[inner], 1]
                at[inner] = np.where(go, nodes[at[inner], 2], nodes[at[inner], 3]).astype(int)
            total += nodes[at, 4]
        return pd.Series(2.0 ** (-(total / len(forest.value)) / factor))

    return df.withColumn("isolation", score("x"))


def ward_merges(x: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """Labels 0 .. k-1 by Ward's method (each row counts ``weight`` times): chains of nearest neighbours, then the lowest merges."""
    n = len(x)
    centre, size, alive = x.astype(float).copy(), weight.astype(float).copy(), np.ones(n, bool)
    merges: list[tuple[float, int, int]] = []
    chain: list[int] = []
    while len(merges) < n - 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        i = chain[-1]
        d = ((centre - centre[i]) ** 2).sum(1) * (size * size[i] / (size + size[i]))
        d[~alive] = np.inf
        d[i] = np.inf
        j = int(d.argmin())
        if len(chain) > 1 and d[chain[-2]] <= d[j]:
            j = chain[-2]
            chain = chain[:-2]
            merges.append((float(d[j]), i, j))
            centre[i] = (size[i] * centre[i] + size[j] * centre[j]) / (size[i] + size[j])
            size[i] += size[j]
            alive[j] = False
        else:
            chain.append(j)
    label = np.arange(n)

    def top(v: int) -> int:
        while label[v] != v:
            v = label[v]
        return int(v)

    for _, i, j in sorted(merges, key=lambda m: m[0])[: max(0, n - k)]:
        a, b = sorted((top(i), top(j)))
        label[b] = a
    return np.unique([top(v) for v in range(n)], return_inverse=True)[1]


def ward(df: DataFrame, k: int) -> DataFrame:
    """(id, cluster) by Ward's method; every merge looks at all rows, so ``df`` is a sample of a size the caller bounds, and one task merges it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = np.array(pdf["x"].tolist(), dtype=float)
        return pd.DataFrame({"id": pdf["id"].to_numpy(), "cluster": ward_merges(x, np.ones(len(x)), k)})

    return df.select("id", "x", F.lit(1).alias("_one")).groupBy("_one").applyInPandas(run, "id long, cluster int")


class Features:
    """A node of a clustering-feature tree: entries (count, sum, sum of squared lengths), each above a node or a subcluster of its own."""

    def __init__(self, dims: int, leaf: bool) -> None:
        self.n, self.total, self.square = np.zeros(BRANCHES + 1), np.zeros((BRANCHES + 1, dims)), np.zeros(BRANCHES + 1)
        self.below: list[Features] | None = None if leaf else []
        self.size = 0

    def put(self, n: float, total: np.ndarray, square: float, below: Features | None = None) -> None:
        self.n[self.size], self.total[self.size], self.square[self.size] = n, total, square
        self.size += 1
        if below is not None:
            self.below.append(below)

    def gap(self, centre: np.ndarray) -> np.ndarray:
        """Squared distances of the entries' centres."""
        return ((self.total[: self.size] / self.n[: self.size, None] - centre) ** 2).sum(1)

    def whole(self) -> tuple[float, np.ndarray, float]:
        return self.n[: self.size].sum(), self.total[: self.size].sum(0), self.square[: self.size].sum()

    def add(self, n: float, total: np.ndarray, square: float, limit: float) -> Features | None:
        """Adds an entry; a node that has grown too large hands half of its entries to a new one, which is returned."""
        if self.size:
            at = int(self.gap(total / n).argmin())
            m, t, q = self.n[at] + n, self.total[at] + total, self.square[at] + square
            if self.below is None:
                if q / m - ((t / m) ** 2).sum() <= limit:
                    self.n[at], self.total[at], self.square[at] = m, t, q
                    return None
                self.put(n, total, square)
            else:
                half = self.below[at].add(n, total, square, limit)
                self.n[at], self.total[at], self.square[at] = (m, t, q) if half is None else self.below[at].whole()
                if half is not None:
                    self.put(*half.whole(), half)
        else:
            self.put(n, total, square)
        return self._halved() if self.size > BRANCHES else None

    def _halved(self) -> Features:
        """Entries go to the nearer of the two that are farthest apart."""
        centre = self.total[: self.size] / self.n[: self.size, None]
        d = ((centre[:, None] - centre[None]) ** 2).sum(2)
        a, b = np.unravel_index(int(d.argmax()), d.shape)
        far = d[:, b] < d[:, a]
        far[a], far[b] = False, True
        other, held = Features(centre.shape[1], self.below is None), [(self.n[i], self.total[i].copy(), self.square[i], None if self.below is None else self.below[i]) for i in range(self.size)]
        self.size, self.below = 0, None if self.below is None else []
        for entry, away in zip(held, far):
            (other if away else self).put(*entry)
        return other

    def leaves(self) -> list[Features]:
        return [self] if self.below is None else [x for b in self.below for x in b.leaves()]


def clustering_features(rows: np.ndarray, own: np.ndarray, squares: np.ndarray, threshold: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(count, sum, sum of squared lengths) of subclusters of radius ``threshold`` at most, by a tree.

    Each entry goes down to the nearest subcluster and joins it if that stays within the threshold; beyond ``most`` subclusters the
    threshold grows by half and the subclusters are gathered again, which bounds memory for any input.
    """
    root, count = Features(rows.shape[1], True), 0
    for i, (n, total, square) in enumerate(zip(own, rows, squares)):
        half = root.add(n, total, square, threshold**2 + 1e-12)
        if half is not None:
            above = Features(rows.shape[1], False)
            above.put(*root.whole(), root)
            above.put(*half.whole(), half)
            root = above
        count += 1
        if count > most:  # an upper bound of the subclusters; counted anew, it is seldom reached again
            leaves = root.leaves()
            count = sum(x.size for x in leaves)
            if count > most:
                held = [np.concatenate([getattr(x, c)[: x.size] for x in leaves]) for c in ("n", "total", "square")]
                rest = [np.concatenate([h, r[i + 1 :]]) for h, r in zip(held, (own, rows, squares))]
                return clustering_features(rest[1], rest[0], rest[2], threshold * 1.5, most)
    leaves = root.leaves()
    return *(np.concatenate([getattr(x, c)[: x.size] for x in leaves]) for c in ("n", "total", "square")), threshold


def birch(df: DataFrame, threshold: float, k: int, most: int = 500) -> DataFrame:
    """(id, cluster): each partition gathers its rows to at most ``most`` subclusters, ``MERGED`` partitions' subclusters are gathered
    to as many, again and again, Ward merges the last to ``k`` clusters, and each row takes the cluster of the nearest subcluster's centre.

    Rows are read in order of id; there are as many partitions as the session's shuffles have.  Subclusters depend on the order of
    arrival, so other partitions give slightly other ones.
    """
    schema = "part int, at int, n double, total array<double>, square double, threshold double"

    def out(part: int, found) -> pd.DataFrame:
        n, total, square, limit = found
        return pd.DataFrame({"part": part, "at": range(len(n)), "n": n, "total": list(total), "square": square, "threshold": limit})

    def gathered(batches):
        state = None
        for pdf in batches:
            x = np.array(pdf["x"].tolist(), dtype=float)
            rows, own, square, limit = x, np.ones(len(x)), (x * x).sum(1), threshold
            if state is not None:
                rows, own, square, limit = np.vstack([state[1], rows]), np.append(state[0], own), np.append(state[2], square), state[3]
            state = clustering_features(rows, own, square, limit, most)
        if state is not None:
            yield out(TaskContext.get().partitionId(), state)

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "at"])
        return out(int(pdf["part"].min()) // MERGED, clustering_features(np.array(pdf["total"].tolist()), pdf["n"].to_numpy(), pdf["square"].to_numpy(), float(pdf["threshold"].max()), most))

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = cut(df.select("id", "x").repartitionByRange(parts, "id").sortWithinPartitions("id").mapInPandas(gathered, schema))
    while parts > 1:
        found = cut(found.groupBy(F.floor(F.col("part") / MERGED).alias("some")).applyInPandas(lambda pdf: joined(pdf), schema))
        parts = -(-parts // MERGED)
    last = found.orderBy("part", "at").toPandas()  # at most ``most`` rows
    if last.empty:
        return df.select("id", F.lit(None).cast("int").alias("cluster"))
    n = last["n"].to_numpy()
    centre = np.array(last["total"].tolist()) / n[:, None]
    label = ward_merges(centre, n, k)

    @F.pandas_udf("int")
    def nearest(x: pd.Series) -> pd.Series:
        rows = np.array(x.tolist(), dtype=float)
        step = max(1, 1_000_000 // len(centre))
        at = [((rows[a : a + step, None] - centre[None]) ** 2).sum(2).argmin(1) for a in range(0, len(rows), step)]
        return pd.Series(label[np.concatenate(at)].astype(np.int32) if at else [], dtype="int32")

    return df.select("id", nearest("x").alias("cluster"))
