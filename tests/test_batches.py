"""BIRCH's tree and mini-batches against plain numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import models
from gridloom.operators.metrics import adjusted_rand, contingency


def groups(n=900, seed=3):
    rng = np.random.default_rng(seed)
    return np.vstack([rng.normal(c, 0.3, (n // 3, 3)) for c in ((0, 0, 0), (4, 0, 0), (0, 5, 1))])[rng.permutation(n)]


def frame(spark, x):
    return spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "id long, x array<double>")


@pytest.mark.parametrize("threshold,most", [(0.5, 500), (0.05, 500), (0.01, 40), (0.0, 2_000)])
def test_tree_keeps_every_row_within_the_threshold(threshold, most):
    x = groups()
    n, total, square, limit = models.clustering_features(x, np.ones(len(x)), (x * x).sum(1), threshold, most)
    assert n.sum() == len(x) and np.allclose(total.sum(0), x.sum(0)) and np.isclose(square.sum(), (x * x).sum()) and len(n) <= most
    radius = np.sqrt(np.maximum(0, square / n - ((total / n[:, None]) ** 2).sum(1)))
    assert radius.max() <= limit + 1e-5 and limit >= threshold
    if not threshold:
        assert len(n) == len(np.unique(x, axis=0))


def test_clusters_hardly_depend_on_the_partitions(spark):
    df, found = frame(spark, groups()), []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (1, 4, 20):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            found.append(models.birch(df, 0.4, 3).select("id", F.col("cluster").alias(f"c{parts}")).toPandas())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    both = found[0].merge(found[1], on="id").merge(found[2], on="id")
    labels = spark.createDataFrame(both.astype(int).values.tolist(), "id long, c1 int, c4 int, c20 int")
    for other in ("c4", "c20"):
        assert adjusted_rand(contingency(labels, "c1", other)).first()[0] > 0.97
    assert models.birch(df.limit(0), 0.4, 3).count() == 0


def test_minibatch_against_numpy(spark):
    x, centres = groups(600), [[0.5, 0.5, 0.0], [3.0, 0.0, 0.0], [0.0, 3.0, 0.0]]
    got = models.minibatch(frame(spark, x), centres, 100, 6)
    own, seen = np.array(centres), np.zeros(3)
    for step in range(1, 7):
        drawn = x[[(i + 7919 * step) * 2654435761 % 2**32 < 2**32 * 100 / 600 for i in range(600)]]
        label = ((drawn[:, None] - own[None]) ** 2).sum(2).argmin(1)
        for c in np.unique(label):
            part = drawn[label == c]
            seen[c] += len(part)
            own[c] += (part.mean(0) - own[c]) * len(part) / seen[c]
    assert np.allclose(got, own)
