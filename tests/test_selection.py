"""Exact samples, quantiles by group and label alignment against brute force."""

from __future__ import annotations

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from gridloom.functions.exprs import id_hash
from gridloom.operators import samples
from gridloom.operators.metrics import aligned, assignment
from gridloom.operators.profiles import quantiles_by


def test_exact_samples(spark, monkeypatch):
    df = spark.range(20_000)
    want = sorted(range(20_000), key=lambda i: i * 2654435761 % 2**32)
    for ranges in (1 << 16, 4):  # few ranges are counted again and again
        monkeypatch.setattr(samples, "RANGES", ranges)
        for n in (1, 17, 2_000, 19_999):
            assert {r[0] for r in samples.exact_sample(df, id_hash("id"), n).collect()} == set(want[:n])
    assert samples.exact_sample(df, id_hash("id"), 30_000).count() == 20_000
    assert samples.exact_sample(df.limit(0), id_hash("id"), 5).count() == 0
    # equal draws at the end: as many rows as asked for; null draws come first
    tied = df.limit(100).withColumn("d", F.when(F.col("id") >= 3, F.lit(7)))
    got = {r[0] for r in samples.exact_sample(tied, F.col("d"), 10).collect()}
    assert len(got) == 10 and {0, 1, 2} <= got
    one = df.withColumn("d", F.lit(5))
    assert samples.exact_sample(one, F.col("d"), 10).count() == 10


def test_quantiles_by_group(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(v)) for g in ("a", "b", None) for v in rng.integers(0, 50, 301)] + [("c", 3.0), ("d", None), ("a", None)]
    got = {(r["feature"], r["p"]): r["value"] for r in quantiles_by(spark.createDataFrame(rows, "feature string, value double"), [0.0, 0.25, 0.5, 1.0]).collect()}
    for g in ("a", "b", None, "c"):
        own = [v for k, v in rows if k == g and v is not None]
        for p in (0.0, 0.25, 0.5, 1.0):
            assert abs(got[g, p] - np.quantile(own, p)) < 1e-9
    assert ("d", 0.5) not in got


def test_assignment_is_optimal_and_first_of_equals(spark):
    rng = random.Random(4)
    for k in (1, 2, 3, 5, 6):
        for top in (2, 50):
            counts = [[rng.randrange(top) for _ in range(k)] for _ in range(k)]
            best = max(itertools.permutations(range(k)), key=lambda p: (sum(counts[r][p[r]] for r in range(k)), [-c for c in p]))
            table = spark.createDataFrame([(r, c, counts[r][c]) for r in range(k) for c in range(k)], "a int, b int, n long")
            assert sorted(map(tuple, aligned(table, k).select("reference", "candidate").collect())) == list(enumerate(best))
    # twelve labels with ties: a shifted diagonal and many equal counts
    k = 12
    counts = [[10 if c == (r + 3) % k else 9 if (r + c) % 2 else 0 for c in range(k)] for r in range(k)]
    assert assignment([[-n for n in row] for row in counts]) == [(r + 3) % k for r in range(k)]
    assert assignment([[0] * 40 for _ in range(40)]) and sorted(assignment([[0] * 40 for _ in range(40)])) == list(range(40))
    flat = spark.createDataFrame([(0, 0, 1)], "a int, b int, n long").limit(0)
    assert sorted(map(tuple, aligned(flat, 4).collect())) == [(i, i) for i in range(4)]
