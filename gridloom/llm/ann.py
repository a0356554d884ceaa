"""Approximate nearest neighbours over balanced posting lists, by largest inner product.

Vectors get one more component so that the largest inner product becomes the smallest Euclidean distance.  A balanced
k-means on a bounded sample gives centroids; an in-memory graph over the centroids finds those near a vector.  Every
vector is posted to its nearest list and, if it lies near a border, to further lists whose distance is within a ratio of
the nearest.  A query searches the lists whose centroids are within a ratio of its nearest centroid.  That ratio comes
from an audit: a fixed number of queries is compared with all vectors, and the ratio is the one that reaches the lists of
``RECALL`` of their true neighbours, and of nine in ten neighbours for ``EACH`` of the queries taken one by one.  Lists are
numbered so that neighbours have near numbers, cut to pieces of bounded length, and dealt to tasks in that order, so that a
query goes to few tasks.

Equal vectors are one class that carries its smallest ids: with ``k`` results and the query left out, ``k + 1`` ids of a
class are all that can count.  Equal queries are searched once; their ids are joined to the result.  Scores are inner
products of the original vectors in double precision.

Defined results: vectors that are null, empty, zero or hold null or non-finite numbers, or rows without an id, take no
part; fewer candidates than ``k`` give fewer rows; ties go to the smaller id; repeated rows count once; vectors of
another length than the most frequent one take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import table, written
from gridloom.llm.hnsw import Graph
from gridloom.llm.vectors import matrix, usable_vectors

NEAREST, EVERY = 20, 20
#: Bound of the sample the centroids are fitted on, and vectors in a list on average: the root of all, up to ``LIST_ROWS``
#: (as far as the sample allows).
SAMPLE, LIST_ROWS, ROWS_EACH_CENTROID = 20_000, 128, 8
#: A vector goes to at most so many lists within this ratio of its nearest (squared distances).
COPIES, COPY_RATIO = 2, 1.1
#: Queries compared with all vectors to find the ratio within which a query looks at lists, and the share to reach.
AUDIT, RECALL, EACH = 128, 0.96, 0.98
#: Lists a query looks at even if it lies on a centroid.
LEAST_LISTS = 4
#: Rows of a list in one piece; at least so many tasks, more as soon as one would hold over ``TASK_ROWS`` rows.
PIECE_ROWS, TASKS, TASK_ROWS = 4_096, 8, 65_536


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means in which a crowded centroid seems farther off, so that lists come out alike in size."""
    rng = np.random.default_rng(3)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    load = np.zeros(k)
    for _ in range(rounds):
        d = (c * c).sum(1)[None, :] - 2 * x @ c.T
        spread = np.median(np.partition(d, min(1, k - 1), axis=1)[:, min(1, k - 1)] - d.min(1)) if k > 1 else 0.0
        own = (d + spread * load).argmin(1)
        size = np.bincount(own, minlength=k)
        load = size / (len(x) / k) - 1
        np.clip(load, -0.5, 2, out=load)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        some = size > 0
        c[some] = total[some] / size[some, None]
        c[~some] = x[rng.choice(len(x), (~some).sum())]
    return c


def ordered(c: np.ndarray) -> np.ndarray:
    """Numbers of the rows so that near ones mostly follow each other: halves at the median of the widest axis, and so on."""
    if len(c) <= 2:
        return np.arange(len(c))
    by = np.argsort(c[:, np.ptp(c, axis=0).argmax()], kind="stable")
    half = len(c) // 2
    return np.concatenate([part[ordered(c[part])] for part in (by[:half], by[half:])])


class Router:
    """The centroids and their graph; broadcast, its size is bounded by the sample."""

    def __init__(self, centroids: np.ndarray, longest: float) -> None:
        self.centroids, self.longest = centroids.astype(np.float32), longest
        self.graph = Graph(self.centroids)

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state
        self.graph.attach(self.centroids)

    def lifted(self, rows: np.ndarray, query: bool = False) -> np.ndarray:
        """Queries at length 1 and with 0, vectors with what they lack to the longest."""
        if query:
            return np.hstack([rows / np.sqrt((rows * rows).sum(1))[:, None] * self.longest, np.zeros((len(rows), 1))])
        return np.hstack([rows, np.sqrt(np.maximum(0, self.longest**2 - (rows * rows).sum(1)))[:, None]])

    def near(self, rows: np.ndarray, ratio: float, most: int | None = None, least: int = 1) -> list[list[int]]:
        """The lists within ``ratio`` of each row's nearest (``least`` lists anyway), nearest first; the beam widens until it ends outside."""
        out: list[list[int]] = [[] for _ in rows]
        todo, width = np.arange(len(rows)), most or 64
        while len(todo):
            found, dist = self.graph.search(rows[todo], max(width, 16))
            inside = ((dist <= ratio * np.maximum(dist[:, :1], 1e-12)) | (np.arange(found.shape[1]) < least)) & (found >= 0)
            open_ = inside[:, -1] & (width < len(self.centroids)) & (most is None)
            for i in np.flatnonzero(~open_).tolist():
                out[todo[i]] = found[i, inside[i]][:most].tolist()
            todo, width = todo[open_], min(4 * width, len(self.centroids))
        return out

    def needed(self, queries: np.ndarray, neighbours: list[np.ndarray]) -> float:
        """The ratio within which ``RECALL`` of the queries' neighbours (rows each) have a list, and most of each query's."""
        ratios = []
        for q, rows in zip(self.lifted(queries, True), neighbours):
            d = ((self.centroids - q) ** 2).sum(1)
            ratios.append([d[own].min() / max(d.min(), 1e-12) for own in self.near(self.lifted(rows), COPY_RATIO, COPIES)])
        return max(1.05, float(np.quantile(np.concatenate(ratios), RECALL)), float(np.quantile([np.quantile(r, 0.9) for r in ratios], EACH)))


def posted_to_lists(classes: DataFrame, router) -> DataFrame:
    """``classes`` once for each list of its vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                lists = router.value.near(router.value.lifted(matrix(part.column("embedding"))), COPY_RATIO, COPIES)
                take = pa.array(np.repeat(np.arange(len(lists)), [len(x) for x in lists]))
                yield pa.RecordBatch.from_arrays([*part.take(take).columns, pa.array([c for own in lists for c in own], pa.int32())], [*part.schema.names, "list"])

    fields = ", ".join(f"{c} {t}" for c, t in classes.dtypes)
    return classes.mapInArrow(run, f"{fields}, list int")


def sent_to_tasks(queries: DataFrame, router, ratio: float, pieces) -> DataFrame:
    """``queries`` once for each task that holds pieces of their lists, with those pieces.  pieces: the first piece of each list (and one more), and the task of each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, tasks = pieces.value
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                take, task, own = [], [], []
                for i, lists in enumerate(router.value.near(router.value.lifted(matrix(part.column("embedding")), True), ratio, least=LEAST_LISTS)):
                    by: dict[int, list[int]] = {}
                    for p in (p for c in lists for p in range(firsts[c], firsts[c + 1])):
                        by.setdefault(tasks[p], []).append(p)
                    take += [i] * len(by)
                    task += by
                    own += by.values()
                yield pa.RecordBatch.from_arrays([*part.take(pa.array(take, pa.int64())).columns, pa.array(task, pa.int32()), pa.array(own, pa.list_(pa.int32()))], [*part.schema.names, "task", "pieces"])

    fields = ", ".join(f"{c} {t}" for c, t in queries.dtypes)
    return queries.mapInArrow(run, f"{fields}, task int, pieces array<int>")


def best_of(score: np.ndarray, q: np.ndarray, x: np.ndarray, longest: float, reps: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of x, exact scores) of the ``count`` largest, ties to smaller ids.

    ``score`` is rough and -inf for rows not looked at; ``longest`` is the length of the longest row.
    """
    looked = np.flatnonzero(np.isfinite(score))
    if len(looked) > count:
        edge = np.partition(score[looked], len(looked) - count)[len(looked) - count]
        # ties at the edge all count; a rough score is off by no more than its terms are large
        looked = looked[score[looked] >= edge - 1e-12 * longest * np.sqrt((q * q).sum())]
    exact = (x[looked] * q).sum(axis=1)
    order = np.lexsort((reps[looked], -exact))[:count]
    return looked[order], exact[order]


def compared(nearest: int):
    """Best ``nearest`` + 1 candidates of each query (a class of equal ones, itself among them) among one task's pieces."""

    def run(posted: pa.Table, asked: pa.Table) -> pa.Table:
        query, vec, score = [], [], []
        if posted.num_rows and asked.num_rows:
            order = np.argsort(posted.column("piece").to_numpy(), kind="stable")
            posted = posted.take(pa.array(order))
            piece, reps, members, x = posted.column("piece").to_numpy(), posted.column("rep").to_numpy(), posted.column("members").to_pylist(), matrix(posted.column("embedding"))
            longest = np.sqrt(np.einsum("ij,ij->i", x, x).max())
            held, first = np.unique(piece, return_index=True)
            span = dict(zip(held.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(piece)])))
            q_all, q_ids, q_pieces = matrix(asked.column("embedding")), asked.column("rep").to_pylist(), asked.column("pieces").to_pylist()
            for a in range(0, len(q_all), 128):
                q = q_all[a : a + 128]
                rough = np.full((len(q), len(x)), -np.inf)
                by_piece: dict[int, list[int]] = {}
                for i, own in enumerate(q_pieces[a : a + 128]):
                    for p in own:
                        by_piece.setdefault(p, []).append(i)
                for p, rows in by_piece.items():
                    if p in span:
                        rough[rows, span[p][0] : span[p][1]] = q[rows] @ x[span[p][0] : span[p][1]].T
                for i in range(len(q)):
                    # a class posted to two lists may stand here twice
                    at, exact = best_of(rough[i], q[i], x, longest, reps, COPIES * (nearest + 1))
                    rows = sorted({(-s, v) for s, r in zip(exact.tolist(), at.tolist()) for v in members[r]})[: nearest + 1]
                    query += [q_ids[a + i]] * len(rows)
                    vec += [v for _, v in rows]
                    score += [-s for s, _ in rows]
        return pa.table({"rep": pa.array(query, pa.int64()), "vec_id": pa.array(vec, pa.int64()), "score": pa.array(score, pa.float64())})

    return run


def audited_ratio(classes: DataFrame, queries: DataFrame, router, nearest: int) -> float:
    """The probe ratio, from ``AUDIT`` queries compared with all vectors."""
    asked = matrix(queries.orderBy(F.xxhash64("embedding"), "embedding").limit(AUDIT).select("embedding").toArrow().column("embedding"))
    if not len(asked):
        return 1.05

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, reps = matrix(batch.column("embedding")), batch.column("rep").to_numpy()
            longest = np.sqrt(np.einsum("ij,ij->i", x, x).max(initial=0.0))
            for i, q in enumerate(asked):
                at, exact = best_of(x @ q, q, x, longest, reps, nearest + 1)
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(at), pa.int32()), pa.array(reps[at]), pa.array(exact), batch.column("embedding").take(pa.array(at))], ["i", "rep", "score", "embedding"])

    kind = dict(classes.dtypes)["embedding"]
    best = Window.partitionBy("i").orderBy(F.desc("score"), "rep")
    true = classes.select("rep", "embedding").mapInArrow(run, f"i int, rep long, score double, embedding {kind}").withColumn("k", F.row_number().over(best)).where(F.col("k").between(2, nearest + 1)).toArrow()
    of, rows = true.column("i").to_numpy(), matrix(true.column("embedding"))
    some = np.unique(of)
    return router.value.needed(asked[some], [rows[of == i] for i in some]) if len(some) else 1.05


def nearest_neighbours(df: DataFrame, nearest: int = NEAREST, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of each query, a row whose id is divisible by ``every``."""
    vectors = usable_vectors(df)
    lengths = vectors.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    vectors = vectors.where(F.size("embedding") == (lengths["d"] if lengths else 0))
    first = Window.partitionBy("embedding").orderBy("vec_id")
    few = vectors.withColumn("k", F.row_number().over(first)).where(f"k <= {nearest + 1}")
    classes = written(few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("members"), F.min("vec_id").alias("rep")), "ann-classes")
    wide = F.transform("embedding", lambda x: x.cast("double"))
    stats = classes.agg(F.count("*").alias("n"), F.sqrt(F.max(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))).alias("longest")).first()
    spark = df.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    if not stats["n"]:
        return spark.createDataFrame([], schema)
    n = stats["n"]
    drawn = classes if n <= SAMPLE else classes.where(F.pmod(F.xxhash64("rep", F.lit("ann")), F.lit(1_000_003)) < 1_000_003 * SAMPLE / n)
    sample = matrix(drawn.select("rep", "embedding").orderBy("rep").toArrow().column("embedding"))
    k = max(1, min(-(-n // max(1, min(LIST_ROWS, int(n**0.5)))), len(sample) // ROWS_EACH_CENTROID))
    lift = np.hstack([sample, np.sqrt(np.maximum(0, stats["longest"] ** 2 - (sample * sample).sum(1)))[:, None]])
    centroids = balanced_centroids(lift, k)
    router = spark.sparkContext.broadcast(Router(centroids[ordered(centroids)], stats["longest"]))

    ids = written(vectors.where(F.pmod("vec_id", F.lit(every)) == 0).join(classes.select("embedding", "rep"), "embedding").select("vec_id", "rep"), "ann-queries")
    queries = classes.join(ids.select("rep").distinct(), "rep", "left_semi").select("rep", "embedding")
    ratio = audited_ratio(classes, queries, router, nearest)
    posted = written(posted_to_lists(classes.select("rep", "members", "embedding"), router), "ann-postings")
    sizes = {r["list"]: r["n"] for r in posted.groupBy("list").agg(F.count("*").alias("n")).collect()}  # one row a centroid
    numbers = [-(-sizes.get(c, 0) // PIECE_ROWS) for c in range(k)]
    firsts = np.cumsum([0, *numbers]).tolist()
    # pieces go to tasks in their order, by the rows before them
    share = max(1.0, min(TASK_ROWS, sum(sizes.values()) / TASKS))
    before = np.cumsum([0, *(sizes.get(c, 0) / m for c, m in enumerate(numbers) for _ in range(m))])
    tasks = (before[:-1] // share).astype(int).tolist()
    pieces = spark.sparkContext.broadcast((firsts, tasks))
    first, number, task = F.array(*map(F.lit, firsts[:k])), F.array(*map(F.lit, numbers)), F.array(*map(F.lit, tasks))
    piece = first[F.col("list")] + F.pmod(F.xxhash64("rep"), F.greatest(number[F.col("list")], F.lit(1))).cast("int")
    held = posted.withColumn("piece", piece).withColumn("task", task[F.col("piece")]).select("task", "piece", "rep", "members", "embedding")
    asked = sent_to_tasks(queries, router, ratio, pieces)
    found = held.groupBy("task").cogroup(asked.groupBy("task")).applyInArrow(compared(nearest), "rep long, vec_id long, score double")
    best = Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
    top = found.groupBy("rep", "vec_id").agg(F.max("score").alias("score")).withColumn("k", F.row_number().over(best)).where(F.col("k") <= nearest + 1)
    lists = top.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("k", "vec_id", "score"))).alias("found"))  # nearest + 1 a class of equal queries
    own = ids.join(lists, "rep").select(F.col("vec_id").alias("query_id"), F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("vec_id")), 1, nearest).alias("found"))
    return own.select("query_id", F.posexplode("found").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def op4_ann(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector."""
    return nearest_neighbours(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
