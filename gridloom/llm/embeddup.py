"""Embedding near-duplicates over hierarchical navigable small-world graphs.

Equal vectors are one class.  Classes are dealt to shards by a hash, bounded in rows and bytes; each shard builds one graph.
Every class queries every shard: a shard's graph and the queries meet in a task that reads the graph once and then streams
the queries, a block at a time; only for every ``PART_ROWS`` queries does the graph travel once more.  A query whose whole beam is linked gets a wider beam until the beam ends
outside the threshold or holds the shard.  Some queries of a part are audited, that is compared with the whole shard: the beam is doubled until the
graph leads to ``RECALL`` of their links and, where links are rare, of their nearest neighbours.  A part whose audit fails at the beam ``WIDEST``
has the exact links instead.  Links are confirmed by cosine in double precision and counted; a block hands on only a spanning forest of its links, which keeps its rows
linear in the vectors.  Components are united over all blocks.

Vectors of different length are in different shards and link with nothing of each other.  Defined results: vectors that
are null, empty, zero or hold null or non-finite numbers have no links and are their own component; so do rows with a
null id (component null); repeated rows count once and come back repeated; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import table, written
from gridloom.llm.graphs import components, forest
from gridloom.llm.hnsw import Graph
from gridloom.llm.vectors import matrix, usable_vectors

COSINE = 0.9
#: At least so many shards; more as soon as one would hold over ``SHARD_ROWS`` vectors or about ``SHARD_BYTES`` bytes.
SHARDS, SHARD_ROWS, SHARD_BYTES = 8, 65_536, 1 << 28
#: Queries that are searched together, and those that meet a shard in one task.
BLOCK_ROWS, PART_ROWS = 8_192, 65_536
BEAM, AUDITED, RECALL = 32, 128, 0.98
#: Audited links below which nearest neighbours, so many of each query, are audited too; beam after which a part is compared with the shard exactly.
EVIDENCE, NEIGHBOURS, WIDEST = 100, 10, 512


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # so that neither tiny nor huge numbers overflow
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def indexed(classes: pa.Table) -> pa.Table:
    """One row: the shard's graph with its ids, sizes and vectors as they came."""
    order = np.argsort(classes.column("rep").to_numpy())
    own = classes.column("embedding").combine_chunks()
    rows = own.flatten().to_numpy().reshape(len(own), -1)[order]
    payload = pickle.dumps((classes.column("rep").to_numpy()[order], classes.column("copies").to_numpy()[order], rows, Graph(unit(rows.astype(np.float64)))), protocol=5)
    return pa.table({"shard": classes.column("shard")[:1].cast(pa.string()), "payload": pa.array([payload], pa.large_binary()).cast(pa.binary())})


def confirmed(rows: np.ndarray, queries: np.ndarray, own: np.ndarray, q: np.ndarray, s: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (q, s) those that are links in double precision and not a query with itself."""
    close = [np.einsum("ij,ij->i", queries[q[a : a + 200_000]], rows[s[a : a + 200_000]]) >= cosine for a in range(0, max(1, len(q)), 200_000)]
    keep = np.concatenate(close) & (own[q] != s)
    return q[keep], s[keep]


def exact_links(rows: np.ndarray, queries: np.ndarray, own: np.ndarray, at: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """All links of the queries ``at``, each compared with the whole shard."""
    step, q, s = max(1, 4_000_000 // len(rows)), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for a in range(0, len(at), step):
        i, j = np.nonzero(queries[at[a : a + step]] @ rows.T >= cosine - 1e-9)
        found = confirmed(rows, queries, own, at[a + i], j, cosine)
        q.append(found[0])
        s.append(found[1])
    return np.concatenate(q), np.concatenate(s)


def graph_links(graph: Graph, rows: np.ndarray, queries: np.ndarray, own: np.ndarray, todo: np.ndarray, beam: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(query number, shard row) of the links of the queries ``todo`` that the graph leads to."""
    limit, width, q, s = 2 - 2 * cosine + 1e-4, beam, [], []  # squared distance of unit vectors, with room for single precision
    while len(todo):
        at, dist = graph.search(queries[todo], width)
        full = (dist[:, -1] <= limit) & (width < len(rows))  # the beam ends inside the threshold: widen
        i, j = np.nonzero((dist <= limit) & (at >= 0) & ~full[:, None])
        q.append(todo[i])
        s.append(at[i, j])
        todo, width = todo[full], min(width * 4, len(rows))
    return confirmed(rows, queries, own, np.concatenate(q), np.concatenate(s), cosine)


def audited_beam(graph: Graph, rows: np.ndarray, queries: np.ndarray, own: np.ndarray, cosine: float) -> int | None:
    """The narrowest beam that passes the audit of some of the queries; None if even ``WIDEST`` fails.

    Audited queries are compared with the whole shard.  The graph must lead to ``RECALL`` of their links and, unless these are
    ``EVIDENCE``, to ``RECALL`` of their nearest neighbours as well: those are there however rare links are, and harder to find.
    """
    at = np.arange(0, len(queries), max(1, len(queries) // AUDITED))
    links = len(exact_links(rows, queries, own, at, cosine)[0])
    k = min(NEIGHBOURS, len(rows) - 1)
    if k < 1:
        return BEAM
    near, step = [], max(1, 4_000_000 // len(rows))
    for a in range(0, len(at), step):
        close = queries[at[a : a + step]] @ rows.T
        mine = own[at[a : a + step]]
        close[np.flatnonzero(mine >= 0), mine[mine >= 0]] = -2  # not a query itself
        near.append(np.argpartition(-close, k - 1, axis=1)[:, :k])
    near, beam = np.concatenate(near), BEAM
    while True:
        enough = len(graph_links(graph, rows, queries, own, at, beam, cosine)[0]) >= RECALL * links
        if enough and links < EVIDENCE:
            got = graph.search(queries[at], max(beam, k + 1))[0]
            enough = np.mean([np.isin(n, g).mean() for n, g in zip(near, got)]) >= RECALL
        if enough:
            return beam
        if beam >= min(WIDEST, len(rows)):
            return None
        beam = min(beam * 2, len(rows))


def found_links(graph: Graph, rows: np.ndarray, queries: np.ndarray, own: np.ndarray, cosine: float, beam: list[int | None] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(query number, shard row) of the links from ``cosine`` on; ``own`` is each query's row in the shard, or -1.

    ``beam`` keeps the outcome of the audit for the blocks that follow.
    """
    beam = [] if beam is None else beam
    if not beam:
        beam.append(audited_beam(graph, rows, queries, own, cosine))
    every = np.arange(len(queries))
    return exact_links(rows, queries, own, every, cosine) if beam[0] is None else graph_links(graph, rows, queries, own, every, beam[0], cosine)


def searched(cosine: float):
    """For rows sorted by shard, part and role: the graph of each part, then its queries, block by block."""

    def answered(shard, block: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, copies, rows, graph, beam = shard
        own = np.concatenate([b.column("rep").to_numpy() for b in block])
        place = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
        # the first block of a part is audited for all of the part
        q, s = found_links(graph, rows, unit(np.vstack([matrix(b.column("embedding")) for b in block])), np.where(ids[place] == own, place, -1), cosine, beam)
        n = np.bincount(q, weights=copies[s], minlength=len(own)).astype(np.int64)
        a, b = forest(own[q], ids[s])
        columns = (np.concatenate([own[n > 0], a]), np.concatenate([own[n > 0], b]), np.concatenate([n[n > 0], np.zeros(len(a), np.int64)]))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["rep", "other", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, held = None, [], 0
        for batch in batches:
            heads = np.flatnonzero(batch.column("payload").is_valid().to_numpy(zero_copy_only=False)).tolist()
            at = 0
            while at < batch.num_rows:
                if heads and heads[0] == at:
                    if block:
                        yield from answered(shard, block)
                    ids, copies, rows, graph = pickle.loads(batch.column("payload")[heads.pop(0)].as_py())
                    rows = unit(rows.astype(np.float64))
                    shard, block, held, at = (ids, copies, rows, graph.attach(rows), []), [], 0, at + 1
                    continue
                end = min(heads[0] if heads else batch.num_rows, at + BLOCK_ROWS - held)
                block.append(batch.slice(at, end - at))
                held, at = held + end - at, end
                if held == BLOCK_ROWS:
                    yield from answered(shard, block)
                    block, held = [], 0
        if block:
            yield from answered(shard, block)

    return run


def near_vectors(df: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``df`` (columns vec_id, embedding)."""
    vectors = usable_vectors(df)
    classes = written(vectors.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "embeddup-classes")
    n, dims = classes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    shards, parts = max(SHARDS, -(-n // max(1, min(SHARD_ROWS, SHARD_BYTES // (16 * (dims or 1)))))), max(1, -(-n // PART_ROWS))
    name = lambda k: F.concat_ws("-", F.size("embedding"), k)  # noqa: E731  shards of one length of vector
    dealt = classes.withColumns({"shard": name(F.pmod(F.xxhash64("rep"), F.lit(shards))), "part": F.pmod(F.xxhash64("rep", F.lit("part")), F.lit(parts)).cast("int")})
    graphs = written(dealt.groupBy("shard").applyInArrow(indexed, "shard string, payload binary"), "embeddup-graphs")
    kind = dict(vectors.dtypes)["embedding"]
    asked = dealt.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("k"), "rep", "embedding", "part").select(name("k").alias("shard"), "part", F.lit(None).cast("binary").alias("payload"), "rep", "embedding")
    # a query whose shard has no vector of its length meets no graph
    asked = asked.join(F.broadcast(graphs.select("shard")), "shard", "left_semi")  # a name a shard
    offered = graphs.select("shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "payload", F.lit(None).cast("long").alias("rep"), F.lit(None).cast(kind).alias("embedding"))
    # more partitions than pairs of shard and part, so that few of these share a task
    met = offered.unionByName(asked).withColumn("role", F.col("payload").isNull()).repartition(max(2 * shards * parts, min(8 * shards * parts, 4_096)), "shard", "part").sortWithinPartitions("shard", "part", "role")
    found = written(met.select("payload", "rep", "embedding").mapInArrow(searched(cosine), "rep long, other long, links long"), "embeddup-links")

    counts = found.where("links > 0").groupBy("rep").agg(F.sum("links").alias("links"))
    named = components(found.where("links = 0").select(F.col("rep").alias("a"), F.col("other").alias("b")), "embeddup-components").withColumnRenamed("node", "rep")
    of_class = classes.join(counts, "rep", "left").join(named, "rep", "left")
    of_vector = vectors.join(of_class, "embedding").groupBy("vec_id").agg(F.max(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.min(F.coalesce("component", "rep")).alias("component"))
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id")).join(of_vector, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op3_embeddup(spark, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op3_sql() -> str:
    return """
    WITH RECURSIVE v AS (
      SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
    reach AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen)
    SELECT r.node AS vec_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_links, min(r.seen) AS component_id, min(r.seen) = r.node AS kept
    FROM reach r LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = r.node GROUP BY r.node
    """
