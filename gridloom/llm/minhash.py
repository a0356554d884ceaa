"""MinHash near-duplicates by an inverted join over signature coordinates.

1. Each text becomes its set of shingle hashes, ``COORDINATES`` minima, a long signature of one minimum in each
   of ``BINS`` bins, and a fingerprint of the set.
   Equal sets are one class from here on, so copies are never paired.
2. Each class is posted under its (coordinate, value) pairs.  A posting list of one member is dead.
   Two sets above the match threshold share at least ``MATCHES`` of them, so a class with fewer live lists has no partner
   and is skipped.
3. Prefix filter: with its live lists ordered by length (shortest first), such a pair meets within the first
   ``live - MATCHES + 1`` lists of both members; the long lists behind them are never merged.
4. First every list's members are paired with one member alone, the one whose lists are the most crowded (the text that
   most copies were made from).  Collisions over whole signatures are counted, pairs above the threshold are confirmed on
   the full shingle sets, a head's text travelling once for ``STAR`` members, and confirmed links contract the lists.  Then lists
   that still hold several components are merged: members of different components are compared in blocks, each pair only in
   the first list it shares.  Members with a partner whose long signature collides in ``BIN_PERCENT`` of the bins get their
   texts, once for each pair of blocks; there all common shingles are counted by one sparse product, and a block hands on a
   spanning forest of its true links.  So neither the candidates' pairs nor a text for each pair are ever written out.
   Inside a component a further link would not change the result.
5. Components of the confirmed links, named by the smallest id.

Rows that share an id but not the text are one node: each text is compared, and a link of either counts for the id.
Defined results: null or wordless texts have no shingles and link with nothing; fewer words than a shingle count as one
shingle; a null id links with nothing; repeated rows come back repeated, in one component; texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import small_batches, table, written
from gridloom.llm.graphs import components, forest
from gridloom.llm.words import shingle_set, texts_words

WORDS, PERCENT = 5, 75
#: Posted minima and those a pair must share; a pair at 75 % shares fewer with a probability of about 3e-5.
COORDINATES, MATCHES = 32, 14
#: Bins of the long signature (one minimum a bin) and the percentage of used bins that must be equal; a pair at 75 % has
#: fewer with a probability below 1e-5, and for sets much smaller than the bins the share is all but exact.
BINS, BIN_PERCENT = 1_024, 69
#: Members of a list compared with each other at once, and of a star that share one copy of its head's text.
BLOCK, STAR = 512, 256
#: Shingles counted at once in a block.
COLUMNS = 8_192

_rng = np.random.default_rng(20240229)
_ODD = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def lowered(texts: list[str | None]) -> list[bytes]:
    """UTF-8 with only A-Z lower-cased."""
    return [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]


def signature(shingles: np.ndarray) -> np.ndarray:
    out = np.full(COORDINATES, ~np.uint64(0))
    for a in range(0, len(shingles), 4096):
        np.minimum(out, ((shingles[a : a + 4096, None] ^ _FLIP) * _ODD).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def long_signature(shingles: np.ndarray) -> bytes:
    """One byte for each bin: 0 if it is empty, else 1 to 255 from its smallest hash (``shingles`` come sorted)."""
    out = np.zeros(BINS, np.uint8)
    value = (((shingles >> np.uint64(20)) & np.uint64(0xFFFF)) % np.uint64(255)).astype(np.uint8) + np.uint8(1)
    out[(shingles % np.uint64(BINS)).astype(np.int64)[::-1]] = value[::-1]  # the smallest is written last
    return out.tobytes()


def features(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, fingerprint, signature, bins) of each document; the last three are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                n, prints, signatures, bins = [], [], [], []
                for _, hashes in texts_words(lowered(part.column("text").to_pylist())):
                    own = shingle_set(hashes, words)
                    n.append(len(own))
                    prints.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                    signatures.append(signature(own) if len(own) else None)
                    bins.append(long_signature(own) if len(own) else None)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(signatures, pa.list_(pa.int32())), pa.array(bins, pa.binary())], ["doc_id", "n_shingles", "fingerprint", "signature", "bins"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, fingerprint binary, signature array<int>, bins binary")


def compressed(docs: DataFrame) -> DataFrame:
    """(doc_id, print, packed): texts squeezed for the way to their partners, and what tells texts of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("print"), pa.array([squeeze.compress(t) for t in lowered(batch.column("text").to_pylist())], pa.binary())], ["doc_id", "print", "packed"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("print"), F.col("text").cast("string")).where("doc_id is not null").mapInArrow(run, "doc_id long, print long, packed binary")


def sets_of(part: pa.RecordBatch, words: int) -> list[np.ndarray]:
    """The shingle sets of the column ``packed``."""
    loosen = zstandard.ZstdDecompressor()
    return [shingle_set(h, words) for _, h in texts_words([loosen.decompress(t.as_py()) for t in part.column("packed")])]


def star_links(pairs: DataFrame, docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The pairs (a: the head, b) whose full shingle sets overlap enough."""
    stars = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts"))
    members = pairs.join(stars, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"), F.col("b").alias("rep"))
    heads = stars.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.col("a").alias("rep"))
    with_texts = members.unionByName(heads).hint("merge").join(compressed(docs), F.col("rep") == F.col("doc_id")).drop("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        star, row, head = None, None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found: set[tuple[int, int]] = set()
                for a, p, role, rep, mark, own in zip(*(part.column(c).to_pylist() for c in ("a", "part", "role", "rep", "print")), sets_of(part, words)):
                    if star != (a, p):
                        star, head = (a, p), []
                    if row == (star, role, rep, mark):  # the same text again
                        continue
                    row = (star, role, rep, mark)
                    if not role:
                        head.append(own)
                        continue
                    common = [len(np.intersect1d(h, own, assume_unique=True)) for h in head]
                    if any(100 * c >= percent * (len(h) + len(own) - c) for c, h in zip(common, head)):
                        found.add((a, rep))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return with_texts.repartition("a", "part").sortWithinPartitions("a", "part", "role", "rep", "print").mapInArrow(run, "a long, b long")


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One record batch for each run of rows with equal key, i and j."""
    held: list[pa.RecordBatch] = []
    last = None
    joined = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    for batch in batches:
        key, i, j = (batch.column(c).to_numpy() for c in ("key", "i", "j"))
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        for a, b in zip([0, *cuts], [*cuts, len(key)]):
            if b > a:
                name = (key[a], i[a], j[a])
                if name != last and held:
                    yield joined()
                    held = []
                last = name
                held.append(batch.slice(a, b - a))
    if held:
        yield joined()


def common_shingles(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left with each right set: products of their 0/1 rows, some columns at a time."""
    sets = [*left, *right]
    sizes = [len(x) for x in sets]
    shingle, column = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(column, minlength=len(shingle)) > 1
    new = np.where(often, np.cumsum(often) - 1, -1)[column]
    row = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(new, kind="stable")
    new, row = new[order], row[order]
    out = np.zeros((len(left), len(right)))
    for a in range(0, int(often.sum()), COLUMNS):
        lo, hi = np.searchsorted(new, [a, a + COLUMNS])
        here = np.zeros((len(sets), COLUMNS), np.float32)
        here[row[lo:hi], new[lo:hi] - a] = 1
        out += here[: len(left)] @ here[len(left) :].T
    return out


def block_links(met: DataFrame, docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """A spanning forest (a, b) of the links in each pair of blocks; ``met`` has key, i, j, block and rep."""
    with_texts = met.hint("merge").join(compressed(docs), F.col("rep") == F.col("doc_id")).drop("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches):
            rep, block, mark = (group.column(c).to_numpy() for c in ("rep", "block", "print"))
            new = np.concatenate([[True], (rep[1:] != rep[:-1]) | (mark[1:] != mark[:-1]) | (block[1:] != block[:-1])])
            rep, block, sets = rep[new], block[new], sets_of(group.filter(pa.array(new)), words)
            left, right = (np.flatnonzero(block == group.column(c)[0].as_py()) for c in "ij")
            if len(left) and len(right):
                common, size = common_shingles([sets[k] for k in left], [sets[k] for k in right]), np.array([len(x) for x in sets])
                p, q = np.nonzero((100 * common >= percent * (size[left][:, None] + size[right][None, :] - common)) & (rep[left][:, None] != rep[right][None, :]))
                a, b = forest(rep[left[p]], rep[right[q]])
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return with_texts.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "block", "rep", "print").mapInArrow(run, "a long, b long")


def alike(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sizes allow a link and whose whole signatures collide often enough."""
    own = classes.select("rep", "n", "signature")
    both = pairs.join(own.withColumnsRenamed({"rep": "a", "n": "na", "signature": "sa"}), "a").join(own.withColumnsRenamed({"rep": "b", "n": "nb", "signature": "sb"}), "b")
    equal = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return both.where((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (equal >= MATCHES)).select("a", "b")


def merged(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(key, i, j, block, rep): members of open lists that collide often enough with one of another component.

    ``rows`` has key, i, j (the blocks met here), block, rep, component, n, mask (the lists of the member's prefix, a bit
    for each coordinate), signature and bins.
    """

    def colliding(part: pa.RecordBatch) -> np.ndarray:
        get = lambda c: part.column(c).to_numpy()
        rep, comp, n, mask, block = get("rep"), get("component"), get("n"), get("mask"), get("block")
        sig = part.column("signature").flatten().to_numpy().reshape(len(rep), -1)
        bins = np.frombuffer(b"".join(part.column("bins").to_pylist()), np.uint8).reshape(len(rep), BINS)
        i, j, key = part.column("i")[0].as_py(), part.column("j")[0].as_py(), part.column("key")[0].as_py()
        left, right, out = np.flatnonzero(block == i), np.flatnonzero(block == j), np.zeros(len(rep), bool)
        for a in range(0, len(left), 128):
            x = left[a : a + 128]
            ok = (comp[x][:, None] != comp[right][None, :]) & (100 * np.minimum(n[x][:, None], n[right][None, :]) >= percent * np.maximum(n[x][:, None], n[right][None, :]))
            if i == j:
                ok &= rep[x][:, None] < rep[right][None, :]
            p, q = np.nonzero(ok)
            p, q = x[p], right[q]
            for c in range(0, len(p), 20_000):
                u, v = p[c : c + 20_000], q[c : c + 20_000]
                common = mask[u].astype(np.uint32) & mask[v].astype(np.uint32)
                for at in range(int(key >> 32)):  # shared earlier: another list has the pair
                    bit = np.uint32(1) << np.uint32(at)
                    own = (common & bit) != 0
                    own[own] = sig[u[own], at] == sig[v[own], at]
                    u, v, common = u[~own], v[~own], common[~own]
                x_bins, y_bins = bins[u], bins[v]
                used = (x_bins | y_bins) != 0
                near = 100 * ((x_bins == y_bins) & used).sum(1) >= BIN_PERCENT * used.sum(1)
                out[u[near]] = out[v[near]] = True
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches):
            if group.num_rows > 1:
                yield group.select(["key", "i", "j", "block", "rep"]).filter(pa.array(colliding(group)))

    dealt = rows.select("key", "i", "j", "block", "rep", "component", "n", "mask", "signature", "bins").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(run, "key long, i int, j int, block int, rep long")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (columns doc_id, text)."""
    with small_batches(docs.sparkSession):
        marked = written(features(docs, words), "minhash-features")
    classes = written(
        marked.where("doc_id is not null and n_shingles > 0").groupBy("fingerprint").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"), F.first("bins").alias("bins")),
        "minhash-classes",
    )
    posted = classes.select("rep", F.posexplode("signature").alias("at", "value")).select("rep", (F.shiftleft(F.col("at").cast("long"), 32) + F.col("value").cast("long") + 2**31).alias("key"))
    lists = posted.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    own = Window.partitionBy("rep")
    ordered = posted.join(lists, "key").withColumns({"k": F.row_number().over(own.orderBy("size", "key")), "live": F.count("*").over(own), "crowd": F.sum("size").over(own)})
    prefix = written(ordered.where(f"k <= live - {MATCHES - 1}").select("rep", "key", "crowd"), "minhash-prefix")

    heads = prefix.groupBy("key").agg(F.max(F.struct("crowd", (-F.col("rep")).alias("minus"))).alias("top"), F.count("*").alias("size")).where("size > 1").select("key", (-F.col("top.minus")).alias("a"))
    stars = prefix.join(heads, "key").where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    with small_batches(docs.sparkSession):
        links = written(star_links(written(alike(stars, classes, percent), "minhash-stars"), docs, words, percent), "minhash-links")
    first = components(links, "minhash-first")

    # lists that still hold several components; a class without a link is its own
    grouped = prefix.join(first.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "key", F.coalesce("component", "rep").alias("component"))
    split = grouped.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("low <> high").select("key", "blocks")
    open_ = grouped.join(split, "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    masks = prefix.groupBy("rep").agg(F.expr("bit_or(shiftleft(1L, cast(shiftright(key, 32) as int)))").alias("mask"))
    full = open_.join(masks, "rep").join(classes.select("rep", "n", "signature", "bins"), "rep")
    met = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    rest = written(merged(met, percent), "minhash-rest")
    if not rest.isEmpty():
        more = written(block_links(rest, docs, words, percent), "minhash-more")
        if not more.isEmpty():
            first = components(links.unionByName(more), "minhash-second")

    named = classes.select("fingerprint", "rep").join(first.withColumnRenamed("node", "rep"), "rep", "left").select("fingerprint", F.coalesce("component", "rep").alias("component"))
    found = marked.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("fingerprint")).alias("fingerprint")).join(named, "fingerprint", "left")
    component = F.coalesce("component", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op2_minhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all whole documents."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_sql() -> str:
    """Exact links by counting common shingles; components by following them."""
    return r"""
    WITH RECURSIVE words AS (
      SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
    ),
    shingles AS (
      SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words
    ),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
    both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.seen)
    SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, m.component_id, m.component_id = d.doc_id AS kept
    FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT node, min(seen) AS component_id FROM reach GROUP BY node) m ON m.node = d.doc_id
    """
