"""Alignment of two tokenizers over whole documents.

No piece of either vocabulary reaches over a space that follows something else than white space, so texts are cut there
into chunks, and all that concerns tokens is done once for each distinct chunk of the corpus instead of once a document.
Documents are read a few megabytes at a time (a part): a part's distinct chunks become rows, its documents lists of their
numbers.  Chunks are reduced over all parts, each with the list of the places (part and number) that wait for it, and encoded with both vocabularies.  The alignment itself is relational: tokens are
exploded by position, running lengths are their ends, A and B meet in one row where a chunk and an end agree, the running count of
such meetings numbers the groups, and a group's last tokens are its link.  Links are counted over the corpus, each chunk as often as
it occurs; then what chunks have returns to their parts, squeezed by part, and documents add it up.

A chunk's rows are bounded by the chunk, a part by its bytes; chunks that occur everywhere are one row a part before they are
shuffled, so no key is hot but pairs of tokens, whose join adaptive execution may split; a chunk's list of places is no longer than there are parts.

Defined results: texts that are null, empty or that a vocabulary alters (U+2581 is a space for B) have no tokens: zeros and an
empty list; very long texts are handled whole; repeated rows, rows that share an id and rows without one are answered each for
itself; equal counts are all best; an empty table gives an empty one; columns besides key and text are left out.
"""

from __future__ import annotations

import gc
import json
import os
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.bpe import byte_letters
from gridloom.llm.common import parts_of, released, small_batches, table, written

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text in a part, and of chunks handed to a library at once.
PART, JOINED = 1 << 24, 1 << 14
#: Bytes of text that are cut into chunks at once.
SLICE = 1 << 21
#: A token is carried as its id times this and its length in bytes, one number.
LENGTH = 1 << 8
#: A place is a part times this and a chunk's number there (2 GB of text hold fewer distinct chunks); a partition numbers up to this many parts.
NUMBERS, OWN_PARTS = 1 << 29, 1 << 14
#: Pairs of linked tokens up to which their counts are broadcast (some 20 MB).
PAIRS = 1 << 20
#: What the pieces of B write for a space.
MARK = "▁"
#: Rows in which a part's documents are returned.
ROWS = 256
FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
#: What returns to a part for each of its chunks.
SENT = pa.schema([("idx", pa.int32()), ("n_a", pa.int32()), ("n_b", pa.int32()), ("n_groups", pa.int32()), ("n_best", pa.int32()), ("count_sum", pa.int64()), ("groups", pa.string())])


def blank_before(data: np.ndarray) -> np.ndarray:
    """Whether the character that ends at each byte may be white space; true for a few others, which only cut less."""
    one = np.zeros(256, bool)
    one[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
    out = one[data]
    back = lambda k: np.concatenate([np.zeros(min(k, len(data)), np.uint8), data[: max(0, len(data) - k)]])
    wide = np.flatnonzero(data >= 0x80)  # the white spaces of two and three bytes begin with these
    p, q = back(1)[wide], back(2)[wide]
    out[wide] |= (p == 0xC2) | ((q == 0xE1) & (p == 0x9A)) | ((q == 0xE2) & (p <= 0x81)) | ((q == 0xE3) & (p == 0x80))
    return out


def chunk_texts(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(chunks of all texts, each with a space in front, in order; chunks of each text; whether the text has tokens)."""
    able = pc.fill_null(pc.and_(pc.greater(pc.binary_length(texts), 0), pc.invert(pc.match_substring(texts, MARK))), False).to_numpy(zero_copy_only=False)
    own = pc.binary_join_element_wise("", texts.filter(pa.array(able)), " ") if able.any() else pa.array([], pa.string())
    own = own.cast(pa.large_binary())
    sizes = pc.binary_length(own).to_numpy().astype(np.int64)
    data = np.frombuffer(b"".join(own.to_pylist()), np.uint8)
    starts = np.zeros(len(data), bool)
    starts[1:] = (data[1:] == 0x20) & ~blank_before(data)[:-1]
    ends = np.cumsum(sizes)
    starts[(ends - sizes)] = True
    at = np.flatnonzero(starts)
    counts = np.zeros(len(texts), np.int64)
    counts[able] = np.diff(np.searchsorted(at, np.concatenate([[0], ends])))
    offsets = np.append(at, len(data)).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]), counts, able


def joined(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together to about ``most`` bytes: the larger a part, the fewer of its chunks are in others too."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and sum(b.nbytes for b in held) + batch.nbytes > most:
            whole, held = pa.concat_batches(held), []
            yield whole
        held.append(batch)
    if held:
        whole, held = pa.concat_batches(held), []
        yield whole


def parts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of documents (part, doc, refs) and of chunks (place, chunk, n), in one table."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() * OWN_PARTS
        last = number + OWN_PARTS - 1
        for batch in joined(batches, PART):
            for rows in parts_of(batch, "text", PART):
                if number > last:
                    raise ValueError(f"more than {OWN_PARTS} parts in a partition; use more partitions")
                # cut a few megabytes at a time: what cutting needs beside the text is many times as large
                found = [chunk_texts(few.column("text"))[:2] for few in parts_of(rows, "text", SLICE)]
                counts = np.concatenate([n for _, n in found])
                coded = pa.concat_arrays([c for c, _ in found]).dictionary_encode()
                del found
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                refs = pa.ListArray.from_arrays(pa.array(ends), coded.indices.cast(pa.int32()))
                k, m = rows.num_rows, len(coded.dictionary)
                null = lambda n, t: pa.nulls(n, t)
                names = ["part", "doc", "refs", "place", "chunk", "n"]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, number)), rows.column("doc"), refs, null(k, pa.int64()), null(k, pa.string()), null(k, pa.int64())], names)
                n = np.bincount(coded.indices.to_numpy(), minlength=m)
                for a in range(0, m, 10_000):
                    b = min(m, a + 10_000)
                    yield pa.RecordBatch.from_arrays([null(b - a, pa.int64()), null(b - a, rows.column("doc").type), null(b - a, pa.list_(pa.int32())), pa.array(number * NUMBERS + np.arange(a, b)), coded.dictionary.slice(a, b - a), pa.array(n[a:b])], names)
                number += 1
                del coded, refs
        pa.default_memory_pool().release_unused()

    return docs.select(F.col(key).alias("doc"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"part long, doc {kind}, refs array<int>, place long, chunk string, n long")


class Vocabulary:
    """One of the two encoders in one worker, with its tokens' lengths in bytes."""

    def __init__(self, path: str) -> None:
        if path.endswith(".json"):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            own.encode_special_tokens = True  # their strings in a text are ordinary text
            byte = {c: b for b, c in enumerate(byte_letters())}
            words = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
            self.bytes = [b""] * (1 + max(words.values()))
            for w, i in words.items():
                self.bytes[i] = bytes(byte[c] for c in w)
            for w in self.bytes:
                raw = np.frombuffer(w, np.uint8)
                if (~blank_before(raw)[:-1] & (raw[1:] == 0x20)).any():
                    raise ValueError(f"{path}: {w!r} reaches over a space")
            self.ids = lambda texts: [e.ids for e in own.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            import sentencepiece

            own = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = [own.id_to_piece(i) for i in range(own.get_piece_size())]
            if any(MARK in p.lstrip(MARK) for p in pieces):
                raise ValueError(f"{path}: a piece reaches over a space")
            self.bytes = [bytes([int(p[1:-1], 16)]) if own.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
            self.ids = lambda texts: own.encode([t[1:] for t in texts], num_threads=1)  # it adds the space itself
        self.sizes = np.array([len(b) for b in self.bytes], np.int32)
        if self.sizes.max() >= LENGTH or len(self.sizes) > (1 << 31) // LENGTH:
            raise ValueError(f"{path}: a token of {LENGTH} bytes and more, or too many tokens")

    def encode(self, chunks: pa.Array) -> pa.Array:
        """The tokens of each chunk, as lists; many chunks are encoded in one text."""
        sizes = pc.binary_length(chunks).to_numpy().astype(np.int64)
        data = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(chunks)], pa.int32()), chunks), "")[0].as_py().encode()
        ends = np.cumsum(sizes)
        alone = blank_before(np.frombuffer(data, np.uint8))[ends - 1]  # white space at the end would reach over to the next chunk
        texts, at = [], 0
        while at < len(sizes):
            end = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + JOINED)))
            stop = np.flatnonzero(alone[at:end])
            end = at + int(stop[0]) + 1 if len(stop) else end
            texts.append(data[ends[at] - sizes[at] : ends[end - 1]].decode())
            at = end
        flat = np.concatenate([np.empty(0, np.int32), *(np.array(i, np.int32) for i in self.ids(texts))])
        upto = np.cumsum(self.sizes[flat].astype(np.int64))
        cuts = np.searchsorted(upto, ends) + 1
        if len(sizes) and (cuts[-1] != len(flat) or not np.array_equal(upto[cuts - 1], ends)):
            raise ValueError("the vocabulary alters a chunk of text")
        offsets = pa.array(np.concatenate([[0], cuts]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(flat * LENGTH + self.sizes[flat]))


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def forget() -> None:
    """Vocabularies that a worker loaded for an earlier step go, for the worker serves the next step too."""
    _loaded.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()


def encoded(chunks: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(places, n, a, b): a chunk's tokens in either vocabulary; its text is needed no longer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in parts_of(batch, "chunk", PART):
                text = rows.column("chunk")
                yield pa.RecordBatch.from_arrays([rows.column("places"), rows.column("n"), vocabulary(path_a).encode(text), vocabulary(path_b).encode(text)], ["places", "n", "a", "b"])

    return chunks.select("chunk", "places", "n").mapInArrow(run, "places array<long>, n long, a array<int>, b array<int>")


def grouped(chunks: DataFrame) -> DataFrame:
    """(id, n_a, n_b, groups, links: array of (a, b)) of each row of ``chunks`` (id, a, b)."""
    in_order = Window.partitionBy("id", "side").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("id").orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
    # dealt by id before tokens become rows, so nothing that follows moves them again
    sides = chunks.repartition("id").select("id", F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("ts")) for i, c in enumerate("ab")])).alias("s"))
    tokens = sides.select("id", "s.side", F.posexplode("s.ts").alias("place", "t"))
    ends = tokens.select("id", "side", "t", F.sum(F.col("t") % LENGTH).over(in_order).alias("end"))
    # a row for each chunk and end: A and B meet where they share it; no token is empty, so a side ends there once
    token = lambda i, c: F.max(F.when(F.col("side") == i, F.floor(F.col("t") / LENGTH).cast("int"))).alias(c)
    met = ends.groupBy("id", "end").agg(token(0, "a"), token(1, "b"))
    # g counts the ends before that both sides share
    rows = met.withColumn("g", F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).over(before))
    own = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("end", c)))), lambda x: x[c]).alias(c)
    groups = rows.groupBy("id", "g").agg(own("a"), own("b"))
    last = lambda c: F.element_at(F.col(c), -1).alias(c)
    groups = groups.select("id", "g", F.size("a").alias("n_a"), F.size("b").alias("n_b"), F.struct(last("a"), last("b")).alias("link"), F.concat_ws("|", F.concat_ws(",", F.col("a").cast("array<string>")), F.concat_ws(",", F.col("b").cast("array<string>"))).alias("text"))
    whole = groups.groupBy("id").agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), F.array_sort(F.collect_list(F.struct("g", "link", "text"))).alias("all"))
    return whole.select("id", "n_a", "n_b", F.concat_ws(";", F.col("all.text")).alias("groups"), F.col("all.link").alias("links"))


@contextmanager
def together(spark: SparkSession) -> Iterator[None]:
    """Rows dealt by a part of a join's keys are joined where they are; the keys left out here are chunks, of which none is hot."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def pair_counts(links: DataFrame) -> DataFrame:
    """(a, b, count, best) from (n, a, b): how often a pair is linked, and whether no other A token is linked to b as often."""
    counts = links.groupBy("a", "b").agg(F.sum("n").alias("count"))
    top = counts.groupBy("b").agg(F.max("count").alias("top"))
    return counts.join(top, "b").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the values of each list, which begin at ``ends[i]`` and end before ``ends[i + 1]``."""
    upto = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return upto[ends[1:]] - upto[ends[:-1]]


def offsets(lists: pa.Array) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).astype(np.int64)


def sent(whole: DataFrame, pairs: DataFrame) -> DataFrame:
    """(part, packed): what each chunk of ``whole`` has, for every part that holds it; a part's rows travel together, squeezed.

    Few pairs reach every task, so that no chunk moves before that; more of them are met by a shuffle, which adaptive execution may split.
    """
    few, known = pairs.count() <= PAIRS, None
    if few:
        table = pairs.select(two("a", "b").alias("pair"), "count", "best").toArrow()
        pair, count, best = (table.column(c).to_numpy() for c in ("pair", "count", "best"))
        order = np.argsort(pair)
        known = whole.sparkSession.sparkContext.broadcast((pair[order], count[order], best[order]))
        rows = whole.select("places", "n_a", "n_b", "groups", F.transform("links", lambda l: two(l.a, l.b)).alias("links"))
    else:
        each = whole.repartition("id").select("id", "places", "n_a", "n_b", "groups", F.size("links").alias("n_groups"), F.explode("links").alias("l")).select("*", "l.a", "l.b").drop("l")
        rows = each.join(pairs, ["a", "b"]).groupBy("id", "places", "n_a", "n_b", "groups", "n_groups").agg(F.count(F.when(F.col("best"), 1)).alias("n_best"), F.sum("count").alias("count_sum")).drop("id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in joined(batches, PART):
            own = {c: batch.column(c).to_numpy() for c in ("n_a", "n_b")}
            if few:
                links = batch.column("links")
                ends, (pair, count, best) = offsets(links), known.value
                at = np.searchsorted(pair, links.flatten().to_numpy())
                own |= {"n_groups": np.diff(ends), "n_best": sums(best[at], ends), "count_sum": sums(count[at], ends)}
            else:
                own |= {c: batch.column(c).to_numpy() for c in ("n_groups", "n_best", "count_sum")}
            places = batch.column("places")
            chunk, place = np.repeat(np.arange(batch.num_rows), np.diff(offsets(places))), places.flatten().to_numpy()
            order = np.argsort(place)
            chunk, place = chunk[order], place[order]
            part = place // NUMBERS
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            packed = []
            for a, b in zip(cuts, [*cuts[1:], len(part)]):
                x = chunk[a:b]
                figures = [pa.array(own[c][x].astype(SENT.field(c).type.to_pandas_dtype())) for c in ("n_a", "n_b", "n_groups", "n_best", "count_sum")]
                rows = pa.RecordBatch.from_arrays([pa.array((place[a:b] % NUMBERS).astype(np.int32)), *figures, batch.column("groups").take(pa.array(x))], schema=SENT)
                packed.append(squeeze.compress(rows.serialize()))
            yield pa.RecordBatch.from_arrays([pa.array(part[cuts]), pa.array(packed, pa.binary())], ["part", "packed"])

    return rows.mapInArrow(run, "part long, packed binary")


def two(a, b) -> Column:
    """Two numbers in one."""
    c = lambda x: (F.col(x) if isinstance(x, str) else x).cast("long")
    return c(a) * (1 << 32) + c(b)


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary_a: str | None = None, vocabulary_b: str | None = None) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each row of ``docs``; groups: ``a1,a2|b1;a3|b2,b3``."""
    path_a, path_b = vocabulary_a or public_tokenizers.path(VOCABULARY_A), vocabulary_b or public_tokenizers.path(VOCABULARY_B)
    with small_batches(docs.sparkSession):
        cut = written(parts(docs, key, text), "alignment-parts", "zstd")
    own = cut.where("place is not null").groupBy("chunk").agg(F.collect_list("place").alias("places"), F.sum("n").alias("n"))
    chunks = written(encoded(own, path_a, path_b).withColumn("id", F.monotonically_increasing_id()), "alignment-chunks", "zstd")
    released(docs.sparkSession)
    with together(docs.sparkSession):
        whole = written(grouped(chunks).join(chunks.select("id", "places", "n"), "id"), "alignment-groups", "zstd")

    links = whole.select("n", F.explode("links").alias("l")).select("n", "l.a", "l.b")
    pairs = written(pair_counts(links), "alignment-pairs")
    released(docs.sparkSession)
    kind = dict(docs.dtypes)[key]
    none = lambda t: F.lit(None).cast(t)
    texts = cut.where("place is null").select("part", F.lit(1).alias("role"), "doc", "refs", none("binary").alias("packed"))
    back = sent(whole, pairs).select("part", F.lit(0).alias("role"), none(kind).alias("doc"), none("array<int>").alias("refs"), "packed")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A part's chunks come first and are kept; its documents stream past them."""
        last, held, found, loosen = None, [], None, zstandard.ZstdDecompressor()
        for batch in batches:
            part, role = batch.column("part").to_numpy(), batch.column("role").to_numpy()
            cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(role) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(part)]):
                if b > a and part[a] != last:
                    last, held, found = part[a], [], None
                if b > a and not role[a]:
                    held += batch.column("packed").slice(a, b - a).to_pylist()
                    continue
                if found is None:
                    found = pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(loosen.decompress(x)), SENT) for x in held], SENT).combine_chunks()
                    place = np.empty(found.num_rows, np.int32)
                    place[found.column("idx").to_numpy()] = np.arange(found.num_rows, dtype=np.int32)
                    # a group's last tokens end together and no token is empty, so every group is one link
                    own = [found.column("n_groups" if c == "n_links" else c).to_numpy() for c in FIGURES]
                    groups, held = found.column("groups").combine_chunks(), []
                for i in range(a, b, ROWS):
                    rows = batch.slice(i, min(ROWS, b - i))
                    refs = rows.column("refs")
                    ends, at = offsets(refs), place[refs.flatten().to_numpy()]
                    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), groups.take(pa.array(at)))
                    yield pa.RecordBatch.from_arrays([rows.column("doc"), *(pa.array(sums(x[at], ends)) for x in own), pc.binary_join(lists, ";")], [key, *FIGURES, "groups"])

    met = texts.unionByName(back).repartition("part").sortWithinPartitions("part", "role")
    return met.mapInArrow(summed, f"`{key}` {kind}, {', '.join(f'{c} long' for c in FIGURES)}, groups string")


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    """Whole documents aligned, their groups reduced to a digest."""
    out = align(table(spark, sf_dir, "documents"))
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), *FIGURES, digest.alias("groups_sha256"))
