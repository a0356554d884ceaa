"""Substring dedup with repeated-phrase automata.

A window is ``WINDOW`` consecutive words.  Every word that lies in a window whose word sequence also starts earlier
(smaller id, or same text and earlier start) is removed; windows are judged on the input.

1. Words are spelled by one letter each (8 bits of their hash).  Each window has one phrase, the spelling of ``PHRASE``
   consecutive words, of smallest mixed value in it.  Equal windows have equal phrases, so only phrases that recur can belong to
   recurring windows.  Phrases are counted over all texts; a spelling is a number of 64 bits, so it is what is shuffled.
2. Texts are dealt to shards by id; the shard count follows the corpus size.  A shard gets the spellings of the recurring
   phrases met in it, compiles them into one Aho-Corasick automaton without a look at its texts, and streams these, spelled,
   through the automaton, which locates every occurrence.  Windows whose phrase was located are candidates.
3. Candidates are judged first inside the shard (so a passage that very many texts share leaves one row a shard).  What is left
   goes on as segments, the neighbouring windows of one located phrase: of segments equal as a whole all but those of the smallest
   id are removed, and only where a phrase has different segments are windows compared one by one.  Equal means the same
   phrase and the same 64 bits of hash over the whole words.
4. The removed windows of each text, gathered by text, go back to the shards, whose texts were shuffled once for both uses,
   and are cut out there.

Defined results: null text has no words; texts below ``WINDOW`` words keep everything; rows with a null id are neither
compared nor cut; rows that share an id are told apart by text, and windows at the same id and start do not count as
earlier; other columns do not matter; any text length is handled whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import table
from gridloom.llm.words import long_rolling, mix, texts_words

WINDOW, PHRASE = 20, 8
#: Characters of text in a shard, about.
SHARD_CHARS = 8_000_000


def spelled_out(hashes: np.ndarray) -> np.ndarray:
    """One letter (1 to 255) for each word; words that share one only make more candidates."""
    return ((hashes >> np.uint64(24)) % np.uint64(255)).astype(np.uint8) + np.uint8(1)


def phrase_starts(letters: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """(spelling of the phrase at each position as a number, position of each window's phrase): leftmost smallest in each window."""
    if len(letters) < window:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    grams = np.zeros(len(letters) - phrase + 1, np.uint64)
    for i in range(phrase):
        grams = (grams << np.uint64(8)) | letters[i : i + len(grams)]
    inside = np.lib.stride_tricks.sliding_window_view(mix(grams), window - phrase + 1)
    return grams, inside.argmin(axis=1) + np.arange(len(inside))


def encoded(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def phrases(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """(phrase, shard, n): how often each window phrase was chosen, combined per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, shards = [], []
            of = batch.column("shard").to_numpy()
            for i, hashes in texts_words(encoded(batch.column("text").to_pylist())):
                grams, at = phrase_starts(spelled_out(hashes), window, phrase)
                if len(at):
                    found.append(grams[at[np.concatenate([[True], at[1:] != at[:-1]])]])
                    shards.append(np.full(len(found[-1]), of[i], np.uint64))
            if found:
                grams, shards = np.concatenate(found), np.concatenate(shards)
                order = np.lexsort((grams, shards))
                grams, shards = grams[order], shards[order]
                first = np.flatnonzero(np.concatenate([[True], (grams[1:] != grams[:-1]) | (shards[1:] != shards[:-1])]))
                n = np.diff(np.append(first, len(grams)))
                yield pa.RecordBatch.from_arrays([pa.array(grams[first].view(np.int64)), pa.array(shards[first].astype(np.int32)), pa.array(n.astype(np.int32))], ["phrase", "shard", "n"])

    return docs.select("shard", "text").mapInArrow(run, "phrase long, shard int, n int")


def packed(docs: DataFrame) -> DataFrame:
    """``docs`` with the text squeezed for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for b in batches:
            at = b.schema.get_field_index("text")
            yield b.set_column(at, "text", pa.array([squeeze.compress(t) for t in encoded(b.column("text").to_pylist())], pa.binary()))

    schema = ", ".join(f"{c} {'binary' if c == 'text' else t}" for c, t in docs.dtypes)
    return docs.mapInArrow(run, schema)


def automaton(phrases: np.ndarray, phrase: int):
    """Automaton of phrases given as numbers."""
    out = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    spelled = phrases.astype(">u8").tobytes().decode("latin-1")
    for i in range(0, len(spelled), 8):
        out.add_word(spelled[i + 8 - phrase : i + 8])
    out.make_automaton()
    return out


FOUND = "phrase long, segment long, doc_id long, print long, place long, windows array<long>"
#: A place is the first window << 32 and the number of windows.
LOW = (1 << 32) - 1


def judged(window: int, phrase: int):
    """The shard's work: locate phrases, judge candidate windows inside the shard.

    A row is a segment of windows that stay so far, or, without a list of windows, a run of removed ones (under a key of its own).
    """

    def table(phrase, segment, doc_id, mark, place, sizes, windows) -> pa.Table:
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(windows), mask=pa.array(sizes == 0))
        return pa.table({"phrase": phrase.view(np.int64), "segment": segment.view(np.int64), "doc_id": doc_id, "print": mark, "place": place, "windows": lists})

    none = table(*(np.empty(0, np.int64) for _ in range(7)))

    def run(texts: pa.Table, wanted: pa.Table) -> pa.Table:
        if not texts.num_rows or not wanted.num_rows:
            return none
        texts = texts.filter(pc.is_valid(texts.column("doc_id")))
        loosen = zstandard.ZstdDecompressor()
        ids, prints = texts.column("doc_id").to_numpy(), texts.column("print").to_numpy()
        order = np.lexsort((prints, ids))
        ids, prints = ids[order], prints[order]
        twins = np.unique(ids[1:][(ids[1:] == ids[:-1]) & (prints[1:] != prints[:-1])])  # ids of several texts
        prints = np.where(np.isin(ids, twins), prints, 0)
        machine = automaton(wanted.column("phrase").to_numpy(), phrase)
        raw = texts.column("text")
        keys, names, spots, owners, starts = [], [], [], [], []
        for i, words in texts_words([loosen.decompress(raw[int(k)].as_py()) for k in order]):
            letters = spelled_out(words)
            grams, at = phrase_starts(letters, window, phrase)
            if not len(at):
                continue
            located = np.zeros(len(grams), bool)
            located[np.fromiter((e for e, _ in machine.iter(letters.tobytes().decode("latin-1"))), np.int64) - phrase + 1] = True
            own = np.flatnonzero(located[at])
            if len(own):
                keys.append(long_rolling(words, window)[own])
                names.append(grams[at[own]])
                spots.append(at[own])
                owners.append(np.full(len(own), i))
                starts.append(own)
        if not keys:
            return none
        key, name, spot, owner, start = (np.concatenate(x) for x in (keys, names, spots, owners, starts))
        # the first of equal windows: rows come by id and start
        by = np.lexsort((np.arange(len(key)), name, key))
        new = np.concatenate([[True], (key[by][1:] != key[by][:-1]) | (name[by][1:] != name[by][:-1])])
        first = np.empty(len(key), np.int64)
        first[by] = by[np.flatnonzero(new)][np.cumsum(new) - 1]
        gone = (ids[owner] != ids[owner[first]]) | (start != start[first])
        # neighbours of one fate become one row; those that stay also have one phrase
        head = np.ones(len(key), bool)
        head[1:] = (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1) | (gone[1:] != gone[:-1]) | (~gone[1:] & (spot[1:] != spot[:-1]))
        at = np.flatnonzero(head)
        size = np.diff(np.append(at, len(key)))
        inside = (np.arange(len(key)) - np.repeat(at, size)).astype(np.uint64)
        segment = mix(np.add.reduceat(mix(key + inside * np.uint64(0x9E3779B97F4A7C15)), at))
        stays = ~gone[at]
        alone = mix(segment ^ mix(owner[at].astype(np.uint64) ^ (start[at].astype(np.uint64) << np.uint64(32))))
        return table(np.where(stays, name[at], alone), segment, ids[owner[at]], prints[owner[at]], (start[at] << 32) | size, np.where(stays, size, 0), key[~gone].view(np.int64))

    return run


def dealt(docs: DataFrame, shards: int) -> DataFrame:
    """``docs`` (with doc_id and print) with the shard of each row; rows without an id are spread by their text."""
    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.col("print"))
    return docs.withColumn("shard", F.pmod(key, F.lit(shards)).cast("int"))


def repeated_passages(docs: DataFrame, texts: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """(doc_id, print, start, n): windows ``start`` to ``start + n - 1`` of the text are removed; print is 0 where an id has one text only.

    ``docs`` has shard, doc_id, print (a hash of the text) and text, ``texts`` the same with the text squeezed.
    """
    if not 0 < phrase <= min(8, window):
        raise ValueError("a phrase has 1 to 8 words and fits into a window")
    counted = phrases(docs.where("doc_id is not null and text is not null"), window, phrase)
    recurring = counted.withColumn("all", F.sum("n").over(Window.partitionBy("phrase"))).where("all > 1").select("phrase", "shard").distinct()
    found = texts.groupBy("shard").cogroup(recurring.groupBy("shard")).applyInArrow(judged(window, phrase), FOUND)
    within = Window.partitionBy("phrase")
    same = Window.partitionBy("phrase", "segment")
    # dealt once by phrase and read twice: for whole rows, and for the windows of the first of segments where a phrase has several
    told = found.repartition("phrase").withColumns({"earliest": F.min("doc_id").over(same), "low": F.min("segment").over(within), "high": F.max("segment").over(within)})
    start, n = F.shiftright("place", 32), F.col("place").bitwiseAND(LOW).cast("int")
    whole = told.where(F.col("windows").isNull() | (F.col("doc_id") > F.col("earliest"))).select("doc_id", "print", start.cast("int").alias("start"), n.alias("n"))
    open_ = told.where(F.col("windows").isNotNull() & (F.col("low") != F.col("high")) & (F.col("doc_id") == F.col("earliest")))
    single = open_.select("phrase", "doc_id", "print", start.alias("start"), F.posexplode("windows").alias("i", "window"))
    lost = single.withColumn("earliest", F.min("doc_id").over(Window.partitionBy("phrase", "window"))).where("doc_id > earliest")
    return whole.unionByName(lost.select("doc_id", "print", (F.col("start") + F.col("i")).cast("int").alias("start"), F.lit(1).alias("n")))


def cut_passages(docs: DataFrame, keep: list[str] | None = None, window: int = WINDOW, phrase: int = PHRASE, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """``docs`` (doc_id, text and the columns ``keep``) with n_words and n_removed, and text without removed words.

    A text that loses words becomes its kept words joined by one space; others stay as they are.  Columns of ``keep`` with
    names used here are left out.
    """
    keep = [c for c in keep or [] if c not in ("doc_id", "text", "print", "shard", "n_words", "n_removed")]
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("print"), *keep)
    shards = max(1, -(-(own.agg(F.sum(F.length("text"))).first()[0] or 0) // shard_chars))
    base = dealt(own, shards)
    texts = packed(base.select("shard", "doc_id", "print", "text", *keep))
    gone = repeated_passages(base.select("shard", "doc_id", "print", "text"), texts, window, phrase)
    cuts = gone.groupBy("doc_id", "print").agg(F.collect_list(F.shiftleft(F.col("start").cast("long"), 32) + F.col("n")).alias("cuts"))
    cuts = dealt(cuts, shards)

    def run(rows: pa.Table, lists: pa.Table) -> pa.Table:
        loosen = zstandard.ZstdDecompressor()
        own = {(d, p): i for i, (d, p) in enumerate(zip(lists.column("doc_id").to_pylist(), lists.column("print").to_pylist()))}
        found = lists.column("cuts").combine_chunks() if lists.num_rows else None
        texts, words, removed = [], [], []
        for doc_id, mark, text in zip(rows.column("doc_id").to_pylist(), rows.column("print").to_pylist(), rows.column("text")):
            raw = loosen.decompress(text.as_py())
            spans = raw.split()
            at, count = own.get((doc_id, 0), own.get((doc_id, mark))), 0
            if at is not None and len(spans) >= window:
                cut = found[at].values.to_numpy()
                step = np.zeros(len(spans) + 1, np.int64)
                np.add.at(step, cut >> 32, 1)
                np.add.at(step, (cut >> 32) + (cut & LOW) - 1 + window, -1)
                gone = np.cumsum(step[:-1]) > 0
                count = int(gone.sum())
                raw = b" ".join([w for w, g in zip(spans, gone.tolist()) if not g])
            texts.append(raw.decode("utf-8", "surrogatepass"))
            words.append(len(spans))
            removed.append(count)
        columns = [rows.column("doc_id"), pa.array(texts, pa.string()), *(rows.column(c) for c in keep), pa.array(words, pa.int64()), pa.array(removed, pa.int64())]
        return pa.table(columns, ["doc_id", "text", *keep, "n_words", "n_removed"])

    kinds = dict(docs.dtypes)
    schema = ", ".join(["doc_id long", "text string", *(f"`{c}` {kinds[c]}" for c in keep), "n_words long", "n_removed long"])
    return texts.groupBy("shard").cogroup(cuts.groupBy("shard")).applyInArrow(run, schema)


def op10_substrings(spark, sf_dir: str) -> DataFrame:
    """All documents without the words of repeated passages, reduced to a digest."""
    cut = cut_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    # the kept words joined by one space: white space runs become one space
    joined = F.regexp_replace(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "), "^ | $", "")
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(joined.cast("binary"), 256).alias("kept_sha256"))


def op10_sql() -> str:
    return r"""
    WITH words AS (
      SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
    ),
    starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM words WHERE len(w) >= 20),
    windows AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 19], ' ')) AS g FROM starts),
    later AS (SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS k FROM windows) WHERE k > 1),
    gone AS (SELECT DISTINCT doc_id, p + unnest(range(0, 20)) AS i FROM later),
    removed AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id),
    kept AS (
      SELECT doc_id, len(w) AS n, coalesce(len(gone), 0) AS r,
        list_filter(w, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)) AS k
      FROM words LEFT JOIN removed USING (doc_id)
    )
    SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept
    """
