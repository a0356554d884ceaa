"""Phrase collocations by pivot partitioning.

Words are counted by language and numbered from the most frequent down; words below the least frequency cut a piece of text like
punctuation.  The rarest word of a phrase, its first occurrence if it has several, is the phrase's pivot.  Around every word
the text is rewritten to what its own phrases can hold: up to four words before it that are more frequent and up to four after it that are
not rarer.  Equal fragments of a part are one row with a number, packed by bucket; a bucket holds whole pivots, so it counts
phrases to the end by itself, level by level (a phrase is counted only where both phrases one word shorter around the
pivot are frequent), and emits only what reaches the least frequency.  Pivots too frequent for one bucket are divided by the words next
to them, which again keeps every phrase whole; what is left of the hottest ones consists of few words and is few distinct fragments.

The word list reaches the tasks by broadcast while it has at most ``LISTED`` words; beyond that, parts are written with their
distinct words, numbers are joined to these, and parts and words meet by part.  Results are the same.

Scores are exact: products are decimals of 38 digits, divided as integers.

Defined results: null text counts as empty, null language as ``und``; empty tables and texts give no phrases; very long texts are
handled whole; repeated rows count as often as they occur; ties are ordered as stated by ``collocations``; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.exprs import ordinal
from gridloom.llm.common import parts_of, table, written
from gridloom.llm.words import mix

LEAST, LONGEST, TOP = 100, 5, 2_000
#: Words of the list up to which it is broadcast (some 30 MB).
LISTED = 1 << 20
#: Occurrences of a pivot from which its fragments are divided by the words next to it.
HOT = 1 << 20
#: Bytes of text in a part; buckets for each partition of a shuffle.
PART, BUCKETS = 1 << 22, 4
UNKNOWN = "und"
# What ends a piece, and what parts words inside one.
ENDS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
SIDE = LONGEST - 1  # words on either side of a pivot
_U = np.uint64


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words of the texts in order, A-Z lower-cased; whether each begins a piece)."""
    data = np.frombuffer(b"\n".join(t or b"" for t in texts.cast(pa.binary()).to_pylist()), np.uint8)
    data = np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, data).astype(np.uint8)
    end = np.isin(data, np.frombuffer(ENDS, np.uint8))
    inside = ~(end | np.isin(data, np.frombuffer(GAPS, np.uint8)))
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ends_before = np.cumsum(end)
    begins = np.ones(len(starts), bool)
    begins[1:] = ends_before[starts[1:]] != ends_before[stops[:-1] - 1]
    offsets = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]), begins


def language_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array]]:
    """(language, texts) of each part and language."""
    for batch in batches:
        for rows in parts_of(batch, "text", PART):
            langs = rows.column("lang")
            for lang in pc.unique(langs).to_pylist():
                yield lang, rows.column("text").filter(pc.equal(langs, lang))


def texts_of(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, f) over all of ``docs`` (lang, text); the row whose word is null counts all words of the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in language_parts(batches):
            words, _ = words_of(texts)
            coded = words.dictionary_encode()
            n = np.append(np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)), len(words))
            found = pa.concat_arrays([coded.dictionary, pa.nulls(1, pa.string())])
            for a in range(0, len(found), 20_000):
                own = found.slice(a, 20_000)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), own, pa.array(n[a : a + 20_000])], ["lang", "word", "n"])

    return docs.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("f"))


def hashed(rows: np.ndarray) -> np.ndarray:
    """64 bits of each row of numbers."""
    out = np.zeros(len(rows), np.uint64)
    for c in range(rows.shape[1]):
        out = mix(out * _U(0x9E3779B97F4A7C55) + (rows[:, c].astype(np.int64).astype(np.uint64) + _U(2)))
    return out


def gathered(rows: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct rows, their weights' sums, number of the distinct row of each row); exact, whatever the hashes."""
    _, first, at = np.unique(hashed(rows), return_index=True, return_inverse=True)
    if not np.array_equal(rows, rows[first][at]):
        own, at = np.unique(rows, axis=0, return_inverse=True)
        return own, np.bincount(at.reshape(-1), weight, len(own)).astype(np.int64), at.reshape(-1)
    return rows[first], np.bincount(at, weight, len(first)).astype(np.int64), at


def fragments(numbers: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A row of 2 * SIDE + 1 numbers for each pivot with a neighbour: the pivot in the middle, -1 outside its fragment.

    ``numbers`` are the words' in order, -1 for infrequent ones; a larger number is a rarer word.
    """
    at = np.arange(len(numbers)) + np.cumsum(begins) + SIDE
    line = np.full((at[-1] + 1 if len(at) else 0) + SIDE, -1, np.int32)
    line[at] = numbers
    at = at[numbers >= 0]
    pivot = line[at]
    out = np.full((len(at), 2 * SIDE + 1), -1, np.int32)
    out[:, SIDE] = pivot
    for step, fits in ((-1, np.less), (1, np.less_equal)):
        open_ = np.ones(len(at), bool)
        for k in range(1, SIDE + 1):
            own = line[at + step * k]
            open_ &= (own >= 0) & fits(own, pivot)
            out[open_, SIDE + step * k] = own[open_]
    return out[(out[:, SIDE - 1] >= 0) | (out[:, SIDE + 1] >= 0)]


def routed(rows: np.ndarray, hot: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, weights, whether only phrases on both sides of the pivot count, bucket), ordered by bucket.

    ``hot`` says of each row whether its pivot is divided: by the word before it, the word after it, or both.
    """
    left, right = rows[:, SIDE - 1] >= 0, rows[:, SIDE + 1] >= 0
    split = rows[hot]
    before, after = split[left[hot]].copy(), split[right[hot]].copy()
    before[:, SIDE + 1 :], after[:, :SIDE] = -1, -1
    kinds = [(rows[~hot], 0), (before, 0), (after, 0), (split[left[hot] & right[hot]], 1)]
    found, weights, spans, keys = [], [], [], []
    for i, (own, spanning) in enumerate(kinds):
        own, n, _ = gathered(own, np.ones(len(own)))
        key = own[:, SIDE : SIDE + 1] if i == 0 else own[:, SIDE - 1 : SIDE + 2]
        found.append(own), weights.append(n), spans.append(np.full(len(own), spanning, np.uint8)), keys.append(hashed(key))
    bucket = (np.concatenate(keys) % _U(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    return np.concatenate(found)[order], np.concatenate(weights)[order], np.concatenate(spans)[order], bucket[order]


def packed(rows: np.ndarray, weights: np.ndarray, spans: np.ndarray) -> bytes:
    """Fragments as bytes: extents, weights and numbers by halves, so that like bytes lie together."""
    held = rows >= 0
    meta = held[:, :SIDE].sum(1) | (held[:, SIDE + 1 :].sum(1) << 3) | (spans.astype(np.int64) << 6)
    numbers, weights = rows[held].astype("<u4"), np.minimum(weights, 0xFFFFFFFF).astype("<u4")
    halves = [x for v in (weights, numbers) for x in (v.astype("<u2").tobytes(), (v >> 16).astype("<u2").tobytes())]
    return b"".join([np.array([len(rows), len(numbers)], "<u4").tobytes(), meta.astype(np.uint8).tobytes(), *halves])


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, m = np.frombuffer(data, "<u4", 2).tolist()
    meta, at, got = np.frombuffer(data, np.uint8, n, 8), 8 + n, []
    for size in (n, m):
        low, high = (np.frombuffer(data, "<u2", size, at + 2 * size * i).astype(np.int64) for i in (0, 1))
        got.append(low | (high << 16))
        at += 4 * size
    place = np.arange(2 * SIDE + 1)
    held = (place >= SIDE - (meta & 7)[:, None].astype(np.int64)) & (place <= SIDE + ((meta >> 3) & 7)[:, None].astype(np.int64))
    rows = np.full((n, 2 * SIDE + 1), -1, np.int32)
    rows[held] = got[1]
    return rows, got[0], meta >> 6


def mined(rows: np.ndarray, weights: np.ndarray, spans: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(phrases as rows of numbers, frequencies) of each length, of those that hold their fragment's pivot and are frequent."""
    every = np.ones(len(rows), bool)
    frequent = {(SIDE, SIDE): every}
    for size in range(2, LONGEST + 1):
        for start in range(SIDE - size + 1, SIDE + 1):
            end = start + size - 1
            both = start < SIDE < end
            able = (rows[:, start] >= 0) & (rows[:, end] >= 0) & ((spans == 0) | both)
            for a, b in ((start + 1, end), (start, end - 1)):
                if a <= SIDE <= b:
                    able &= frequent[a, b] | ((spans == 1) if not a < SIDE < b else False)
            frequent[start, end] = np.zeros(len(rows), bool)
            own = np.flatnonzero(able)
            if len(own):
                phrases, n, at = gathered(rows[own, start : end + 1], weights[own])
                frequent[start, end][own] = (n >= least)[at]
                if (n >= least).any():
                    yield phrases[n >= least], n[n >= least]


def blobs(numbers: np.ndarray, begins: np.ndarray, hot: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, fragments) of one part; ``hot``: by number, whether the word is a divided pivot."""
    rows = fragments(numbers, begins)
    rows, weights, spans, bucket = routed(rows, hot[rows[:, SIDE]], buckets)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    out = [packed(rows[a:b], weights[a:b], spans[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
    yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), pa.array(out, pa.binary())], ["bucket", "fragments"])


def listed_fragments(docs: DataFrame, numbered: DataFrame, buckets: int, hot: int) -> DataFrame:
    """(bucket, fragments) of ``docs`` (lang, text), the word list at hand in every task."""
    own = numbered.orderBy("id").toPandas()  # at most ``LISTED`` rows
    lists = {lang: (pa.array(g["word"], pa.string()), g["id"].to_numpy(np.int32)) for lang, g in own.groupby("lang")}
    shared = docs.sparkSession.sparkContext.broadcast((lists, own["f"].to_numpy() > hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = shared.value
        for lang, texts in language_parts(batches):
            if lang in known:
                words, begins = words_of(texts)
                coded = words.dictionary_encode()
                found = pc.fill_null(pc.index_in(coded.dictionary, known[lang][0]), -1).to_numpy()
                number = np.where(found >= 0, known[lang][1][found], -1)
                yield from blobs(number[coded.indices.to_numpy()], begins, often, buckets)

    return docs.mapInArrow(run, "bucket int, fragments binary")


def joined_fragments(docs: DataFrame, numbered: DataFrame, buckets: int, hot: int) -> DataFrame:
    """As ``listed_fragments`` for word lists of any size: each part's distinct words are joined to the list."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        names = ["part", "lang", "refs", "begins", "idx", "word"]
        for lang, texts in language_parts(batches):
            words, begins = words_of(texts)
            coded = words.dictionary_encode()
            one = [pa.array([number]), pa.array([lang], pa.string()), pa.array([coded.indices.to_numpy()], pa.list_(pa.int32())), pa.array([np.flatnonzero(begins).astype(np.int32)], pa.list_(pa.int32())), pa.nulls(1, pa.int32()), pa.nulls(1, pa.string())]
            yield pa.RecordBatch.from_arrays(one, names)
            k = len(coded.dictionary)
            rows = [pa.array(np.full(k, number)), pa.array([lang] * k, pa.string()), pa.nulls(k, pa.list_(pa.int32())), pa.nulls(k, pa.list_(pa.int32())), pa.array(np.arange(k, dtype=np.int32)), coded.dictionary]
            yield pa.RecordBatch.from_arrays(rows, names)
            number += 1

    cut = written(docs.mapInArrow(split, "part long, lang string, refs array<int>, begins array<int>, idx int, word string"), "collocations-parts")
    known = cut.where("idx is not null").join(numbered, ["lang", "word"]).select(F.col("part").alias("home"), "idx", F.col("id").cast("int").alias("id"), (F.col("f") > hot).alias("hot"))

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        refs = left.column("refs").combine_chunks().flatten().to_numpy()
        begins = np.zeros(len(refs), bool)
        begins[left.column("begins").combine_chunks().flatten().to_numpy()] = True
        ids = right.column("id").to_numpy()
        # numbers within the part keep the order of the whole list; the words' own are put back below
        order = np.sort(ids)
        number = np.full(int(refs.max(initial=-1)) + 1, -1, np.int64)
        number[right.column("idx").to_numpy()] = np.searchsorted(order, ids)
        often = np.zeros(len(order), bool)
        often[np.searchsorted(order, ids)] = right.column("hot").to_numpy(zero_copy_only=False)
        rows = fragments(number[refs], begins)
        hot_rows = often[rows[:, SIDE]]
        rows = np.where(rows >= 0, order[rows] if len(order) else rows, -1).astype(np.int32)
        rows, weights, spans, bucket = routed(rows, hot_rows, buckets)
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
        out = [packed(rows[a:b], weights[a:b], spans[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
        return pa.table({"bucket": pa.array(bucket[cuts[:-1]], pa.int32()), "fragments": pa.array(out, pa.binary())})

    whole = cut.where("idx is null").select("part", "refs", "begins")
    return whole.groupBy("part").cogroup(known.groupBy("home")).applyInArrow(met, "bucket int, fragments binary")


def frequent_phrases(found: DataFrame, buckets: int, least: int) -> DataFrame:
    """(gram: array of numbers, a) of all frequent phrases of two words and more; each bucket by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(own: list[bytes]) -> Iterator[pa.RecordBatch]:
            rows, weights, spans = (np.concatenate(x) for x in zip(*map(unpacked, own)))
            for phrases, n in mined(rows, weights, spans, least):
                grams = pa.FixedSizeListArray.from_arrays(pa.array(phrases.reshape(-1)), phrases.shape[1]).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([grams, pa.array(n)], ["gram", "a"])

        now, held = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("fragments").to_pylist()):
                if bucket != now and held:
                    yield from counted(held)
                    held = []
                now = bucket
                held.append(blob)
        if held:
            yield from counted(held)

    return found.repartition(max(1, buckets // BUCKETS), "bucket").sortWithinPartitions("bucket").mapInArrow(run, "gram array<int>, a long")


def phrase_counts(docs: DataFrame, least: int = LEAST, text: str = "text", lang: str = "lang", listed: int = LISTED, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """((lang, words, phrase, a) of all phrases of 1 to LONGEST words with a >= ``least``, (lang, n) of all words)."""
    own = texts_of(docs, text, lang)
    counts = written(word_counts(own).where(F.col("word").isNull() | (F.col("f") >= least)), "collocations-words")
    n = counts.where("word is null and f > 0").select("lang", F.col("f").alias("n"))
    numbered = written(ordinal(counts.where("word is not null"), [F.desc("f"), F.col("lang"), F.col("word")], "id").withColumn("id", F.col("id") - 1), "collocations-list")
    buckets = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    way = listed_fragments if numbered.count() <= listed else joined_fragments
    grams = written(frequent_phrases(way(own, numbered, buckets, hot), buckets, least).withColumn("g", F.monotonically_increasing_id()), "collocations-phrases")
    spelled = grams.select("g", "a", F.posexplode("gram").alias("place", "id")).join(numbered.select("id", "lang", "word"), "id")
    spelled = spelled.groupBy("g").agg(F.first("lang").alias("lang"), F.first("a").alias("a"), F.array_sort(F.collect_list(F.struct("place", "word"))).alias("w")).select("lang", F.col("w.word").alias("words"), "a")
    single = numbered.select("lang", F.array("word").alias("words"), F.col("f").alias("a"))
    return single.unionByName(spelled).withColumn("phrase", F.array_join("words", " ")), n


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, text: str = "text", lang: str = "lang", listed: int = LISTED, hot: int = HOT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language by score, then a, both descending, then phrase.

    score = floor(1000 a n / (l r)) of the cut that makes it lowest, ties to the shortest first part; phrases inside a longer one that is as
    frequent are left out.
    """
    counts, n = phrase_counts(docs, least, text, lang, listed, hot)
    counts = written(counts, "collocations-counts")
    several = counts.where(F.size("words") > 1)
    inner = F.expr("flatten(transform(sequence(2, size(words) - 1), m -> transform(sequence(1, size(words) - m + 1), s -> array_join(slice(words, s, m), ' '))))")
    covered = several.where(F.size("words") > 2).select("lang", "a", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = several.join(covered, ["lang", "phrase"], "left").where("longer is null or longer < a").select("lang", "phrase", "words", "a")
    cuts = kept.select("lang", "phrase", "a", F.explode(F.expr("transform(sequence(1, size(words) - 1), k -> struct(k as k, array_join(slice(words, 1, k), ' ') as first, array_join(slice(words, k + 1, size(words)), ' ') as rest))")).alias("c"))
    cuts = cuts.select("lang", "phrase", "a", "c.k", "c.first", "c.rest")
    part = lambda c, f: counts.select("lang", F.col("phrase").alias(c), F.col("a").alias(f))
    both = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(n, "lang")
    scored = both.withColumn("score", F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(18,0)))"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return best.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    """Collocations of all documents by language."""
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def op12_sql() -> str:
    return rf"""
    WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    p AS (SELECT lang, list_filter(string_split_regex(unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')), '[\x20\x09]+'), lambda x: x <> '') AS w FROM d),
    i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p WHERE len(w) > 0),
    g AS (SELECT lang, w[i : i + m - 1] AS w FROM i, (SELECT unnest(range(1, {LONGEST + 1})) AS m) WHERE i + m - 1 <= len(w)),
    f AS (SELECT lang, array_to_string(w, ' ') AS phrase, w, count(*) AS a FROM g GROUP BY lang, w HAVING count(*) >= {LEAST}),
    n AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
    s AS (SELECT lang, a, w, unnest(range(1, len(w))) AS i FROM f WHERE len(w) > 2),
    c AS (SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT lang, a, w, unnest(range(1, len(w))) AS i FROM f WHERE len(w) > 2), (SELECT unnest(range(2, {LONGEST})) AS m)
      WHERE m < len(w) AND i + m - 1 <= len(w) GROUP BY 1, 2),
    k AS (SELECT f.lang, f.phrase, f.w, f.a, unnest(range(1, len(f.w))) AS k FROM f LEFT JOIN c ON c.lang = f.lang AND c.phrase = f.phrase WHERE len(f.w) > 1 AND coalesce(c.longer < f.a, true)),
    x AS (SELECT k.lang, k.phrase, k.a, l.a AS l, r.a AS r, n.n, (1000::HUGEINT * k.a::HUGEINT * n.n::HUGEINT) // (l.a::HUGEINT * r.a::HUGEINT) AS score, k.k
      FROM k JOIN f l ON l.lang = k.lang AND l.w = k.w[1 : k.k] JOIN f r ON r.lang = k.lang AND r.w = k.w[k.k + 1 :] JOIN n ON n.lang = k.lang),
    b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM x),
    o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM b WHERE o = 1)
    SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM o WHERE rank <= {TOP}
    """
