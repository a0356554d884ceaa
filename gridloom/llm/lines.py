"""Line dedup: lines that many documents share stay only in the last of these documents.

Every long line becomes two hashes of its key (128 bits), its document and its place; texts stay where they are.  The hashes
are range-partitioned with document and place as further keys, so a line that a third of all documents hold is spread over as
many partitions as it fills, and each partition streams the first occurrence of a key in a document.  First occurrences are
counted by key (combined before the shuffle), lines are joined to the keys that are frequent enough, and what comes back is a
bitmap a document: words of 64 lines, those without a dropped line left out.  Only the last step meets texts again, once.

DataFrame functions alone; no Python runs on an executor.

Defined results: a null text counts as empty, an empty text is one empty line; very long texts and lines are handled whole; rows
that share an id count as one document and each keeps its own text; rows without an id count for nothing and keep all lines;
ties cannot occur, for the largest id is unique; an empty table gives an empty one; other columns pass through, those that clash
with an output's name are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import table, written

#: Keys of fewer code points are never dropped; nor are those found in fewer documents.
LEAST_CHARS, LEAST_DOCS = 40, 5
# What is stripped from both ends of a line, and the letters that are lower-cased.
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """Stripped, A-Z lower-cased.  Lines of single bytes take the short way, on which both functions agree."""
    own = F.btrim(line, F.lit(BLANK))
    return F.when(F.octet_length(own) == F.char_length(own), F.lower(own)).otherwise(F.translate(own, UPPER, LOWER))


def keep_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text_hash, keep: array of (word, bits), n_dropped) of the documents that lose a line.

    Bit i of a word is set where line 64 * word + i stays; words that are not listed keep all their lines.
    """
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.xxhash64(text).alias("text_hash"), F.posexplode(lines_of(F.col(text))).alias("place", "line"))
    long = rows.where(F.char_length("line") >= least_chars).withColumn("k", line_key(F.col("line"))).where(F.char_length("k") >= least_chars)
    hashed = long.select(F.xxhash64("k").alias("h1"), F.xxhash64(F.lit("line"), "k").alias("h2"), "doc", "text_hash", "place")
    hashed = written(hashed, "lines-hashes")  # the borders of a range partitioning are drawn in a pass of their own
    dealt = hashed.repartitionByRange("h1", "h2", "doc").sortWithinPartitions("h1", "h2", "doc", "text_hash", "place")
    first = F.row_number().over(Window.partitionBy("h1", "h2", "doc").orderBy("text_hash", "place")) == 1
    streamed = written(dealt.withColumn("first", first), "lines-sorted")

    shared = streamed.where("first").groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc").alias("holder")).where(F.col("docs") >= least_docs)
    shared = written(shared, "lines-shared")  # read back with its size, and so that the join below can split a hot line
    lost = streamed.join(shared, ["h1", "h2"]).where("doc <> holder")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % 64).cast("int"))
    words = lost.groupBy("doc", "text_hash", F.floor(F.col("place") / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("lost"))
    return words.groupBy(F.col("doc").alias(key), "text_hash").agg(
        F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("lost").alias("bits")))).alias("keep"),
        F.sum(F.bit_count("lost")).cast("long").alias("n_dropped"),
    )


def kept_text(text: Column, keep: Column) -> Column:
    """The lines whose bit is set, joined again.  The listed words are first laid out in full, so a line's bit is one look-up."""
    gap = lambda x, i: x["word"] - F.when(i > 0, F.get(keep, i - 1)["word"]).otherwise(F.lit(-1)) - 1
    dense = F.flatten(F.transform(keep, lambda x, i: F.concat(F.array_repeat(F.lit(-1).cast("long"), gap(x, i)), F.array(x["bits"]))))
    # each word once more as its lines' flags, still in order, so that lines and flags meet by place
    flags = F.flatten(F.transform(dense, lambda bits: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(bits, i) == 1)))
    lines = F.zip_with(lines_of(text), flags, lambda line, flag: F.when(F.coalesce(flag, F.lit(True)), line))
    return F.concat_ws("\n", F.filter(lines, lambda line: line.isNotNull()))


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with kept (the text without its dropped lines), n_lines and n_dropped."""
    docs = docs.drop("kept", "n_lines", "n_dropped")
    found = keep_bitmaps(docs, least_chars, least_docs, key, text).select(F.col(key).alias("_doc"), F.col("text_hash").alias("_hash"), F.col("keep").alias("_keep"), "n_dropped")
    both = docs.join(found, (F.col(key) == F.col("_doc")) & (F.xxhash64(text) == F.col("_hash")), "left")
    own = F.coalesce(F.col(text), F.lit(""))
    out = both.withColumns({"kept": F.when(F.col("_keep").isNull(), own).otherwise(kept_text(F.col(text), F.col("_keep"))), "n_lines": F.size(lines_of(F.col(text))).cast("long"), "n_dropped": F.coalesce("n_dropped", F.lit(0).cast("long"))})
    return out.select(*docs.columns, "kept", "n_lines", "n_dropped")


def op11_lines(spark, sf_dir: str) -> DataFrame:
    """Line dedup of whole documents, reduced to digests."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op11_sql() -> str:
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM d),
    k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{UPPER}', '{LOWER}') AS key FROM l),
    s AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= {LEAST_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}),
    m AS (SELECT doc_id, line, place, coalesce(doc_id <> holder, false) AS lost FROM k LEFT JOIN s USING (key))
    SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (lost) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT lost), '')) AS kept_sha256
    FROM m GROUP BY doc_id
    """
