"""Language identification with language-bitmask n-gram filters.

Learning counts, per language, in how many sampled documents each letter trigram occurs.  A language contains a trigram
if its share of documents with it is at least ``KEEP`` of the highest share any language has (strays in foreign texts
therefore do not count).  All languages share one bit-sliced Bloom filter: each slot holds one bit per language, so the
AND of a trigram's slots returns all languages that contain it at once.  A document's votes are per-language popcounts,
corrected for each language's false-positive rate; the language with most votes wins.

Defined results: null text or text without a letter is ``und`` with score 0; ties go to the language that sorts first;
very long texts are read whole, in slices that lose no trigram; letters of no known trigram give the first language with score 0;
a table without learnable labels makes everything ``und``; repeated rows and extra columns change nothing, nor do rows that share an
id: each text has its own prediction.  Columns of the output's names are replaced.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import held_out, table

UNKNOWN = "und"
#: Bound of the learning sample: about so many documents of each language (all of them, if fewer).
SAMPLE = 2_000
#: A trigram belongs to a language from this share of its highest document share on.
KEEP = 0.25
#: Documents of a language that must have a trigram.
LEAST = 2
#: Hash functions, and slots for each trigram held.
PROBES, SLOTS_EACH = 3, 12
#: Characters looked at in one go.
SLICE = 1 << 20

_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Hashes of the letter trigrams, word edges included, a slice of the text at a time; runs of other characters count as one space."""
    low, before = text.lower(), np.array([32], np.uint32)
    for a in range(0, max(1, len(low)), SLICE):
        part = np.frombuffer(low[a : a + SLICE].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = np.concatenate([before, np.where(letters()[part], part, np.uint32(32)), [32] if a + SLICE >= len(low) else []]).astype(np.uint64)
        codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
        before = codes[-2:].astype(np.uint32)  # with these the next slice's trigrams begin
        h = (codes[:-2] << np.uint64(42)) ^ (codes[1:-1] << np.uint64(21)) ^ codes[2:]
        h = (h ^ (h >> np.uint64(29))) * _MIX[0]
        yield h ^ (h >> np.uint64(32))


def slots(grams: np.ndarray, bits: int) -> list[np.ndarray]:
    return [((grams * m) >> np.uint64(64 - bits)).astype(np.int64) for m in _MIX[:PROBES]]


class Filters:
    """The bit-sliced filter: one row of language bits (in planes of 64) for each slot."""

    def __init__(self, languages: list[str], grams: np.ndarray, masks: np.ndarray) -> None:
        """masks: planes x grams, the languages that contain each gram."""
        self.languages = languages
        self.bits = max(10, int(np.ceil(np.log2(max(1, len(grams)) * SLOTS_EACH))))
        self.table = np.zeros((len(masks), 1 << self.bits), np.uint64)
        for at in slots(grams, self.bits):
            for plane, mask in zip(self.table, masks):
                np.bitwise_or.at(plane, at, mask)
        fill = np.array([np.mean((self.table[i // 64] >> np.uint64(i % 64)) & np.uint64(1)) for i in range(len(languages))])
        self.false = fill**PROBES

    def votes(self, text: str) -> np.ndarray:
        """Per language, trigrams it contains, less those expected by chance."""
        hits, n = np.zeros(len(self.languages)), 0
        for grams in trigrams(text):
            n += len(grams)
            at = slots(grams, self.bits)
            for p, plane in enumerate(self.table):
                found = plane[at[0]] & plane[at[1]] & plane[at[2]]
                for i in range(64 * p, min(64 * p + 64, len(self.languages))):
                    hits[i] += np.count_nonzero(found & np.uint64(1 << (i % 64)))
        return np.maximum(0, (hits - n * self.false) / (1 - np.minimum(self.false, 0.999)))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        votes = self.votes(text)
        total = votes.sum()
        if not total:  # letters, but none of a known language: the first language, without trust
            return self.languages[0], 0.0
        best = int(np.argmax(votes))
        return self.languages[best], float(votes[best] / total)


def learning_sample(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, lang) of about ``sample`` learnable documents of each language, chosen by a hash of the id."""
    usable = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return usable.select("text", "lang")
    share = F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(1.0, sample / n))])
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("langid")), F.lit(1_000_003)) / 1_000_003
    return usable.where(draw < share[F.col("lang")]).select("text", "lang")


def learn(docs: DataFrame, sample: int = SAMPLE) -> Filters:
    """Filters from the learnable documents of ``docs`` (columns doc_id, text, lang)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                by.setdefault(lang, []).append(np.unique(np.concatenate(list(trigrams(text)))))
            for lang, found in by.items():
                grams, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n, pa.int64())], ["lang", "gram", "n"])
            yield pa.RecordBatch.from_arrays([pa.array(list(by), pa.string()), pa.array([0] * len(by), pa.int64()), pa.array([len(x) for x in by.values()], pa.int64())], ["lang", "gram", "n"])

    counted = learning_sample(docs, sample).mapInArrow(count, "lang string, gram long, n long")
    # bounded by the sample; gram 0 carries the number of documents
    found = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).where((F.col("n") >= LEAST) | (F.col("gram") == 0)).toPandas()
    of = found[found.gram == 0].set_index("lang").n
    found = found[(found.gram != 0) & found.lang.isin(of.index)]
    languages = sorted(of.index)
    found["share"] = found.n / found.lang.map(of)
    found = found[found.share >= KEEP * found.groupby("gram").share.transform("max")]
    grams, at = np.unique(found.gram.to_numpy(np.int64), return_inverse=True)
    masks = np.zeros((max(1, -(-len(languages) // 64)), len(grams)), np.uint64)
    number = found.lang.map({k: i for i, k in enumerate(languages)}).to_numpy(np.int64)
    np.bitwise_or.at(masks, (number // 64, at), np.uint64(1) << (number % 64).astype(np.uint64))
    return Filters(languages, grams.view(np.uint64), masks)


def identify(docs: DataFrame, filters: Filters, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and lang_score, which take the place of columns of those names."""
    docs = docs.drop("lang_pred", "lang_score")
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # bounded by the learning sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(x) for x in batch.column(text).to_pylist()]
            columns = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "lang_pred", "lang_score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]))


def op6_langid(spark, sf_dir: str) -> DataFrame:
    """The language of every whole document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
