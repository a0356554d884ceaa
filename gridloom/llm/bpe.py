"""BPE encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be merged over, so it marks a certain cut: the two
sides are encoded independently and their ids concatenated.  The vocabulary's own rules (NFC, white space, lower
case, letter/number/other runs) come first.  Texts are taken a few megabytes at a time: their white-space chunks and then
the fragments of those are reduced to distinct ones, so each is encoded once, and nothing is kept from one part to the next.

Defined results: null text counts as empty, empty text gives an empty id list, very long texts are handled whole,
repeated rows are kept, rows that share an id are encoded each by its own text, all other columns pass through unchanged; a column
of the output's name is replaced.
"""

from __future__ import annotations

import json
import os
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import parts_of, table

VOCABULARY = "word_bpe_49k.json"
#: Bytes of fragments handed to the library at once.
JOINED = 1 << 14

# The pre-tokeniser of the vocabulary file: these endings of English words, else runs of letters, single
# numbers, and runs of what is neither letter, number nor white space.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
SPACE, LETTER, NUMBER, OTHER = range(4)


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    kept = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


def ragged(flat: np.ndarray, ends: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``take`` of the rows that end at ``ends`` in ``flat``, again as (flat, ends)."""
    starts = np.concatenate([[0], ends[:-1]])
    sizes = (ends - starts)[take]
    out = np.cumsum(sizes)
    at = np.repeat((starts[take] - out + sizes).astype(np.int32), sizes)
    at += np.arange(len(at), dtype=np.int32)
    return flat[at], out


def kinds() -> np.ndarray:
    """SPACE, LETTER, NUMBER or OTHER for each code point."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    every = np.arange(sys.maxunicode + 1, dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")
    for kind, pattern in ((SPACE, r"\p{White_Space}+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def pretoken_starts(codes: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Whether a pretoken starts at each code point."""
    starts = kind != SPACE
    starts[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    quotes = np.flatnonzero(starts & (codes == ord("'")))
    padded = np.concatenate([codes, np.zeros(3, codes.dtype)])
    for ending in ENDINGS:
        own = quotes[np.logical_and.reduce([padded[quotes + 1 + i] == ord(c) for i, c in enumerate(ending)])]
        starts[own + 1] = False
        after = own + 1 + len(ending)
        after = after[after < len(codes)]
        starts[after[kind[after] != SPACE]] = True
    return starts


class Encoder:
    """One vocabulary in one worker."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        end = model["end_of_word_suffix"] or ""
        letters = byte_letters()
        # line feeds part the fragments of one call; they are white space, so no fragment holds one
        self.to_letters = {b: c for b, c in enumerate(letters) if b != 10}
        self.last, self.inner = (Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, **x)) for x in ({"end_of_word_suffix": end} if end else {}, {}))
        self.last.pre_tokenizer = self.inner.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens: list[str | None] = [None] * (1 + max([*model["vocab"].values(), *self.special.values()]))
        for word, i in [*model["vocab"].items(), *self.special.items()]:
            tokens[i] = word
        self.tokens = pa.array(tokens, pa.string())
        byte = {c: b for b, c in enumerate(letters)}
        self.mergeable = np.zeros((256, 256), bool)
        for w in model["vocab"]:
            own = [byte[c] for c in (w.removesuffix(end) if end else w) if c in byte]
            self.mergeable[own[:-1], own[1:]] = True
        self.kinds = kinds()
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.marks = [*self.special, *"\x1c\x1d\x1e\x1f"]  # the four are no white space here, though for Arrow they are
        self.space = regex.compile(r"\p{White_Space}+")

    def fragments(self, chunks: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(fragments as bytes, whether each ends its word, number of its chunk); cuts are where no token goes across."""
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(chunks)], pa.int32()), chunks), "\n")[0].as_py()
        # character by character as the normaliser does: a capital sigma never becomes a final one
        low = unicodedata.normalize("NFC", joined).replace("Σ", "σ").lower()
        codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
        data = np.frombuffer(low.encode("utf-8", "surrogatepass"), np.uint8)
        gap = data == 10
        first = np.zeros(len(data), bool)  # of a pretoken, then of a fragment
        first[(data & 0xC0) != 0x80] = pretoken_starts(codes, self.kinds[codes])
        ends_word = np.append(first[1:] | gap[1:], True)
        first[1:] |= ~gap[:-1] & ~gap[1:] & ~self.mergeable[data[:-1], data[1:]]
        at = np.flatnonzero(first)
        kept = np.cumsum(~gap, dtype=np.int32)
        offsets = np.concatenate([[0], kept[at[1:]] - 1, kept[-1:]]).astype(np.int32)
        until = np.append(at[1:], len(data)) - 1  # the byte before the next fragment, or the line feed between
        until -= gap[until]
        return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data[~gap])]), ends_word[until], np.searchsorted(np.flatnonzero(gap), at)

    def known(self, fragments: pa.Array, library) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each fragment as (flat, ends)."""
        coded = fragments.dictionary_encode()
        words = coded.dictionary
        ends = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1) if len(words) else np.zeros(1, np.int32)
        data = np.frombuffer(words.buffers()[2], np.uint8, ends[-1]) if len(words) else np.empty(0, np.uint8)
        flat, sizes, at = [np.empty(0, np.int32)], [np.empty(0, np.int64)], 0
        while at < len(words):
            end = max(at + 1, int(np.searchsorted(ends, ends[at] + JOINED)) - 1)
            parted = np.insert(data[ends[at] : ends[end]], ends[at + 1 : end] - ends[at], 10)
            found = library.encode(parted.tobytes().decode("latin-1").translate(self.to_letters), add_special_tokens=False)
            flat.append(np.array(found.ids, np.int32))
            sizes.append(np.bincount(np.array(found.word_ids, np.int64), minlength=end - at))
            at = end
        return ragged(np.concatenate(flat), np.cumsum(np.concatenate(sizes)), coded.indices.to_numpy())

    def chunk_ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each of the distinct chunks as (flat, ends)."""
        fixed = {"": [], **{s: [i] for s, i in self.special.items()}}
        odd = pc.is_in(chunks, pa.array(list(fixed), chunks.type)).to_numpy(zero_copy_only=False)
        flat, sizes = np.empty(0, np.int32), np.zeros(len(chunks), np.int64)
        if not odd.all():
            fragments, ends_word, chunk = self.fragments(chunks.filter(pa.array(~odd)) if odd.any() else chunks)
            by = [self.known(fragments.filter(pa.array(ends_word)), self.last), self.known(fragments.filter(pa.array(~ends_word)), self.inner)]
            order = np.empty(len(fragments), np.int64)
            order[np.concatenate([np.flatnonzero(ends_word), np.flatnonzero(~ends_word)])] = np.arange(len(fragments))
            flat, ends = ragged(np.concatenate([by[0][0], by[1][0]]), np.concatenate([by[0][1], by[1][1] + len(by[0][0])]), order)
            sizes[~odd] = np.bincount(chunk, weights=np.diff(ends, prepend=0), minlength=int((~odd).sum())).astype(np.int64)
        for i in np.flatnonzero(odd).tolist():
            put = fixed[chunks[i].as_py()]
            flat = np.insert(flat, int(sizes[:i].sum()), put).astype(np.int32)
            sizes[i] = len(put)
        return flat, np.cumsum(sizes)

    def pieces(self, text: str) -> list[str]:
        """The white-space chunks of a text; a special token stands alone."""
        out: list[str] = []
        for part in self.at_special.split(text):
            out += [part] if part in self.special else [c for c in self.space.split(part) if c]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each text as (flat, ends); null counts as empty."""
        texts = pc.fill_null(texts, "")
        odd = np.zeros(len(texts), bool)
        for mark in self.marks:
            odd |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        if odd.any():
            lists = pa.concat_arrays([pc.utf8_split_whitespace(texts.filter(pa.array(~odd))), pa.array([self.pieces(t) for t in texts.filter(pa.array(odd)).to_pylist()], pa.list_(texts.type))])
            order = np.empty(len(texts), np.int64)
            order[np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])] = np.arange(len(texts))
            lists = lists.take(pa.array(order))
        else:
            lists = pc.utf8_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        flat, ends = ragged(*self.chunk_ids(coded.dictionary), coded.indices.to_numpy())
        words = np.cumsum(pc.list_value_length(lists).to_numpy())
        return flat, np.concatenate([[0], ends])[words]

    def decode(self, flat: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The vocabulary names no decoder: each row's tokens joined by one space."""
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), self.tokens.take(pa.array(flat))), " ")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file, built once; it holds the vocabulary and nothing of the texts."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def bpe_encode(df: DataFrame, text: str = "text", out: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """``df`` with ``out``: the text's token ids, array<int>."""
    df = df.drop(out)
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for part in parts_of(batch, text):
                flat, ends = own.encode(part.column(text))
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], [*part.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def bpe_decode(df: DataFrame, ids: str = "ids", out: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """``df`` with ``out``: the tokens' text as the vocabulary decodes it, string."""
    df = df.drop(out)
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for part in parts_of(batch, ids, 1 << 22):
                col = part.column(ids)
                texts = own.decode(col.flatten().to_numpy(), np.cumsum(pc.fill_null(pc.list_value_length(col), 0).to_numpy()))
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*part.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    """Every whole document encoded and decoded, reduced to digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe_decode(bpe_encode(docs).drop("text"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
