"""Toxicity by a support vector machine over a gap-weighted subsequence string kernel with Nystroem landmarks.

Texts are read as sentences, sentences as words.  A word's features are its (not necessarily contiguous) subsequences of
three and four letters, each occurrence weighted LAMBDA to the power of the stretch it spans, spans up to SPAN letters; those
of a sentence are the sums over its words.  The kernel of two sentences is the inner product of their features over the square
roots of their letters, where a subsequence that clean sentences are full of counts little.  Inserted letters and gaps only
stretch a subsequence, so ``idxiot`` stays close to ``idiot``.  Punctuation inside a word is skipped, look-alike digits and
signs are read as letters, and runs of spaced-out single letters are joined to a word.

The machine is trained on sentences of labelled texts.  A toxic text's label holds for some of its sentences only, so learning
is multiple-instance: at first all sentences of toxic texts are positive, then those the machine itself finds toxic and each
text's most toxic one, while clean texts' worst sentences join the negatives.  Landmarks are sentences of both classes, drawn
anew each round.  With landmarks l and Nystroem weights g the decision sum_l g_l K(s, l) is linear in the subsequences, so it is
folded into one weight each: a word has one value, and scoring costs the same for any number of landmarks.  A logistic
regression turns a text's largest margin, and the number and share of its toxic sentences, into the score.

Defined results: null and empty texts, and texts without a word of three letters, get the score of a wordless text
(near 0); texts of any length are read whole; one-sided or missing labels give score 0 everywhere; repeated rows score
alike; rows that share an id are scored each by its own text; other columns pass through.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import held_out, parts_of, released, table

#: Bounds of the labelled sample: about so many texts of each class (all, if fewer), and the longest text that is drawn.
SAMPLE, LONGEST_DRAWN = 2_500, 6_000
#: Bound of the labelled sentences of each class that the machine sees in a round, and landmarks of each class.
SENTENCES, LANDMARKS = 6_000, 200
ROUNDS = 2
#: What a sentence inside of the margin costs, all those of a class together.
COST = 200_000.0
#: Words in a sentence; longer ones are cut.
WORDS = 30
LAMBDA, SPAN = 0.5, 7
#: Letters of a word seen at once; longer words are read in overlapping stretches.
LONGEST = 24
#: Letter numbers put before and after each word.
FIRST, LAST = 30, 31
SIZES = (3, 4)
ALPHABET = 32
#: Share of all clean weight from which on a subsequence counts half.
COMMON = 2e-6
#: Margin of a text without a word.
WORDLESS = -3.0

# Signs commonly written for letters.
LOOKALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

_codes: list[np.ndarray] = []
OFFSETS = [(k, (0, *rest)) for k in SIZES for rest in combinations(range(1, SPAN), k - 1)]


def codes() -> np.ndarray:
    """Letter number of each code point: a-z are 1 to 26, other letters share three numbers, 0 parts words, -1 is skipped."""
    if not _codes:
        out = np.full(sys.maxunicode + 1, -1, np.int8)
        for c in range(sys.maxunicode + 1):
            if chr(c).isalpha():
                out[c] = 27 + c % 3
        out[ord("a") : ord("z") + 1] = np.arange(1, 27)
        for sign, letter in LOOKALIKE.items():
            out[ord(sign)] = ord(letter) - 96
        out[ord("\n")] = 0
        _codes.append(out)
    return _codes[0]


def stretches(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, word numbers, letters as rows) of all words' stretches, by length; no word holds a line feed."""
    if not words:
        return
    flat = codes()[np.frombuffer("\n".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    flat = np.concatenate([[0], flat[flat >= 0], [0]])
    gaps = np.flatnonzero(flat == 0)  # each becomes the end of a word, a gap and the start of the next
    flat = np.insert(flat, np.concatenate([gaps[:-1] + 1, gaps[1:]]), np.repeat([FIRST, LAST], len(words)).astype(flat.dtype))[1:-1]
    ends = np.flatnonzero(np.concatenate([flat, [0]]) == 0)
    starts = np.concatenate([[0], ends[:-1] + 1])
    sizes, number = ends - starts, np.arange(len(words))
    long = np.flatnonzero(sizes > LONGEST)
    if len(long):
        step = LONGEST // 2
        more = [(i, starts[i] + a) for i in long for a in [*range(0, sizes[i] - LONGEST, step), sizes[i] - LONGEST]]
        keep = sizes <= LONGEST
        number = np.concatenate([number[keep], [i for i, _ in more]])
        starts = np.concatenate([starts[keep], [a for _, a in more]])
        sizes = np.concatenate([sizes[keep], np.full(len(more), LONGEST)])
    for n in range(min(SIZES) + 2, LONGEST + 1):
        own = np.flatnonzero(sizes == n)
        for a in range(0, len(own), 20_000):
            part = own[a : a + 20_000]
            yield n, number[part], flat[starts[part, None] + np.arange(n)].astype(np.int32)


def subsequences(rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, float]]:
    """(size, code of each row's subsequences, weight) for each pattern of gaps."""
    n = rows.shape[1]
    for size, at in OFFSETS:
        if at[-1] < n:
            code = rows[:, : n - at[-1]]
            for a in at[1:]:
                code = code * ALPHABET + rows[:, a : n - at[-1] + a]
            yield size, code, LAMBDA ** (at[-1] + 1)


def letters_of(words: list[str]) -> np.ndarray:
    """Letters of each word as the kernel counts them (0 below three)."""
    out = np.zeros(len(words))
    for n, number, _ in stretches(words):
        np.add.at(out, number, n - 2.0)
    return out


def values(words: list[str], weights: dict[int, np.ndarray]) -> np.ndarray:
    """Each word's part of the decision."""
    out = np.zeros(len(words))
    for _, number, rows in stretches(words):
        total = np.zeros(len(rows))
        for size, code, weight in subsequences(rows):
            total += weight * weights[size][code].sum(axis=1)
        np.add.at(out, number, total)
    return out


def add_features(words: list[str], times: np.ndarray, out: dict[int, np.ndarray]) -> None:
    """Adds ``times`` the features of each word to ``out``."""
    for _, number, rows in stretches(words):
        for size, code, weight in subsequences(rows):
            out[size] += np.bincount(code.ravel(), weights=np.repeat(weight * times[number], code.shape[1]), minlength=len(out[size]))


class Sentences:
    """Sentences of texts: distinct words, and for each sentence its text and its words' numbers."""

    def __init__(self, texts: pa.Array) -> None:
        lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
        coded = lists.flatten().dictionary_encode()
        word, self.words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        counts = pc.list_value_length(lists).to_numpy()
        text = np.repeat(np.arange(len(counts)), counts)
        closing = pc.match_substring_regex(coded.dictionary, r"[.!?|…]['\")]*$").to_numpy(zero_copy_only=False)
        single = (pc.utf8_length(coded.dictionary).to_numpy() == 1)[word] if len(word) else np.zeros(0, bool)
        start = np.ones(len(word), bool)
        start[1:] = (text[1:] != text[:-1]) | closing[word[:-1]]
        at = np.flatnonzero(start)
        inside = np.arange(len(word)) - np.repeat(at, np.diff(np.append(at, len(word))))
        start |= inside % WORDS == 0
        sentence = np.cumsum(start) - 1
        self.text = text[start]
        # runs of three and more single letters also make a word, in the sentence they begin in
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (single).astype(np.int8), [0]])))
        number = {w: i for i, w in enumerate(self.words)} if len(edge) else {}
        more_w, more_s = [], []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            while a < b:
                end = min(b, int(np.searchsorted(text, text[a], side="right")))
                if end - a >= 3:
                    joined = "".join(self.words[w] for w in word[a:end].tolist())
                    if joined not in number:
                        number[joined] = len(self.words)
                        self.words.append(joined)
                    more_w.append(number[joined])
                    more_s.append(sentence[a])
                a = end
        self.word, self.sentence = np.concatenate([word, np.array(more_w, np.int64)]), np.concatenate([sentence, np.array(more_s, np.int64)])

    def __len__(self) -> int:
        return len(self.text)

    def sums(self, of_words: np.ndarray) -> np.ndarray:
        return np.bincount(self.sentence, weights=of_words[self.word], minlength=len(self))

    def scaled(self, of_words: np.ndarray) -> np.ndarray:
        """Sums over each sentence, divided by the square root of its letters."""
        return self.sums(of_words) / np.sqrt(np.maximum(1.0, self.sums(letters_of(self.words))))

    def chosen(self, sentences: np.ndarray) -> list[list[int]]:
        """The word numbers of some sentences."""
        order = np.argsort(self.sentence, kind="stable")
        at = np.searchsorted(self.sentence[order], np.append(np.arange(len(self)), len(self)))
        return [self.word[order[at[i] : at[i + 1]]].tolist() for i in sentences]


def kernel(words: list[str], landmarks: list[list[str]], common: dict[int, np.ndarray], block: int = 40) -> np.ndarray:
    """Inner product of each word with each landmark (a list of words), weighted by ``common``; not yet scaled by letters."""
    out = np.empty((len(words), len(landmarks)), np.float32)
    for a in range(0, len(landmarks), block):
        out[:, a : a + block] = _kernel(words, landmarks[a : a + block], common)
    return out


def _kernel(words: list[str], landmarks: list[list[str]], common: dict[int, np.ndarray]) -> np.ndarray:
    flat = [w for own in landmarks for w in own]
    owner = np.repeat(np.arange(len(landmarks)), [len(own) for own in landmarks])
    keys, owners, amounts = [], [], []
    for _, number, rows in stretches(flat):
        for size, code, weight in subsequences(rows):
            keys.append(code.ravel() + (ALPHABET**4 if size == 3 else 0))
            owners.append(np.repeat(owner[number], code.shape[1]))
            amounts.append(weight * common[size][code].ravel())
    out = np.zeros((len(words), len(landmarks)), np.float32)
    if not keys:
        return out
    key, column = np.unique(np.concatenate(keys), return_inverse=True)
    dense = np.zeros((len(key) + 1, len(landmarks)), np.float32)
    np.add.at(dense, (column, np.concatenate(owners)), np.concatenate(amounts))
    at = np.full(ALPHABET**4 + ALPHABET**3, len(key), np.int32)
    at[key] = np.arange(len(key))
    for _, number, rows in stretches(words):
        for a in range(0, len(rows), 2_000):
            part = rows[a : a + 2_000]
            total = np.zeros((len(part), len(landmarks)), np.float32)
            for size, code, weight in subsequences(part):
                hit = at[code + (ALPHABET**4 if size == 3 else 0)]
                for c in range(hit.shape[1]):
                    some = np.flatnonzero(hit[:, c] < len(key))
                    total[some] += weight * dense[hit[some, c]]
            np.add.at(out, number[a : a + 2_000], total)
    return out


def machine(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Linear support vector machine, squared hinge loss, both classes of equal weight; Newton steps on the primal."""
    x = np.hstack([x, np.ones((len(x), 1))])
    c = COST / np.where(y > 0, (y > 0).sum(), (y < 0).sum())
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(30):
        out = y * (x @ w) < 1
        own, k = x[out], c[out]
        new = np.linalg.solve(ridge + 2 * (own.T * k) @ own, 2 * own.T @ (k * y[out]))
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w[:-1], float(w[-1])


class Model:
    """Weights of subsequences, bias, and the logistic regression over what a text's margins show."""

    def __init__(self, texts: list[str], toxic: list[int], seed: int = 11) -> None:
        self.weights = {size: np.zeros(ALPHABET**size, np.float32) for size in SIZES}
        self.bias, self.curve = 0.0, np.array([0.0, 0.0, 0.0, -50.0])
        y = np.array(toxic, int)
        learnt = np.arange(len(y)) % 3 != 0  # the rest sets the curve
        if 0 < y[learnt].sum() < learnt.sum():
            self._learn(Sentences(pa.array([t for t, k in zip(texts, learnt) if k], pa.string())), y[learnt], np.random.default_rng(seed))
            self._curve(self.show(pa.array([t for t, k in zip(texts, learnt) if not k], pa.string())), y[~learnt])

    def _learn(self, own: Sentences, toxic: np.ndarray, rng: np.random.Generator) -> None:
        bad, letters = toxic[own.text] > 0, letters_of(own.words)
        size = np.sqrt(np.maximum(1.0, own.sums(letters)))
        clean = {k: np.zeros(ALPHABET**k) for k in SIZES}
        add_features(own.words, np.bincount(own.word, weights=~bad[own.sentence], minlength=len(own.words)), clean)
        total = sum(v.sum() for v in clean.values()) or 1.0
        common = {k: (1 / (1 + v / (COMMON * total))).astype(np.float32) for k, v in clean.items()}
        draw = lambda at, n: rng.permutation(at)[:n]
        worst_of = lambda m: (o := np.lexsort((-m, own.text)))[np.concatenate([[True], own.text[o][1:] != own.text[o][:-1]])]
        # before there is a machine: the difference of the classes' mean features
        mean = {k: np.zeros(ALPHABET**k) for k in SIZES}
        part = np.where(bad, 1 / max(1, bad.sum()), -1 / max(1, (~bad).sum())) / size
        add_features(own.words, np.bincount(own.word, weights=part[own.sentence], minlength=len(own.words)), mean)
        worst = worst_of(own.sums(values(own.words, {k: (v * common[k]).astype(np.float32) for k, v in mean.items()})) / size)
        positive, negative, hard = worst[bad[worst]], np.flatnonzero(~bad), worst[~bad[worst]]
        for _ in range(ROUNDS):
            pos, neg = draw(positive, SENTENCES), np.unique(np.concatenate([draw(negative, SENTENCES), hard]))
            landmark = np.concatenate([draw(pos, LANDMARKS), draw(neg, LANDMARKS)])
            marks = [[own.words[w] for w in s] for s in own.chosen(landmark)]
            used = np.concatenate([landmark, pos, neg])
            rows = own.chosen(used)
            word, at = np.unique([w for r in rows for w in r], return_inverse=True)
            k = kernel([own.words[w] for w in word], marks, common)
            k /= size[landmark].astype(np.float32)
            x, ends = np.zeros((len(used), len(landmark))), np.cumsum([0, *(len(r) for r in rows)])
            for a in range(0, len(used), 500):
                b = min(a + 500, len(used))
                np.add.at(x, np.repeat(np.arange(a, b), np.diff(ends[a : b + 1])), k[at[ends[a] : ends[b]]])
            del k
            x /= size[used][:, None]
            among, x = x[: len(landmark)], x[len(landmark) :]
            found, vectors = np.linalg.eigh((among + among.T) / 2)
            kept = found > 1e-4 * found[-1]
            project = vectors[:, kept] / np.sqrt(found[kept])
            w, self.bias = machine(x @ project, np.concatenate([np.ones(len(pos)), -np.ones(len(neg))]))
            self._fold(marks, project @ w / size[landmark], common)
            margin = own.sums(values(own.words, self.weights)) / size + self.bias
            worst = worst_of(margin)
            positive = np.flatnonzero(bad & ((margin > 0) | np.isin(np.arange(len(own)), worst)))
            hard = np.union1d(hard, worst[~bad[worst]])

    def _fold(self, marks: list[list[str]], g: np.ndarray, common: dict[int, np.ndarray]) -> None:
        flat = [w for own in marks for w in own]
        out = {k: np.zeros(ALPHABET**k) for k in SIZES}
        add_features(flat, np.repeat(g, [len(own) for own in marks]), out)
        self.weights = {k: (v * common[k]).astype(np.float32) for k, v in out.items()}

    def margins(self, own: Sentences) -> np.ndarray:
        """The machine's margin of each sentence."""
        return own.scaled(values(own.words, self.weights)) + self.bias

    def show(self, texts: pa.Array) -> np.ndarray:
        """Per text: largest margin, logarithm of its toxic sentences, logarithm of their share, and 1."""
        own = Sentences(texts)
        m = self.margins(own)
        out = np.ones((len(texts), 4))
        most = np.full(len(texts), WORDLESS)
        np.maximum.at(most, own.text, m)
        hits = np.bincount(own.text, weights=1 / (1 + np.exp(-6 * np.clip(m, -4, 4))), minlength=len(texts))
        out[:, 0], out[:, 1], out[:, 2] = most, np.log(hits + 0.05), np.log((hits + 0.05) / (np.bincount(own.text, minlength=len(texts)) + 2))
        return out

    def _curve(self, x: np.ndarray, y: np.ndarray) -> None:
        if not 0 < y.sum() < len(y):
            self.curve = np.array([4.0, 0.0, 0.0, 0.0])
            return
        mean, scale = x.mean(0), x.std(0) + 1e-9
        mean[3], scale[3] = 0.0, 1.0
        z, w = (x - mean) / scale, np.zeros(4)
        pull = np.array([0.5, 0.5, 0.5, 0.0])
        loss = lambda w: np.logaddexp(0, np.where(y > 0, -1, 1) * (z @ w)).sum() + 0.5 * (pull * w * w).sum()
        for _ in range(50):  # logistic regression with a slight pull to 0; damped Newton steps
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z.T * (p * (1 - p))) @ z + np.diag(pull + 1e-6), z.T @ (y - p) - pull * w)
            while np.abs(step).max() > 1e-6 and loss(w + step) > loss(w):
                step = step / 2
            w = w + step
        w = w / scale
        w[3] -= w[:3] @ mean[:3]
        self.curve = w

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.show(texts) @ self.curve, -50, 50)))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The machine, from documents (doc_id, text) and labels (doc_id, toxic) outside the held-out fold."""
    marked = labels.where(~held_out() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model([], [])
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity")), F.lit(1_000_003)) / 1_000_003
    share = F.when(F.col("toxic") == 1, min(1.0, sample / sizes[1])).otherwise(min(1.0, sample / sizes[0]))
    drawn = F.broadcast(marked.where(draw < share))  # bounded: about twice the sample

    short = docs.where(F.length("text") <= LONGEST_DRAWN).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    one = short.join(drawn, "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))  # an id may be there often
    rows = one.collect()  # bounded: rows and length
    released(docs.sparkSession)  # the fit below needs the driver's memory
    rows.sort(key=lambda r: (r["doc_id"] * 2654435761 % 2**32, r["text"]))
    return Model([r["text"] for r in rows], [r["toxic"] for r in rows])


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", out: str = "toxic_score") -> DataFrame:
    """``docs`` with the score of each text, which takes the place of a column of its name."""
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two fixed tables of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch, text, 1 << 22):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.scores(part.column(text)), pa.float64())], [*part.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every whole document scored."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, learn(docs, table(spark, sf_dir, "labels")))
    score = F.col("toxic_score")
    return scored.select("doc_id", held_out().alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
