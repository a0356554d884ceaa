"""The training-data operators on small cases: brute force, round trips, held-out accuracy, and defined corner cases."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gridloom.llm import ann, bpe, embeddup, hnsw, langid, licenses, minhash, packing, queries, substrings, toxicity, urls
from gridloom.llm.graphs import components
from gridloom.llm.words import word_spans

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VECTORS = "vec_id long, embedding array<float>, label int"


def words(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def docs(spark, texts, **extra):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Null id, null text, empty text, white space, a very long text, repeated rows."""
    long = " ".join(words(30_000, 3))
    rows = [(None, "a b c d e f", None, None, None), (1, None, None, None, None), (2, "", "en", None, 0), (3, " \t\n ", None, "s", 4), (4, long, "en", "s", len(long)), (5, "one two", "en", "s", 7), (5, "one two", "en", "s", 7)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    found = con.execute(queries.ORACLE_SQL[name])
    at = [[d[0] for d in found.description].index(c) for c in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in found.fetchall())


def test_word_hashes_part_words_as_stated():
    data = b" a\tbb\x0bccc\x1cd  e\xc3\xa9\n"
    hashes, starts, ends = word_spans(data)
    assert [data[a:b] for a, b in zip(starts, ends)] == data.split() and len(set(hashes.tolist())) == 4


def test_components_by_brute_force(spark):
    rng = random.Random(4)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(20)]
    label = {v: v for e in links for v in e if e[0] != e[1]}
    for _ in label:
        for a, b in links:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert dict(components(spark.createDataFrame(links, "a long, b long")).collect()) == label


# --- encoding


ODD_TEXTS = ["", " ", "don't STOP I'm we'll", "a<|endoftext|>b", "Σας ΣΑΣ İx", "été", "x\x1cy\x85z w", "日本語 123 ٣", "😀!!!", "\u0000b", "ǅ ß"]


def test_encoding_equals_the_library(spark):
    library = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    rng = random.Random(2)
    texts = ODD_TEXTS + ["".join(rng.choice("aéñΣ'\"-. \n\x1d​09٣你😀abcdefg") for _ in range(rng.randint(0, 120))) for _ in range(400)] + [" ".join(words(3000, 5))]
    own = bpe.encoder(public_tokenizers.path(bpe.VOCABULARY))
    flat, ends = own.encode(pa.array(texts))
    decoded = own.decode(flat, ends).to_pylist()
    for text, a, b, back in zip(texts, [0, *ends], ends, decoded):
        ids = library.encode(text, add_special_tokens=False).ids
        assert flat[a:b].tolist() == ids
        assert back == library.decode(ids, skip_special_tokens=False)
    assert [len(x) for x in own.encode(pa.array([None, "", "<|endoftext|>"], pa.string()))] == [1, 3]


def test_encoding_corner_cases(spark, odd, none):
    out = bpe.bpe_decode(bpe.bpe_encode(odd)).collect()
    assert len(out) == 7 and [r["ids"] for r in out if r["doc_id"] in (1, 2, 3)] == [[], [], []] and all(r["decoded"] == "" for r in out if r["doc_id"] in (1, 2, 3))
    assert bpe.bpe_encode(none).count() == 0


def test_columns_of_the_outputs_names_are_replaced(spark, odd):
    d = docs(spark, ["one two three", "http://a.net/x"])
    assert bpe.bpe_encode(d.withColumn("ids", F.lit("x"))).schema["ids"].dataType.simpleString() == "array<int>"
    assert bpe.bpe_decode(bpe.bpe_encode(d).withColumn("decoded", F.lit(1))).schema["decoded"].dataType.simpleString() == "string"
    assert langid.identify(d.withColumn("lang_pred", F.lit(1)), langid.Filters([], np.empty(0, np.uint64), np.zeros((1, 0), np.uint64))).first()["lang_pred"] == "und"
    assert toxicity.score_toxicity(d.withColumn("toxic_score", F.lit("x")), toxicity.Model([], [])).schema["toxic_score"].dataType.simpleString() == "double"
    assert urls.filter_urls(d.select(F.col("text").alias("url"), F.lit(1).alias("host"), F.lit(2).alias("verdict"), F.lit(3).alias("label"))).where("host = 'a.net'").first()["verdict"] == "block"
    assert substrings.cut_passages(d, keep=["print", "n_words", "lang"]).columns == ["doc_id", "text", "lang", "n_words", "n_removed"]


# --- packing


def test_best_fit_by_brute_force():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 65, 400)
    bins, offsets, opened = packing.best_fit_decreasing(sizes, 64)
    free: list[int] = []
    for s in sorted(sizes.tolist(), reverse=True):
        fits = [f for f in free if f >= s]
        free.append(64) if not fits else None
        room = min(fits) if fits else 64
        free[free.index(room)] -= s
    assert opened == len(free) and sorted(64 - np.bincount(bins, weights=sizes).astype(int)) == sorted(free)
    for b in range(opened):
        own = np.argsort(offsets[bins == b])
        assert (np.cumsum([0, *sizes[bins == b][own]])[:-1] == offsets[bins == b][own]).all()


def test_packing_keeps_each_token_once(spark, odd, none):
    out = packing.pack_documents(odd, window=64, block_tokens=5_000).toPandas()
    library = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    text = odd.where("doc_id = 4").first()["text"]
    own = out[out.doc_id == 4].sort_values("start")
    assert np.frombuffer(b"".join(own.ids), "<u4").tolist() == [*library.encode(text, add_special_tokens=False).ids, packing.END_OF_TEXT]
    assert (out.groupby("sequence_id").length.sum() <= 64).all() and len(out[out.doc_id == 5]) == 2 and out[out.doc_id == 1].doc_tokens.tolist() == [1]
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == np.cumsum([0, *g.length])[:-1].tolist()
    assert packing.pack_documents(none).count() == 0


# --- language


def test_language_on_held_out_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = queries.QUERIES["op6_langid"](spark, "/root/testdata/sf0.01").join(d.select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def plain_trigrams(text):
    low = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    while "  " in low:
        low = low.replace("  ", " ")
    return [low[i : i + 3] for i in range(len(low) - 2)]


def test_language_votes_against_plain_sets(monkeypatch):
    """Slices lose no trigram; filters return every language that contains one, and few others."""
    monkeypatch.setattr(langid, "SLICE", 7)
    rng = random.Random(3)
    texts = {k: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(400)) for k, letters in (("aa", "abcdé"), ("bb", "cdefgh"), ("cc", "xyz'1"))}
    code = {g: int(h) for t in texts.values() for g, h in zip(plain_trigrams(t), np.concatenate(list(langid.trigrams(t))).tolist())}
    for t in texts.values():
        assert [code[g] for g in plain_trigrams(t)] == np.concatenate(list(langid.trigrams(t))).tolist()
    own = {k: {code[g] for g in plain_trigrams(t)} for k, t in texts.items()}
    grams = np.array(sorted(set().union(*own.values())), np.uint64)
    masks = np.array([[sum((int(g) in own[k]) << i for i, k in enumerate(sorted(own))) for g in grams]], np.uint64)
    filters = langid.Filters(sorted(own), grams, masks)
    for t in [*texts.values(), "abc def xyz", "é1é"]:
        seen = [code.get(g) for g in plain_trigrams(t)]
        hits = np.array([sum(g in own[k] for g in seen) for k in sorted(own)])
        # votes are hits, wrong ones among them, less those expected by chance
        votes = filters.votes(t)
        assert (votes * (1 - filters.false) + len(seen) * filters.false >= hits - 1e-6).all() and (votes <= hits + 0.1 * len(seen)).all()
    assert langid.Filters(["b", "c"], grams[:4], np.full((1, 4), 3, np.uint64)).languages[int(np.argmax([1, 1]))] == "b"


def test_language_ties_go_to_the_first(spark):
    same = spark.createDataFrame([(i, "one two three", k) for i in range(30) for k in ("zz", "aa")], "doc_id long, text string, lang string")
    assert langid.learn(same).predict("one two")[0] == "aa"


def test_language_of_a_single_document_is_learnt(spark):
    d = spark.createDataFrame([(i, "the cat and the dog", "en") for i in range(40)] + [(1, "wxyzzy wxyzzy qqq", "qq")], "doc_id long, text string, lang string")
    assert langid.learn(d).languages == ["en", "qq"]


def test_language_corner_cases(spark, odd, none):
    filters = langid.learn(spark.createDataFrame([(i, t, k) for i in range(40) for t, k in (("the cat and the dog", "en"), ("der hund und die katze", "de"))], "doc_id long, text string, lang string"))
    out = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in langid.identify(odd, filters).collect()}
    assert out[1] == out[2] == out[3] == ("und", 0.0) and 0 <= out[4][1] <= 1
    assert filters.predict("der hund")[0] == "de" and filters.predict("123 !")[0] == "und" and filters.predict("ωψ")[1] == 0.0
    assert langid.identify(none, langid.learn(none)).count() == 0 and langid.learn(none).predict("abc") == ("und", 0.0)


# --- toxicity


def test_toxicity_tolerates_inserted_letters():
    plain = ["gentle", "river", "stone", "garden", "window", "summer", "letter", "market", "silver", "yellow"]
    rng = random.Random(7)
    texts, toxic = [], []
    for i in range(900):
        own = [rng.choice(plain) + rng.choice(["", "s", "ing", "er", "y"]) + rng.choice(["", "", "", "."]) for _ in range(40)] + [f"w{rng.randrange(9999)}"]
        if i % 2:
            own[rng.randrange(20)] = rng.choice(["blorg", "krumph"])
        texts.append(" ".join(own))
        toxic.append(i % 2)
    model = toxicity.Model(texts, toxic)
    score = lambda t: float(model.scores(pa.array([t], pa.string()))[0])
    clean = ". ".join(plain)
    assert score(clean) < 0.5 < score(f"{clean}. Such blorg krumph")
    assert score(f"{clean}. Such blxorg kru-mph") > 0.5 and score(f"{clean}. Such b l o r g krummph") > 0.5
    assert score("") < 0.5 and score(None) == score("  ")


def naive_features(word):
    """Gap-weighted subsequences of three and four letters of a lower-case word, its edges included."""
    w, out = [toxicity.FIRST, *(ord(c) - 96 for c in word), toxicity.LAST], {}
    for k in (3, 4):
        for at in itertools.combinations(range(len(w)), k):
            if at[-1] - at[0] < toxicity.SPAN:
                key = tuple(w[i] for i in at)
                out[key] = out.get(key, 0.0) + toxicity.LAMBDA ** (at[-1] - at[0] + 1)
    return out


def test_kernel_and_fold_by_brute_force():
    words = ["idiot", "idxiot", "gentle", "moron", "river", "abc", "ab"]
    landmarks = [["idiot", "moron", "river"], ["gentle", "abc"], ["ab"]]
    rng = np.random.default_rng(1)
    common = {k: rng.uniform(0.1, 1, toxicity.ALPHABET**k).astype(np.float32) for k in toxicity.SIZES}

    def weight(key):
        code = 0
        for letter in key:
            code = code * toxicity.ALPHABET + letter
        return common[len(key)][code]

    def features(own):
        out = {}
        for w in own:
            for key, v in naive_features(w).items() if len(w) >= 3 else ():
                out[key] = out.get(key, 0.0) + v
        return out

    marks = [features(own) for own in landmarks]
    naive = np.array([[sum(v * weight(k) * m.get(k, 0.0) for k, v in features([w]).items()) for m in marks] for w in words])
    assert np.allclose(toxicity.kernel(words, landmarks, common), naive, rtol=1e-4)
    model, g = toxicity.Model([], []), np.array([0.7, -1.3, 5.0])
    model._fold(landmarks, g, common)
    assert np.allclose(toxicity.values(words, model.weights), naive @ g, rtol=1e-3, atol=1e-5)


def test_toxicity_on_held_out_documents(spark):
    """Of the planted insults at least four in five are caught; few clean texts are blamed."""
    sf = "/root/testdata/sf0.1"
    found = queries.QUERIES["op1_toxicity"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    n = {(r["toxic"], r["predicted"]): r["n"] for r in found.groupBy("toxic", "predicted").agg(F.count("*").alias("n")).collect()}
    assert n[1, 1] >= 0.8 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.03 * n[0, 0]


def test_toxicity_corner_cases(spark, odd, none):
    model = toxicity.learn(none, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.score_toxicity(odd, model).where("toxic_score >= 0.5").count() == 0 and toxicity.score_toxicity(none, model).count() == 0


# --- near duplicates


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(texts):
    own = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for _ in range(len(texts)):
        for i in range(len(texts)):
            for j in range(i):
                if own[i] and own[j] and 100 * len(own[i] & own[j]) >= 75 * len(own[i] | own[j]):
                    label[i] = label[j] = min(label[i], label[j])
    return label


def test_near_duplicates_by_brute_force(spark):
    rng, texts = random.Random(5), []
    for g in range(6):
        base = words(120, 50 + g)
        for _ in range(8):
            own = list(base)
            for _ in range(rng.randrange(0, 9)):
                own[rng.randrange(len(own))] = "changed"
            texts.append(" ".join(own))
    texts += [texts[0], texts[0].upper(), "one two", "one two", "a b c d", "", None]
    out = {r["doc_id"]: r for r in minhash.near_duplicates(docs(spark, texts)).collect()}
    assert [out[i]["component_id"] for i in range(len(texts))] == brute_components(texts)
    assert [out[i]["n_shingles"] for i in range(len(texts))] == [len(shingles(t)) for t in texts]


def test_near_duplicates_in_crowded_lists(spark, monkeypatch):
    """Blocks far smaller than the lists, so that pairs of blocks are met."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rng, base, texts = random.Random(6), words(60, 9), []
    for i in range(40):
        own = list(base)
        for _ in range(rng.randrange(0, 7)):
            own[rng.randrange(len(own))] = f"x{i}"
        texts.append(" ".join(own))
    out = dict(minhash.near_duplicates(docs(spark, texts)).select("doc_id", "component_id").collect())
    assert [out[i] for i in range(len(texts))] == brute_components(texts)


def test_near_duplicates_of_a_family_just_below_the_threshold(spark):
    """2,000 texts that share a frame: nearly every pair is alike in 70 to 75 of 100 shingles and few are linked."""
    rng = random.Random(11)
    frame, texts = words(176, 31), []
    for i in range(2000):
        own = list(frame)
        for at in rng.sample(range(5), 1) + [20, 50, 80, 110, 140]:
            own[at] = f"q{i}"
        texts.append(" ".join(own))
    for i in range(0, 2000, 100):
        texts[i + 1] = texts[i] + " tail"
    out = dict(minhash.near_duplicates(docs(spark, texts)).select("doc_id", "component_id").collect())
    sets = [np.unique([zlib.crc32(b" ".join(x)) for x in shingles(t)]) for t in texts]
    common = minhash.common_shingles(sets, sets)
    size = np.array([len(x) for x in sets])
    link = 100 * common >= 75 * (size[:, None] + size[None, :] - common)
    shares = (common / (size[:, None] + size[None, :] - common))[~link]
    assert np.quantile(shares, 0.5) > 0.69 and 20 <= link.sum() - 2000 < 4000
    label = np.arange(2000)
    for _ in range(6):
        label = np.array([label[link[i]].min() for i in range(2000)])
    assert [out[i] for i in range(2000)] == label.tolist()


def test_common_shingles_by_brute_force(monkeypatch):
    monkeypatch.setattr(minhash, "COLUMNS", 7)
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(12)]
    assert minhash.common_shingles(sets[:5], sets[5:]).tolist() == [[len(set(x) & set(y)) for y in sets[5:]] for x in sets[:5]]


def test_near_duplicate_texts_of_one_id_are_compared_each(spark):
    base = words(60, 71)
    rows = [(1, " ".join(words(50, 72))), (1, " ".join(base)), (2, " ".join([*base, "tail"])), (3, " ".join(words(40, 73)))]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").distinct().collect()
    assert sorted(map(tuple, out)) == [(1, 1), (2, 1), (3, 3)]


def test_near_duplicate_corner_cases(spark, odd, none):
    out = minhash.near_duplicates(odd.select("doc_id", "text")).collect()
    assert len(out) == 7 and sum(r["doc_id"] is None and r["component_id"] is None for r in out) == 1
    assert {r["doc_id"]: r["n_shingles"] for r in out if r["doc_id"] in (1, 2, 3, 5)} == {1: 0, 2: 0, 3: 0, 5: 1}
    assert minhash.near_duplicates(none.select("doc_id", "text")).count() == 0


# --- passages


def brute_passages(texts, n=20):
    seen, out = set(), []
    for t in texts:
        w = (t or "").encode().split()
        gone = set()
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            gone |= set(range(i, i + n)) if key in seen else set()
            seen.add(key)
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out


@pytest.mark.parametrize("shard", [300, 10**9])
def test_passages_by_brute_force(spark, shard):
    passage, other = words(26, 1), words(45, 2)
    texts = [" ".join([*words(30, 10 + i), *passage[i % 5 :], *words(12, 40 + i), *(other if i % 3 == 0 else [])]) for i in range(12)]
    texts += [texts[3], " ".join([*passage, *passage, *passage]), " ".join(["again"] * 50), " ".join(passage[:19]), "", None, "é x\x1cy"]
    out = substrings.cut_passages(docs(spark, texts).select("doc_id", "text"), shard_chars=shard).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(b" ".join(r["text"].encode().split())).hexdigest()) for r in out}
    assert [got[i] for i in range(len(texts))] == brute_passages(texts)


def test_passage_corner_cases(spark, odd, none):
    out = substrings.cut_passages(odd.select("doc_id", "text")).collect()
    assert len(out) == 7 and all(r["n_removed"] == 0 for r in out) and substrings.cut_passages(none.select("doc_id", "text")).count() == 0


# --- vectors


def cloud(n, dims=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    for i in range(0, n, 4):
        x[i : i + 3] = x[i] + 0.15 * rng.normal(size=(len(x[i : i + 3]), dims))
    return x.astype(np.float32)


def vector_table(spark, x):
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    d = x.shape[1]
    odd = [(9001, None, 0), (9002, [0.0] * d, 0), (9003, [float("nan")] * d, 0), (9004, [None] * d, 0), (9005, [float("inf")] * d, 0), (9006, [], 0), (9007, [1.0, 2.0], 0), (None, rows[0][1], 0), (20_000, rows[0][1], 0), (20_000, rows[0][1], 0)]
    return spark.createDataFrame(rows + odd, VECTORS)


def test_graph_finds_neighbours():
    x = np.random.default_rng(0).normal(size=(3000, 8)).astype(np.float32)
    found, dist = hnsw.Graph(x).search(x[:200], 64)
    true = np.argsort(((x[:200, None] - x[None]) ** 2).sum(-1), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(found, true)]) > 0.95 and (np.diff(dist, axis=1) >= 0).all()


def test_vector_links_by_brute_force(spark):
    x = cloud(400).astype(float)
    df = vector_table(spark, cloud(400))
    out = {r["vec_id"]: r for r in embeddup.near_vectors(df).collect()}
    x = np.vstack([x, x[:1]])
    ids = [*range(400), 20_000]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    label = np.arange(len(x))
    for _ in range(50):
        label = np.array([label[link[i]].min() for i in range(len(x))])
    assert [out[i]["n_links"] for i in ids] == (link.sum(1) - 1).tolist()
    assert [out[i]["component_id"] for i in ids] == [ids[k] for k in label]
    assert all(out[i]["n_links"] == 0 and out[i]["component_id"] == i and out[i]["kept"] for i in range(9001, 9008)) and embeddup.near_vectors(df.limit(0)).count() == 0


class Blind:
    """A graph that reaches only the queries themselves, or only what lies in every third row."""

    def __init__(self, rows, reach):
        self.rows, self.reach = rows, reach

    def search(self, queries, beam):
        d = ((queries**2).sum(1)[:, None] + (self.rows**2).sum(1) - 2 * queries @ self.rows.T).clip(0)
        d[(d > 1e-9) & ~self.reach] = np.inf
        at = np.argsort(d, axis=1)[:, :beam]
        dist = np.take_along_axis(d, at, 1)
        return np.where(np.isfinite(dist), at, -1), dist


@pytest.mark.parametrize("linked", [0, 24, 1600])
@pytest.mark.parametrize("third", [False, True])
def test_audit_of_links_leaves_out_the_query_itself(linked, third):
    rows = np.random.default_rng(7).normal(size=(1600, 32))
    for i in range(0, linked, 2):
        rows[i + 1] = rows[i] + 0.02 * rows[i + 1]
    rows = embeddup.unit(rows)
    q, s = embeddup.found_links(Blind(rows, np.arange(1600) % 3 == 0 if third else np.zeros(1600, bool)), rows, rows, np.arange(1600), 0.9)
    assert sorted(zip(q.tolist(), s.tolist())) == sorted((i, i ^ 1) for i in range(linked))


def test_vector_links_through_graphs_of_several_layers(spark):
    """6,000 vectors in 8 shards of about 750, planted links on both sides of the threshold, repeated vectors among them."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(6000, 24))
    for i in range(0, 3000, 3):
        step = rng.normal(size=(2, 24))
        x[i + 1 : i + 3] = x[i] + np.linalg.norm(x[i]) * np.array([[0.44], [0.5]]) * step / np.linalg.norm(step, axis=1, keepdims=True)
    x[5900:] = x[:100]
    x = x.astype(np.float32)
    out = embeddup.near_vectors(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")).toPandas().set_index("vec_id").sort_index()
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    assert link.sum() - 6000 > 2000
    label = np.arange(6000)
    for _ in range(20):
        label = np.array([label[link[i]].min() for i in range(6000)])
    assert out.n_links.sum() >= 0.98 * (link.sum() - 6000) and (out.n_links.to_numpy() <= link.sum(1) - 1).all()
    assert (out.component_id.to_numpy() == label).mean() >= 0.99 and (out.component_id.to_numpy() >= label).all()


def test_nearest_neighbours_with_lists_left_out(spark):
    """8,000 clustered vectors of mixed lengths: recall, the worst query, and that most lists are not looked at."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 16))
    x = (centres[rng.integers(0, 60, 8000)] + 0.2 * rng.normal(size=(8000, 16))) * rng.uniform(0.5, 2, (8000, 1))
    x = x.astype(np.float32)
    looked = []
    sent = ann.sent_to_tasks

    def counted(queries, router, ratio, pieces):
        lists = router.value.near(router.value.lifted(x[::20].astype(float), True), ratio, least=ann.LEAST_LISTS)
        looked.append(np.mean([len(own) for own in lists]) / len(router.value.centroids))
        return sent(queries, router, ratio, pieces)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(ann, "sent_to_tasks", counted)
        out = ann.nearest_neighbours(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")).toPandas()
    s = x[::20].astype(float) @ x.astype(float).T
    s[np.arange(400), np.arange(0, 8000, 20)] = -np.inf
    true = np.argsort(-s, axis=1)[:, :20]
    found = {q: set(g.vec_id) for q, g in out.groupby("query_id")}
    recall = np.array([len(found[20 * i] & set(true[i].tolist())) / 20 for i in range(400)])
    assert looked[0] < 0.6 and recall.mean() >= 0.95 and np.quantile(recall, 0.02) >= 0.7, (looked, recall.mean(), recall.min())


def test_nearest_neighbours_of_repeated_and_tied_vectors(spark):
    """One vector that most rows share, and pairs of equal score: ties go to the smaller id."""
    rows = [(i, [1.0, 0.0]) for i in range(200)] + [(300 + i, [0.5, 0.5 if i % 2 else -0.5]) for i in range(6)]
    out = ann.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).toPandas().sort_values(["query_id", "rank"])
    assert sorted(out.query_id.unique()) == [*range(0, 200, 20), 300]
    for q in range(0, 200, 20):
        assert out[out.query_id == q].vec_id.tolist() == [i for i in range(21) if i != q][:20]
    assert out[out.query_id == 300].vec_id.tolist() == list(range(20)) and set(out[out.query_id == 300].score) == {0.5}


def test_nearest_neighbours_by_brute_force(spark):
    x = cloud(600, seed=4).astype(float)
    df = vector_table(spark, cloud(600, seed=4))
    out = ann.nearest_neighbours(df).toPandas()
    ids = np.array([*range(600), 20_000])
    x = np.vstack([x, x[:1]])
    hits = []
    for q in [i for i, k in enumerate(ids) if k % 20 == 0]:
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        true = ids[np.lexsort((ids, -s))[:20]]
        own = out[out.query_id == ids[q]].sort_values("rank")
        hits.append(len(set(true) & set(own.vec_id)) / 20)
        assert own["rank"].tolist() == list(range(1, 21)) and ids[q] not in set(own.vec_id)
        assert np.allclose(own.score, [(x[np.flatnonzero(ids == v)[0]] * x[q]).sum() for v in own.vec_id])
        assert sorted(zip(-own.score, own.vec_id)) == list(zip(-own.score, own.vec_id))
    assert np.mean(hits) >= 0.9
    assert ann.nearest_neighbours(df.limit(0)).count() == 0 and ann.nearest_neighbours(df.where("vec_id in (0, 1)")).count() == 1


# --- URLs and licences


def test_url_rules_and_parts(spark, none):
    cases = {"http://a.NET/x": ("a.net", "/x", "net/", "block"), "https://www.example.net/en/1?x=/": ("www.example.net", "/en/1", "example.net/en/", "allow"), "http://net": ("net", "", None, None), "no scheme": ("", "", None, None), "http://x.org/fr/#t": ("x.org", "/fr/", "org/fr/", "allow"), "http://myexample.com/de/": ("myexample.com", "/de/", None, None), "http://b.example.com/de/2": ("b.example.com", "/de/2", "example.com/de/", "block"), None: ("", "", None, None), "": ("", "", None, None), "http://h?q/net/": ("h", "", None, None)}
    df = spark.createDataFrame([(i, u, "<p>", 1) for i, u in enumerate(cases)], "page_id long, url string, html string, extra int")
    out = sorted(urls.filter_urls(df).collect(), key=lambda r: r["page_id"])
    for r, (host, path, rule, verdict) in zip(out, cases.values()):
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and (verdict is None or r["verdict"] == verdict) and r["verdict"] in ("allow", "block")
    assert urls.filter_urls(df.limit(0)).count() == 0
    assert {r["verdict"] for r in urls.filter_urls(df.where("page_id in (2, 3)")).collect()} == {"allow"}


def test_url_features_against_plain_python(spark):
    cases = ["http://a.b-c.example.org/x/y1/22?q=1&r=#top", "https://WWW.site.net", "no scheme", "", "ftp://h/é漢?"]
    out = urls.lexical(urls.parts(spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id long, url string"))).orderBy("page_id").collect()
    for r, u in zip(out, cases):
        after = u.split("://", 1)[1] if "://" in u else ""
        host = after.split("/")[0].split("?")[0].split("#")[0].lower()
        path = after[len(host) :].split("?")[0].split("#")[0]
        n = len(u)
        entropy = -sum(u.count(c) / n * math.log2(u.count(c) / n) for c in set(u)) if n else 0.0
        params = len(u.split("?", 1)[1].split("#")[0].split("&")) if "?" in u else 0
        assert (r["host"], r["path"], r["n_chars"], r["n_host"], r["depth"], r["n_hyphens"], r["n_params"]) == (host, path, n, len(host), path.count("/"), u.count("-"), params)
        assert r["digit_ratio"] == pytest.approx(sum(c.isdigit() for c in u) / n if n else 0) and r["entropy"] == pytest.approx(entropy, abs=1e-9)
        assert (r["n_labels"], r["suffix1"], r["suffix2"]) == (len(host.split(".")), host.split(".")[-1], ".".join(host.split(".")[-2:]))


def test_url_suffix_shares_leave_out_the_rows_own_fold(spark):
    rows = [(i, "net" if i % 3 else "org", f"s{i % 4}.net", float(i % 5 == 0), i % urls.FOLDS) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, suffix1 string, suffix2 string, label double, fold int")
    for r in urls.with_suffix_shares(df, df, 0.2).collect():
        own = [x for x in rows if x[1] == r["suffix1"] and x[4] != r["fold"]]
        assert r["suffix1_share"] == pytest.approx((sum(x[3] for x in own) + urls.PRIOR * 0.2) / (len(own) + urls.PRIOR))
    new = spark.createDataFrame([(1, "net", "none", None)], "page_id long, suffix1 string, suffix2 string, fold int")
    r = urls.with_suffix_shares(new, df, 0.2).first()
    own = [x for x in rows if x[1] == "net"]
    assert r["suffix1_share"] == pytest.approx((sum(x[3] for x in own) + urls.PRIOR * 0.2) / (len(own) + urls.PRIOR)) and r["suffix2_share"] == 0.2


def test_url_trees_on_held_out_urls(spark):
    """Trees fitted on four fifths of the URLs that rules decide, asked about the rest, whose suffixes alone say too little."""
    rng = random.Random(4)
    rows = []
    for i in range(1500):
        bad = rng.random() < 0.4
        tail = "".join(rng.choice("0123456789") for _ in range(rng.randint(12, 24))) if bad else rng.choice(["about", "news", "people", "garden"])
        rows.append((i, f"http://h{rng.randrange(40)}.example.{rng.choice(['com', 'info'])}/{tail}", float(bad)))
    df = spark.createDataFrame(rows, "page_id long, url string, label double").withColumn("fold", (F.col("page_id") % urls.FOLDS).cast("int"))
    marked = urls.lexical(urls.parts(df))
    train = marked.where("fold > 0")
    model = urls.fit(urls.with_suffix_shares(train, train, 0.4), 1200, 50_000)
    rest = urls.VectorAssembler(inputCols=urls.FEATURES, outputCol="features").transform(urls.with_suffix_shares(marked.where("fold = 0"), train, 0.4))
    assert model.transform(rest).agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0] > 0.97


def test_url_trees_judge_what_no_rule_fits(spark):
    rows = [(i, f"http://h{i % 7}.net/{'9' * (i % 30)}") for i in range(150)] + [(1000 + i, f"http://s.example.net/en/{'word' * (i % 5)}") for i in range(150)] + [(5000, "http://q.info/999999999999")]
    out = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"))
    assert out.where("rule is null").first()["verdict"] == "block" and out.count() == 301


def test_licence_ties_go_to_the_name_that_sorts_first(spark, monkeypatch):
    monkeypatch.setattr(licenses, "TEMPLATES", {"B": ["Granted under alpha beta gamma."], "A": ["Granted under alpha beta gamma."]})
    assert [r["license"] for r in licenses.scan_licenses(docs(spark, ["granted under alpha beta gamma"])).collect()] == ["A"]


def test_licence_lines(spark, odd, none):
    text = "Prose here\nlicensed UNDER the Apache License -- version 2.0\nReleased under the MIT License!\nAll rights reserved.\nword"
    out = [(r["line_no"], r["license"]) for r in licenses.scan_licenses(docs(spark, [text])).orderBy("line_no").collect()]
    assert out == [(2, "Apache-2.0"), (3, "MIT"), (4, "Proprietary")]
    assert licenses.scan_licenses(odd).count() == 0 and licenses.scan_licenses(none).count() == 0


def test_licence_notices_that_are_wrapped_or_inside_of_prose(spark):
    mit = 'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction.'
    prose = "The files were gathered by hand and are Released under the MIT License. See the archive for older ones; All rights reserved."
    split = "Some words first\nLicensed under CC BY-\nNC 4.0 and more words"
    gpl = "x\n" + "\n * ".join(licenses.TEMPLATES["GPL-3.0"][1][i : i + 60] for i in range(0, 240, 60)).replace("-\n", "")
    out = [tuple(r)[:3] for r in licenses.scan_licenses(docs(spark, [mit, prose, split, gpl, "under the tree, the software of any person"])).collect()]
    assert sorted(out) == [(0, 1, "MIT"), (1, 1, "MIT"), (1, 1, "Proprietary"), (2, 2, "CC-BY-NC-4.0"), (3, 2, "GPL-3.0")]


# --- pipeline


def test_pipeline_stages(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    at = d
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, SF)
        assert out.columns == list(corpus_pipeline.COLUMNS), name
        assert out.join(at, "doc_id", "left_anti").count() == 0, name
        at = spark.createDataFrame(out.collect(), DOCS)
    pieces = corpus_pipeline.STAGES[-1][1](spark, at, SF).toPandas()
    assert set(pieces.doc_id) == {r[0] for r in at.select("doc_id").collect()} and (pieces.groupby("sequence_id").length.sum() <= 4096).all()
    library = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    first = at.first()
    own = pieces[pieces.doc_id == first["doc_id"]].sort_values("start")
    assert zlib.crc32(b"".join(own.ids)) == zlib.crc32(np.array([*library.encode(first["text"], add_special_tokens=False).ids, 2], "<u4").tobytes())


def test_pipeline_corner_cases(spark, odd, none):
    for rows in (odd, none):
        at = rows.withColumn("extra", F.lit(1))
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, at, SF)
            at = spark.createDataFrame(out.collect(), out.schema)
        assert at.columns == packing.PIECES.names
