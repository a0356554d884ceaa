"""Line dedup, collocations and alignment against brute force and on odd rows."""

from __future__ import annotations

import collections
import hashlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import alignment, collocations, lines

SF = "/root/testdata/sf0.001"


def agrees(df, sql, documents=None):
    con = duckdb.connect()
    if documents is None:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    else:
        con.register("documents", documents)
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    return sorted(map(repr, df.select(*columns).toPandas().itertuples(index=False, name=None))) == sorted(map(repr, found.df().itertuples(index=False, name=None)))


def documents_table(rows):
    return pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "lang": pa.array([r[2] if len(r) > 2 else "en" for r in rows], pa.string())})


# ---- line dedup


def naive_lines(rows, least_chars=40, least_docs=5):
    blank = " \t\n\x0b\x0c\r"
    low = str.maketrans(lines.UPPER, lines.LOWER)
    holders = collections.defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            k = line.strip(blank).translate(low)
            if d is not None and len(k) >= least_chars:
                holders[k].add(d)
    out = []
    for d, t in rows:
        every = (t or "").split("\n")
        own = [x for x in every if d is None or len(holders[x.strip(blank).translate(low)]) < least_docs or d == max(holders[x.strip(blank).translate(low)])]
        out.append((d, len(every), len(every) - len(own), "\n".join(own)))
    return out


def by_text(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[3]))


LINE = "A line that is long enough to be looked at, äöü ÄÖÜ"


def test_lines_agree_with_sql_and_brute_force(spark):
    assert agrees(lines.op11_lines(spark, SF), lines.op11_sql())
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = lines.dedup_lines(df, 10, 3).select("doc_id", "n_lines", "n_dropped", "kept").collect()
    assert by_text(map(tuple, got)) == by_text(naive_lines([tuple(r) for r in df.collect()], 10, 3))
    assert sum(r["n_dropped"] for r in got) > 0


def test_lines_of_odd_rows(spark):
    spread = "\n".join(f"{i}\n{LINE}" if i % 70 == 3 else str(i) for i in range(300))  # bits in several words, others left out
    rows = [(i, f"x{i}\n {LINE}\t\r\n{LINE.replace('A', 'a', 1)}\n{LINE[:-3]}ÄÖ") for i in range(1, 7)]
    rows += [(7, None), (8, ""), (9, "\n\n"), (None, LINE), (10, spread), (10, f"{LINE}\nother text of the same id"), (11, LINE + "\n" + "y" * 200_000), (11, LINE + "\n" + "y" * 200_000), (12, LINE)]
    df = spark.createDataFrame([(*r, "kept") for r in rows], "doc_id long, text string, kept string")
    got = lines.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "kept", "n_lines", "n_dropped"]
    want = naive_lines(rows)
    assert by_text(map(tuple, got.select("doc_id", "n_lines", "n_dropped", "kept").collect())) == by_text(want)
    assert sum(w[2] for w in want) > 10
    assert lines.dedup_lines(df.limit(0)).count() == 0
    bits = {r["doc_id"]: [w["word"] for w in r["keep"]] for r in lines.keep_bitmaps(df).where("doc_id = 10 and n_dropped > 1").collect()}
    assert bits[10] and len(bits[10]) < 300 // 64 + 2 and 12 not in bits  # the last holder keeps its line


# ---- collocations


def test_collocations_agree_with_sql(spark):
    assert agrees(collocations.op12_collocations(spark, SF), collocations.op12_sql())


def small_corpus():
    rng = np.random.default_rng(5)
    words = np.array("the of and a to red blue green stone water Stone x-ray ñandú".split())
    weight = 1 / np.arange(1, len(words) + 1)
    rows = []
    for i in range(400):
        text = " ".join(rng.choice(words, 30, p=weight / weight.sum()))
        marks = rng.choice([" ", ". ", "\n", " \t ", ", "], 4)
        rows.append((i, f"New York City{marks[0]}{text}{marks[1]}the the the the{marks[2]}new york city hall{marks[3]}", ["en", "de", None][i % 3]))
    return [*rows, (500, None, "en"), (501, "", "en"), (502, "...", "fr"), (503, "A" * 50_000, "en"), (503, "A" * 50_000, "en")]


@pytest.mark.parametrize("listed,hot", [(1 << 20, 1 << 20), (1 << 20, 120), (3, 1 << 20), (3, 120)])
def test_collocations_by_either_way_and_with_divided_pivots(spark, listed, hot):
    table = documents_table(small_corpus())
    df = spark.createDataFrame(table.to_pandas().astype(object).where(lambda x: x.notna(), None), "doc_id long, text string, lang string")
    got = collocations.collocations(df, listed=listed, hot=hot)
    assert got.count() > 30 and agrees(got, collocations.op12_sql(), table)


def test_collocations_without_phrases(spark):
    df = spark.createDataFrame([(None, None), ("one two", "en")], "text string, lang string")
    assert collocations.collocations(df).count() == 0 and collocations.collocations(df.limit(0)).count() == 0


def test_scores_beyond_64_bits(spark):
    # 1000 a n passes 2**63 and l r divides it without a rest, one below, one above
    a, n, l = 3_000_000_007, 9_000_000_011, 27_000_000_001
    row = spark.sql(f"select (cast(1000 as decimal(4,0)) * cast({a} as decimal(17,0)) * cast({n} as decimal(17,0))) div (cast({l} as decimal(19,0)) * cast({a} as decimal(18,0))) as s").first()
    assert row["s"] == 1000 * a * n // (l * a)


def test_fragments_are_packed_and_mined_exactly():
    rng = np.random.default_rng(2)
    numbers, begins = rng.integers(-1, 6, 5_000), rng.random(5_000) < 0.2
    begins[0] = True
    rows = collocations.fragments(numbers.astype(np.int32), begins)
    want = collections.Counter()
    piece = np.cumsum(begins)
    for size in range(2, 6):
        for i in range(len(numbers) - size + 1):
            own = tuple(numbers[i : i + size].tolist())
            if min(own) >= 0 and piece[i] == piece[i + size - 1]:
                want[own] += 1
    for hot in (np.zeros(len(rows), bool), np.ones(len(rows), bool)):
        got = collections.Counter()
        own, weights, spans, bucket = collocations.routed(rows, hot, 7)
        for b in np.unique(bucket):
            at = bucket == b
            back = collocations.unpacked(collocations.packed(own[at], weights[at], spans[at]))
            assert (back[0] == own[at]).all() and (back[1] == weights[at]).all() and (back[2] == spans[at]).all()
            for phrases, n in collocations.mined(*back, 20):
                for p, k in zip(phrases.tolist(), n.tolist()):
                    assert tuple(p) not in got  # every phrase has one bucket
                    got[tuple(p)] = k
        assert got == {p: k for p, k in want.items() if k >= 20}


# ---- alignment


def naive_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = alignment.public_tokenizers.path(alignment.VOCABULARY_A), alignment.public_tokenizers.path(alignment.VOCABULARY_B)
    bytes_a, bytes_b = alignment.vocabulary(path_a).bytes, alignment.vocabulary(path_b).bytes
    own_a = Tokenizer.from_file(path_a)
    own_a.encode_special_tokens = True
    own_b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    coded, count, best = [], collections.Counter(), collections.Counter()
    for d, t in rows:
        a, b = (own_a.encode(f" {t}", add_special_tokens=False).ids, own_b.encode(t)) if t else ([], [])
        if not t or b"".join(bytes_a[i] for i in a) != f" {t}".encode() or b"".join(bytes_b[i] for i in b) != f" {t}".encode():
            coded.append((d, None))
            continue
        ends = {int(e): j for j, e in enumerate(np.cumsum([len(bytes_b[i]) for i in b]))}
        links = [(i, ends[int(e)]) for i, e in enumerate(np.cumsum([len(bytes_a[i]) for i in a])) if int(e) in ends]
        count.update((a[i], b[j]) for i, j in links)
        coded.append((d, (a, b, links)))
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    out = []
    for d, own in coded:
        if own is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, links = own
        groups, i0, j0 = [], 0, 0
        for i, j in links:
            groups.append(",".join(map(str, a[i0 : i + 1])) + "|" + ",".join(map(str, b[j0 : j + 1])))
            i0, j0 = i + 1, j + 1
        pairs = [(a[i], b[j]) for i, j in links]
        out.append((d, len(a), len(b), len(groups), len(links), sum(count[p] == best[p[1]] for p in pairs), sum(count[p] for p in pairs), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


ODD = [
    (1, "Plain words, twice; plain words."), (1, "another text of the same id"), (2, None), (3, ""), (4, " "), (5, "   three  spaces   and more   "), (6, "a\n\n b \t c\r\nd"), (7, "▁ is a space for one of them"),
    (8, "<|endoftext|> <s> </s> <unk> <0x0A> are text"), (9, "naïve Ünïcödé 漢字かな 🙂🙂 a b c　d \u0085 e"), (10, "x" * 30_000), (None, "no id"), (11, "don't we'll they've 12345 67 %%%"), (11, "don't we'll they've 12345 67 %%%"), (12, "\u0000 nul \x1c \x1d sep"),
]


def aligned_digests(df):
    from pyspark.sql import functions as F

    out = alignment.align(df).withColumn("h", F.when(F.col("n_a") == 0, "").otherwise(F.sha2(F.col("groups").cast("binary"), 256)))
    return in_order(map(tuple, out.select("doc_id", *alignment.FIGURES, "h").collect()))


def test_alignment_of_odd_rows(spark, monkeypatch):
    df = spark.createDataFrame([(*r, "x", 1) for r in ODD], "doc_id long, text string, part string, n int")
    want = in_order(naive_alignment(ODD))
    assert aligned_digests(df) == want
    assert alignment.align(df.limit(0)).count() == 0
    monkeypatch.setattr(alignment, "PAIRS", 1)  # pairs met by a shuffle
    assert aligned_digests(df) == want


def test_alignment_agrees_with_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, alignment.op13_alignment(spark, SF).collect())) == sorted(naive_alignment(rows))


def test_chunks_return_to_their_parts_together(spark, monkeypatch):
    """Written tables and shuffles: a row for each part that a task has chunks of, not one for each chunk; chunks' texts are written once."""
    seen, own, keep = {}, alignment.sent, alignment.written
    monkeypatch.setattr(alignment, "sent", lambda whole, pairs: seen.setdefault("sent", own(whole, pairs)))
    monkeypatch.setattr(alignment, "written", lambda df, name, *rest: seen.setdefault(name, keep(df, name, *rest)))
    assert alignment.align(spark.read.parquet(f"{SF}/documents.parquet").repartition(2)).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert not {"chunk", "text"} & {*seen["alignment-chunks"].columns, *seen["alignment-groups"].columns}
    sent, distinct = seen["sent"], seen["alignment-groups"].count()
    assert sent.select("part").distinct().count() == 2 and 20 * sent.count() < distinct


def test_whole_texts_reach_python_in_small_batches(spark, monkeypatch):
    """The steps that read whole texts hold at most 1,000 of them in a batch, and the session's own setting stays."""
    from gridloom.llm import minhash

    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", {}
    before = spark.conf.get(name)
    for module in (alignment, minhash):
        keep = module.written
        monkeypatch.setattr(module, "written", lambda df, step, *rest, keep=keep: seen.setdefault(step, int(spark.conf.get(name))) and keep(df, step, *rest))
    docs = spark.createDataFrame([(i, f"some words of text {i}") for i in range(20)], "doc_id long, text string")
    alignment.align(docs)
    minhash.near_duplicates(docs)
    assert seen["alignment-parts"] <= 1_000 and seen["minhash-features"] <= 1_000 and seen["minhash-links"] <= 1_000
    assert spark.conf.get(name) == before


def test_groups_sort_tokens_twice(spark):
    """A task of the alignment holds few sorts at once: tokens of both sides go through one window for their ends and one for their groups."""
    import re

    size = alignment.LENGTH
    rows = [(1, [10 * size + 2, 11 * size + 3, 12 * size + 1], [20 * size + 5, 21 * size + 1]), (2, [13 * size + 4], [22 * size + 1, 23 * size + 3])]
    found = alignment.grouped(spark.createDataFrame(rows, "id long, a array<int>, b array<int>"))
    assert len(re.findall(r"\bSort \[", found._jdf.queryExecution().executedPlan().toString())) <= 3
    own = {r["id"]: (r["n_a"], r["n_b"], r["groups"], [tuple(x) for x in r["links"]]) for r in found.collect()}
    assert own == {1: (3, 2, "10,11|20;12|21", [(11, 20), (12, 21)]), 2: (1, 2, "13|22,23", [(13, 23)])}


def test_stages_hand_texts_to_python_in_small_batches(spark):
    """Packing runs after its stage has returned, so the session itself has to keep the batches small."""
    import corpus_pipeline

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        docs = spark.createDataFrame([(1, "a text", "en", "x", 6)], "doc_id long, text string, lang string, source string, n_chars long")
        corpus_pipeline.packed(spark, docs, "")
        assert int(spark.conf.get(name)) <= 1_000
    finally:
        spark.conf.set(name, before)


def test_chunks_are_certain_cuts():
    texts = pa.array(["two words", "", None, "  a  b ", "x  y", "▁", "tail "])
    chunks, counts, able = alignment.chunk_texts(texts)
    assert chunks.to_pylist() == [" two", " words", "   a", "  b", " ", " x  y", " tail", " "] and counts.tolist() == [2, 0, 0, 3, 1, 0, 2] and able.tolist() == [True, False, False, True, True, False, True]


# ---- the pipeline's language stage


def test_language_stage_sets_languages_by_its_model(spark, monkeypatch):
    from pyspark.sql import functions as F

    import corpus_pipeline
    from gridloom.llm import langid
    from gridloom.llm.common import held_out

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null")
    # held-out documents lose their language or get another one; a text without a letter is rejected
    wrong = docs.withColumn("lang", F.when(held_out() & (F.col("doc_id") % 2 == 0), F.lit(None)).when(held_out(), F.when(F.col("lang") == "en", "de").otherwise("en")).otherwise(F.col("lang")))
    wrong = wrong.unionByName(spark.createDataFrame([(10**9, "12345 %%% 678", "en", "x", 13)], docs.schema))
    true = {r["doc_id"]: r["lang"] for r in docs.collect()}
    own = {r["doc_id"] for r in docs.where(held_out()).collect()}

    def restored():
        rows = corpus_pipeline.language(spark, wrong, SF).collect()
        assert 10**9 not in {r["doc_id"] for r in rows} and {r["doc_id"] for r in rows} <= set(true)
        return np.mean([r["lang"] == true[r["doc_id"]] for r in rows if r["doc_id"] in own])

    assert len(own) > 20 and restored() > 0.9
    # a test for letters in the place of the model restores next to nothing
    monkeypatch.setattr(langid.Filters, "predict", lambda self, text: ("en" if any(map(str.isalpha, text or "")) else langid.UNKNOWN, 0.0))
    model = langid.learn(wrong)
    monkeypatch.setattr(langid, "identify", lambda df, filters, text="text": df.withColumns({"lang_pred": F.when(F.col(text).rlike("[a-zA-Z]"), "en").otherwise(langid.UNKNOWN), "lang_score": F.lit(0.0)}))
    assert model.languages and restored() < 0.7


# ---- the share of embedding queries that are compared exactly


@pytest.mark.parametrize("share", [0.0, 0.01, 0.2])
def test_links_come_from_the_graphs(share, monkeypatch):
    from gridloom.llm import embeddup
    from gridloom.llm.hnsw import Graph

    rng, n, shards = np.random.default_rng(8), 3_000, 2
    x = rng.normal(size=(n, 32))
    m = int(n * share / 2)
    x[:m] = x[n - m :] + 0.25 * rng.normal(size=(m, 32))
    x = embeddup.unit(x)
    asked = {"exact_links": 0, "graph_links": 0}
    for name, at in (("exact_links", 3), ("graph_links", 4)):
        plain = getattr(embeddup, name)
        monkeypatch.setattr(embeddup, name, lambda *a, plain=plain, name=name, at=at: (asked.__setitem__(name, asked[name] + len(a[at])), plain(*a))[1])
    found = set()
    for k in range(shards):
        at = np.arange(k, n, shards)
        own, beam = np.full(n, -1), []
        own[at] = np.arange(len(at))
        graph = Graph(x[at]).attach(x[at])
        for a in range(0, n, 1_000):  # blocks of one part share the audit
            q, s = embeddup.found_links(graph, x[at], x[a : a + 1_000], own[a : a + 1_000], 0.9, beam)
            found |= {(a + int(i), int(at[j])) for i, j in zip(q, s)}
        assert beam[0] is not None
    i, j = np.nonzero(x @ x.T >= 0.9)
    true = {(a, b) for a, b in zip(i.tolist(), j.tolist()) if a != b}
    assert found <= true and len(found) >= 0.98 * len(true) and (share == 0) == (not true)
    assert asked["exact_links"] < 0.1 * n * shards and asked["graph_links"] > n * shards
