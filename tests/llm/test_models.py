"""Language ID, LM scoring, token counts, SimHash, neighbours, chats and the pipeline."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from specblock.llm import chat_formatting, elias_fano, language_id, near_copies, nearest, ngram_lm, queries, simhash, token_counts, word_arrays

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def table():
    return token_counts.sentencepiece_table(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@given(st.lists(st.text(st.sampled_from("ab ▁\n\tétheer-=_0日😀") | st.characters(exclude_categories=["Cs"]), max_size=40), max_size=5))
@settings(max_examples=150, deadline=None)
def test_token_counts_equal_the_library(table, library, texts):
    assert token_counts.text_counter(table)(texts) == [len(x) for x in library.encode(texts)] if texts else True


def test_token_counts_of_odd_texts(table, library):
    texts = ["", "<s>", "</s><unk><0x0A>", "a\x00b", " " * 700, "\t\n\r", "-" * 3000, "ab" * 3000, "é" * 500, "  x  y "]
    assert token_counts.text_counter(table)(texts) == [len(x) for x in library.encode(texts)]


LETTERS = {
    "letters": "abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "cjk": "的一是不了人我在有他这为之大来以个中上们日本語のはにをがと",
    "few": "ae",
    "vowels": "étaoin",
}


@pytest.mark.parametrize("kind", LETTERS)
def test_long_words_equal_the_library(kind, table, library):
    rng = random.Random(kind)
    texts = ["".join(rng.choice(LETTERS[kind]) for _ in range(n)) for n in (1, 2, 3, 50, 255, 256, 257, 258, 300, 1000, 5000, 100_000)]
    assert token_counts.text_counter(table)(texts) == [len(x) for x in library.encode(texts)]


@given(st.lists(st.text("aeintABé日", min_size=1, max_size=60), min_size=1, max_size=4))
@settings(max_examples=100, deadline=None)
def test_long_rows_merge_as_short_ones(table, words):
    joined = ["".join(words) * 3, *words]
    limit, token_counts.LONG_ROW = token_counts.LONG_ROW, 4
    try:
        by_heap = token_counts.count_pretokens(table, joined).tolist()
    finally:
        token_counts.LONG_ROW = limit
    assert by_heap == token_counts.count_pretokens(table, joined).tolist()


def test_token_count_query(spark, sf_dir, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op10_token_counts(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = len(library.encode(docs[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 4096)
    odd = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 2)], "doc_id long, text string, n_tokens int")
    assert [tuple(r) for r in token_counts.token_counts(odd, MODEL, 10).collect()] == [(None, 0, 0, False), (1, 0, 0, False), (1, 0, 0, False)]
    assert token_counts.token_counts(odd.where("false"), MODEL, 10).count() == 0


def slow_ngrams(text, max_n):
    table, counts = language_id.letters(), Counter()
    codes = [32, *(int(table[ord(c)]) or 32 for c in text), 32]
    for n in range(1, max_n + 1):
        for i in range(len(codes) - n + 1):
            g = codes[i : i + n]
            if (n == 1 and g[0] != 32) or (n > 1 and 32 not in g[1:-1] and not (g[0] == 32 and g[-1] == 32)):
                counts[sum(c << language_id.BITS * k for k, c in enumerate(g))] += 1
    return counts


@pytest.mark.parametrize("piece", [1 << 20, 3, 5])
def test_ngram_counts(piece, monkeypatch):
    monkeypatch.setattr(language_id, "PIECE", piece)
    for text in ("Straße, É!", "a", " ", "ab  cd1ef", "日本語 x", "İI"):
        codes, counts = language_id.ngram_counts(text, language_id.letters(), 3)
        assert dict(zip(codes.tolist(), counts.tolist(), strict=True)) == slow_ngrams(text, 3)


def test_language_id(spark, sf_dir):
    rows = queries.op3_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 200 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = language_id.fit_profiles(docs)
    odd = spark.createDataFrame([(None, None, "x"), (1, "12 ,.", "x"), (2, "", "x"), (3, "der die das und", None), (3, "der die das und", None)], "doc_id long, text string, lang_pred string")
    told = [tuple(r) for r in language_id.detect(odd, profiles, ["doc_id"]).select("doc_id", "lang_pred").collect()]
    assert told == [(None, "und"), (1, "und"), (2, "und"), (3, "de"), (3, "de")]
    nothing = language_id.fit_profiles(docs.where("false"))
    assert {tuple(r) for r in language_id.detect(odd, nothing, ["doc_id"]).select("lang_pred", "score").collect()} == {("und", 0.0)}
    few = language_id.fit_profiles(docs, sample_per_lang=20)
    assert few.langs == profiles.langs


@given(st.lists(st.integers(0, 10**6), max_size=200), st.lists(st.integers(0, 10**6 + 50), max_size=50))
@settings(max_examples=60, deadline=None)
def test_elias_fano(values, wanted):
    values, wanted = np.sort(np.array(values, np.int64)), np.array(wanted, np.int64)
    code = elias_fano.Sequence(**elias_fano.encode(values))
    assert (code.get(np.arange(len(values))) == values).all()
    place, same = code.successor(wanted)
    assert (place == np.searchsorted(values, wanted)).all() and (same == np.isin(wanted, values)).all()


@given(st.lists(st.none() | st.text("aB\t \x0b\né\x00", max_size=12), max_size=6))
@settings(max_examples=100, deadline=None)
def test_word_arrays(texts):
    hashes, sizes = word_arrays.WordHasher().tokens(texts)
    words = [w for t in texts for w in (t or "").encode().lower().split()]
    assert sizes.tolist() == [len((t or "").encode().split()) for t in texts] and len(hashes) == len(words)
    seen = {}
    for w, h in zip(words, hashes.tolist(), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_one_word_longer_than_a_block(monkeypatch):
    monkeypatch.setattr(word_arrays, "BLOCK", 8)
    hasher = word_arrays.WordHasher()
    a, _ = hasher.tokens(["x" * 50 + " ab " + "x" * 50 + " abcdefg hij"])
    assert a[0] == a[2] and len(set(a.tolist())) == 4


def lm_model(train, order, discount):
    tokens = [[*(t or "").encode().lower().split(), b" "] for t in train]
    counts = {n: Counter(tuple(t[i : i + n]) for t in tokens for i in range(len(t) - n + 1)) for n in range(1, order + 1)}
    kept = {n: counts[n] for n in range(2, order + 1)}
    mass = {n: defaultdict(float) for n in kept}
    for n, grams in kept.items():
        for g, c in grams.items():
            mass[n][g[:-1]] += c - discount
    total, types = sum(counts[1].values()), len(counts[1])

    def p(gram):
        n = len(gram)
        if n == 1:
            return (counts[1].get(gram, 0) + 0.5) / (total + 0.5 * (types + 1))
        context = gram[:-1]
        have = counts[1].get(context, 0) if n == 2 else kept[n - 1].get(context, 0)
        if not have:
            return p(gram[1:])
        return max(kept[n].get(gram, 0) - discount, 0) / have + (1 - mass[n][context] / have) * p(gram[1:])

    return counts[1], total, lambda t: [p(tuple(t[max(0, i - order + 1) : i + 1])) for i in range(len(t))]


@pytest.mark.parametrize(("order", "part_tokens", "mounted"), [(1, 1 << 20, True), (2, 20, True), (3, 1 << 20, None), (3, 20, True), (4, 50, True), (3, 20, False)])
def test_lm_scores(order, part_tokens, mounted, spark):
    rng = random.Random(order)
    texts = [" ".join(rng.choice(["a", "b", "c", "D", f"w{rng.randrange(30)}"]) for _ in range(rng.choice([0, 1, 2, 40]))) for _ in range(80)] + [None]
    train = texts[:60]
    model = ngram_lm.train_model(spark.createDataFrame([(t,) for t in train], "text string"), order=order, part_tokens=part_tokens, mounted=mounted)
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, score int")
    unigrams, total, probabilities = lm_model(train, order, ngram_lm.DISCOUNT)
    for r in ngram_lm.score(docs, model, ["doc_id"]).collect():
        tokens = [*(texts[r.doc_id] or "").encode().lower().split(), b" "]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum((t,) in unigrams for t in tokens), total)
        assert r.score == pytest.approx(sum(map(math.log10, probabilities(tokens))), abs=2e-3 * len(tokens))
        assert r.base_score == pytest.approx(sum(math.log10((unigrams.get((t,), 0) + 0.5) / (total + 0.5 * (len(unigrams) + 1))) for t in tokens))


def test_lm_query_keeps_what_one_document_teaches(spark, tmp_path):
    text = " ".join(f"rare{i}" for i in range(60))
    ids = range(200)
    bucket = {r.i: r.b for r in spark.range(200).select(F.col("id").alias("i"), queries.id_bucket("id", 5).alias("b")).collect()}
    taught, held = next(i for i in ids if bucket[i] != 1), next(i for i in ids if bucket[i] == 1)
    rows = [(taught, text), (held, text), *((i, f"other{i} words{i}") for i in ids if i not in (taught, held) and bucket[i] != 1)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    row = next(r for r in queries.op5_lm_scoring(spark, str(tmp_path)).collect() if r.doc_id == held)
    assert row.held_out and row.n_known == row.n_tokens and row.score - row.base_score > 1.5


def test_lm_probabilities_sum_to_one():
    counts, _, probabilities = lm_model(["a b a b c", "a b c a", "b b a"], 3, 0.75)
    vocabulary = [g[0] for g in counts] + [b"unknown"]
    for context in ([b"a"], [b"a", b"b"], [b"c", b"a"]):
        assert sum(probabilities([*context, w])[-1] for w in vocabulary) == pytest.approx(1)


def test_lm_without_training(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    model = ngram_lm.train_model(empty)
    rows = ngram_lm.score(spark.createDataFrame([(None, None), (1, "a b")], "doc_id long, text string"), model, ["doc_id"]).collect()
    assert [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows] == [(None, 1, 0, 0, 0.0, 0.0), (1, 3, 0, 0, 0.0, 0.0)]
    assert ngram_lm.score(empty, model, ["doc_id"]).count() == 0


def test_held_out_text_scores_above_the_base(spark):
    rows = queries.op5_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert rows.s > rows.b


def slow_fingerprint(text, shingle):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@given(st.text("aB \n\x0bé", max_size=60))
@settings(max_examples=60, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text, 3) == [slow_fingerprint(text, 3)]


@pytest.mark.parametrize(("radius", "parts"), [(0, 1), (1, 1), (3, 1), (5, 1), (11, 2), (7, 3)])
def test_masks_cover_every_pair_within_the_radius(radius, parts):
    masks = simhash.covering_masks(radius, parts=parts)
    rng = random.Random(radius)
    for _ in range(2000):
        differing = sum(1 << p for p in rng.sample(range(64), radius))
        assert any(not m & differing for m in masks)
    for own in masks[:3]:
        finer = simhash.covering_masks(radius, ((1 << 64) - 1) & ~own, parts)
        free = [p for p in range(64) if not own >> p & 1]
        for _ in range(300):
            differing = sum(1 << p for p in rng.sample(free, min(radius, len(free))))
            assert any(not m & differing for m in finer)


@pytest.mark.parametrize("bucket_rows", [4096, 2])
def test_near_duplicates(bucket_rows, spark):
    rng = random.Random(4)
    base = [" ".join(rng.choice("one two three four five six seven".split()) for _ in range(60)) for _ in range(8)]
    docs = []
    for i in range(90):
        words = base[i % 8].split()
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            words[rng.randrange(60)] = rng.choice(["x", "y", "z"])
        docs.append((i if i % 11 else None, " ".join(words)))
    docs += [docs[2], (700, None), (701, ""), (702, " \n"), (703, "short one")]
    table = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, fingerprint string")
    fps = [slow_fingerprint(t, 3) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        groups[find(i)].append(d)
    least = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
    own = sorted(((d, format(fps[i], "016x"), least[find(i)]) for i, (d, _) in enumerate(docs)), key=str)
    assert sorted(map(tuple, simhash.near_duplicates(table, 3, 3, bucket_rows=bucket_rows).collect()), key=str) == own
    assert simhash.near_duplicates(table.where("false")).count() == 0


def test_simhash_query_is_that_of_brute_force(spark, sf_dir):
    docs = sorted((r.doc_id, slow_fingerprint(r.text, 3)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    group = {d: d for d, _ in docs}
    for i, (d, x) in enumerate(docs):
        for e, y in docs[:i]:
            if (x ^ y).bit_count() <= 3 and group[d] != group[e]:
                low, high = sorted((group[d], group[e]))
                group = {k: low if g == high else g for k, g in group.items()}
    rows = queries.op6_simhash_near_dedup(spark, sf_dir).collect()
    assert sorted(map(tuple, rows)) == [(d, format(x, "016x"), group[d]) for d, x in docs]


def test_pipeline_stages_of_odd_tables(spark, sf_dir):
    """Empty tables, repeated rows, nulls and columns that documents does not have."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    null = spark.createDataFrame([(None, "the same words as ever in a text of some length", None, None, None)], docs.schema)
    odd = docs.union(docs.limit(5)).union(null).withColumn("fp", F.lit(1)).withColumn("lines", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd.where("false"), sf_dir).count() == 0, name
        kept = stage(spark, odd, sf_dir)
        assert kept.columns == corpus_pipeline.COLUMNS and kept.count() <= odd.count(), name
    assert corpus_pipeline.mix_sources(spark, odd.where("false"), sf_dir).count() == 0
    rows = corpus_pipeline.mix_sources(spark, odd, sf_dir).collect()
    assert rows and all(0 < r.taken <= 2 * r.size for r in rows)
    once = corpus_pipeline.drop_near_duplicates(spark, odd, sf_dir).collect()
    assert len({r.doc_id for r in once}) == len(once)


def test_neighbours_find_what_brute_force_finds(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    found = defaultdict(list)
    for r in queries.op7_nearest_neighbours(spark, sf_dir).collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        own = sorted(found[ids[q]])
        assert [r for r, _, _ in own] == list(range(1, 11)) and [(s, v) for _, v, s in own] == sorted((s, v) for _, v, s in own)
        assert all(s == pytest.approx(d[np.flatnonzero(ids == v)[0]], abs=1e-12) for _, v, s in own)
        hits += sum(s <= np.sort(d)[9] for _, _, s in own)
    assert hits / (10 * len(found)) >= 0.9


def test_neighbours_of_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(1, 60)] + [(100 + i, [1.0, 2.0, 3.0, 0.0, 0.0, 1.0]) for i in range(30)]
    bad = [(200, None), (300, [0.0] * 6), (400, [float("nan")] * 6), (500, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (600, [1.0, 2.0]), (None, [1.0] * 6), (700, [float("inf")] * 6)]
    table = spark.createDataFrame([(*r, 7) for r in rows + bad + rows[:2]], "vec_id long, embedding array<double>, rank int")
    exact = nearest.nearest(table, F.col("id") % 100 == 0, tables=12, part_rows=8)
    got = sorted((r["rank"], r.vec_id, r.score) for r in exact.collect())
    assert got == [(k, 100 + k, 0.0) for k in range(1, 11)]
    alone = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert nearest.nearest(alone, F.col("id") % 100 == 0).count() == 0
    assert nearest.nearest(table.where("false"), F.col("id") == 0).count() == 0


def test_neighbours_of_repeated_ids_and_a_huge_norm(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.9, 0.1]), (100, [1.0, 0.05]), (100, [0.0, 1.0])]
    found = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 100 == 0)
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in found.collect())
    every = []
    for i, v in enumerate(rows):
        if v[0] == 100:
            others = sorted((round(math.dist(v[1], w[1]), 6), w[0]) for j, w in enumerate(rows) if j != i)
            every += [(100, r, d, s) for r, (s, d) in enumerate(others, 1)]
    assert got == sorted(every)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[7] *= 1000
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = defaultdict(list)
    for r in nearest.nearest(table, F.col("id") % 100 == 0).collect():
        found[r.query_id].append(r.vec_id)
    hits = 0
    for q, ids in found.items():
        d = np.sqrt(((x.astype(float) - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hits += len({*ids} & {*np.argsort(d)[:10].tolist()})
    assert len(found) == 30 and hits >= 0.9 * 300


def test_chats(spark):
    long = [("user", "hi"), ("bot", "yes"), ("user", "<|im_end|>")]
    chats = {1: long[:1], 2: long[:2], 3: long, 4: long, 5: [("user", "hi"), ("bot", None)], 6: [("user", "hi"), ("bot", "")], None: [("bot", "x")]}
    rows = [(c, t, *m, "x") for c, ms in chats.items() for t, m in enumerate(ms)] + [(7, None, "user", "hi", "x"), (7, 0, None, "tail", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rendered string")
    out = {(r.conv_id, r.chunk): r for r in chat_formatting.format_chats(table, chunk_turns=2).collect()}
    assert set(out) == {(3, 0), (3, 1), (5, 0), (6, 0), (7, 0), (None, 0)}
    assert out[3, 0].rendered == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>bot\nyes<|im_end|>\n" and out[3, 0].n_turns == 3
    assert out[3, 1].rendered == "<|im_start|>user\n< |im_end|><|im_end|>\n"
    assert out[7, 0].rendered == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>\ntail<|im_end|>\n"
    assert chat_formatting.format_chats(table.where("false")).count() == 0


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "decontamination", "source_mixing"]
    extra = [(90001, None, None, None, 0), (90002, "!!! 123", "en", "s", 7), (90003, docs.first().text, "en", "other", 1)]
    start = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    first = corpus_pipeline.keep_languages(spark, start, sf_dir)
    kept = {r.doc_id for r in first.collect()}
    assert kept == {r.doc_id for r in start.collect()} - {90001, 90002}
    second = corpus_pipeline.drop_boilerplate(spark, first, sf_dir)
    assert second.columns == corpus_pipeline.COLUMNS and second.count() == len(kept)
    third = {r.doc_id: r.text for r in corpus_pipeline.drop_near_duplicates(spark, second, sf_dir).collect()}
    texts = {r.doc_id: r.text for r in second.collect()}
    assert len({*third.values()}) == len(third) and {*third.values()} <= {*texts.values()}
    brute = slow_near_dedup(texts.items())
    # No text goes without a chain of links; few links are missed.
    assert {*third} >= brute and len(third) - len(brute) <= 0.1 * (len(texts) - len(brute))


def test_pipeline_runs(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and all(0 < r.taken <= 2 * r.size for r in rows)
    assert corpus_pipeline.ORACLE_SQL is None


def grams_of(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def slow_near_dedup(rows):
    """The ids that stay of (id, text), by the Jaccard similarity of all pairs."""
    rows = sorted(rows)
    sets, group = [grams_of(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    return {rows[g][0] for g in group}


def test_near_copies_are_those_of_exact_jaccard(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows = []
    for base in range(40):
        words = [word() for _ in range(rng.choice((30, 60, 200)))]
        for _ in range(6):
            copy = list(words)
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
        rows.append(" ".join(words[: int(len(words) * 0.85)]))
    rows += [None, "", " \n", "a b", "A  b", "a b c", rows[3], rows[3].upper()]
    rows = [(i, t) for i, t in enumerate(rows)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    brute, once = slow_near_dedup(rows), {r.doc_id for r in near_copies.one_of_each(table).collect()}
    assert once >= brute and len(once) - len(brute) <= 0.1 * (len(rows) - len(brute))
    twice = table.union(table).union(spark.createDataFrame([(None, rows[0][1]), (None, "only here")], table.schema))
    kept = [r.doc_id for r in near_copies.one_of_each(twice).collect()]
    assert len(kept) == len(set(kept)) and set(kept) == once | {None}
    assert near_copies.one_of_each(table.where("false")).count() == 0
