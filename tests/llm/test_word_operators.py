"""Decontamination, mixing, substring and line dedup against brute force on small fixtures."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from specblock.llm import decontamination, line_dedup, mixing, queries, substring_dedup
from tests.oracle import connect, rows_of, sql_rows


def by_text(rows):
    return sorted(rows, key=str)


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))


def contaminated(docs, items, size):
    windows = {}
    for item, text in items:
        w = bench_words(text)
        for j in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[j : j + size]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = bench_words(text), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
                    found |= windows[tuple(w[j : j + n])]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), ",".join(ids), bool(hit)))
    return by_text(out)


@pytest.fixture(scope="module")
def mixed_docs():
    rng = random.Random(1)
    vocabulary = ["a", "b", "C", "É", "é", "d1", "x_y", "it's", "ΑΣ", "Ƞ", "İz", "日本"]
    word = lambda: rng.choice(["", " ", "--", "\n"]) + rng.choice(vocabulary) + rng.choice([" ", "' ", "."])
    docs = [(i if i % 9 else None, "".join(word() for _ in range(rng.choice([0, 1, 5, 60])))) for i in range(60)]
    items = [(rng.choice([1, 2, 3, 10, None]), " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 6])))) for _ in range(14)]
    return docs + [docs[3], (None, None), (7, ""), (8, "..."), (9, "a " * 3000)], items + [(5, None), (6, "?"), (77, docs[5][1])]


@pytest.mark.parametrize("size", [2, 4])
@pytest.mark.parametrize("broadcast_rows", [10**6, 0])
def test_decontamination(size, broadcast_rows, spark, mixed_docs):
    docs, items = mixed_docs
    table = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, n_words string")
    found = decontamination.contamination(table, spark.createDataFrame(items, "item_id long, text string"), size, broadcast_rows)
    rows = found.select("doc_id", "n_words", "n_hit", F.array_join("item_ids", ","), "contaminated").collect()
    assert by_text(map(tuple, rows)) == contaminated(docs, items, size)


def test_decontamination_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in decontamination.contamination(docs, none).collect()] == [(1, 3, 0, [], False)]
    assert decontamination.contamination(docs.where("false"), docs.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_proximity_matches(spark):
    docs = spark.createDataFrame([(1, "x beta y alpha z"), (2, "alpha q q q q q beta"), (3, "alpha beta")], "doc_id long, text string")
    windows = decontamination.test_windows(spark.createDataFrame([(9, "Alpha beta")], "item_id long, text string"), 2)
    terms = windows.select(F.explode("words").alias("word")).select(decontamination.term_of(F.col("word")).alias("term")).distinct()
    led = decontamination.led_windows(windows, decontamination.term_frequencies(docs, terms))
    index = decontamination.postings(docs, led.select("term").distinct(), 4)
    assert {r.id for r in decontamination.proximity_matches(index, led, 1).collect()} == {1, 3}
    assert {r.id for r in decontamination.phrase_matches(index, led).collect()} == {3}


def targets(sizes, weights, share, most):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, full = share * sum(sizes.values()), set()
    while True:
        rest = [s for s in order if s not in full]
        left, total = budget - sum(most * sizes[s] for s in full), sum(w[s] for s in rest)
        out = {s: most * sizes[s] if s in full else left * w[s] / total for s in order}
        over = {s for s in rest if out[s] > most * sizes[s]}
        if not over:
            return out
        full |= over


@pytest.mark.parametrize("seed", range(3))
def test_mixing(seed, spark):
    rng = random.Random(seed)
    sources = [None, "", "a", "Z", "é", "z", "空"]
    docs = [(rng.choice([i, i, None, 3]), " ".join(["w"] * int(rng.paretovariate(0.8))), rng.choice(sources + ["hot"] * 6)) for i in range(150)]
    docs += [(500, None, "nulls"), (501, "\x0b \t", "blank"), docs[0], docs[0]]
    table = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, source string, size string")
    rows = mixing.mix(table).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert by_text((r.doc_id, r.source, r.size) for r in rows) == by_text((i, s, size(t)) for i, t, s in docs)
    sizes = Counter()
    for _, t, s in docs:
        sizes[s] += size(t)
    wanted, taken = targets(sizes, mixing.WEIGHTS, mixing.SHARE, mixing.MOST), Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(wanted[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(0 <= wanted[s] - taken[s] < 1 + 1e-6 for s in sizes)
    assert by_text(map(tuple, rows)) == by_text(map(tuple, mixing.mix(table.repartition(5)).collect()))


def test_mixing_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert {(r.doc_id, r.size, r.target, r.taken) for r in mixing.mix(blank).collect()} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}
    with pytest.raises(ValueError):
        mixing.mix(blank, share=3.0)


def deduped(docs, k):
    words = [(i, (t or "").encode().split()) for i, t in docs]
    counts = Counter(tuple(w[j : j + k]) for _, w in words for j in range(len(w) - k + 1))
    out = []
    for i, w in words:
        keep = [True] * len(w)
        for j in range(len(w) - k + 1):
            if counts[tuple(w[j : j + k])] > 1:
                keep[j : j + k] = [False] * k
        left = b" ".join(x for x, yes in zip(w, keep, strict=True) if yes)
        out.append((i, len(w), len(w) - sum(keep), left.decode()))
    return by_text(out)


@pytest.mark.parametrize(("seed", "batch", "letters"), [(0, 10000, "abcdefghij"), (1, 3, "abc"), (2, 7, "ab")])
def test_substring_dedup(seed, batch, letters, spark):
    rng = random.Random(seed)
    base = [rng.choice("ab cd ef gh ij kl É".split()) for _ in range(200)]
    docs = []
    for i in range(50):
        w = [rng.choice(letters) for _ in range(rng.choice([0, 1, 4, 5, 6, 30, 100]))]
        if rng.random() < 0.6:
            a = rng.randrange(150)
            w[len(w) // 2 : len(w) // 2] = base[a : a + rng.choice([4, 6, 12, 30])]
        docs.append((i if i % 7 else None, rng.choice([" ", "\n", "\x0b"]).join(w)))
    docs += [docs[3], docs[4], (None, None), (99, ""), (5, "a " * 40)]
    table = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, kept_text int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        for k, s in ((6, 2), (5, 5), (8, 3)):
            assert by_text(map(tuple, substring_dedup.dedup_substrings(table, k, s).collect())) == deduped(docs, k)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_substring_dedup_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "PIECE_WORDS", 16)
    monkeypatch.setattr(substring_dedup, "HELD_ROWS", 4)
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice("abc") for _ in range(90))) for i in range(12)]
    assert by_text(map(tuple, substring_dedup.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string"), 7, 3).collect())) == deduped(docs, 7)
    assert substring_dedup.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string"), 3, 4)


def test_line_dedup(spark):
    hot = [(i, f"menu\nown {i}\n menu \n\n", f"s{i % 5}") for i in range(20)]
    docs = hot + [(100, "menu", None), (101, None, "s1"), (102, "", "s2"), (103, "rare\nrare", "s1"), (104, "rare", "s2"), hot[0]]
    table = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, source string, n_lines string")
    rows = {r.doc_id: r for r in line_dedup.dedup_lines(table, 5).collect()}
    assert rows[3].kept_text == "own 3\n\n" and (rows[3].n_lines, rows[3].n_removed) == (5, 2)
    assert rows[100].kept_text == "" and rows[101].kept_text is None and rows[102].kept_text == ""
    assert rows[103].kept_text == "rare\nrare"
    assert line_dedup.dedup_lines(table, 5).count() == len(docs)
    spared = {r.doc_id: r for r in line_dedup.dedup_lines(table, 5, spare_whole=True).collect()}
    assert spared[100].kept_text == "menu" and spared[100].n_removed == 0 and spared[3].n_removed == 2
    assert line_dedup.dedup_lines(table.where("false")).count() == 0


def test_only_copies_keep_their_boilerplate(spark):
    hot = [(i, f"menu\nfooter\nown {i}", f"s{i}") for i in range(8)]
    docs = hot + [(100, "menu\nfooter", "s1"), (101, "footer\nmenu", "s1"), (101, "footer\nmenu", "s1"), (None, "menu", "s2")] + [(200 + i, "whole\ncopy", f"s{i}") for i in range(8)]
    table = spark.createDataFrame([(*d, "en", 0) for d in docs], "doc_id long, text string, source string, lang string, n_chars long")
    for spare in (line_dedup.dedup_lines(table, spare_copies=True).select("doc_id", "kept_text"), corpus_pipeline.drop_boilerplate(spark, table, "").select("doc_id", "text")):
        kept = sorted(map(tuple, spare.collect()), key=str)
        assert kept == sorted([(i, f"own {i}") for i in range(8)] + [(100, ""), (101, ""), (101, ""), (None, "")] + [(200 + i, "whole\ncopy") for i in range(8)], key=str)


@pytest.mark.parametrize("sites", [3, 40])
def test_near_threshold_lines_are_exact(sites, spark):
    rows = [(n * 1000 + i, f"line {n}", f"site {i}") for n in range(sites - 2, sites + 3) for i in range(n)]
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), sites)
    gone = {r.doc_id // 1000 for r in found.where("n_removed > 0").collect()}
    assert gone == set(range(sites, sites + 3))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_twins(name, spark):
    sf_dir = "/root/testdata/sf0.01"
    columns, rows = rows_of(queries.QUERIES[name](spark, sf_dir))
    assert rows == sql_rows(connect(sf_dir), queries.ORACLE_SQL[name], columns)


def test_digest_queries_match_brute_force(spark, sf_dir):
    """op1, op2 and op4 over their whole tables."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    own = [(d, n, h, len(i.split(",")) if i else 0, sha(i), c) for d, n, h, i, c in contaminated(docs, items, 10)]
    assert by_text(map(tuple, queries.op1_decontamination(spark, sf_dir).collect())) == by_text(own)
    own = [(d, n, r, sha(t)) for d, n, r, t in deduped(docs, 35)]
    assert by_text(map(tuple, queries.op4_substring_dedup(spark, sf_dir).collect())) == by_text(own)
    assert queries.op2_source_mixing(spark, sf_dir).columns == ["doc_id", "size", "source_size", "target", "taken"]


def test_very_many_lines(spark):
    """A text of 30,000 lines of which most are boilerplate: time must not grow with lines times removed lines."""
    lines = [f"line {i}" for i in range(30_000)]
    rows = [(i, "\n".join(lines), f"s{i}") for i in range(8)] + [(9, "\n".join([*lines[:10], "own", "", *lines[10:]]), "s0")]
    kept = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert (kept[9].kept_text, kept[9].n_lines, kept[9].n_removed) == ("own\n", 30_002, 30_000)
    assert (kept[3].kept_text, kept[3].n_removed) == ("", 30_000)
