"""Benchmark decontamination over a distributed positional inverted index.

DataFrame and SQL functions only.  A test item gives windows of consecutive
words.  The corpus frequency of every test term is counted, each window is led
by its rarest term, and only those terms' postings are stored: document,
position, and the words around it.  Windows meet the postings of their rarest
term; the second rarest term's offset-adjusted position must hold that term,
and what is left is compared word by word.  A window with a term that the
corpus lacks cannot occur and is dropped before the index is built.

The test side is broadcast while it has at most `broadcast_rows` rows; beyond
that the same joins shuffle.  Hot terms and passages spread with their
documents; aggregates are by document and combine before they shuffle.

Defined results: a null or wordless text has no words and no hits, and a null
or wordless item no windows; an item of fewer words than a window is one
window; a window of a null item id hits words but is no item; repeated item
ids are one item; repeated documents get equal results; null ids are kept;
empty tables give no items or no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specblock.llm.common import broadcast_if_small
from specblock.session import cut

WINDOW = 10
BROADCAST_ROWS = 500_000
#: Runs of characters between words, before A-Z is lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: What is not between, as the characters that it holds: Java matches these ranges ten times as fast as a negated set.
WORD = r"[0-9A-Za-z\x80-\x{10FFFF}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def term_of(word: Column) -> Column:
    """What words are indexed by: equal for words that differ in the case of A-Z, and fast."""
    return F.lower(word)


def test_windows(items: DataFrame, size: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(words, items): the distinct windows and the ids (as text) of the items that hold them."""
    words = F.filter(F.split(ascii_lower(F.col(text_col)), BETWEEN, -1), lambda w: w != "")
    rows = items.select(F.col(id_col).cast("string").alias("item"), words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (size - 1)))
    rows = rows.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("words"))
    return rows.groupBy("words").agg(F.collect_set("item").alias("items"))


def tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tag, words, pos, term) of every word; positions are those in words."""
    rows = docs.select(F.col(id_col).alias("id"), F.hash(text_col).alias("tag"), F.split(F.col(text_col), BETWEEN, -1).alias("words"))
    return rows.select("id", "tag", "words", F.posexplode("words").alias("pos", "word")).withColumn("term", term_of(F.col("word"))).drop("word")


def term_frequencies(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(term, n) of those terms (term) that occur in docs."""
    return tokens(docs, id_col, text_col).select("term").join(broadcast_if_small(terms, broadcast_rows), "term").groupBy("term").count().withColumnRenamed("count", "n")


def led_windows(windows: DataFrame, frequencies: DataFrame) -> DataFrame:
    """windows with term and at (the rarest), term_2 and at_2 (the second rarest, if any).

    Windows with a term that does not occur are left out.
    """
    numbered = windows.withColumn("window", F.xxhash64("words"))
    parts = numbered.select("window", "words", F.posexplode("words").alias("at", "word")).withColumn("term", term_of(F.col("word")))
    ranked = parts.join(frequencies, "term").groupBy("window", "words").agg(F.array_sort(F.collect_list(F.struct("n", "at", "term"))).alias("by"))
    ranked = ranked.where(F.size("by") == F.size("words"))
    rare, second = F.col("by")[0], F.get("by", F.lit(1))
    led = ranked.select("words", rare["term"].alias("term"), rare["at"].alias("at"), second["term"].alias("term_2"), second["at"].alias("at_2"))
    return led.join(windows, "words")


def postings(docs: DataFrame, terms: DataFrame, reach: int, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The positional index of terms (term): (term, id, tag, pos, from, near).

    near holds the words from position `from` to reach words after pos.
    """
    hits = tokens(docs, id_col, text_col).join(broadcast_if_small(terms, broadcast_rows), "term")
    start = F.greatest(F.col("pos") - reach, F.lit(0))
    return hits.select("term", "id", "tag", "pos", start.alias("from"), F.slice("words", start + 1, F.col("pos") - start + 1 + reach).alias("near"))


def phrase_matches(index: DataFrame, led: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(id, tag, start, length, items) of every exact occurrence of a window.

    index must reach as far as the windows are long.
    """
    met = index.join(broadcast_if_small(led, broadcast_rows), "term")
    start = F.col("pos") - F.col("at")
    place_2 = start + F.col("at_2") - F.col("from")
    second = F.col("term_2").isNull() | (term_of(F.get("near", place_2)) == F.col("term_2"))
    held = F.slice("near", start - F.col("from") + 1, F.size("words"))
    same = F.transform(held, ascii_lower) == F.col("words")
    met = met.where((start >= F.col("from")) & second)
    return met.where(F.when(start >= F.col("from"), same)).select("id", "tag", start.alias("start"), F.size("words").alias("length"), "items")


def proximity_matches(index: DataFrame, led: DataFrame, slop: int, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(id, tag, pos, items): a window's distinct terms, in any order, within its length + slop words around pos.

    index must reach as far as the windows are long, plus slop.
    """
    met = index.join(broadcast_if_small(led, broadcast_rows), "term")
    wanted = F.array_distinct(F.transform("words", term_of))
    span = F.size("words") + slop
    here = F.col("pos") - F.col("from")
    near = F.transform("near", term_of)
    first = F.greatest(F.lit(0), here - span + 1)
    within = F.exists(F.sequence(first, here), lambda i: F.size(F.array_except(wanted, F.slice(near, i + 1, span))) == 0)
    return met.where(within).select("id", "tag", "pos", "items").distinct()


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The columns keep (the id alone by default), n_words, n_hit, item_ids, contaminated of every row."""
    keep = [id_col] if keep is None else keep
    windows = cut(test_windows(items, window))
    terms = cut(windows.select(F.explode("words").alias("word")).select(term_of(F.col("word")).alias("term")).distinct())
    led = cut(led_windows(windows, term_frequencies(docs, terms, id_col, text_col, broadcast_rows)))
    index = cut(postings(docs, cut(led.select("term").distinct()), window, id_col, text_col, broadcast_rows))
    found = phrase_matches(index, led, broadcast_rows)
    spans = found.groupBy("id", "tag").agg(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"),
    )
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(
        "spans",
        none,
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["end"], x["start"]))).alias("n"), F.greatest(a["end"], x["end"]).alias("end")),
    )["n"]
    hits = spans.select(F.col("id").alias("__id"), F.col("tag").alias("__tag"), covered.cast("long").alias("n_hit"), "item_ids").hint("shuffle_hash")
    rows = docs.select(F.struct(*keep).alias("kept"), F.col(id_col).alias("id"), F.hash(text_col).alias("tag"), word_count(text_col).alias("n_words"))
    joined = rows.join(hits, rows["id"].eqNullSafe(hits["__id"]) & (rows["tag"] == hits["__tag"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return joined.select("kept.*", "n_words", n_hit.alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), (n_hit > 0).alias("contaminated"))
