"""Language identification by rank-order n-gram profiles.

A profile is the ranked list of a language's most frequent character n-grams
(words padded with a blank).  A document's own ranked list is compared with
each profile by the out-of-place measure: the sum, over the document's
n-grams, of how far each one's rank lies from its rank in the profile, a
missing one counting as the profile's length.  The nearest profile wins; ties
go to the smaller language by code point.

Profiles are fitted on a documented, bounded sample of labelled rows
(`sample_per_lang` distinct texts of each language on average, chosen by a
hash of the text, the whole language where it has fewer).  Prediction reads
every whole text and nothing but the text.

Defined results: `und` with score 0 for a null text or one without letters,
and where no language could be learned; repeated rows get equal results; null
ids are kept; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNDETERMINED = "und"
SAMPLE_PER_LANG = 2000
PROFILE_SIZE = 300
MAX_N = 3
#: Bits of a code point in an n-gram code.
BITS = 21
#: N-grams of a long text are counted in pieces of so many characters.
PIECE = 1 << 20


def letters() -> np.ndarray:
    """For each code point: 0 if no letter, else its lower case."""
    table = np.zeros(0x110000, np.int64)
    for cp in range(0x110000):
        ch = chr(cp)
        if ch.isalpha():
            low = ch.lower()
            table[cp] = ord(low) if len(low) == 1 else cp
    return table


def ngram_counts(text: str, table: np.ndarray, max_n: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of whole text (n up to max_n, 3 at most) and their counts."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    parts = []
    # Each piece but the first repeats max_n - 1 characters, which its shorter n-grams leave out.
    for at in range(0, max(1, len(raw)), PIECE):
        low = max(0, at - (max_n - 1))
        low_table = table[raw[low : at + PIECE]]
        edge_left, edge_right = at == 0, at + PIECE >= len(raw)
        codes = np.concatenate(([0] * edge_left, low_table, [0] * edge_right)).astype(np.int64)
        codes[codes == 0] = 32
        skip = at - low
        for n in range(1, max_n + 1):
            size = len(codes) - n + 1
            if size <= 0:
                continue
            gram = codes[:size].copy()
            blank = codes[:size] == 32
            inner = np.zeros(size, bool)
            for k in range(1, n):
                part = codes[k : k + size]
                gram |= part << (BITS * k)
                if k < n - 1:
                    inner |= part == 32
                else:
                    last_blank = part == 32
            if n == 1:
                ok = ~blank
            else:
                # Blanks pad a word: at the ends only, and never on their own.
                ok = ~inner & ~(blank & last_blank)
            first = max(0, skip - n + 1)
            parts.append(gram[first:][ok[first:]])
    return np.unique(np.concatenate(parts), return_counts=True)


def top_ngrams(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The size most frequent codes, most frequent first, ties by code."""
    if len(codes) > 4 * size:
        keep = counts >= np.partition(counts, len(counts) - size)[len(counts) - size]
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))[:size]]


class Profiles:
    """Ranked n-grams of each language, laid out for searching."""

    def __init__(self, langs: list[str], ranked: list[np.ndarray], size: int):
        by = sorted(range(len(langs)), key=lambda i: langs[i])
        self.langs = [langs[i] for i in by]
        self.size = size
        self.codes = np.unique(np.concatenate([ranked[i] for i in by])) if by else np.empty(0, np.int64)
        self.rank = np.full((len(self.codes), len(by)), -1, np.int64)
        for column, i in enumerate(by):
            self.rank[np.searchsorted(self.codes, ranked[i]), column] = np.arange(len(ranked[i]))

    def nearest(self, grams: np.ndarray) -> tuple[str, float]:
        """The nearest language and 1 - distance / the largest distance possible."""
        if not len(grams) or not self.langs:
            return UNDETERMINED, 0.0
        at = np.minimum(np.searchsorted(self.codes, grams), len(self.codes) - 1)
        found = self.codes[at] == grams
        rank = self.rank[at[found]]
        place = np.flatnonzero(found)[:, None]
        away = np.where(rank >= 0, np.minimum(np.abs(rank - place), self.size), self.size)
        distance = away.sum(axis=0) + self.size * (len(grams) - len(rank))
        best = int(np.argmin(distance))
        return self.langs[best], float(1 - distance[best] / (self.size * len(grams)))


def fit_profiles(
    labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_per_lang: int = SAMPLE_PER_LANG, size: int = PROFILE_SIZE, max_n: int = MAX_N
) -> Profiles:
    """Profiles from rows whose text and language are not null."""
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    rows = rows.withColumn("h", F.xxhash64("text"))
    # One number a language reaches the driver and goes back as a literal: no join, which a hot language would skew.
    totals = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()
    # Keep the share of the hash range that leaves sample_per_lang distinct texts of each language.
    share = F.coalesce(*(F.when(F.col("lang") == r["lang"], sample_per_lang / max(1, r["n"])) for r in totals), F.lit(1.0))
    chosen = (
        rows.where((share >= 1) | (F.pmod(F.xxhash64("h"), F.lit(1 << 40)) < share * float(1 << 40)))
        .groupBy("lang", "h")
        .agg(F.first("text").alias("text"))
        .select("lang", "text")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = letters()
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            texts = batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                pairs = [ngram_counts(texts[i], table, max_n) for i in np.flatnonzero(langs == lang)]
                codes, back = np.unique(np.concatenate([c for c, _ in pairs]), return_inverse=True)
                sums = np.bincount(back, np.concatenate([n for _, n in pairs]), len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(sums)], ["lang", "gram", "n"])

    grams = chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # size n-grams of each language: what reaches the driver is bounded by the number of languages.
    found = {r["lang"]: np.array(r["grams"], np.int64) for r in _top_by_rank(grams, size).collect()}
    return Profiles(list(found), list(found.values()), size)


def _top_by_rank(grams: DataFrame, size: int) -> DataFrame:
    """The best-ranked n-grams: first within hash parts of a language, then over the parts."""
    order = (F.desc("n"), F.asc("gram"))
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(64))).orderBy(*order)
    whole = Window.partitionBy("lang").orderBy(*order)
    best = grams.withColumn("r", F.row_number().over(part)).where(F.col("r") <= size)
    best = best.withColumn("r", F.row_number().over(whole)).where(F.col("r") <= size)
    return best.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "gram"))), lambda x: x["gram"]).alias("grams"))


def detect(docs: DataFrame, profiles: Profiles, keep: list[str | Column], text_col: str = "text", max_n: int = MAX_N) -> DataFrame:
    """The columns keep of every row, with lang_pred and score."""
    rows = docs.select(*keep, F.col(text_col).alias("__text"))
    names = rows.columns[:-1]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = letters()
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                grams = top_ngrams(*ngram_counts(text, table, max_n), profiles.size) if text else ()
                lang, score = profiles.nearest(grams)
                langs.append(lang)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

    schema = rows.drop("__text").schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(predict, schema)
