"""Substring dedup by compacting repeated token k-mers.

A window is k consecutive words of one document; as in a de Bruijn graph each
window is an edge between its two (k-1)-word ends.  Every word covered by a
window whose word sequence also starts anywhere else is removed, in all of its
occurrences; windows are judged on the input.

Windows never travel one by one.  Each has an anchor: its smallest-hashing
short word sequence (leftmost of equals).  Equal windows have the same anchor
at the same offset, so windows that share an anchor occurrence form one path
of consecutive edges, which travels as one row: anchor, hash of the whole
path, source coordinates.  Spark deals the rows by anchor and sorts them:

- an anchor that occurs once ends there: all its windows are unique;
- paths with equal hashes are nonbranching repeats: all their windows repeat;
- where different paths share an anchor they branch.  One row of each goes
  back to its source document, and only those windows are hashed and compared
  by themselves.

Before each exchange a task keeps one row of equal ones it has seen and settles
the others at once, so a passage that a third of all documents share costs a
row a task.  Sequences are compared by two 64-bit hashes.

Defined results: a null text or one without words has no words and nothing
removed, and the hash of the empty string; texts shorter than a window lose
nothing; repeated rows are occurrences of each other, so that their windows
all repeat; null ids are kept; an empty table gives none; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specblock.llm.common import shuffle_partitions
from specblock.session import cut

WINDOW = 35
#: Words of the short sequences that anchors are chosen from.
ANCHOR_WORDS = 8
#: Rows a task holds to settle equal ones before the exchange.
HELD_ROWS = 1 << 17
#: Words of one text whose windows are handled at once, bounding memory.
PIECE_WORDS = 1 << 18
MEMO_WORDS = 100_000

#: Fixed odd multipliers of the two rolling hashes, and of the final mixing.
BASE_1, BASE_2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

#: What a row of the comparison says of its path: all its windows repeat; it goes back to its source.
REPEATED, BRANCH = 0, 1


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any run of words, from prefix sums of word hash times base^-i."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.empty(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            self.up = np.cumprod(np.append(np.uint64(1), np.full(n - 1, self.base, np.uint64)), dtype=np.uint64)
            self.down = np.cumprod(np.append(np.uint64(1), np.full(n - 1, self.inverse, np.uint64)), dtype=np.uint64)

    def prefix(self, hashes: np.ndarray) -> np.ndarray:
        self._powers(len(hashes) + 1)
        return np.append(np.uint64(0), np.cumsum(hashes * self.down[: len(hashes)], dtype=np.uint64))

    def runs(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.up[start] + (end - start).astype(np.uint64))


class Hasher:
    """Word hashes with a bounded memo, and the two rolling hashes."""

    def __init__(self):
        self.memo: dict[bytes, int] = {}
        self.one, self.two = Rolling(BASE_1), Rolling(BASE_2)

    def words(self, words: list[bytes]) -> np.ndarray:
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        try:
            return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for w in set(words).difference(memo):
                memo[w] = xxhash.xxh3_64_intdigest(w)
            return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def split_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def paths(hashes: np.ndarray, hasher: Hasher, k: int, s: int) -> tuple[np.ndarray, ...]:
    """anchor, path hashes 1 and 2, first window and number of windows of each path of a text."""
    one = hasher.one.prefix(hashes)
    two = hasher.two.prefix(mix(hashes))
    n = len(hashes) - s + 1
    at = np.arange(n)
    short = hasher.one.runs(one, at, at + s)
    # The leftmost smallest of the k - s + 1 short sequences of each window, by doubling.
    bits = np.uint64(max(1, int(n).bit_length()))
    key = (short >> bits << bits) | at.astype(np.uint64)
    reach, width = key, 1
    span = k - s + 1
    while 2 * width <= span:
        reach = np.minimum(reach[:-width], reach[width:])
        width *= 2
    if width < span:
        reach = np.minimum(reach[: len(reach) - (span - width)], reach[span - width :])
    chosen = (reach & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1]))
    count = np.diff(np.append(first, len(chosen)))
    end = first + count + k - 1
    # The anchor's place in the path is part of what must be equal.
    place = (chosen[first] - first).astype(np.uint64)
    h1 = mix(hasher.one.runs(one, first, end) + place)
    return short[chosen[first]], h1, hasher.two.runs(two, first, end), first, count


def text_paths(words: list[bytes], hasher: Hasher, k: int, s: int):
    """paths() of a text of any length, piece by piece."""
    if len(words) < k:
        return
    for at in range(0, len(words) - k + 1, PIECE_WORDS):
        piece = hasher.words(words[at : at + PIECE_WORDS + k - 1])
        anchor, h1, h2, first, count = paths(piece, hasher, k, s)
        yield anchor, h1, h2, first + at, count


def _settle(key, h1, h2, doc, first, n) -> tuple[np.ndarray, ...]:
    """Settles rows of one task that are equal: all but one are repeats, and the one says so.

    Returns the rows with a column that packs first window, number of windows,
    whether the row is settled, and whether it is known to repeat.  What is
    settled gets an even key drawn from its place, what waits an odd one.
    """
    key = key | np.uint64(1)
    by = np.lexsort((h2, h1, key))
    key, h1, h2, doc, first, n = (c[by] for c in (key, h1, h2, doc, first, n))
    same = np.append(False, (key[1:] == key[:-1]) & (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1]))
    known = same | np.append(same[1:], False)
    place = mix(doc.astype(np.uint64) * np.uint64(BASE_1) + first.astype(np.uint64)) & ~np.uint64(1)
    packed = (first << 16) | (n << 2) | (same.astype(np.int64) << 1) | known
    return np.where(same, place, key), h1, h2, doc, packed


def _emit(rows: DataFrame, of_text) -> DataFrame:
    """(key, h1, h2, id, tag, packed) of the paths or windows that of_text finds.

    rows has id, tag, text and, perhaps, an argument for of_text.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        held: list[tuple[np.ndarray, ...]] = []
        ids: list[pa.Array] = []
        tags: list[pa.Array] = []

        def flush():
            if held:
                key, h1, h2, doc, packed = _settle(*map(np.concatenate, zip(*held, strict=True)))
                all_ids, all_tags = pa.concat_arrays(ids), pa.concat_arrays(tags)
                for at in range(0, len(key), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    where = pa.array(doc[part])
                    columns = [pa.array(key[part].view(np.int64)), pa.array(h1[part].view(np.int64)), pa.array((h2[part] >> np.uint64(33)).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([*columns, all_ids.take(where), all_tags.take(where), pa.array(packed[part])], ["key", "h1", "h2", "id", "tag", "packed"])
            for x in (held, ids, tags):
                x.clear()

        docs = size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids.append(part.column(0))
                tags.append(part.column(1))
                texts = part.column(2).to_pylist()
                args = part.column(3).to_pylist() if part.num_columns > 3 else texts
                for i, text in enumerate(texts):
                    for key, h1, h2, first, n in of_text(text, args[i], hasher):
                        held.append((key, h1, h2, np.full(len(key), docs + i), first, n))
                        size += len(key)
                docs += part.num_rows
                if size > HELD_ROWS:
                    yield from flush()
                    docs = size = 0
        yield from flush()

    return rows.mapInArrow(work, f"key long, h1 long, h2 int, id {rows.schema['id'].dataType.simpleString()}, tag int, packed long")


def _compare(rows: DataFrame) -> DataFrame:
    """(id, tag, packed, kind) of rows that repeat, and of one row of each path that branches."""
    placed = rows.repartition(shuffle_partitions(rows), "key").sortWithinPartitions("key", "h1", "h2")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, which waits for the one after it
        before = None  # key, h1, h2 of the row before the held one
        pending = None  # the first row of the key that goes on, if it has one path so far

        def said(table, mask, kind):
            part = table.filter(pa.array(mask))
            return pa.RecordBatch.from_arrays([part.column(3), part.column(4), part.column(5), pa.array(np.full(part.num_rows, kind, np.int8))], ["id", "tag", "packed", "kind"])

        def settle(table, last):
            nonlocal held, before, pending
            key, h1, h2, packed = (table.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 5))
            open_ = key & 1 == 1
            if before is None:
                k, a, b = np.append(False, key[1:] == key[:-1]), np.append(False, h1[1:] == h1[:-1]), np.append(False, h2[1:] == h2[:-1])
            else:
                k, a, b = (np.append(c[0] == old, c[1:] == c[:-1]) for c, old in zip((key, h1, h2), before, strict=True))
            same_key = k & open_
            same = same_key & a & b
            repeated = (packed & 1 == 1) | same | np.append(same[1:], False)
            branch = open_ & same_key & ~same
            group = np.cumsum(~same_key)
            several = np.zeros(group[-1] + 1, bool)
            several[group[branch]] = True
            if pending is not None and same_key[0] and several[0]:
                yield said(pending, np.ones(1, bool), BRANCH)
                pending = None
            lead = open_ & ~same_key
            branch |= lead & several[group]
            done = len(key) if last else len(key) - 1
            if group[done - 1] if done else False:
                pending = None
            at = np.flatnonzero(lead[:done])
            if len(at) and not several[group[at[-1]]] and group[at[-1]] == group[-1]:
                pending = table.slice(int(at[-1]), 1)
            if done:
                before = (key[done - 1], h1[done - 1], h2[done - 1])
            held = None if last else table.slice(done)
            table = table.slice(0, done)
            yield said(table, repeated[:done], REPEATED)
            yield said(table, branch[:done], BRANCH)

        for batch in batches:
            if batch.num_rows:
                table = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
                yield from settle(table, False)
        if held is not None:
            yield from settle(held, True)

    return placed.mapInArrow(work, f"id {rows.schema['id'].dataType.simpleString()}, tag int, packed long, kind byte")


def _all_paths(k: int, s: int):
    return lambda text, _, hasher: text_paths(split_words(text), hasher, k, s)


def _windows(k: int):
    """The single windows of the paths that are named by their packed columns."""

    def of_text(text, packed, hasher):
        words = split_words(text)
        packed = np.unique(np.array(packed, np.int64))
        first, n = packed >> 16, (packed >> 2) & 0x3FFF
        start = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        for at in range(0, len(words) - k + 1, PIECE_WORDS):
            here = start[(start >= at) & (start < at + PIECE_WORDS)] - at
            if len(here):
                hashes = hasher.words(words[at : at + PIECE_WORDS + k - 1])
                one = hasher.one.runs(hasher.one.prefix(hashes), here, here + k)
                two = hasher.two.runs(hasher.two.prefix(mix(hashes)), here, here + k)
                yield one, one, two, here + at, np.ones(len(here), np.int64)

    return of_text


def repeated_spans(docs: DataFrame, k: int = WINDOW, s: int = ANCHOR_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tag, spans) of texts with repeated windows.

    tag is hash(text); spans packs, for each, first window << 16 | number << 2.
    """
    if not 1 <= s <= k or k - s >= 1 << 12:
        raise ValueError("1 <= s <= k is needed, and windows of moderate length")
    rows = docs.select(F.col(id_col).alias("id"), F.hash(text_col).alias("tag"), F.col(text_col).alias("text")).where("text is not null")
    found = cut(_compare(_emit(rows, _all_paths(k, s))))
    branching = found.where(F.col("kind") == BRANCH).groupBy("id", "tag").agg(F.collect_set("packed").alias("packed"))
    back = _with(rows, branching, "inner").select("id", "tag", "text", "packed")
    single = _compare(_emit(back, _windows(k))).where(F.col("kind") == REPEATED)
    spans = found.where(F.col("kind") == REPEATED).union(single).select("id", "tag", (F.shiftright("packed", 2) * 4).alias("packed"))
    return spans.groupBy("id", "tag").agg(F.collect_set("packed").alias("spans"))


def _with(rows: DataFrame, more: DataFrame, how: str) -> DataFrame:
    """rows joined with what is known of their id (null-safe) and tag."""
    more = more.withColumnsRenamed({"id": "__id", "tag": "__tag"}).hint("shuffle_hash")
    return rows.join(more, rows["id"].eqNullSafe(more["__id"]) & rows["tag"].eqNullSafe(more["__tag"]), how).drop("__id", "__tag")


def kept_mask(n_words: int, spans: list[int] | None, k: int) -> np.ndarray:
    keep = np.ones(n_words, bool)
    for packed in spans or ():
        first, n = packed >> 16, (packed >> 2) & 0x3FFF
        keep[first : first + n + k - 1] = False
    return keep


def dedup_substrings(docs: DataFrame, k: int = WINDOW, s: int = ANCHOR_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, n_removed, kept_text of every row: the text without its repeated spans."""
    spans = repeated_spans(docs, k, s, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.hash(text_col).alias("tag"), F.col(text_col).alias("text"))
    marked = _with(rows, spans, "left").select("id", "text", "spans")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n_words, n_removed, kept = [], [], []
                for text, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    words = split_words(text)
                    if found:
                        keep = kept_mask(len(words), found, k)
                        left = [w for w, yes in zip(words, keep.tolist(), strict=True) if yes]
                    else:
                        left = words
                    n_words.append(len(words))
                    n_removed.append(len(words) - len(left))
                    kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept_text"]
                )

    kind = rows.schema["id"].dataType.simpleString()
    return marked.mapInArrow(work, f"id {kind}, n_words long, n_removed long, kept_text string").withColumnRenamed("id", id_col)
