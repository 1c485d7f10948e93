"""Near-duplicates: SimHash candidates, verified by the similarity of word shingles.

Two texts are linked if the sets of their five-word shingles have a Jaccard
similarity of `similarity` or more; groups are those of chained links.  Every
link is verified on the texts.  Which pairs are verified is told by SimHash:
fingerprints of two-word shingles, which an edited word changes less than those
of five, dealt out by the covering tables of simhash.py.  Pairs within RADIUS
bits share a table for certain, those a little further apart mostly; what is
within NEAR bits in both lanes is a candidate.

The buckets of the tables are read in two rounds.  In the first each member
meets a few leaders, so a large group of near copies is joined without all
pairs.  In the second the pairs that the
links so far leave in different groups meet, so a group is never split because
a leader resembled its members too little.

Texts are made distinct first.  Words and shingles are told apart by 64-bit
hashes; numbers of shingles that rule out the similarity rule out a pair.

Defined results: a null text or one without words equals the others without
words; fewer words than a shingle make one shingle of them all; rows with a
null id take part in links, and stay only if none of their group has an id; an
empty table gives none; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specblock.llm import simhash
from specblock.llm.common import shuffle_partitions
from specblock.llm.word_arrays import WordHasher, mixed
from specblock.operators.graph import connected_components
from specblock.session import cut

SHINGLE = 5
SIMILARITY = 0.8
#: Words of a shingle of the fingerprint that is dealt out, bits that its tables cover in how many parts, bits that candidates may differ in.
FINGERPRINT_SHINGLE = 2
RADIUS, PARTS = 9, 2
NEAR = 13
#: Seeds of the fingerprints of whole shingles, and bits that candidates may differ in.
SEEDS = (42, 43)
NEAR_LONG = 27
LANES = simhash.lane_names(1 + len(SEEDS))
#: Leaders that a member of a bucket meets.
DRAWS = 2
#: Texts handled at once, and the members of a bucket whose pairs are all looked at.
TEXTS = 256
FEW = 64
#: Nodes of a bucket that go to a block together, and their shingles; columns of a block that are counted at once.
BLOCK_TEXTS, BLOCK_SHINGLES = 256, 1 << 18
COLUMNS = 1 << 13
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: list[str | None], hasher: WordHasher, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts, repeats included, and the number of each text (1 at least)."""
    words, sizes = hasher.tokens(texts)
    words, sizes = words.view(np.uint64), np.asarray(sizes, np.int64)
    counts = np.maximum(sizes - shingle + 1, 1)
    row = np.repeat(np.arange(len(sizes)), counts)
    at = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + (np.cumsum(sizes) - sizes)[row]
    end, padded = np.cumsum(sizes)[row], np.append(words, np.zeros(shingle, np.uint64))
    out = np.zeros(len(row), np.uint64)
    for k in range(shingle):
        inside = at + k < end
        out = np.where(inside, mixed(out * _FACTOR + padded[np.minimum(at + k, len(words))] + np.uint64(1)), out)
    return out, counts


def distinct(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) without repeats, sorted."""
    row = np.repeat(np.arange(len(counts)), counts)
    by = np.lexsort((grams, row))
    row, grams = row[by], grams[by]
    new = np.append(True, (row[1:] != row[:-1]) | (grams[1:] != grams[:-1]))[: len(row)]
    return row[new], grams[new]


def similarities(a: list[str | None], b: list[str | None], hasher: WordHasher, shingle: int) -> np.ndarray:
    """Jaccard similarity of each text of a with that of b."""
    (ra, ga), (rb, gb) = (distinct(*shingles(texts, hasher, shingle)) for texts in (a, b))
    row, gram = np.concatenate((ra, rb)), np.concatenate((ga, gb))
    by = np.lexsort((gram, row))
    row, gram = row[by], gram[by]
    both = np.bincount(row[1:][(row[1:] == row[:-1]) & (gram[1:] == gram[:-1])], minlength=len(a))
    return both / (np.bincount(row, minlength=len(a)) - both)


def signatures(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(id, txt, node, n, LANES) of every row: hash of the text, of its words, number of shingles, fingerprints."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                part = batch.slice(start, TEXTS)
                texts = part.column(2).to_pylist()
                grams, counts = shingles(texts, hasher, shingle)
                starts = np.cumsum(counts) - counts
                place = (np.arange(len(grams)) - np.repeat(starts, counts)).astype(np.uint64)
                node = np.add.reduceat(mixed(grams + place * _FACTOR), starts)
                n = np.bincount(distinct(grams, counts)[0], minlength=len(counts))
                fps = np.array([simhash.fingerprint(t, FINGERPRINT_SHINGLE) + simhash.fingerprint(t, shingle, SEEDS) for t in texts], np.uint64).view(np.int64)
                columns = [pa.array(node.view(np.int64)), pa.array(n.astype(np.int64)), *(pa.array(fps[:, k]) for k in range(len(LANES)))]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *columns], ["id", "txt", "node", "n", *LANES])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("txt"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, f"id {rows.schema['id'].dataType.simpleString()}, txt long, node long, n long, {', '.join(f'{lane} long' for lane in LANES)}")


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar."""
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    needed = nodes.select("node", "txt").join(needed, "node")
    held = cut(texts.join(needed, "txt").dropDuplicates(["node"]).select("node", "text"))
    ta, tb = (held.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                part = batch.slice(start, TEXTS)
                a, b = (part.column(i).to_pylist() for i in (2, 3))
                ok = pa.array(similarities(a, b, hasher, shingle) >= similarity)
                yield part.select(["a", "b"]).filter(ok)

    joined = pairs.join(ta, "a").join(tb, "b").select("a", "b", "text_a", "text_b")
    return cut(joined.mapInArrow(work, "a long, b long"))


def _fits(i: np.ndarray, j: np.ndarray, lanes: list[np.ndarray], sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of rows are candidates."""
    ok = np.minimum(sizes[i], sizes[j]) >= similarity * np.maximum(sizes[i], sizes[j])
    ok[ok] = np.bitwise_count(lanes[0][i[ok]] ^ lanes[0][j[ok]]) <= NEAR
    ok[ok] = sum(np.bitwise_count(lane[i[ok]] ^ lane[j[ok]]) for lane in lanes[1:]) <= NEAR_LONG
    return ok


def _ordered(node: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of nodes, the smaller first."""
    pairs = np.unique(np.stack((np.minimum(node[i], node[j]), np.maximum(node[i], node[j])), axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _off_centre(starts: np.ndarray, many: np.ndarray, lanes: list[np.ndarray]) -> np.ndarray:
    """How many bits each row differs in from the majority of its bucket."""
    off = np.zeros(int(many.sum()), np.int64)
    for lane in lanes:
        bits = np.unpackbits(lane.view(np.uint8).reshape(-1, 8), axis=1)
        centre = np.packbits(2 * np.add.reduceat(bits, starts, axis=0, dtype=np.int32) > many[:, None], axis=1).view(np.uint64)[:, 0]
        off += np.bitwise_count(lane ^ np.repeat(centre, many))
    return off


def leaders_of(similarity: float):
    """For simhash.radius_links: candidates of each member of a bucket and its leaders.

    One leader is the member nearest to the majority of the bucket's bits: of
    a text and its near copies the text itself, more often than not.  The
    others are drawn by hash, alike in all buckets, so the members of a large
    group meet the same few again, not new ones in each table.
    """

    def find(group: np.ndarray, node: np.ndarray, columns: list[np.ndarray], radius: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        several = np.append(True, group[1:] != group[:-1])
        several = ~(several & np.append(several[1:], True))
        group, node, columns = group[several], node[several], [c[several] for c in columns]
        if not len(group):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        lanes, sizes = [np.ascontiguousarray(c).view(np.uint64) for c in columns[:-1]], columns[-1]
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        many = np.diff(np.append(starts, len(group)))
        found = []
        for draw in range(DRAWS):
            order = mixed(node.view(np.uint64) + np.uint64(draw))
            by = np.lexsort((order, _off_centre(starts, many, lanes), group)) if not draw else np.lexsort((order, group))
            leader = np.repeat(by[starts], many)
            other = np.flatnonzero(node[leader] != node)
            ok = other[_fits(other, leader[other], lanes, sizes, similarity)]
            found.append((ok, leader[ok]))
        return _ordered(node, *map(np.concatenate, zip(*found, strict=True)))

    return find


def _elsewhere(table: np.ndarray, differing: np.ndarray, masks: simhash.Masks) -> np.ndarray:
    """Which pairs, given by their table and differing bits, share a table before it that covers them for certain."""
    out = np.zeros(len(table), bool)
    close = np.bitwise_count(differing) <= masks.radius
    for own in np.unique(table[close]).tolist():
        at = np.flatnonzero(close & (table == own))
        for mask in masks.children((own - 1) // masks.per)[: (own - 1) % masks.per]:
            out[at] |= differing[at] & np.uint64(mask) == 0
    return out


def _blocks(node: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block, node) that bring the pairs (i, j) of one bucket together; a block is named by its nodes."""
    rows = np.unique(np.concatenate((i, j)))
    rows = rows[np.argsort(node[rows])]
    chunk = np.zeros(len(node), np.int64)
    chunk[rows] = np.maximum(np.arange(len(rows)) // BLOCK_TEXTS, (np.cumsum(sizes[rows]) - 1) // BLOCK_SHINGLES)
    chunk[rows] = np.unique(chunk[rows], return_inverse=True)[1]
    low, high = np.minimum(chunk[i], chunk[j]), np.maximum(chunk[i], chunk[j])
    both = low * (int(high.max()) + 1) + high
    members = np.unique(np.concatenate((np.stack((both, i), axis=1), np.stack((both, j), axis=1))), axis=0)
    return _named(members[:, 0], node[members[:, 1]])


def _named(block: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block, node) with blocks, which are sorted, named by a hash of their nodes."""
    starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    names = np.add.reduceat(mixed(node.view(np.uint64) + np.uint64(1)), starts).view(np.int64)
    return np.repeat(names, np.diff(np.append(starts, len(block)))), node


def apart_in(similarity: float, masks: simhash.Masks):
    """For simhash.radius_links: (block, node) of all candidates of a bucket between nodes of different groups, told by the last lane."""

    def find(group: np.ndarray, node: np.ndarray, columns: list[np.ndarray], radius: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        label, sizes, lanes = columns[-1], columns[-2], [c.view(np.uint64) for c in columns[:-2]]
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        ends = np.append(starts[1:], len(group))
        mixed_up = (np.minimum.reduceat(label, starts) != np.maximum.reduceat(label, starts)) & (ends - starts > 1)
        found = []

        def fitting(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            ok = _fits(i, j, lanes, sizes, similarity)
            i, j = i[ok], j[ok]
            new = ~_elsewhere(table[i], lanes[0][i] ^ lanes[0][j], masks)
            return i[new], j[new]

        few = mixed_up & (ends - starts <= FEW) & (np.add.reduceat(sizes, starts) <= BLOCK_SHINGLES)
        # Few members: all pairs, by how far apart they stand; they make one block.
        left = np.zeros(len(group), np.int64)
        for start, end in zip(starts[few], ends[few], strict=True):
            left[start:end] = np.arange(end - start, 0, -1)
        at, step, rows = np.flatnonzero(left > 1), 1, []
        while len(at):
            near = at[label[at] != label[at + step]]
            rows += fitting(near, near + step)
            step += 1
            at = at[left[at] > step]
        if rows and len(rows := np.unique(np.concatenate(rows))):
            found.append(_named(group[rows], node[rows]))
        # Many: those outside the largest group against all.
        for start, end in zip(starts[mixed_up & ~few], ends[mixed_up & ~few], strict=True):
            labels, back, n = np.unique(label[start:end], return_inverse=True, return_counts=True)
            members = np.arange(start, end)
            pairs = []
            for i in members[back != n.argmax()]:
                j = members[label[start:end] != label[i]]
                i, j = fitting(np.full(len(j), i), j)
                pairs.append((i - start, j - start))
            i, j = map(np.concatenate, zip(*pairs, strict=True))
            if len(i):
                found.append(_blocks(node[start:end], sizes[start:end], i, j))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(map(np.concatenate, zip(*found, strict=True)))

    return find


def block_links(texts: list[str | None], node: np.ndarray, label: np.ndarray, hasher: WordHasher, shingle: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A star forest of the links between nodes of different labels in one block of texts."""
    m = len(texts)
    parts = [distinct(*shingles(texts[k : k + TEXTS], hasher, shingle)) for k in range(0, m, TEXTS)]
    row = np.concatenate([r + k * TEXTS for k, (r, _) in enumerate(parts)])
    gram = np.concatenate([g for _, g in parts])
    n = np.bincount(row, minlength=m).astype(np.float64)
    by = np.argsort(gram, kind="stable")
    row, gram = row[by], gram[by]
    # Only shingles of several texts count, a slab of them at a time.
    again = gram[1:] == gram[:-1]
    shared = np.append(again, False) | np.append(False, again)
    row, gram = row[shared], gram[shared]
    column = np.cumsum(np.append(True, gram[1:] != gram[:-1])[: len(gram)]) - 1
    both = np.zeros((m, m))
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, (first, first + COLUMNS))
        slab = np.zeros((m, int(column[hi - 1]) - first + 1), np.float32)
        slab[row[lo:hi], column[lo:hi] - first] = 1
        both += slab @ slab.T
    i, j = np.nonzero(np.triu(both / (n[:, None] + n[None] - both) >= similarity, 1) & (label[:, None] != label[None]))
    return simhash.forest(node[i], node[j]) if len(i) else (node[:0], node[:0])


def _verified_blocks(blocks: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) within blocks (block, node) of nodes (node, txt, label): their components are those of all similar pairs."""
    needed = nodes.select("node", "txt", "label").join(blocks.select("node").distinct(), "node")
    held = cut(texts.join(needed, "txt").dropDuplicates(["node"]).select("node", "label", "text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, waiting = WordHasher(), None
        for batch in batches:
            now = pa.table([*batch.columns], ["block", "node", "label", "text"])
            waiting = now if waiting is None else pa.concat_tables([waiting, now])
            block = waiting.column(0).to_numpy()
            edges = np.flatnonzero(block[1:] != block[:-1]) + 1
            yield from linked(waiting, np.append(0, edges), hasher)
            waiting = waiting.slice(edges[-1]) if len(edges) else waiting
        if waiting is not None and waiting.num_rows:
            yield from linked(waiting, np.array([0, waiting.num_rows]), hasher)

    def linked(rows: pa.Table, edges: np.ndarray, hasher: WordHasher) -> Iterator[pa.RecordBatch]:
        for start, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            node, label = (rows.column(k).slice(start, end - start).to_numpy() for k in (1, 2))
            a, b = block_links(rows.column(3).slice(start, end - start).to_pylist(), node, label, hasher, shingle, similarity)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    met = blocks.join(held, "node").select("block", "node", "label", "text")
    placed = met.repartition(shuffle_partitions(met), "block").sortWithinPartitions("block")
    return cut(placed.mapInArrow(work, "a long, b long"))


def links(nodes: DataFrame, texts: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b) between nodes (node, txt, n, LANES): verified links whose components are those of all candidates."""
    first = cut(simhash.radius_links(nodes.select("node", *LANES, "n"), RADIUS, PARTS, find=leaders_of(similarity)).distinct())
    found = _verified(first, nodes, texts, shingle, similarity)
    group = connected_components(found)
    placed = nodes.select("node", "txt", *LANES, "n").join(group, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    find = apart_in(similarity, simhash.Masks(RADIUS, PARTS))
    blocks = simhash.radius_links(placed.select("node", *LANES, "n", "label"), RADIUS, PARTS, find=find)
    blocks = cut(blocks.select(F.col("a").alias("block"), F.col("b").alias("node")).distinct())
    return found.union(_verified_blocks(blocks, placed, texts, shingle, similarity))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near-duplicates: of each group the row with the smallest id stays."""
    marked = cut(signatures(docs, shingle, id_col, text_col))
    nodes = cut(marked.groupBy("node").agg(F.min("txt").alias("txt"), *(F.first(c).alias(c) for c in ("n", *LANES))))
    texts = docs.select(F.xxhash64(text_col).alias("txt"), F.col(text_col).alias("text"))
    joined = connected_components(links(nodes, texts, shingle, similarity))
    named = marked.select("id", "txt", "node").join(joined, "node", "left").withColumn("label", F.coalesce("component", "node"))
    first = F.min(F.struct(F.col("id").isNull(), F.col("id").alias("id"), F.col("txt").alias("txt"))).alias("first")
    kept = named.groupBy("label").agg(first).select(F.col("first.id").alias("__id"), F.col("first.txt").alias("__txt")).hint("shuffle_hash")
    left = docs.join(kept, docs[id_col].eqNullSafe(kept["__id"]) & (F.xxhash64(docs[text_col]) == kept["__txt"]), "left_semi")
    # Rows that share id and text are one another's copies as well.
    repeated = marked.groupBy("id", "txt").count().where("count > 1")
    return left if repeated.isEmpty() else left.withColumn("__txt", F.xxhash64(text_col)).dropDuplicates([id_col, "__txt"]).drop("__txt")
