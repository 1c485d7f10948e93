"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits; bit i is set if it is set in over half of the
hashes (XXH64 of the UTF-8 bytes, seed 42) of the text's word shingles.  For
radius r each bit position i carries a nonzero vector m(i) of r + 1 bits, and
each nonzero vector v of r + 1 bits makes a table whose mask keeps the
positions with <m(i), v> odd.  The positions in which two fingerprints within
the radius differ have at most r vectors, so some v is orthogonal to all of
them: its mask keeps none of these positions and the pair shares a bucket.
Every link is found, none by chance.

Fingerprints are made distinct first, so exact copies and empty texts cost one
row.  Buckets stream through sorted partitions, where a spanning forest of the
verified links goes on, never all pairs.  A bucket of over `bucket_rows`
fingerprints is not held: its members stream on to a further level, which
splits it by the same construction over the positions its mask left free.
That keeps the guarantee, and after three levels a bucket has at most a few
hundred possible values of these positions.

A wider radius is covered by parts: of t parts of the positions one holds at
most radius // t of the differing ones, so a covering of each part by that
smaller radius covers all.  With further lanes (more fingerprints, by other
seeds) a link must hold in every lane, which keeps chance links out of a large
table; the first lane alone deals out the buckets.

Defined results: a null text or one without words has fingerprint zero; fewer
words than a shingle make one shingle of them all; a row with a null id takes
part in links but never names a component (null, if none of a component has
an id); repeated rows share a component; an empty table gives none; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specblock.llm.common import shuffle_partitions
from specblock.operators.graph import connected_components
from specblock.session import cut

BITS = 64
SEED = 42
BUCKET_ROWS = 4096
LEVELS = 3
#: Shingles whose bits are counted at once, and pairs held before they become a forest.
BLOCK = 1 << 16
PAIRS = 1 << 18


def fingerprint(text: str | None, shingle: int, seeds: tuple[int, ...] = (SEED,)) -> list[int]:
    """The unsigned fingerprints of a text, one for each seed."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return [0] * len(seeds)
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)))
    return [_majority(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64, len(grams))) for seed in seeds]


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BLOCK):
        block = hashes[at : at + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0])


#: Lower-cases A-Z and nothing else.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def covering_masks(radius: int, free: int = (1 << BITS) - 1, parts: int = 1) -> list[int]:
    """For each part of the free positions, a mask for each nonzero vector of radius // parts + 1 bits."""
    top = (1 << (radius // parts + 1)) - 1
    # Odd vectors first: where positions are few, every mask still keeps about half of them.
    order = [*range(1, top + 1, 2), *range(2, top + 1, 2)]
    positions = [i for i in range(BITS) if free >> i & 1]
    masks = []
    for part in range(parts):
        vectors = {p: order[k % top] for k, p in enumerate(positions[part::parts])}
        masks += [sum(1 << p for p, m in vectors.items() if (m & v).bit_count() & 1) for v in range(1, top + 1)]
    return masks


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int, seeds: tuple[int, ...] = (SEED,), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tag, fp, fp1, ...) of every row.

    tag is hash(text); fp and its like are the fingerprints' bits as signed longs.
    """
    lanes = lane_names(len(seeds))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle, seeds) for t in batch.column(2).to_pylist()], np.uint64).reshape(-1, len(seeds)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(fps[:, k]) for k in range(len(seeds)))], ["id", "tag", *lanes])

    rows = docs.select(F.col(id_col).alias("id"), F.hash(text_col).alias("tag"), F.col(text_col).alias("text"))
    kinds = ", ".join(f"{lane} long" for lane in lanes)
    return rows.mapInArrow(work, f"id {rows.schema['id'].dataType.simpleString()}, tag int, {kinds}")


def lane_names(n: int) -> list[str]:
    return ["fp", *(f"fp{k}" for k in range(1, n))]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star forest with the components of the edges (a, b)."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        px, py = parent[x], parent[y]
        if np.array_equal(px, py):
            break
        np.minimum.at(parent, np.maximum(px, py), np.minimum(px, py))
        while not np.array_equal(parent, up := parent[parent]):
            parent = up
    other = parent != np.arange(len(nodes))
    return nodes[other], nodes[parent[other]]


def bucket_links(group: np.ndarray, node: np.ndarray, lanes: list[np.ndarray], radius: int, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A star forest of the links between nodes within equal values of group, which is sorted."""
    size = np.diff(np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group)))
    left = np.repeat(size, size) - (np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size))
    bits, found, held = [lane.view(np.uint64) for lane in lanes], [], 0
    at, step = np.flatnonzero(left > 1), 1
    while len(at):
        near = at[np.bitwise_count(bits[0][at] ^ bits[0][at + step]) <= radius]
        for lane in bits[1:]:
            near = near[np.bitwise_count(lane[near] ^ lane[near + step]) <= radius]
        if len(near):
            found.append((node[near], node[near + step]))
            held += len(near)
            if held > PAIRS:
                found = [forest(*map(np.concatenate, zip(*found, strict=True)))]
                held = len(found[0][0])
        step += 1
        at = at[left[at] > step]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return forest(*map(np.concatenate, zip(*found, strict=True)))


def _stream_links(keys: DataFrame, radius: int, bucket_rows: int | None, find: Callable = bucket_links) -> DataFrame:
    """(table, a, b, more) from (table, key, node, lanes).

    Rows of table -1 are links (a, b) that find gives for whole buckets; the
    others are members of buckets of over bucket_rows rows, with node in a and
    the lanes in b and more.
    """
    lanes = keys.columns[3:]
    names = ["table", "a", "b", *lanes[1:]]

    def batch_of(table, a, b, more):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (table, a, b, *more)], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        passing = None  # table and key of the bucket whose members stream on

        def settle(parts, last):
            nonlocal held, passing
            table, key, node = parts[:3]
            edges = np.flatnonzero((table[1:] != table[:-1]) | (key[1:] != key[:-1])) + 1
            starts, ends = np.append(0, edges), np.append(edges, len(node))
            large = ends - starts > bucket_rows if bucket_rows else np.zeros(len(starts), bool)
            if passing is not None and (table[0], key[0]) == passing:
                large[0] = True
            passing = (table[-1], key[-1]) if large[-1] and not last else None
            # The last bucket may go on: it waits, unless its members stream on already.
            waits = not last and not large[-1]
            done = int(starts[-1]) if waits else len(node)
            held = [p[done:] for p in parts] if waits else None
            sizes = (ends - starts)[: len(starts) - waits]
            on = np.repeat(large[: len(sizes)], sizes)
            if on.any():
                yield batch_of(*(p[:done][on] for p in (table, node, parts[3])), [p[:done][on] for p in parts[4:]])
            group = np.repeat(np.arange(len(sizes)), sizes)[~on]
            if len(group) > 1:
                a, b = find(group, node[:done][~on], [p[:done][~on] for p in parts[3:]], radius, table[:done][~on])
                if len(a):
                    yield batch_of(np.full(len(a), -1), a, b, [np.zeros(len(a), np.int64)] * (len(lanes) - 1))

        for batch in batches:
            if batch.num_rows:
                new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                yield from settle(new if held is None else [np.concatenate(p) for p in zip(held, new, strict=True)], False)
        if held is not None and len(held[0]):
            yield from settle(held, True)

    placed = keys.repartition(shuffle_partitions(keys), "table", "key").sortWithinPartitions("table", "key")
    return placed.mapInArrow(work, ", ".join(f"{c} long" for c in names))


class Masks:
    """The tree of masks: each bucket's mask has children that cover the positions it leaves free."""

    def __init__(self, radius: int, parts: int):
        self.radius, self.parts = radius, parts
        self.per = len(covering_masks(radius, parts=parts))
        self.known: dict[int, list[int]] = {0: covering_masks(radius, parts=parts)}

    def children(self, table: int) -> list[int]:
        """Masks of the tables table * per + 1, ..., below a table (0: the top)."""
        if table not in self.known:
            own = self.children((table - 1) // self.per)[(table - 1) % self.per]
            finer = covering_masks(self.radius, ((1 << BITS) - 1) & ~own, self.parts)
            self.known[table] = [own | f for f in finer]
        return self.known[table]


def _spread(members: DataFrame, masks: Masks) -> DataFrame:
    """(table, key, node, lanes): each member of a table (table, node, lanes) in the tables below it."""
    names = members.columns[1:]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table, fp = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for own in np.unique(table).tolist():
                at = np.flatnonzero(table == own)
                rows = [c.take(pa.array(at)) for c in batch.columns[1:]]
                for k, mask in enumerate(masks.children(own)):
                    below = np.full(len(at), own * masks.per + k + 1)
                    # Keys are told apart by 32 bits: if two share them, a bucket holds more, never less.
                    bits = fp[at].view(np.uint64) & np.uint64(mask)
                    key = ((bits ^ (bits >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(below), pa.array(key), *rows], ["table", "key", *names])

    kinds = ", ".join(f"{c} long" for c in names)
    return members.mapInArrow(work, f"table long, key int, {kinds}")


def radius_links(fps: DataFrame, radius: int, parts: int = 1, bucket_rows: int = BUCKET_ROWS, find: Callable = bucket_links) -> DataFrame:
    """(a, b) between nodes: links whose components are those of all pairs within radius.

    fps holds distinct nodes (node long) with their fingerprints (fp and
    further lanes).  Another find than bucket_links tells what else to take of
    the nodes of a bucket: it gets their bucket, node, lanes and table.
    """
    lanes = [c for c in fps.columns if c != "node"]
    masks = Masks(radius, parts)
    members = fps.select(F.lit(0).cast("long").alias("table"), "node", *lanes)
    found = None
    for level in range(1, LEVELS + 1):
        out = cut(_stream_links(_spread(members, masks), radius, bucket_rows if level < LEVELS else None, find))
        links = out.where("table = -1").select("a", "b")
        found = links if found is None else found.union(links)
        rest = out.where("table <> -1")
        if rest.isEmpty():
            break
        members = rest.select("table", F.col("a").alias("node"), F.col("b").alias(lanes[0]), *lanes[1:])
    return found


def components(marked: DataFrame, radius: int, parts: int = 1, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The distinct fingerprints in marked (id, tag, fp, further lanes) with label and component_id.

    component_id is the smallest id that is reachable by links; label tells components apart.
    """
    lanes = [c for c in marked.columns if c not in ("id", "tag")]
    node = F.col("fp") if len(lanes) == 1 else F.xxhash64(*lanes)
    fps = cut(marked.groupBy(*lanes).agg(F.min("id").alias("rep")).withColumn("own", node))
    joined = connected_components(radius_links(fps.select(F.col("own").alias("node"), *lanes), radius, parts, bucket_rows))
    named = cut(fps.join(joined, fps["own"] == joined["node"], "left").select(*lanes, "rep", F.coalesce("component", "own").alias("label")))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    return named.join(least, "label").select(*lanes, "label", "component_id")


def near_duplicates(
    docs: DataFrame, shingle: int = 5, radius: int = 3, parts: int = 1, seeds: tuple[int, ...] = (SEED,), bucket_rows: int = BUCKET_ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id_col, fingerprint (16 hex digits of the first lane), component_id of every row of docs."""
    marked = cut(fingerprints(docs, shingle, seeds, id_col, text_col))
    named = components(marked, radius, parts, bucket_rows)
    whole = marked.join(named, lane_names(len(seeds)))
    return whole.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

