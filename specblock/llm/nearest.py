"""Approximate nearest neighbours by cross-polytope hashing.

A function turns unit vectors by a pseudo-rotation (three rounds of random
signs and a fast Walsh-Hadamard transform) and hashes each to its nearest
signed axis; a table composes several.  Every vector is indexed in every
table; a query probes, in each table, the cells whose axes are nearest to it
together.  What shares a cell is compared in blocks of matrix products, and
the best are measured again on the original vectors in double precision.

Vectors are hashed by classes of norm (a factor of two each, so at most some
two thousand; in practice a few).  Within a class one more component lifts
them to the sphere of its largest norm, so nearness there follows the
Euclidean distance; a query probes every class.

How many functions a table composes and how many cells a query probes is
fitted on a bounded sample: `sample` asked vectors are searched by brute
force, and the cheapest choice that finds `recall` of their neighbours holds.

Equal vectors are one candidate, which carries its k + 1 smallest ids: all
that any result can need.  Cells of over `part_rows` vectors are split into
parts, which every probing query visits, so a crowded cell is spread and no
candidate is ever left out; a part gives at most k + 1 rows a query.

Defined results: vectors that are null or zero, hold null or non-finite
components or are not as long as most take no part, nor do null ids; a query
that is the only vector finds nothing; equal distances rank by smaller id;
repeated rows (id and vector) count once; rows that share an id but no vector
are rows of their own, as candidates and as queries, each with its own ranks;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specblock.llm.common import broadcast_if_small, shuffle_partitions
from specblock.session import cut

TABLES = 24
PART_ROWS = 4096
SEED = 11
#: Neighbours of the sample that a fit has to find, the sample's size, and the most cells probed in a table.
RECALL = 0.95
SAMPLE = 64
MOST_PROBES = 512
#: Comparisons that one more probed cell costs, about, besides those in it.
PROBE_COST = 20
#: Vectors compared with a block of queries at once; rows of a cell that is compared together with others; pairs measured at once.
BLOCK = 2048
SMALL = 256
PAIRS = 1 << 16
BROADCAST_ROWS = 500_000


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """x (rows of a power of two) after rounds of signs and Walsh-Hadamard transforms."""
    n = x.shape[1]
    for row in signs:
        x = x * row
        h = 1
        while h < n:
            pairs = x.reshape(len(x), n // (2 * h), 2, h)
            x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(len(x), n)
            h *= 2
        x = x / np.sqrt(n)
    return x


class Tables:
    """Hash functions over vectors of dim components; tops tells the largest norm of each class of norms."""

    def __init__(self, dim: int, tops: dict[int, float], lift: bool, tables: int, composed: int, seed: int):
        self.lift, self.tops, self.composed = lift, tops, composed
        self.width = 1 << max(1, (dim + lift - 1).bit_length())
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, composed, 3, self.width))

    def on_sphere(self, x: np.ndarray, top: np.ndarray) -> np.ndarray:
        """x on the sphere of radius top; what is longer goes to where its direction meets it."""
        out = np.zeros((len(x), self.width))
        out[:, : x.shape[1]] = x
        if self.lift:
            out[:, x.shape[1]] = np.sqrt(np.maximum(0.0, top**2 - (x * x).sum(axis=1)))
        return out / np.linalg.norm(out, axis=1, keepdims=True)

    def cells(self, x: np.ndarray, top: np.ndarray) -> np.ndarray:
        """(rows, tables): the own cell of each."""
        unit = self.on_sphere(x, top)
        out = np.zeros((len(x), len(self.signs)), np.int64)
        for t, functions in enumerate(self.signs):
            for signs in functions:
                turned = rotate(unit, signs)
                axis = np.abs(turned).argmax(axis=1)
                out[:, t] = out[:, t] * 2 * self.width + 2 * axis + (np.take_along_axis(turned, axis[:, None], axis=1)[:, 0] < 0)
        return out

    def probes(self, x: np.ndarray, top: np.ndarray, n: int) -> np.ndarray:
        """(rows, tables, n or all): cells, nearest first: by the sum of what their axes fall short of the nearest."""
        unit = self.on_sphere(x, top)
        # The n best of the composed functions lie within the n best of each.
        each = min(n, 2 * self.width)
        out = []
        for functions in self.signs:
            cell, short = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
            for signs in functions:
                turned = rotate(unit, signs)
                both = np.stack((turned, -turned), axis=2).reshape(len(x), -1)
                by = np.argsort(-both, axis=1, kind="stable")[:, :each]
                value = np.take_along_axis(both, by, axis=1)
                lost = (value[:, :1] - value) ** 2
                cell = (cell[:, :, None] * 2 * self.width + by[:, None, :]).reshape(len(x), -1)
                short = (short[:, :, None] + lost[:, None, :]).reshape(len(x), -1)
                if short.shape[1] > 4 * n:
                    keep = np.argpartition(short, n, axis=1)[:, :n]
                    cell, short = np.take_along_axis(cell, keep, axis=1), np.take_along_axis(short, keep, axis=1)
                keep = np.argsort(short, axis=1, kind="stable")[:, :n]
                cell, short = np.take_along_axis(cell, keep, axis=1), np.take_along_axis(short, keep, axis=1)
            out.append(cell)
        return np.stack(out, axis=1)


def norm_class(v: Column) -> Column:
    """Classes are a factor of two wide and none ends at 1, so rounding does not split unit vectors."""
    return F.floor(F.log2(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))) + 0.37).cast("int")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): v an array of doubles without null, non-finite or only zero components."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return rows.where(F.forall("v", finite) & F.exists("v", lambda x: x != 0))


def _classes(rows: DataFrame, size: int) -> DataFrame:
    """(cls, rep, norm, v, asks, ids): each distinct vector, whether it is asked for, and its smallest ids.

    Ids are counted off within parts of a class first, so a hot one is spread.
    """
    marked = rows.groupBy("id", "v").agg(F.max("asks").alias("asks"))
    in_part = Window.partitionBy("v", F.pmod(F.xxhash64("id"), F.lit(256)))
    some = marked.withColumn("r", F.row_number().over(in_part.orderBy("id"))).withColumn("asks", F.max("asks").over(in_part))
    ids = F.slice(F.array_sort(F.collect_list("id")), 1, size)
    whole = some.where(F.col("r") <= size).groupBy("v").agg(F.max("asks").alias("asks"), ids.alias("ids"))
    return cut(whole.select(F.xxhash64("v").alias("cls"), F.element_at("ids", 1).alias("rep"), norm_class(F.col("v")).alias("norm"), "v", "asks", "ids"))


def _merge_best(best: tuple, q: np.ndarray, ids: np.ndarray, cls: np.ndarray, score: np.ndarray, k: int) -> tuple:
    """The k best (score, id, cls) of each q among best and the new ones."""
    q, score, ids, cls = (np.concatenate(pair) for pair in zip(best, (q, score, ids, cls), strict=True))
    by = np.lexsort((cls, ids, score, q))
    starts = np.flatnonzero(np.append(True, q[by][1:] != q[by][:-1]))
    by = by[np.arange(len(by)) - np.repeat(starts, np.diff(np.append(starts, len(by)))) < k]
    return q[by], score[by], ids[by], cls[by]


def _nobody() -> tuple:
    return np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)


def _near(q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (of q, of x) that hold the k nearest of each q, with their exact distances."""
    rough = (q * q).sum(axis=1)[:, None] - 2 * q @ x.T + (x * x).sum(axis=1)
    m = min(len(x), 2 * k + 16)
    # More than k by the rough measure; what ties with the last is measured as well.
    limit = np.partition(rough, m - 1, axis=1)[:, m - 1]
    a, b = np.nonzero(rough <= (limit + 1e-9 * (1 + np.abs(limit)))[:, None])
    return a, b, np.sqrt(((q[a] - x[b]) ** 2).sum(axis=1))


def _small_cells(starts: np.ndarray, firsts: np.ndarray, ends: np.ndarray, cls: np.ndarray, rep: np.ndarray, x: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best of each query in cells of few rows, whose queries begin at starts and candidates at firsts."""
    asked, held = firsts - starts, ends - firsts
    row = np.repeat(starts - np.cumsum(asked) + asked, asked) + np.arange(asked.sum())
    first, many = np.repeat(firsts, asked), np.repeat(held, asked)
    q, name = np.unique(cls[row], return_inverse=True)
    best = _nobody()
    upto = np.cumsum(many)
    low = 0
    while low < len(row):
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + PAIRS, "right")))
        n = many[low:high]
        a = np.repeat(np.arange(low, high), n)
        b = np.repeat(first[low:high] - np.cumsum(n) + n, n) + np.arange(n.sum())
        score = np.sqrt(((x[row[a]] - x[b]) ** 2).sum(axis=1))
        # A candidate that shares several cells with a query counts once.
        by = np.lexsort((cls[b], name[a]))
        by = by[np.append(True, (name[a][by][1:] != name[a][by][:-1]) | (cls[b][by][1:] != cls[b][by][:-1]))[: len(by)]]
        best = _merge_best(best, name[a][by], rep[b][by], cls[b][by], score[by], 2 * k)
        low = high
    return pa.RecordBatch.from_arrays([pa.array(q[best[0]]), pa.array(best[3]), pa.array(best[2]), pa.array(best[1])], ["q", "cls", "rep", "score"])


def _searcher(k: int):
    """Streams cells (queries first): the k best classes of each query, by cells or by several small cells together."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, qs, q_cls, best = None, [], [], None

        def flush():
            if best is not None and len(best[0]):
                yield pa.RecordBatch.from_arrays([pa.array(q_cls[best[0]]), pa.array(best[3]), pa.array(best[2]), pa.array(best[1])], ["q", "cls", "rep", "score"])

        for batch in batches:
            cells, salts, kinds, cls, rep = (batch.column(i).to_numpy() for i in range(5))
            x = _matrix(batch.column(5))
            new = np.append(True, (cells[1:] != cells[:-1]) | (salts[1:] != salts[:-1]))[: len(cells)]
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(cells))[: len(starts)]
            firsts = starts + np.add.reduceat(kinds == 0, starts) if len(starts) else starts
            # The first and the last cell of a batch may be part of a larger one.
            inner = np.zeros(len(starts), bool)
            inner[1:-1] = True
            small = inner & (ends - starts <= SMALL)
            both = small & (firsts > starts) & (firsts < ends)
            if both.any():
                yield _small_cells(starts[both], firsts[both], ends[both], cls, rep, x, k)
            rest = [edge for at in np.flatnonzero(~small) for edge in ((starts[at], firsts[at]), (firsts[at], ends[at])) if edge[0] < edge[1]]
            for start, end in rest:
                if (cells[start], salts[start]) != cell:
                    yield from flush()
                    cell, qs, q_cls, best = (cells[start], salts[start]), [], [], None
                if kinds[start] == 0:
                    qs.append(x[start:end])
                    q_cls.append(cls[start:end])
                    continue
                if best is None:
                    if not qs:
                        continue  # nobody asks here
                    qs, q_cls, best = np.concatenate(qs), np.concatenate(q_cls), _nobody()
                for at in range(start, end, BLOCK):
                    stop = min(end, at + BLOCK)
                    for low in range(0, len(qs), BLOCK):
                        a, b, score = _near(qs[low : low + BLOCK], x[at:stop], k)
                        best = _merge_best(best, a + low, rep[at:stop][b], cls[at:stop][b], score, k)
        yield from flush()

    return work


def _sampled_neighbours(classes: DataFrame, k: int, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Asked vectors, at most `sample`, and of their k nearest others the number of the query, vectors and norm classes."""
    asked = classes.where("asks").orderBy(F.xxhash64("cls"), "cls").limit(sample).select("cls", "v").collect()
    if not asked:
        return np.empty((0, 1)), np.empty(0, np.int64), np.empty((0, 1)), np.empty(0, np.int64), np.empty(0)
    q, own = np.array([r["v"] for r in asked], float), np.array([r["cls"] for r in asked], np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _nobody()
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                cls = part.column(0).to_numpy()
                a, b, score = _near(q, _matrix(part.column(1)), k + 1)
                other = own[a] != cls[b]
                best = _merge_best(best, a[other], cls[b][other], cls[b][other], score[other], k)
        yield pa.RecordBatch.from_arrays([pa.array(best[0]), pa.array(best[3]), pa.array(best[1])], ["q", "cls", "score"])

    near = classes.select("cls", "v").mapInArrow(work, "q long, cls long, score double")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("score", "cls"))).where(F.col("r") <= k)
    # At most k rows for each of the sample.
    rows = classes.join(F.broadcast(near), "cls").select("q", "v", "norm", "score").collect()
    return q, np.array([r["q"] for r in rows], np.int64), np.array([r["v"] for r in rows], float).reshape(len(rows), q.shape[1]), np.array([r["norm"] for r in rows], np.int64), np.array([r["score"] for r in rows])


def fitted(classes: DataFrame, total: int, dim: int, tops: dict[int, float], lift: bool, k: int, tables: int, recall: float, sample: int, seed: int) -> tuple[Tables, int]:
    """The tables and the number of cells probed that find `recall` of the sample's neighbours at the least cost."""
    q, of, near, norm, _ = _sampled_neighbours(classes, k, sample)
    choices = []
    for composed in (1, 2, 3, 4):
        hashes = Tables(dim, tops, lift, tables, composed, seed)
        per_table = (2 * hashes.width) ** composed
        if composed > 1 and per_table > 4 * total:
            break
        n = min(MOST_PROBES, per_table)
        rank = np.full((len(of), tables), n)
        for each in np.unique(norm):
            at = np.flatnonzero(norm == each)
            top = np.full(len(at), tops[int(each)])
            probed = hashes.probes(q, np.full(len(q), tops[int(each)]), n)
            hit = probed[of[at]] == hashes.cells(near[at], top)[:, :, None]
            rank[at] = np.where(hit.any(axis=2), hit.argmax(axis=2), n)
        first = np.sort(rank.min(axis=1)) if len(of) else np.zeros(1, int)
        needed = int(first[min(len(first) - 1, int(np.ceil(recall * len(first))) - 1)]) + 1
        if needed <= n:
            choices.append((needed * (PROBE_COST + total / per_table), composed, hashes, needed))
    if not choices:
        # Not even so many probes of one function: every cell is probed, which is a search of all.
        hashes = Tables(dim, tops, lift, 1, 1, seed)
        return hashes, 2 * hashes.width
    return min(choices, key=lambda c: c[:2])[2:]


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    tables: int = TABLES,
    recall: float = RECALL,
    part_rows: int = PART_ROWS,
    sample: int = SAMPLE,
    seed: int = SEED,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, id_col, score): for each row with is_query (over `id`) its k nearest other rows found."""
    rows = usable(vectors, id_col, vector_col)
    shape = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = shape["dim"] if shape else 1
    rows = rows.where(F.size("v") == dim).withColumn("asks", is_query)
    # Equal vectors become one class with its k + 1 smallest ids.
    classes = _classes(rows, k + 1)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    # One row for each binary order of magnitude that norms have.
    spread = classes.groupBy("norm").agg(F.max(norm).alias("top"), F.min(norm).alias("low"), F.count("*").alias("n")).collect()
    tops, total = {r["norm"]: r["top"] for r in spread}, sum(r["n"] for r in spread)
    lift = any(r["top"] - r["low"] > 1e-6 * r["top"] for r in spread)
    hashes, probes = fitted(classes, total, dim, tops, lift, k, tables, recall, sample, seed)
    per_table = (2 * hashes.width) ** hashes.composed
    # A cell's number: norm class, table, cell.
    origin = {each: at * len(hashes.signs) * per_table for at, each in enumerate(sorted(tops))}

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.arange(len(hashes.signs), dtype=np.int64) * per_table
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                norms, x, asks = part.column(2).to_numpy(), _matrix(part.column(3)), part.column(4).to_numpy(zero_copy_only=False)
                own = hashes.cells(x, np.array([tops[n] for n in norms.tolist()])) + table + np.array([origin[n] for n in norms.tolist()], np.int64)[:, None]
                lists = [None] * len(x)
                asked = np.flatnonzero(asks)
                for low in range(0, len(asked), 64):
                    some = asked[low : low + 64]
                    found = [(hashes.probes(x[some], np.full(len(some), tops[n]), probes) + table[None, :, None] + origin[n]).reshape(len(some), -1) for n in origin]
                    for i, cells in zip(some, np.concatenate(found, axis=1), strict=True):
                        lists[i] = cells
                probed = pa.array(lists, pa.list_(pa.int64()))
                cells = pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, own.shape[1], dtype=np.int32)), pa.array(own.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in (0, 1, 3)), cells, probed], ["cls", "rep", "v", "cells", "probed"])

    # Vectors travel as they came: floats stay floats.
    kind = vectors.schema[vector_col].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    hashed = classes.select("cls", "rep", "norm", "v", "asks").mapInArrow(index, "cls long, rep long, v array<double>, cells array<long>, probed array<long>")
    hashed = cut(hashed.withColumn("v", F.col("v").cast(kind)))
    held = hashed.select(F.explode("cells").alias("cell"), F.lit(1).cast("byte").alias("kind"), "cls", "rep", "v")
    asked = hashed.where("probed is not null").select(F.explode("probed").alias("cell"), F.lit(0).cast("byte").alias("kind"), "cls", "rep", "v")
    counts = held.groupBy("cell").count()
    crowded = cut(counts.where(F.col("count") > part_rows).select("cell", F.ceil(F.col("count") / part_rows).cast("int").alias("parts")))
    crowded = broadcast_if_small(crowded, BROADCAST_ROWS)
    parts = F.coalesce("parts", F.lit(1))
    held = held.join(crowded, "cell", "left").withColumn("salt", F.pmod(F.hash("cls"), parts))
    asked = asked.join(crowded, "cell", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    cells = reduce(DataFrame.union, [d.select("cell", "salt", "kind", "cls", "rep", "v") for d in (held, asked)])
    placed = cells.repartition(shuffle_partitions(cells), "cell", "salt").sortWithinPartitions("cell", "salt", "kind")
    near = placed.mapInArrow(_searcher(k + 1), "q long, cls long, rep long, score double")
    best = Window.partitionBy("q").orderBy("score", "rep", "cls")
    near = near.groupBy("q", "cls", "rep").agg(F.min("score").alias("score")).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    near = near.join(classes.select("cls", "ids"), "cls").select("q", "cls", "score", F.explode("ids").alias("id"))
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("score", "id", "cls"))).where(F.col("r") <= k + 1)
    queries = rows.where("asks").select(F.col("id").alias("query_id"), F.xxhash64("v").alias("q")).distinct()
    # What a query must not find is its own row: its id with its vector.
    found = queries.join(near, "q").where((F.col("id") != F.col("query_id")) | (F.col("cls") != F.col("q")))
    rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy("score", "id", "cls"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
