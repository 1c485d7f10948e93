"""Language-model scoring with an Elias-Fano n-gram trie.

Training counts every n-gram of the training texts in Spark and keeps them
all.  Absolute discounting interpolates levels:

    P(w | c) = (n(cw) - D) / n(c) + b(c) P(w | shorter c),  b(c) = D m(c) / n(c)

with m(c) the number of distinct words after c, so each P(. | c) sums to one;
the lowest level adds one half to each count.  A level's entries are sorted by
context and word.  Pointers from contexts to their entries and the entries'
words, made monotone by starting each context where the one before ended, are
Elias-Fano coded; probabilities and b are quantised to 16 bits.  A word is
looked up as the successor of its context-relative value.

A level is dealt out by ranges of its contexts.  How many tokens follow a
context is its own count, which the level below tells, so ranges of about
`part_tokens` tokens are known without a sample, and a context that is hotter
than that is split by ranges of the words after it.  Tasks combine equal
n-grams, cut what they hold at these ranges and send it packed (differences of
sorted keys, compressed); a range is folded by one task and becomes one part
of the level.  So no task holds more than a block of texts and a part.

Tasks write the parts to the shared folder, where workers memory-map them;
only sizes and bounds of parts reach the driver.  Where that folder is no
mounted file system, Spark writes the parts there and each executor fetches
them with SparkContext.addFile.  The disk that an executor sees must hold the
model.  Words are told apart by a 64-bit hash.

Defined results: a null text is empty (one token, the end); with no training
text every score is that of the formulas with no counts; repeated rows count
as often as they occur; null ids are kept; an empty table gives none; other
columns are ignored.
"""

from __future__ import annotations

import ast
import os
import struct
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specblock.llm import elias_fano
from specblock.llm.common import shuffle_partitions
from specblock.llm.word_arrays import WordHasher
from specblock.session import discard, ensure_checkpoint_dir, shared_folder, stored

ORDER = 3
DISCOUNT = 0.75
#: Texts and tokens handled at once, and quantisation steps for each unit of log10.
TEXTS = 4096
CHUNK_TOKENS = 1 << 20
#: Tokens whose n-grams one part of a level holds, about.
PART_TOKENS = 1 << 21
STEPS = 4096
#: Rows that a task holds to combine equal ones, and entries packed into one row.
HELD_ROWS = 1 << 21
PACKED = 1 << 12
#: Stands among the hashes for the token that ends a text.
END = 0x5EED0F7E87E11D


def quantise(log10: np.ndarray) -> np.ndarray:
    """Codes 1..65535 of logarithms from 0 down; code 0 says that there is none."""
    return (np.clip(np.rint(-log10 * STEPS), 0, 65534) + 1).astype(np.uint16)


def dequantise(code: np.ndarray) -> np.ndarray:
    return np.where(code == 0, 0.0, -(code.astype(np.float64) - 1) / STEPS)


def text_hashes(texts: list[str | None], hasher: WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (int64) of all tokens, ends included, and the number of each text."""
    words, sizes = hasher.tokens(texts)
    sizes = sizes + 1
    out = np.full(len(words) + len(sizes), END)
    is_word = np.ones(len(out), bool)
    is_word[np.cumsum(sizes) - 1] = False
    out[is_word] = words.view(np.int64)
    return out, sizes


def text_blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK_TOKENS tokens at most (a longer text stands alone)."""
    start = size = 0
    for i, text in enumerate(texts):
        more = len(text) // 3 + 1 if text else 1
        if size and size + more > CHUNK_TOKENS:
            yield start, i
            start, size = i, 0
        size += more
    if start < len(texts):
        yield start, len(texts)


def since_begin(sizes: np.ndarray) -> np.ndarray:
    """How many tokens of its text stand before each token."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


# Packed entries: sorted keys as differences, counts and codes, each as planes of bytes.


def _planes(x: np.ndarray) -> tuple[int, bytes]:
    width = max(1, (int(x.max()).bit_length() + 7) // 8)
    return width, x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _from_planes(raw: np.ndarray, width: int, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = raw.reshape(width, n).T
    return out.reshape(-1).view("<u8")


def pack(keys: np.ndarray, counts: np.ndarray, codes: np.ndarray) -> bytes:
    widths, parts = zip(*map(_planes, (np.diff(keys, prepend=keys[:1]).view(np.uint64), counts, codes)), strict=True)
    return struct.pack("<qq3B", int(keys[0]), len(keys), *widths) + pa.compress(b"".join(parts), codec="zstd", asbytes=True)


def unpack(packed: bytes) -> list[np.ndarray]:
    first, n, *widths = struct.unpack_from("<qq3B", packed)
    raw = np.frombuffer(pa.decompress(memoryview(packed)[struct.calcsize("<qq3B") :], n * sum(widths), codec="zstd"), np.uint8)
    ends = np.cumsum([w * n for w in widths])
    deltas, counts, codes = (_from_planes(raw[e - w * n : e], w, n) for w, e in zip(widths, ends, strict=True))
    return [np.cumsum(deltas).view(np.int64) + first, counts.view(np.int64), codes.astype(np.uint16)]


def _joined(held: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Blocks of (keys, counts, codes) as one of distinct, sorted keys; equal keys have equal codes."""
    keys, counts, codes = map(np.concatenate, zip(*held, strict=True))
    by = np.argsort(keys)
    keys = keys[by]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return [keys[first], np.add.reduceat(counts[by], first), codes[by][first]]


def _combined(blocks: Iterator[tuple[np.ndarray, np.ndarray | None]]) -> Iterator[list[np.ndarray]]:
    """Blocks of (keys, codes) as larger ones of distinct, sorted keys with their counts."""
    held, size = [], 0
    for keys, codes in blocks:
        if not len(keys):
            continue
        held.append(_joined([[keys, np.ones(len(keys), np.int64), codes if codes is not None else np.zeros(len(keys), np.uint16)]]))
        size += len(held[-1][0])
        if size > HELD_ROWS:
            yield _joined(held)
            held, size = [], 0
    if held:
        yield _joined(held)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[str | None]]:
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            texts = batch.slice(at, TEXTS).column(0).to_pylist()
            for start, end in text_blocks(texts):
                yield texts[start:end]


class Ranges:
    """How the keys of a level are dealt out: ranges of contexts, of which hot ones are split by words.

    first and tokens tell of each range its first context and its tokens;
    words and before of each range of words its first and the tokens before it.
    """

    def __init__(self, first: np.ndarray, tokens: np.ndarray, alone: np.ndarray, base: int, part_tokens: int, words: np.ndarray, before: np.ndarray):
        self.first, self.base, self.words = first, base, words
        self.splits = np.where(alone, np.maximum(1, -(-tokens // part_tokens)), 1)
        self.offset = np.cumsum(self.splits) - self.splits
        self.before = before / max(1, int(tokens.sum()))

    def _split(self, splits: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.minimum(self.before[at] * splits, splits - 1).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The part of each key; it does not fall as the key rises."""
        context, word = keys // self.base, keys % self.base
        at = np.searchsorted(self.first, context, "right") - 1
        part = self.offset[at]
        hot = np.flatnonzero(self.splits[at] > 1)
        part[hot] += self._split(self.splits[at[hot]], np.searchsorted(self.words, word[hot], "right") - 1)
        return part

    def range_of(self, part: int) -> int:
        return int(np.searchsorted(self.offset, part, "right")) - 1

    def least_keys(self, parts: list[int]) -> list[int]:
        """Where keys begin to belong to each of these parts, of which the empty ones are left out."""
        out, last = [], -1
        for part in parts:
            at = self.range_of(part)
            least = int(self.first[at]) * self.base
            if at == last:
                of_words = self._split(self.splits[at], np.arange(len(self.words)))
                least += int(self.words[np.searchsorted(of_words, part - int(self.offset[at]))])
            out.append(least)
            last = at
        return out


class Model:
    """The trie as files: what a closure carries is folders, sizes and bounds of parts."""

    def __init__(self):
        self.tokens = self.types = 0
        #: Of the words: least hash, first place and name of each part.
        self.words: list[tuple[int, int, str]] = []
        #: Of each level from the second on: what _build tells of each part.
        self.levels: list[list[dict]] = []
        #: Folders of Parquet that executors have fetched, by name, where no folder is mounted.
        self.folder = ""
        self.mounted = True

    def open(self, name: str) -> np.ndarray:
        """The bytes of a part, memory-mapped: from the shared folder or this executor's copy."""
        path = os.path.join(self.folder, name) if self.mounted else _fetched(name)
        return np.memmap(path, np.uint8, "r").view(np.ndarray)

    def reader(self) -> Reader:
        return Reader(self)


def _fetched(name: str) -> str:
    """A part out of the Parquet files that this executor has fetched; unpacked once."""
    kind = name.split("-")[0]
    out = os.path.join(SparkFiles.getRootDirectory(), f"unpacked-{kind}")
    if not os.path.isdir(out):
        making = f"{out}-{uuid.uuid4().hex}"
        os.makedirs(making)
        source = SparkFiles.get(kind)
        for file in sorted(os.listdir(source)):
            if file.endswith(".parquet"):
                for batch in pq.ParquetFile(os.path.join(source, file)).iter_batches(batch_size=1, columns=["name", "blob"]):
                    for part, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        with open(os.path.join(making, part), "wb") as target:
                            target.write(blob)
        try:
            os.rename(making, out)
        except OSError:  # another worker of this executor was first
            if not os.path.isdir(out):
                raise
    return os.path.join(out, name)


class Reader:
    """A worker's view of the files; a part is mapped while it is read."""

    def __init__(self, model: Model):
        self.model = model
        self.base = model.types + 1
        self.least_hash = np.array([p[0] for p in model.words], np.int64)
        self.least_key = {n: np.array([p["least_key"] for p in parts], np.int64) for n, parts in enumerate(model.levels, 2)}

    def word(self, part: tuple[int, int, str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and counts of a part of the words."""
        return tuple(self.model.open(part[2]).view(np.int64).reshape(2, -1))

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the vocabulary (-1 for words that training lacks), and log10 of the lowest level."""
        distinct, back = np.unique(hashes, return_inverse=True)
        ids, counts = np.full(len(distinct), -1), np.zeros(len(distinct))
        bounds = np.append(np.searchsorted(distinct, self.least_hash), len(distinct))
        for part, low, high in zip(self.model.words, bounds, bounds[1:], strict=False):
            if low < high:
                known, n = self.word(part)
                at = np.minimum(np.searchsorted(known, distinct[low:high]), len(known) - 1)
                hit = np.flatnonzero(known[at] == distinct[low:high])
                ids[low + hit] = part[1] + at[hit]
                counts[low + hit] = n[at[hit]]
        return ids[back], self.lowest(counts)[back]

    def lowest(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.model.tokens + 0.5 * (self.model.types + 1)))

    def word_counts(self, ids: np.ndarray) -> np.ndarray:
        """The counts of words by their places, which do not fall."""
        out = np.empty(len(ids), np.int64)
        bounds = np.append(np.searchsorted(ids, [p[1] for p in self.model.words]), len(ids))
        for part, low, high in zip(self.model.words, bounds, bounds[1:], strict=False):
            if low < high:
                out[low:high] = self.word(part)[1][ids[low:high] - part[1]]
        return out

    def find(self, n: int, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places (-1: none) and codes of (context, word) at level n, and codes of what each context leaves."""
        distinct, back = np.unique(context * self.base + word, return_inverse=True)
        place, prob, backoff = np.full(len(distinct), -1), np.zeros(len(distinct), np.uint16), np.zeros(len(distinct), np.uint16)
        bounds = np.append(np.searchsorted(distinct, self.least_key[n]), len(distinct))
        for meta, low, high in zip(self.model.levels[n - 2], bounds, bounds[1:], strict=False):
            if low == high:
                continue
            blob = self.model.open(meta["name"])

            def array(name, blob=blob, meta=meta):
                offset, dtype, size = meta["arrays"][name]
                return blob[offset : offset + size * np.dtype(dtype).itemsize].view(dtype)

            code = lambda name, array=array, meta=meta: elias_fano.Sequence(*meta[name], array(f"{name}_low"), array(f"{name}_words"), array(f"{name}_ranks"))
            at = low + np.flatnonzero((c := distinct[low:high] // self.base - meta["first_context"]) < meta["contexts"])
            c = c[: len(at)]
            backoff[at] = array("backoff")[c]
            if not len(at):
                continue
            w, pointers, values = distinct[at] % self.base, code("pointers"), code("values")
            # Keys are sorted: each context's bounds and origin are read once.
            new = np.append(True, c[1:] != c[:-1])
            each = c[new]
            begin, end = pointers.get_two(each)
            origin = np.zeros(len(each), np.int64)
            later = np.flatnonzero((begin > 0) & (begin < end))
            origin[later] = values.get(begin[later] - 1) + 1
            of = np.cumsum(new) - 1
            filled = (begin < end)[of]
            at, of = at[filled], of[filled]
            found, same = values.successor(origin[of] + w[filled])
            ok = same & (found < end[of])
            place[at[ok]] = meta["start"] + found[ok]
            prob[at[ok]] = array("probs")[found[ok]]
        return place[back], prob[back], backoff[back]

    def entries(self, ids: np.ndarray, lowest: np.ndarray, since: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For tokens with `since` of their text before them: place and code at level top, and log10 P up to it.

        lowest is log10 P at the lowest level.
        """
        places, lp, codes = ids, lowest.copy(), np.zeros(len(ids), np.uint16)
        for n in range(2, top + 1):
            at = np.flatnonzero(since >= n - 1)
            context = places[at - 1]
            at, context = at[context >= 0], context[context >= 0]
            # A word that training lacks, or whose shorter n-gram it lacks, stands for none.
            word = np.where((ids[at] >= 0) & (places[at] >= 0), ids[at], self.model.types)
            place, prob, backoff = self.find(n, context, word)
            places, codes = np.full(len(ids), -1), np.zeros(len(ids), np.uint16)
            places[at], codes[at] = place, prob
            lp[at] = np.where(place >= 0, dequantise(prob), lp[at] + dequantise(backoff))
        return places, codes, lp


def _counted(train: DataFrame, blocks: Callable[[], Callable], ranges: Callable[[np.ndarray], np.ndarray], part_tokens: int) -> DataFrame:
    """(part, size, tokens, packed, cuts), stored: the distinct keys of each part, sorted, with counts and codes.

    blocks gives, on a worker, a function from texts to (keys, codes).  cuts
    holds where ranges of about part_tokens tokens begin, and their tokens.
    """

    def count(batches):
        of = blocks()
        for keys, counts, codes in _combined(map(of, _texts(batches))):
            part = ranges(keys)
            edges = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            for start, end in zip(edges, np.append(edges[1:], len(part)), strict=True):
                for at in range(start, end, PACKED):
                    cut = slice(at, min(end, at + PACKED))
                    yield pa.RecordBatch.from_arrays([pa.array([int(part[start])]), pa.array([pack(keys[cut], counts[cut], codes[cut])], pa.binary())], ["part", "packed"])

    def whole(part, held):
        keys, counts, codes = _joined(held)
        cuts = cuts_of(counts, part_tokens)
        columns = [pa.array([part]), pa.array([len(keys)]), pa.array([int(counts.sum())]), pa.array([pack(keys, counts, codes)], pa.binary()), pa.array([cuts.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["part", "size", "tokens", "packed", "cuts"])

    def fold(batches):
        own, held, size, most = None, [], 0, 2 * part_tokens
        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if part != own and held:
                    yield whole(own, held)
                    held, size, most = [], 0, 2 * part_tokens
                own = part
                held.append(unpack(packed.as_py()))
                size += len(held[-1][0])
                if size > most:
                    held = [_joined(held)]
                    size = len(held[0][0])
                    most = 2 * max(size, part_tokens)
        if held:
            yield whole(own, held)

    rows = train.mapInArrow(count, "part long, packed binary")
    placed = rows.repartition(shuffle_partitions(train), "part").sortWithinPartitions("part")
    return stored(placed.mapInArrow(fold, "part long, size long, tokens long, packed binary, cuts binary"))


def cuts_of(counts: np.ndarray, part_tokens: int) -> np.ndarray:
    """(start, tokens, 1 if it is one entry of more than part_tokens) of each range of entries."""
    return _ranged(np.stack((np.arange(len(counts)), counts, counts > part_tokens), axis=1).astype(np.int64), part_tokens)


def _ranged(cuts: np.ndarray, part_tokens: int) -> np.ndarray:
    """Ranges like those of cuts_of, joined to about part_tokens tokens each."""
    if not len(cuts):
        return cuts
    _, tokens, alone = cuts.T
    before = np.cumsum(tokens) - tokens
    new = np.append(True, (np.diff(before // part_tokens) > 0) | (alone[1:] > 0) | (alone[:-1] > 0))
    starts = np.flatnonzero(new)
    return np.stack((cuts[starts, 0], np.add.reduceat(tokens, starts), alone[starts]), axis=1)


class _Parts:
    """Where parts go: tasks write them to the shared folder, by themselves or through Spark."""

    def __init__(self, spark, model: Model, mounted: bool | None = None):
        self.spark, self.model = spark, model
        shared = urlparse(ensure_checkpoint_dir(spark))
        # Spark itself needs a file: folder to be one mount on all machines.
        model.mounted = shared.scheme in ("", "file") if mounted is None else mounted
        if model.mounted:
            model.folder = unquote(urlparse(shared_folder(spark, "lm")).path)

    def make(self, rows: DataFrame, kind: str, build: Callable) -> list[dict]:
        """Builds and keeps a part of each row of rows (part, ...); what build tells of them, in order of parts.

        build takes a row of columns and gives the part's bytes and a dictionary.
        """
        mounted, folder, kind = self.model.mounted, self.model.folder, f"{kind}_{uuid.uuid4().hex}"

        def work(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                    blob, meta = build(row)
                    name = f"{kind}-{row['part']}"
                    if mounted:
                        # A task that runs again writes the same bytes: whoever is last replaces them.
                        path = os.path.join(folder, name)
                        with open(f"{path}.{uuid.uuid4().hex}", "wb") as out:
                            out.write(blob)
                        os.replace(out.name, path)
                    columns = [pa.array([row["part"]]), pa.array([name]), pa.array([repr(meta)]), pa.array([None if mounted else blob], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["part", "name", "meta", "blob"])

        made = rows.mapInArrow(work, "part long, name string, meta string, blob binary")
        if not mounted:
            path = f"{shared_folder(self.spark, 'lm')}/{kind}"
            made.write.parquet(path)
            made = self.spark.read.schema(made.schema).parquet(path)
            self.spark.sparkContext.addFile(path, recursive=True)
        return [ast.literal_eval(r["meta"]) | {"part": r["part"], "name": r["name"]} for r in sorted(made.select("part", "name", "meta").collect())]


def _ranges_above(counted: DataFrame, part_tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, int]]:
    """First place, tokens and loneliness of the ranges that entries of a level make, and the first place of each part."""
    starts, found, at = {}, [np.empty((0, 3), np.int64)], 0
    for row in sorted(counted.select("part", "size", "cuts").collect()):
        starts[row["part"]] = at
        cuts = np.frombuffer(row["cuts"], np.int64).reshape(-1, 3).copy()
        cuts[:, 0] += at
        found.append(cuts)
        at += row["size"]
    cuts = _ranged(np.concatenate(found), part_tokens)
    return cuts[:, 0], cuts[:, 1], cuts[:, 2], starts


def _vocabulary(train: DataFrame, model: Model, parts: _Parts, part_tokens: int):
    """Counts and keeps the words; their ranges."""
    n_parts = shuffle_partitions(train)

    def blocks():
        hasher = WordHasher()
        return lambda texts: (text_hashes(texts, hasher)[0], None)

    def spread(h):
        return np.minimum((h.astype(np.float64) + 2.0**63) / 2.0**64 * n_parts, n_parts - 1).astype(np.int64)

    def build(row):
        keys, counts, _ = unpack(row["packed"])
        return np.stack((keys, counts)).tobytes(), {"least": int(keys[0]), "tokens": row["tokens"], "size": len(keys)}

    counted = _counted(train, blocks, spread, part_tokens)
    first, tokens, alone, starts = _ranges_above(counted, part_tokens)
    for meta in parts.make(counted.select("part", "tokens", "packed"), "words", build):
        model.words.append((meta["least"], starts[meta["part"]], meta["name"]))
        model.types += meta["size"]
        model.tokens += meta["tokens"]
    discard(counted)
    return first, tokens, alone


def _bytes_of(key: np.ndarray, base: int, probs: np.ndarray, backoff: np.ndarray) -> tuple[bytes, dict]:
    """The bytes of one part of a level and where its arrays lie; backoff has a code for each distinct context."""
    context, word = key // base, key % base
    contexts = int(context[-1] - context[0]) + 1
    starts = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
    sizes = np.diff(np.append(starts, len(key)))
    last = word[starts + sizes - 1]
    origin = np.concatenate(([0], np.cumsum(last + 1)[:-1]))
    values = elias_fano.encode(word + np.repeat(origin, sizes))
    pointers = elias_fano.encode(np.searchsorted(context, np.arange(context[0], context[0] + contexts + 1)))
    dense = np.zeros(contexts, np.uint16)
    dense[context[starts] - context[0]] = backoff
    arrays = {f"{name}_{part}": code[part] for name, code in (("pointers", pointers), ("values", values)) for part in ("words", "ranks", "low")}
    out, offset, where = [], 0, {}
    for name, a in (arrays | {"probs": probs, "backoff": dense}).items():
        raw = a.tobytes()
        raw += b"\0" * (-len(raw) % 8)
        where[name] = (offset, a.dtype.str, len(a))
        out.append(raw)
        offset += len(raw)
    return b"".join(out), {"first_context": int(context[0]), "contexts": contexts, "size": len(key), "pointers": (pointers["n"], pointers["low_bits"]), "values": (values["n"], values["low_bits"]), "arrays": where}


def _level(train: DataFrame, model: Model, parts: _Parts, n: int, discount: float, ranges: Ranges, part_tokens: int):
    """Counts, smooths and keeps level n with the help of the levels below; the ranges of its entries."""
    base = model.types + 1

    def blocks():
        hasher, reader = WordHasher(), model.reader()

        def keys_of(texts):
            hashes, sizes = text_hashes(texts, hasher)
            ids, lowest = reader.lookup(hashes)
            since = since_begin(sizes)
            places, codes, _ = reader.entries(ids, lowest, since, n - 1)
            at = np.flatnonzero(since >= n - 1)
            # What the shorter n-gram has is needed to smooth; the words' own is at hand.
            return places[at - 1] * base + ids[at], codes[at] if n > 2 else None

        return keys_of

    counted = _counted(train, blocks, ranges, part_tokens)
    first, tokens, alone, starts = _ranges_above(counted, part_tokens)
    sizes: dict[int, int] = {}
    for row in counted.select("part", "size").collect():
        at = ranges.range_of(row["part"])
        sizes[at] = sizes.get(at, 0) + row["size"]
    # A context whose words are split is the only one of its parts: how many words it has, and its tokens.
    split = {at: sizes[at] for at in np.flatnonzero(ranges.splits > 1).tolist() if at in sizes}
    follow: dict[int, int] = {}
    for row in counted.select("part", "tokens").collect() if split else []:
        at = ranges.range_of(row["part"])
        if at in split:
            follow[at] = follow.get(at, 0) + row["tokens"]

    def build(row):
        key, times, codes = unpack(row["packed"])
        context, word = key // base, key % base
        begin = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
        m = np.diff(np.append(begin, len(key)))
        totals = np.add.reduceat(times, begin)
        at = ranges.range_of(row["part"])
        if at in split:
            m, totals = np.array([split[at]]), np.array([follow[at]])
        backoff = quantise(np.log10(discount * m / totals))
        if n == 2:
            by = np.argsort(word, kind="stable")
            counts = np.empty(len(word), np.int64)
            counts[by] = model.reader().word_counts(word[by])
            under = (counts + 0.5) / (model.tokens + 0.5 * (model.types + 1))
        else:
            under = 10 ** dequantise(codes)
        of = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(key))))
        p = (times - discount) / totals[of] + 10 ** dequantise(backoff[of]) * under
        return _bytes_of(key, base, quantise(np.log10(np.minimum(p, 1.0))), backoff)

    made = parts.make(counted.select("part", "packed"), f"level{n}", build)
    discard(counted)
    least = ranges.least_keys([meta["part"] for meta in made])
    model.levels.append([meta | {"start": starts[meta["part"]], "least_key": k} for meta, k in zip(made, least, strict=True)])
    return first, tokens, alone


def train_model(train: DataFrame, text_col: str = "text", order: int = ORDER, discount: float = DISCOUNT, part_tokens: int = PART_TOKENS, mounted: bool | None = None) -> Model:
    """A model of the texts of train, kept where the executors of its session read it.

    mounted tells whether executors see the shared folder as a file system;
    by default it is taken from the folder's scheme.
    """
    texts = train.select(F.col(text_col).alias("text"))
    model = Model()
    parts = _Parts(train.sparkSession, model, mounted)
    found = _vocabulary(texts, model, parts, part_tokens)
    words, before = found[0], np.cumsum(found[1]) - found[1]
    for n in range(2, order + 1):
        first, tokens, alone = found
        if len(first) and (int(tokens.sum()) + 1) * (model.types + 1) >= 1 << 63:
            raise ValueError("contexts times words go beyond 63 bits")
        found = _level(texts, model, parts, n, discount, Ranges(first, tokens, alone > 0, model.types + 1, part_tokens, words, before), part_tokens)
    return model


def score(docs: DataFrame, model: Model, keep: list[str | Column], text_col: str = "text") -> DataFrame:
    """The columns keep of every row, with n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.select(*keep, F.col(text_col).alias("__text"))
    names = rows.columns[:-1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, reader = WordHasher(), model.reader()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                texts = part.column(part.num_columns - 1).to_pylist()
                for start, end in text_blocks(texts):
                    hashes, sizes = text_hashes(texts[start:end], hasher)
                    ids, lowest = reader.lookup(hashes)
                    row = np.repeat(np.arange(len(sizes)), sizes)
                    lp = reader.entries(ids, lowest, since_begin(sizes), len(model.levels) + 1)[2]
                    sums = lambda x, n=len(sizes), row=row: np.bincount(row, x, n)
                    columns = [sizes, sums(ids >= 0).astype(np.int64), np.full(len(sizes), model.tokens, np.int64), sums(lowest), sums(lp)]
                    yield pa.RecordBatch.from_arrays(
                        [*(c.slice(start, end - start) for c in part.columns[:-1]), *map(pa.array, columns)], [*names, "n_tokens", "n_known", "train_tokens", "base_score", "score"]
                    )

    schema = rows.drop("__text").schema
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double")):
        schema = schema.add(name, kind)
    return rows.mapInArrow(work, schema)
