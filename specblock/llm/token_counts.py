"""Token counts of a merge-table tokenizer by rank-synchronous array merging.

Pre-tokens of a batch are laid out in one ragged numpy array of symbol ids, in
rows that end where two characters meet that no piece holds side by side: no
merge can cross such a place.  Each round finds the best-ranked adjacent pair
of every row at once, applies it, and retires the rows that have none left;
the symbols that survive are counted.  A pair may be applied at all its places
in a row at once only when no pair with the new symbol could outrank it, which
a table made beforehand tells; otherwise only the leftmost place is taken, so
the result is that of merging one pair at a time.  A row of over `LONG_ROW`
symbols (letters without a space, for instance) would need too many rounds: it
merges one pair at a time from a heap, in about linear time.

Defined results: a null text counts as empty (no bytes, no tokens); null ids
are kept; repeated rows give repeated results; an empty table gives none;
columns other than the id and the text are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The mark that stands for a space.
SPACE = "▁"
NO_RANK = np.iinfo(np.int32).max
#: Pre-tokens kept with their counts in a worker, and the longest one kept.
MEMO_ENTRIES = 600_000
MEMO_CHARS = 64
#: Symbols laid out at once, and the most that a row has in array rounds.
CHUNK_SYMBOLS = 2_000_000
LONG_ROW = 256


class MergeTable:
    """Pair ranks of a model whose pieces merge by score, with byte fallback."""

    def __init__(self, pieces: list[tuple[str, float]]):
        order = sorted({-score for _, score in pieces})
        rank_of_score = {s: i for i, s in enumerate(order)}
        ids = {p: i for i, (p, _) in enumerate(pieces)}
        known = len(ids)
        for piece, _ in pieces:
            for ch in piece:
                ids.setdefault(ch, len(ids))
        ranks = {p: rank_of_score[-s] for p, s in pieces}
        pairs: dict[tuple[int, int], tuple[int, int]] = {}
        unsafe = np.zeros(len(ids) + 1, bool)
        for piece, _ in pieces:
            rank = ranks[piece]
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                if left in ids and right in ids:
                    pairs[ids[left], ids[right]] = (rank, ids[piece])
                    for part in (left, right):
                        if ranks.get(part, -1) >= rank:
                            unsafe[ids[part]] = True
        self.other = len(ids)  # every character that no piece holds
        self.base = self.other + 1
        keys = np.array([a * self.base + b for a, b in pairs], np.int64)
        by = np.argsort(keys)
        self.keys = keys[by]
        self.rank = np.array([r for r, _ in pairs.values()], np.int32)[by]
        self.made = np.array([m for _, m in pairs.values()], np.int32)[by]
        self.unsafe = unsafe
        self.known = known
        chars = {ch: i for ch, i in ids.items() if len(ch) == 1}
        self.char_codes = np.array(sorted(map(ord, chars)), np.int64)
        self.char_ids = np.array([chars[chr(c)] for c in self.char_codes], np.int32)
        #: Characters that stand side by side in a piece.
        inner = {(ord(a) << 21) + ord(b) for p, _ in pieces for a, b in zip(p, p[1:], strict=False)}
        self.inner = np.array(sorted(inner), np.int64)
        #: Spaces lead their word in every piece, and no piece holds a newline.
        self.splits_words = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _ in pieces)
        self.splits_lines = not any("\n" in p for p, _ in pieces)

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.char_codes, codes), len(self.char_codes) - 1)
        return np.where(self.char_codes[at] == codes, self.char_ids[at], self.other)

    def meets(self, codes: np.ndarray) -> np.ndarray:
        """Whether each character and the next can be in one piece."""
        key = (codes[:-1] << 21) + codes[1:]
        if not len(self.inner):
            return np.zeros(len(key), bool)
        return self.inner[np.minimum(np.searchsorted(self.inner, key), len(self.inner) - 1)] == key

    @cached_property
    def merges(self) -> dict[int, tuple[int, int]]:
        """(rank, made) of each pair."""
        return dict(zip(self.keys.tolist(), zip(self.rank.tolist(), self.made.tolist(), strict=True), strict=True))

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], NO_RANK), self.made[at]


def sentencepiece_table(model_file: str) -> MergeTable:
    """The table of a sentencepiece BPE model that keeps text as it is.

    A model with another normalizer would need it applied first; such a model
    is refused.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    probe = "A  ﬁÅ a "
    if "".join(sp.encode(probe, out_type=str)) != SPACE + probe.replace(" ", SPACE):
        raise ValueError("the model rewrites text before it merges")
    special = lambda i: sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)
    return MergeTable([(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not special(i)])


def count_pretokens(table: MergeTable, words: list[str]) -> np.ndarray:
    """Tokens of each pre-token (no empty ones)."""
    out = np.empty(len(words), np.int64)
    start = 0
    while start < len(words):
        end, size = start, 0
        while end < len(words) and (end == start or size + len(words[end]) <= CHUNK_SYMBOLS):
            size += len(words[end])
            end += 1
        out[start:end] = _count_chunk(table, words[start:end])
        start = end
    return out


def _merge_long(table: MergeTable, symbol: list[int]) -> list[int]:
    """Where symbols survive in one row: its pairs merge best rank first, leftmost of equal ones."""
    merges, base, n = table.merges, table.base, len(symbol)
    after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
    heap = []

    def consider(left: int) -> None:
        key = symbol[left] * base + symbol[after[left]]
        if key in merges:
            heapq.heappush(heap, (merges[key][0], left, key))

    for left in range(n - 1):
        consider(left)
    while heap:
        _, left, key = heapq.heappop(heap)
        right = after[left]
        if right == n or symbol[left] * base + symbol[right] != key:
            continue  # one of the two has merged meanwhile
        symbol[left], symbol[right] = merges[key][1], -1
        after[left] = then = after[right]
        if then < n:
            before[then] = left
            consider(left)
        if before[left] >= 0:
            consider(before[left])
    return [i for i in range(n) if symbol[i] >= 0]


def _count_chunk(table: MergeTable, words: list[str]) -> np.ndarray:
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    length = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(length) - length
    begins = np.append(True, ~table.meets(codes))
    begins[starts] = True
    starts = np.searchsorted(np.flatnonzero(begins), starts)
    total = _count_rows(table, codes, np.cumsum(begins) - 1)
    return np.add.reduceat(total, starts)


def _count_rows(table: MergeTable, codes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Tokens of each row of characters, which are numbered from 0."""
    symbol = table.symbols(codes)
    # A character outside the vocabulary never merges; it falls back to its bytes.
    width = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
    n_rows = int(row[-1]) + 1
    total, sizes = np.zeros(n_rows, np.int64), np.bincount(row)
    if sizes.max() > LONG_ROW:
        ends = np.cumsum(sizes)
        for each in np.flatnonzero(sizes > LONG_ROW).tolist():
            own = slice(ends[each] - sizes[each], ends[each])
            left = _merge_long(table, merged := symbol[own].tolist())
            wide = width[own].tolist()
            total[each] = sum(1 if merged[i] < table.known else wide[i] for i in left)
        short = sizes[row] <= LONG_ROW
        symbol, width, row = symbol[short], width[short], row[short]
    while len(symbol):
        rank, made = table.pair_ranks(symbol[:-1], symbol[1:])
        rank[row[:-1] != row[1:]] = NO_RANK
        rank = np.append(rank, NO_RANK).astype(np.int32)
        made = np.append(made, 0)
        starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        best = np.minimum.reduceat(rank, starts)
        per_row = np.diff(np.append(starts, len(row)))
        done = np.repeat(best == NO_RANK, per_row)
        if done.any():
            counted = np.where(symbol[done] < table.known, 1, width[done])
            total += np.bincount(row[done], counted, n_rows).astype(np.int64)
            keep = ~done
            symbol, row, width, rank, made = symbol[keep], row[keep], width[keep], rank[keep], made[keep]
            alive = best != NO_RANK
            best, per_row = best[alive], per_row[alive]
            if not len(symbol):
                break
            starts = np.cumsum(per_row) - per_row
        chosen = np.flatnonzero(rank == np.repeat(best, per_row))
        chosen_row = row[chosen]
        first = np.append(True, chosen_row[1:] != chosen_row[:-1])
        run_start = np.append(True, (np.diff(chosen) != 1) | first[1:])
        in_run = np.arange(len(chosen)) - np.flatnonzero(run_start)[np.cumsum(run_start) - 1]
        single = table.unsafe[made[chosen]]
        # A row whose first choice is unsafe, or that mixes pieces of one rank, takes the leftmost only.
        row_index = np.cumsum(first) - 1
        mixed = np.append(False, (made[chosen][1:] != made[chosen][:-1]) & ~first[1:])
        alone = np.zeros(row_index[-1] + 1, bool)
        np.logical_or.at(alone, row_index[single | mixed], True)
        take = np.where(alone[row_index], first, in_run % 2 == 0)
        at = chosen[take]
        symbol[at] = made[at]
        keep = np.ones(len(symbol), bool)
        keep[at + 1] = False
        symbol, row, width = symbol[keep], row[keep], width[keep]
    return total


def text_counter(table: MergeTable):
    """A function from texts to token counts, with a bounded memo of words."""
    if table.splits_words:
        inner = f"[^{SPACE}\n]" if table.splits_lines else f"[^{SPACE}]"
        pattern = re.compile(f"{SPACE}*{inner}+|{SPACE}+" + ("|\n" if table.splits_lines else ""))
    else:
        pattern = re.compile("(?s:.+)")
    memo: dict[str, int] = {}

    def count(texts: list[str | None]) -> list[int]:
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        parts = [pattern.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        new = list({w for p in parts for w in p if w not in memo})
        fresh: dict[str, int] = dict(zip(new, count_pretokens(table, new).tolist(), strict=True))
        memo.update((w, n) for w, n in fresh.items() if len(w) <= MEMO_CHARS)
        if all(len(w) <= MEMO_CHARS for w in new):
            return [sum(map(memo.__getitem__, p)) for p in parts]
        return [sum(memo[w] if w in memo else fresh[w] for w in p) for p in parts]

    return count


def token_counts(docs: DataFrame, model_file: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs."""
    table = sentencepiece_table(model_file)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = text_counter(table)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(1).to_pylist()
                n_tokens = np.array(count(texts), np.int64)
                n_bytes = [len(t.encode()) if t else 0 for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens), pa.array(n_tokens > limit)],
                    ["id", "n_bytes", "n_tokens", "over_limit"],
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(work, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
