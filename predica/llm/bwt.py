"""Burrows-Wheeler transform and common prefixes of a collection, column by column.

One symbol of each document is inserted each round, from the last symbol to the first. The transform and the array of
longest common prefixes with the row before live in two files that a round reads and writes once, in sequence and in
blocks; in memory are a block and a few numbers for each document.

A row is a suffix. In round j the symbol before each document's current suffix is put in front of it; where the new
suffix goes follows from the number of equal symbols above its row (its rank), and its common prefix with the new
neighbours is one more than the least common prefix between its row and the nearest equal symbols above and below.
"""

from __future__ import annotations

import tempfile

import numpy as np

BLOCK = 1 << 20
#: Common prefixes are counted up to this length.
LONGEST = 254


def _least(table: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minima of table[0][low : high + 1]; table[k] has those of 2**k elements, and grows as needed."""
    span = high - low + 1
    level = np.frexp(span.astype(np.float64))[1] - 1
    while len(table) <= level.max(initial=0):
        half, last = 1 << (len(table) - 1), table[-1]
        table.append(np.minimum(last[:-half], last[half:]))
    out = np.empty(len(low), np.uint8)
    for k in np.flatnonzero(np.bincount(level, minlength=1)):
        own = level == k
        out[own] = np.minimum(table[k][low[own]], table[k][high[own] - (1 << int(k)) + 1])
    return out


class _Files:
    """A row is two bytes, symbol and common prefix, in the file that is read, and in the one that the next round writes."""

    def __init__(self, folder: str | None):
        self.now, self.next = tempfile.TemporaryFile(dir=folder, buffering=0), tempfile.TemporaryFile(dir=folder, buffering=0)

    def blocks(self, rows: int):
        self.now.seek(0)
        for at in range(0, rows, BLOCK):
            yield at, np.fromfile(self.now, np.uint16, min(BLOCK, rows - at))

    def write(self, rows: np.ndarray) -> None:
        rows.tofile(self.next)

    def turn(self) -> None:
        self.now, self.next = self.next, self.now
        self.next.seek(0)

    def close(self) -> None:
        self.now.close()
        self.next.close()


def _places(order: np.ndarray, first: np.ndarray, number: np.ndarray, row: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Places of rows in order, which lists rows by symbol, then row; `first` and `number` of each symbol."""
    out = np.empty(len(row), np.int64)
    by_symbol = np.argsort(symbol, kind="stable")
    cuts = np.searchsorted(symbol[by_symbol], np.arange(257))
    for c in np.flatnonzero(np.diff(cuts)):
        own = by_symbol[cuts[c] : cuts[c + 1]]
        out[own] = first[c] + np.searchsorted(order[first[c] : first[c] + number[c]], row[own])
    return out


def _ranks(files: _Files, rows: int, at: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For documents in order of their rows `at`: rank of their symbol, common prefix with the nearest equal symbol above
    and below and whether there is one below; and the number of each symbol."""
    n = len(at)
    rank, above, below, has_below = np.empty(n, np.int64), np.zeros(n, np.uint8), np.zeros(n, np.uint8), np.zeros(n, bool)
    count, since = np.zeros(256, np.int64), np.full(256, 255, np.uint8)
    waits, waiting = np.full(256, -1), np.full(256, 255, np.uint8)
    cut = np.searchsorted(at, [*range(0, rows, BLOCK), rows])
    for i, (start, block) in enumerate(files.blocks(rows)):
        symbols, prefixes = (block >> 8).astype(np.uint8), (block & 255).astype(np.uint8)
        own = slice(cut[i], cut[i + 1])
        row, c = at[own] - start, symbol[own].astype(np.int64)
        order, number = np.argsort(symbols, kind="stable"), np.bincount(symbols, minlength=256)
        first = np.cumsum(number) - number
        place = _places(order, first, number, row, symbol[own])
        rank[own] = count[c] + place - first[c]
        near, last = place > first[c], place + 1 == first[c] + number[c]
        table, value = [prefixes], np.zeros(len(row), np.uint8)
        value[near] = _least(table, order[place[near] - 1] + 1, row[near])
        if i:  # the symbol's last row above may be in an earlier block
            value = np.where(near, value, np.minimum(since[c], np.minimum.accumulate(prefixes)[row])).astype(np.uint8)
        above[own] = np.where(near | (count[c] > 0), value + 1, 0)
        value = np.zeros(len(row), np.uint8)
        value[~last] = _least(table, row[~last] + 1, order[place[~last] + 1])
        below[own], has_below[own] = value + 1, ~last
        if rows > BLOCK:
            upto, ends = np.minimum.accumulate(prefixes), np.append(np.minimum.accumulate(prefixes[::-1])[::-1], np.uint8(255))
            seen = number > 0
            held = np.flatnonzero((waits >= 0) & seen)  # documents that wait for their symbol's next row
            below[waits[held]] = np.minimum(waiting[held], upto[order[first[held]]]) + 1
            has_below[waits[held]] = True
            waits[held] = -1
            waiting = np.minimum(waiting, prefixes.min())
            waits[c[last]] = np.flatnonzero(last) + cut[i]
            waiting[c[last]] = ends[row[last] + 1]
            since = np.where(seen, ends[order[np.maximum(first + number - 1, 0)] + 1], np.minimum(since, prefixes.min())).astype(np.uint8)
        count += number
    return rank, np.minimum(above, LONGEST), np.minimum(below, LONGEST), has_below, count


def _merge(files: _Files, rows: int, at: np.ndarray, symbols: np.ndarray, above: np.ndarray, below: np.ndarray, has_below: np.ndarray) -> None:
    """Inserts rows at their final places `at`, in increasing order, and sets the common prefixes of the rows after them."""
    slot = at - np.arange(len(at))  # old rows before each new one
    inserted = symbols.astype(np.uint16) << 8 | above
    later, value = at[has_below] + 1, below[has_below]
    done = 0
    for start, old_rows in files.blocks(rows):
        end = start + len(old_rows)
        lo, hi = np.searchsorted(slot, start, "left"), len(slot) if end == rows else np.searchsorted(slot, end, "left")
        size = len(old_rows) + hi - lo
        old = np.ones(size, bool)
        old[at[lo:hi] - done] = False
        out = np.empty(size, np.uint16)
        out[old] = old_rows
        out[at[lo:hi] - done] = inserted[lo:hi]
        a, b = np.searchsorted(later, [done, done + size])
        changed = later[a:b] - done
        out[changed] = out[changed] & 0xFF00 | value[a:b]
        files.write(out)
        done += size
    files.turn()


def collection_bwt(texts: np.ndarray, lengths: np.ndarray, folder: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(transform, common prefixes) of documents of at most LONGEST symbols, none of them 0.

    texts: their symbols one after another. Row i < len(lengths) is document i's end; a document's first suffix has the
    symbol 0. Ends differ from each other, so no common prefix goes past one.
    """
    n = len(lengths)
    ends = np.cumsum(lengths)
    files = _Files(folder)
    try:
        files.write(np.where(lengths > 0, texts[np.maximum(ends, 1) - 1] if len(texts) else 0, 0).astype(np.uint16) << 8)
        files.turn()
        rows, who, at = n, np.flatnonzero(lengths > 0), np.flatnonzero(lengths > 0)
        for j in range(int(lengths.max(initial=0))):
            symbol = texts[ends[who] - 1 - j]
            rank, above, below, has_below, count = _ranks(files, rows, at, symbol)
            count[0] = 0
            at = n + (np.cumsum(count) - count)[symbol] + rank
            order = np.argsort(at, kind="stable")
            who, at = who[order], at[order]
            more = lengths[who] > j + 1
            before = np.where(more, texts[np.maximum(ends[who] - 2 - j, 0)], 0).astype(np.uint8)
            _merge(files, rows, at, before, above[order], below[order], has_below[order])
            rows += len(who)
            who, at = who[more], at[more]
        found = np.concatenate([block for _, block in files.blocks(rows)] or [np.zeros(0, np.uint16)])
        return (found >> 8).astype(np.uint8), (found & 255).astype(np.uint8)
    finally:
        files.close()


def suffix_rows(transform: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(documents, longest length + 1) rows of each document's suffixes by their length; -1 past the document."""
    n, number = len(lengths), np.bincount(transform, minlength=256)
    number[0] = 0
    first = n + np.cumsum(number) - number
    order = np.argsort(transform, kind="stable")
    order = order[np.count_nonzero(transform == 0) :]
    step = np.empty(len(transform), np.int64)
    step[order] = first[1:].min(initial=n) + np.arange(len(order)) if len(order) else n
    out = np.full((n, int(lengths.max(initial=0)) + 1), -1)
    out[:, 0] = np.arange(n)
    for j in range(1, out.shape[1]):
        live = lengths >= j
        out[live, j] = step[out[live, j - 1]]
    return out
