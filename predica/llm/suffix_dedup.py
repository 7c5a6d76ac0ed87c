"""Removal of repeated byte strings by suffix sorting, column by column over many documents.

A byte goes if a string of `length` bytes that covers it also starts earlier: in a document of smaller id, or earlier in
the same one. The result is exact and judged on the input.

1. Anchors. Every window of `length` bytes has an anchor, the least of its GRAM-byte strings by a rolling hash; equal
   windows have the same anchor in the same place. Neighbouring windows with one anchor make a segment: the bytes they
   cover. A scan task packs its segments (anchor, place) by anchor and combines those of equal bytes, so a passage that a
   third of all rows hold is one entry a task.
2. Owners of anchors tell which ones several entries share; their bytes are fetched, once each. Where more than HOT entries
   share an anchor, each is cut into RANGES smaller segments by how far their windows reach to the left of the anchor; the
   windows of a range have further bytes in common, by which entries are dealt out, so one passage with many surroundings
   is many small groups.
3. Of fetched segments of equal bytes all but the first place go as a whole. The others are the documents of collections in
   bwt.collection_bwt(): one symbol of each is inserted a round, and transform and common prefixes are updated through
   sequential files. Windows whose suffixes have a common prefix of a whole window are equal; all but the first place go.
   The anchor, equal in all of a group and compared byte by byte, is written as a few symbols that number the group.
4. The places are brought back to the documents.

Hashes only bring together what may be equal; whatever is removed was compared byte by byte.

Whole-collection construction would take a round for each symbol of the longest document, each over all rows so far;
segments keep it to less than two windows' rounds over files of a few MB, and make it work on any number of machines.

Scale: shuffles carry compressed columns: anchors once, texts at most twice, and only those of documents that take part
(told apart by bit tables of at most 2**MAX_TABLE_BITS bits, the only broadcasts). Tasks hold one partition's columns and
one collection; a collection is COLLECTION bytes, or one group of different segments with the same anchor (of a hot one,
with the same further bytes too). Collections' files are in Spark's local folders.

Defined cases: null text is empty; texts shorter than a window lose nothing; repeated or null ids are first numbered in
order of (id, text), null first, and so are ids that aren't integers; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bwt import collection_bwt, suffix_rows
from .common import bit_table, checkpointed, in_bit_table, shuffle_partitions

LENGTH = 100
GRAM = 32
#: Bytes that are hashed together, that are packed together, and of a collection.
CHUNK, PACK, COLLECTION = 1 << 18, 1 << 24, 1 << 20
#: Entries of an anchor from which on their segments are cut, and into how many.
HOT, RANGES = 4096, 8
_P = 0x9E3779B97F4A7C15
_LOW = np.uint64((1 << 24) - 1)
SCHEMA = "key long, kind int, id long, body binary"
ANCHORS, SPANS, WANTED, TEXT, SEGMENTS = range(5)


def _mix(h: np.ndarray) -> np.ndarray:
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def pack_columns(*columns: np.ndarray) -> bytes:
    """Equally long arrays, compressed by byte planes."""
    press = zstandard.ZstdCompressor(level=1)
    out = [np.array([len(columns), len(columns[0])], np.int64).tobytes()]
    for c in columns:
        body = press.compress(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T).tobytes())
        out += [np.array([len(body)], np.int64).tobytes(), c.dtype.str.encode().ljust(8), body]
    return b"".join(out)


def unpack_columns(body: bytes) -> list[np.ndarray]:
    number, n = np.frombuffer(body, np.int64, 2)
    at, out, press = 16, [], zstandard.ZstdDecompressor()
    for _ in range(number):
        size, kind = int(np.frombuffer(body, np.int64, 1, at)[0]), np.dtype(body[at + 8 : at + 16].decode().strip())
        planes = np.frombuffer(press.decompress(body[at + 16 : at + 16 + size], max_output_size=max(1, int(n) * kind.itemsize)), np.uint8)
        out.append(np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind).ravel())
        at += 16 + size
    return out


def segments(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(start, size, anchor's place in it, anchor's hash, hash of its bytes) of the segments of documents that end at
    `ends` in data, at most 2**24 bytes."""
    n = len(data)
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    if n < length:
        return none
    power = np.full(n + 1, _P, np.uint64)
    inverse = np.full(n + 1, pow(_P, -1, 1 << 64), np.uint64)
    power[0] = inverse[0] = 1
    power, inverse = np.cumprod(power, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    of = lambda a, b: _mix((sums[b] - sums[a]) * inverse[a])
    grams = n - gram + 1
    value = (_mix((sums[gram:] - sums[:-gram]) * inverse[:grams]) & ~_LOW) | np.arange(grams, dtype=np.uint64)
    width, windows = length - gram + 1, n - length + 1
    rows = np.concatenate((value, np.full(-grams % width, np.iinfo(np.uint64).max))).reshape(-1, width)
    upto = np.minimum.accumulate(rows, axis=1).ravel()
    onward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(onward[:windows], upto[width - 1 : width - 1 + windows])
    new = np.ones(windows, bool)
    new[1:] = least[1:] != least[:-1]
    # A window that crosses a document's end isn't one; a document's first window begins a segment.
    inside = np.ones(windows, bool)
    for e in ends[:-1]:
        inside[max(0, e - length + 1) : e] = False
    begins = np.concatenate(([0], ends[:-1]))
    new[begins[begins < windows]] = True
    first = np.flatnonzero(new & inside)
    if not len(first):
        return none
    stops = np.flatnonzero(np.append(new[1:] | ~inside[1:], True) & inside)
    last = stops[np.searchsorted(stops, first)]
    size = last - first + length
    anchor = (least[first] & _LOW).astype(np.int64)
    return first, size, anchor - first, least[first] >> np.uint64(24), of(first, first + size)


def _numbers_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (_mix(keys.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _rows(items: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*items)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["key", "kind", "id", "body"])


def _dealt(kind: int, numbers: np.ndarray, *columns: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    """A row of packed columns for each number."""
    order = np.argsort(numbers, kind="stable")
    cuts = np.flatnonzero(np.diff(numbers[order], prepend=-1, append=-1))
    return [(int(numbers[order[a]]), kind, -1, pack_columns(*(c[order[a:b]] for c in columns))) for a, b in zip(cuts, cuts[1:])]


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the strings of `size` bytes at a and b are equal."""
    out = np.ones(len(a), bool)
    total = np.cumsum(size)
    low = 0
    while low < len(a):
        high = max(low + 1, int(np.searchsorted(total, total[low] + (1 << 20))))
        own = size[low:high]
        at = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        differ = data[np.repeat(a[low:high], own) + at] != data[np.repeat(b[low:high], own) + at]
        out[low:high] = ~np.logical_or.reduceat(differ, np.cumsum(own) - own)
        low = high
    return out


def _combined(data: np.ndarray, anchor: np.ndarray, body: np.ndarray, ids: np.ndarray, start: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by anchor, bytes' hash and place; whether a row isn't equal, byte by byte, to the first of its hash)."""
    order = np.lexsort((start, ids, body, anchor))
    a, b = anchor[order], body[order]
    first = np.ones(len(order), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    head = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
    rest = np.flatnonzero(~first)
    fits = size[order[rest]] == size[head[rest]]
    first[rest[~fits]] = True
    rest = rest[fits]
    first[rest[~same_bytes(data, at[order[rest]], at[head[rest]], size[order[rest]])]] = True
    return order, first


def _scanner(length: int, gram: int, buckets: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []
        datas: list[np.ndarray] = []
        chunk: list[tuple[int, int, bytes]] = []  # id, place in its text, bytes
        sizes = [0, 0, 0]  # bytes of the chunk, of the pack, and of the pack before the chunk

        def hashed() -> None:
            ends = np.cumsum([len(b) for _, _, b in chunk])
            datas.append(np.frombuffer(b"".join(b for _, _, b in chunk), np.uint8))
            first, size, place, anchor, body = segments(datas[-1], ends, length, gram)
            document = np.searchsorted(ends, first, side="right")
            shift = np.array([at for _, at, _ in chunk]) - np.concatenate(([0], ends[:-1]))
            found.append((anchor, body, np.array([i for i, _, _ in chunk], np.int64)[document], first + shift[document], size, place.astype(np.uint8), first + sizes[2]))
            chunk.clear()
            sizes[2] += sizes[0]
            sizes[0] = 0

        def packed() -> Iterator[pa.RecordBatch]:
            if not found:
                return
            anchor, body, ids, start, size, place, at = (np.concatenate(c) for c in zip(*found))
            order, first = _combined(np.concatenate(datas), anchor, body, ids, start, size, at)
            found.clear()
            datas.clear()
            sizes[1] = sizes[2] = 0
            again, own = order[~first], order[first]
            short = size.astype(np.uint16)
            yield _rows(_dealt(ANCHORS, _numbers_of(anchor[own], buckets), *(c[own] for c in (anchor, ids, start, short, place))) + _dealt(SPANS, _numbers_of(ids[again], buckets), ids[again], start[again], start[again] + size[again]))

        for batch in batches:
            for number, text in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist()):
                text = text or b""
                for at in range(0, max(1, len(text) - length + 1), 1 << 23):  # windows of a very long text go in blocks
                    part = text[at : at + (1 << 23) + length - 1] if len(text) > 1 << 23 else text
                    chunk.append((number, at, part))
                    sizes[0] += len(part)
                    sizes[1] += len(part)
                    if sizes[0] >= CHUNK:
                        hashed()
                    if sizes[1] >= PACK:
                        if chunk:
                            hashed()
                        yield from packed()
        if chunk:
            hashed()
        yield from packed()

    return scan


def _owner(buckets: int):
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            passed = [r for r in zip(*(c.to_pylist() for c in batch.columns))]
            parts += [unpack_columns(r[3]) for r in passed if r[1] == ANCHORS]
            yield _rows([r for r in passed if r[1] != ANCHORS])
        if not parts:
            return
        anchor, ids, start, size, place = (np.concatenate(c) for c in zip(*parts))
        parts.clear()
        order = np.argsort(anchor, kind="stable")
        a = anchor[order]
        edges = np.append(np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))), len(a))
        number = np.repeat(np.diff(edges), np.diff(edges))
        kept, hot = order[number > 1], (number > HOT)[number > 1]
        yield _rows(_dealt(WANTED, _numbers_of(ids[kept], buckets), ids[kept], start[kept], size[kept], place[kept], anchor[kept], hot))

    return own


def ranges_of(body: bytes, place: int, anchor: int, length: int, gram: int) -> Iterator[tuple[int, int, int, int]]:
    """(key, first byte, past the last, anchor's place) of the smaller segments: one for each range of bytes that windows
    have before the anchor; windows of a range share the least number before it and after it, which make the key."""
    width = length - gram
    cuts = [round(k * (width + 1) / RANGES) for k in range(RANGES + 1)]
    for low, past in zip(cuts, cuts[1:]):
        high = past - 1
        begin, end = max(0, place - high), min(len(body), place + gram + width - low)
        if place - begin >= low and end - place - gram >= width - high and end - begin >= length and past > low:
            shared = body[place - low : place + gram + width - high]
            yield xxhash.xxh64_intdigest(shared, anchor & 0xFFFFFFFF ^ low), begin, end, place - begin


def _fetcher(length: int, gram: int, buckets: int):
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, parts = {}, []
        for batch in batches:
            for _, kind, number, body in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == TEXT:
                    texts[number] = body
                else:
                    parts.append(unpack_columns(body))
        if not parts:
            return
        ids, start, size, place, anchor, hot = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(ids, kind="stable")
        press, held, opened, bodies = zstandard.ZstdDecompressor(), None, b"", [b""] * len(ids)
        for i in order.tolist():
            if ids[i] != held:
                held = ids[i]
                opened = press.decompress(texts[int(held)])
            bodies[i] = opened[start[i] : start[i] + size[i]]
        texts.clear()
        cold = np.flatnonzero(~hot)
        yield from sent(anchor[cold], ids[cold], start[cold], size[cold], place[cold], [bodies[i] for i in cold])
        for at in range(0, int(hot.sum()), 1 << 16):
            smaller = [(key, int(ids[i]), int(start[i]) + a, b - a, at_, bodies[i][a:b]) for i in np.flatnonzero(hot)[at : at + (1 << 16)].tolist() for key, a, b, at_ in ranges_of(bodies[i], int(place[i]), int(anchor[i]), length, gram)]
            if smaller:
                columns = list(zip(*smaller))
                yield from sent(*(np.array(c, t) for c, t in zip(columns, (np.uint64, np.int64, np.int64, np.uint16, np.uint8))), list(columns[5]))

    def sent(anchor: np.ndarray, ids: np.ndarray, start: np.ndarray, size: np.ndarray, place: np.ndarray, bodies: list[bytes]) -> Iterator[pa.RecordBatch]:
        numbers = _numbers_of(anchor, buckets)
        order = np.argsort(numbers, kind="stable")
        cuts = np.flatnonzero(np.diff(numbers[order], prepend=-1, append=-1))
        pack = zstandard.ZstdCompressor(level=1)
        for a, b in zip(cuts, cuts[1:]):
            own = order[a:b]
            columns = pack_columns(anchor[own], ids[own], start[own], size[own], place[own])
            yield _rows([(int(numbers[own[0]]), SEGMENTS, len(columns), columns + pack.compress(b"".join(bodies[i] for i in own)))])

    return fetch


def _groups(anchor: np.ndarray, data: np.ndarray, at: np.ndarray, gram: int) -> np.ndarray:
    """Numbers of the groups of segments, in order of anchor: equal anchors' hashes whose bytes, at `at`, are equal too."""
    new = np.ones(len(anchor), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    group = np.cumsum(new) - 1
    head = np.flatnonzero(new)[group]
    grid = at[:, None] + np.arange(gram)
    odd = np.flatnonzero((data[grid] != data[grid[head]]).any(axis=1))
    others: dict[tuple[int, bytes], int] = {}
    for i in odd.tolist():
        group[i] = others.setdefault((int(anchor[i]), data[grid[i]].tobytes()), int(new.sum()) + len(others))
    return group


def repeated_windows(data: np.ndarray, sizes: np.ndarray, places: np.ndarray, group: np.ndarray, ids: np.ndarray, starts: np.ndarray, length: int, gram: int) -> np.ndarray:
    """(segment, window) pairs of the windows that also start earlier in another segment of the collection."""
    n, ends = len(sizes), np.cumsum(sizes)
    begin = ends - sizes
    present = np.flatnonzero(np.bincount(data, minlength=256))
    code = np.zeros(256, np.uint8)
    code[present] = np.arange(1, len(present) + 1)
    group = np.unique(group, return_inverse=True)[1]
    base, digits = 254 - len(present), 1
    while base**digits <= group.max():
        digits += 1
    short = sizes - gram + digits
    short_end = np.cumsum(short)
    short_begin = short_end - short
    text = np.empty(int(short_end[-1]), np.uint8)
    owner = np.repeat(np.arange(n), sizes)
    offset = np.arange(len(data)) - begin[owner]
    outside = (offset < places[owner]) | (offset >= places[owner] + gram)
    where = short_begin[owner] + offset + np.where(offset >= places[owner] + gram, digits - gram, 0)
    text[where[outside]] = code[data[outside]]
    left = group.copy()
    for k in range(digits):
        text[short_begin + places + k] = len(present) + 1 + left % base
        left //= base
    transform, prefixes = collection_bwt(text, short, os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
    rows = suffix_rows(transform, short)
    whole = length - gram + digits
    windows = sizes - length + 1
    segment = np.repeat(np.arange(n), windows)
    window = np.arange(len(segment)) - np.repeat(np.cumsum(windows) - windows, windows)
    row = rows[segment, short[segment] - window]
    run = np.cumsum(prefixes < whole)[row]  # rows of one run begin with the same window
    order = np.lexsort((starts[segment] + window, ids[segment], run))
    later = np.zeros(len(order), bool)
    later[1:] = run[order[1:]] == run[order[:-1]]
    again = order[later]
    return np.stack([segment[again], window[again]], axis=1)


def _comparer(length: int, gram: int, buckets: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, datas, press = [], [], zstandard.ZstdDecompressor()
        for batch in batches:
            for _, _, cut, body in zip(*(c.to_pylist() for c in batch.columns)):
                parts.append(unpack_columns(body[:cut]))
                datas.append(np.frombuffer(press.decompress(body[cut:]), np.uint8))
        if not parts:
            return
        anchor, ids, starts, sizes, places = (np.concatenate(c) for c in zip(*parts))
        data = np.concatenate(datas)
        parts.clear()
        datas.clear()
        sizes, places = sizes.astype(np.int64), places.astype(np.int64)
        begin = np.cumsum(sizes) - sizes
        # Segments of equal bytes: all but the first place go.
        seen: set[tuple[int, bytes]] = set()
        copies = np.zeros(len(anchor), bool)
        for i in np.lexsort((starts, ids)).tolist():
            key = int(anchor[i]), data[begin[i] : begin[i] + sizes[i]].tobytes()
            copies[i] = key in seen
            seen.add(key)
        seen.clear()
        yield _rows(_dealt(SPANS, _numbers_of(ids[copies], buckets), ids[copies], starts[copies], starts[copies] + sizes[copies]))
        order = np.argsort(anchor, kind="stable")
        order = order[~copies[order]]
        a = anchor[order]
        alone = np.concatenate(([True], a[1:] != a[:-1])) & np.concatenate((a[1:] != a[:-1], [True]))
        order = order[~alone]
        if not len(order):
            return
        a = anchor[order]
        edges = np.append(np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))), len(order))
        total = np.concatenate(([0], np.cumsum(sizes[order])))
        a = 0
        while a < len(order):
            b = int(edges[max(np.searchsorted(edges, a, side="right"), np.searchsorted(edges, np.searchsorted(total, total[a] + COLLECTION), side="right") - 1)])
            own = order[a:b]
            a = b
            owner = np.repeat(np.arange(len(own)), sizes[own])
            taken = data[np.repeat(begin[own] - (np.cumsum(sizes[own]) - sizes[own]), sizes[own]) + np.arange(len(owner))]
            group = _groups(anchor[own], taken, np.cumsum(sizes[own]) - sizes[own] + places[own], gram)
            pairs = repeated_windows(taken, sizes[own], places[own], group, ids[own], starts[own], length, gram)
            if len(pairs):
                i = own[pairs[:, 0]]
                at = starts[i] + pairs[:, 1]
                order2 = np.lexsort((at, ids[i]))
                number, at = ids[i][order2], at[order2]
                new = np.flatnonzero(np.concatenate(([True], (number[1:] != number[:-1]) | (at[1:] > at[:-1] + length))))
                last = np.append(new[1:], len(at)) - 1
                yield _rows(_dealt(SPANS, _numbers_of(number[new], buckets), number[new], at[new], at[last] + length))

    return compare


def _removed(size: int, spans: np.ndarray) -> np.ndarray:
    """Maximal runs (from, to) of removed bytes; spans in any order."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.concatenate(([True], spans[1:, 0] > reach[:-1])))
    return np.stack([spans[new, 0], np.append(reach[new[1:] - 1], reach[-1])], axis=1)


RESULT = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, stop: long>>, kept binary"


def _finisher(with_kept: bool):
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, whole, parts, press = {}, {}, [], zstandard.ZstdDecompressor()
        for batch in batches:
            for _, kind, number, body in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == TEXT:
                    size, digest = int.from_bytes(body[:8], "little"), body[8:40]
                    texts[number], whole[number] = body[40:], (size, digest)
                else:
                    parts.append(unpack_columns(body))
        ids, start, stop = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3
        order = np.argsort(ids, kind="stable")
        ids, spans = ids[order], np.stack([start[order], stop[order]], axis=1).astype(np.int64)
        out = []
        for number, (size, digest) in whole.items():
            a, b = np.searchsorted(ids, [number, number + 1])
            runs, kept = np.zeros((0, 2), np.int64), None
            if b > a:
                runs = _removed(size, spans[a:b])
                text = press.decompress(texts[number])
                edges = [0, *runs.ravel().tolist(), size]
                kept = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2]))
                digest = hashlib.sha256(kept).digest()
            elif with_kept:
                kept = press.decompress(texts[number]) if size else b""
            out.append((number, size, int((runs[:, 1] - runs[:, 0]).sum()), len(runs), digest.hex(), [{"start": x, "stop": y} for x, y in runs.tolist()], kept if with_kept else None))
            if len(out) == 2000:
                yield table(out)
                out = []
        yield table(out)

    def table(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 7, kinds)], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    return finish


def _sender(buckets: int, wanted, with_head: bool, everything: bool):
    """Rows of the texts whose ids are in the bit table; with a head (size, digest), rows of all texts."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = batch.column("id").to_numpy()
            hit = in_bit_table(wanted.value, _mix(ids.astype(np.uint64)))
            keys, texts = _numbers_of(ids, buckets), batch.column("text").cast(pa.large_binary())
            out, held = [], 0
            for i in range(len(ids)) if with_head else np.flatnonzero(hit).tolist():
                text = texts[i].as_py() or b""
                head = len(text).to_bytes(8, "little") + hashlib.sha256(text).digest() if with_head else b""
                out.append((int(keys[i]), TEXT, int(ids[i]), head + (press.compress(text) if hit[i] or everything else b"")))
                held += len(out[-1][3])
                if held > 1 << 22:
                    yield _rows(out)
                    out, held = [], 0
            yield _rows(out)

    return send


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """((id, text), None) with the ids as they are, or with numbers in their place and the (number, id) table."""
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if plain.schema["id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint"):
        if plain.groupBy("id").count().where("id IS NULL OR count > 1").isEmpty():
            return plain.withColumn("id", F.col("id").cast("long")), None
    kind = plain.schema["id"].dataType.simpleString()
    pairs = plain.orderBy(F.col("id").asc_nulls_first(), "text").rdd.zipWithIndex().map(lambda r: (r[1], r[0][0], r[0][1]))
    numbered = checkpointed(docs.sparkSession.createDataFrame(pairs, f"number long, id {kind}, text string"))
    return numbered.select(F.col("number").alias("id"), "text"), numbered.select("number", "id")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, with_kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed runs) and, if asked for, the kept bytes."""
    if not 8 <= gram < length or 2 * length - gram > 250:
        raise ValueError("length and gram don't fit a segment")
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    buckets = 4 * parts
    rows, names = _numbered(docs, id_col, text_col)
    scanned = rows.mapInArrow(_scanner(length, gram, buckets), SCHEMA)
    owned = checkpointed(scanned.repartition(parts, "key").mapInArrow(_owner(buckets), SCHEMA))
    table = bit_table(owned.where(f"kind = {WANTED}").mapInArrow(_ids_of, "hash long"), "hash")
    wanted = spark.sparkContext.broadcast(table)
    texts = rows.mapInArrow(_sender(buckets, wanted, False, False), SCHEMA)
    fetched = texts.union(owned.where(f"kind = {WANTED}")).repartition(parts, "key").mapInArrow(_fetcher(length, gram, buckets), SCHEMA)
    compared = checkpointed(fetched.repartition(parts, "key").mapInArrow(_comparer(length, gram, buckets), SCHEMA))
    spans = owned.where(f"kind = {SPANS}").union(compared)
    touched = spark.sparkContext.broadcast(bit_table(spans.mapInArrow(_ids_of, "hash long"), "hash"))
    heads = rows.mapInArrow(_sender(buckets, touched, True, with_kept), SCHEMA)
    out = heads.union(spans).repartition(parts, "key").mapInArrow(_finisher(with_kept), RESULT)
    if names is not None:
        out = out.withColumnRenamed("id", "number").join(names, "number")
    found = out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")
    return found if with_kept else found.drop("kept")


def _ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the ids in packed columns, each once a row."""
    for batch in batches:
        for body, kind in zip(batch.column("body").to_pylist(), batch.column("kind").to_pylist()):
            ids = np.unique(unpack_columns(body)[0])
            yield pa.RecordBatch.from_arrays([pa.array(_mix(ids.astype(np.uint64)).view(np.int64))], names=["hash"])
