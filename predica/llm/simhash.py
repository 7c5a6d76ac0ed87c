"""Near-duplicates by SimHash with deletion-variant signatures.

Fingerprints of 64 bits link at MAX_BITS = 3 or fewer differing bits. Cut into SEGMENTS = 2 segments, one of which must
then differ in at most one bit (3 = 1 + 2), a fingerprint is indexed under every segment with one of its bits left out:
64 signatures. Two segments that differ in at most one bit agree in the signature without that bit, so an equality join
on signatures finds every link, where exact segments would need four of 16 bits with far longer lists.

Only distinct fingerprints are indexed: a group of copies is one entry. Rows that share a signature arrive sorted and are
verified in a stream; of a signature's links only a spanning forest is emitted, never all pairs. A long list is cut
further, again and again, by the eight-bit pieces of the fingerprint before pairs are compared (see forest()).

Sets that share most of their elements, but far from all, differ in more bits than two segments can bear. For those,
wide_fingerprint() has WIDE = 768 bits, cut into 48 segments of 16, and clusters() finds the fingerprints of which a segment
differs in at most one bit. See there for what it misses.

Defined cases: null text is empty; a text without words has fingerprint zero and links like any other; fewer words than a
shingle give one shingle of the whole sequence; repeated rows share a component; null ids never become a component's id
unless it has no other; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, hex64, shuffle_partitions
from .graph import connected_components

MAX_BITS = 3
SEGMENTS = 2
SEED = 42
#: Lists up to this length are compared pair by pair; longer ones are first cut by pieces that links must share.
LIST = 4096
#: Bits of a wide fingerprint, in words of 64.
WORDS = 12
WIDE = 64 * WORDS
#: Members of a cluster differ from another one in at most FIRST bits of the first word, MOST of the first three, and pairs
#: of a cluster in at most FAR of all: the second figure is for sets of at most SMALL elements.
FIRST, MOST, FAR, SMALL = 26, (54, 60), (168, 200), 5
#: The similarity that pairs may have: the smaller of two sets has at least this share of the larger one's elements.
SIZES = 0.8
#: Words of a set's marks (see marks()).
MARKS = 32
#: Rows and pairs that are treated at once, and the length from which a list may be a crowd (see _crowds()).
BLOCK, PAIRS, CROWD = 1 << 17, 1 << 20, 1024


def shingles(text: bytes, n: int) -> list[bytes]:
    """The n-word shingles of a text, A-Z lower-cased; all its words if they are fewer; none without words."""
    words = text.lower().split()
    joined = b" ".join(words)
    if len(words) <= n:
        return [joined] if words else []
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate((ends[:1] * 0, ends[:-1]))
    return [joined[a:b] for a, b in zip(starts[: len(words) - n + 1].tolist(), (ends[n - 1 :] - 1).tolist())]


def fingerprint(text: bytes, n: int = 3) -> int:
    """The SimHash: a bit is 1 if it is set in over half of the shingles' XXH64 (seed 42)."""
    digest, parts = xxhash.xxh64_intdigest, shingles(text, n)
    if not parts:
        return 0
    total = np.zeros(64, np.int64)
    for at in range(0, len(parts), 1 << 14):  # a very long text takes no more memory than a block
        hashes = np.array([digest(x, SEED) for x in parts[at : at + (1 << 14)]], dtype=">u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(parts)).tobytes(), "big")


def _fingerprinter(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            fps = np.fromiter((fingerprint(x or b"", n) for x in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_fingerprinter(shingle_words), f"doc_id {id_type}, fp long")


def _near(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= bits


def _tree(values: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct values: breadth-first, each value is compared once it is reached."""
    out, left = [], values
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            node = queue.pop()
            near = _near(left, node, bits)
            if near.any():
                found = left[near]
                out += [(int(node), int(x)) for x in found]
                queue += list(found)
                left = left[~near]
    return out


def forest(values: np.ndarray, bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Edges that connect what the links among distinct uint64 values connect.

    Values that differ in at most `bits` < 4 bits agree in one of any four disjoint pieces. A long list is therefore cut
    four times, by each of the four eight-bit pieces in which its values vary most, and each part is treated by itself: if
    it is still long, it is cut by the pieces that its values don't all agree in by now.
    """
    return _cut(values, bits, tuple(range(0, 64, 8)))


def _cut(values: np.ndarray, bits: int, pieces: tuple[int, ...]) -> list[tuple[int, int]]:
    if len(values) <= LIST or len(pieces) < 4:
        return _tree(values, bits)
    keys = {p: (values >> np.uint64(p)) & np.uint64(255) for p in pieces}
    out = []
    for piece in sorted(pieces, key=lambda p: -len(np.unique(keys[p])))[:4]:
        order = np.argsort(keys[piece], kind="stable")
        left = tuple(p for p in pieces if p != piece)
        for part in np.split(values[order], np.flatnonzero(np.diff(keys[piece][order])) + 1):
            out += _cut(part, bits, left)
    return out


def _verifier(bits: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, []

        def edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            flat = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["a", "b"])

        for batch in batches:
            keys, fps = batch.column("signature").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            if not len(keys):
                continue
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]))
            if held and keys[0] != held_key:
                yield edges(forest(np.concatenate(held), bits))
                held = []
            if len(cuts) == 2:  # the whole batch has one signature
                held_key = keys[0]
                held.append(fps)
                continue
            if held:
                yield edges(forest(np.concatenate([*held, fps[: cuts[1]]]), bits))
                held = []
                cuts = cuts[1:]
            pairs: list[tuple[int, int]] = []
            lengths = np.diff(cuts)
            two = np.flatnonzero(lengths[:-1] == 2)
            left, right = fps[cuts[two]], fps[cuts[two] + 1]
            near = _near(left, right, bits)
            pairs += zip(left[near].tolist(), right[near].tolist())
            for i in np.flatnonzero(lengths[:-1] > 2):
                pairs += forest(fps[cuts[i] : cuts[i + 1]], bits)
            held_key, held = keys[-1], [fps[cuts[-2] :]]
            yield edges(pairs)
        if held:
            yield edges(forest(np.concatenate(held), bits))

    return verify


def links(fps: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect what links of at most `bits` bits connect."""
    if not 0 <= bits <= MAX_BITS:
        raise ValueError(f"two segments find links of at most {MAX_BITS} bits")
    spark = fps.sparkSession
    # Signature i: segment i / 32 without its bit i % 32, under the number i.
    signature = "(shiftleft(cast(i as bigint), 32) | (shiftrightunsigned(fp, 32 * cast(i div 32 as int)) & 4294967295L & ~shiftleft(1L, cast(i % 32 as int))))"
    variants = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).select(F.expr(signature).alias("signature"), "fp")
    return variants.repartition(shuffle_partitions(spark), "signature").sortWithinPartitions("signature").mapInArrow(_verifier(bits), "a long, b long")


def _mixed(x: np.ndarray) -> np.ndarray:
    """Other 64-bit hashes for 64-bit hashes (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEPS = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of a set, of WIDE bits, as WORDS int64: a bit is 1 if it is set in over half of the elements' hashes.

    hashes: the elements' distinct uint64 hashes, of which each word makes its own.
    """
    total = np.zeros(WIDE, np.int64)
    for at in range(0, len(hashes), 255):  # as many as a byte can count
        words = _mixed(hashes[at : at + 255, None] + _STEPS)
        total += np.add.reduce(np.unpackbits(words.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * total > len(hashes)).view(np.int64)


def marks(hashes: np.ndarray) -> np.ndarray:
    """A bit for each of the 64 * MARKS parts of the hashes that has one, as MARKS int64."""
    out = np.zeros(64 * MARKS, bool)
    out[(hashes % np.uint64(64 * MARKS)).astype(np.int64)] = True
    return np.packbits(out).view(np.int64)


def _possible(sizes: np.ndarray, marked: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets may have a Jaccard similarity of SIZES: a mark that one lacks stands for an element at least that it lacks."""
    common = np.minimum(*(sizes[x] - sum(np.bitwise_count(m[x] & ~m[y]).astype(np.int32) for m in marked) for x, y in ((a, b), (b, a))))
    return (1 + SIZES) * common + 1e-6 >= SIZES * (sizes[a] + sizes[b])


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Gives a[i] and b[i], and whatever has their labels, one label: the least index. Labels are their own labels."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label[:] = further


def _limit(bits: tuple[int, int], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.where(np.minimum(x, y) <= SMALL, bits[1], bits[0])


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.minimum(x, y) >= SIZES * np.maximum(x, y)


def _alike(words: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs (a, b) of rows those that may be members of a cluster; one may be a single row."""
    def kept(yes):
        return (a[yes] if a.ndim else a), b[yes]

    a, b = kept(np.bitwise_count(words[0][a] ^ words[0][b]) <= FIRST)
    a, b = kept(sum(np.bitwise_count(w[a] ^ w[b]) for w in words) <= _limit(MOST, sizes[a], sizes[b]))
    return kept(_fit(sizes[a], sizes[b]))


def _reach(label: np.ndarray, left: np.ndarray, words: np.ndarray, sizes: np.ndarray) -> None:
    """Labels the rows `left` by their components, each row compared with those that aren't reached yet."""
    while len(left):
        root, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            found = _alike(words, sizes, np.asarray(queue.pop()), left)[1]
            if len(found):
                label[found] = root
                queue += list(found)
                left = np.setdiff1d(left, found, True)


def _crowds(lists: np.ndarray, meetings: np.ndarray) -> np.ndarray:
    """Whether rows are of a long list of which over an eighth of all pairs would be compared; a 57th is usual."""
    lengths = np.bincount(lists)
    pairs = np.bincount(lists, meetings)
    return ((lengths > CROWD) & (8 * pairs > lengths.astype(np.float64) ** 2))[lists]


def _labels(code: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The label of each row, equal for the members of a cluster. Rows come by code, in whole lists."""
    sizes, lists = code & 0xFFFFFFFF, np.cumsum(np.diff(code >> 40, prepend=code[0] >> 40) != 0)
    cell = lists * 256 + (code >> 32 & 255)
    starts = np.concatenate(([0], np.cumsum(np.bincount(cell, minlength=256 * (int(lists[-1]) + 1)))))
    label = np.arange(len(code))
    # Equal segments meet in the list of their first byte only.
    meet = [(label + 1, np.where(code >> 48 & 1, 0, starts[cell + 1]))]
    for bit in (1 << k for k in range(8)):
        other = cell | bit
        meet.append((starts[other], np.where(cell & bit, 0, starts[other + 1])))
    crowds = _crowds(lists, sum(np.maximum(high - low, 0) for low, high in meet))
    for crowd in np.unique(lists[crowds]):
        _reach(label, np.flatnonzero(lists == crowd), words, sizes)
    for low, high in meet:
        number = np.where(crowds, 0, np.maximum(high - low, 0))
        rows = np.flatnonzero(number)
        upto = np.cumsum(number[rows])
        for part in np.split(rows, np.searchsorted(upto, np.arange(PAIRS, upto[-1], PAIRS))) if len(rows) else []:
            times = number[part]
            a, b = np.repeat(part, times), np.repeat(low[part] - np.cumsum(times) + times, times)
            _join(label, *_alike(words, sizes, a, b + np.arange(len(b))))
    return label


def _clustered(block: np.ndarray) -> pa.RecordBatch:
    label = _labels(block[0], block[2:].view(np.uint64))
    members = np.flatnonzero(np.bincount(label, minlength=len(label))[label] > 1)
    names = np.full(len(label), np.iinfo(np.int64).max)
    np.minimum.at(names, label[members], block[1, members])
    columns = [names[label[members]], block[1, members], block[0, members] & 0xFFFFFFFF]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cluster", "id", "n"])


def _whole(batches: Iterator[pa.RecordBatch], key: Callable[[np.ndarray], np.ndarray]) -> Iterator[np.ndarray]:
    """The batches' columns as blocks of some 5 * BLOCK values, with rows of equal key(first column) in one block. Rows come by it."""
    held, rows, enough = [], 0, 0
    for batch in batches:
        least = BLOCK * 5 // batch.num_columns
        held.append(np.array([c.to_numpy() for c in batch.columns]))
        rows += batch.num_rows
        if rows < max(least, enough):
            continue
        block = np.concatenate(held, axis=1)
        keys = key(block[0])
        last = int(np.searchsorted(keys, keys[-1]))  # these may go on
        if last:
            yield block[:, :last]
        held, rows = [block[:, last:]], rows - last
        enough = 2 * rows
    if rows:
        yield np.concatenate(held, axis=1)


def _cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return map(_clustered, _whole(batches, lambda code: code >> 40))


def _near_pairs(label: np.ndarray, sizes: np.ndarray, words: np.ndarray, mode: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, other row, bits) of pairs of one cluster, see pairs()."""
    columns = np.arange(len(label))
    if mode == "first":
        rows, columns = columns[1:], columns[:CROWD]
    else:
        names, number = np.unique(label, return_counts=True)
        rows = np.flatnonzero(label != names[number.argmax()])
    for part in np.array_split(rows, 1 + len(rows) * len(columns) // PAIRS) if len(rows) else []:
        x, y = part[:, None], columns[None, :]
        bits = sum(np.bitwise_count(w[x] ^ w[y]).astype(np.int32) for w in words[:WORDS])
        fits = (bits <= _limit(FAR, sizes[x], sizes[y])) & _fit(sizes[x], sizes[y]) & (y < x if mode == "first" else label[x] != label[y])
        if mode == "all":
            i, j = np.nonzero(fits)
            possible = _possible(sizes, words[WORDS:], part[i], columns[j])
            i, j = i[possible], j[possible]
        else:
            bits[~fits] = WIDE + 1
            j = bits.argmin(axis=1)
            i = np.flatnonzero(fits[np.arange(len(part)), j])
            j = j[i]
        yield part[i], columns[j], bits[i, j]


def _meeter(mode: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _whole(batches, lambda cluster: cluster):
            found = [np.zeros((4, 0), np.int64)]
            for one in np.split(block, np.flatnonzero(np.diff(block[0])) + 1, axis=1):
                if len(one[0]) > 1 and (one[2] != one[2, 0]).any():
                    found += [np.array([one[1, x], one[1, y], one[2, x], bits]) for x, y, bits in _near_pairs(one[2], one[3], one[4:].view(np.uint64), mode)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(found, axis=1)], names=["a", "b", "label", "bits"])

    return run


def pairs(members: DataFrame, mode: str) -> DataFrame:
    """(a, b): pairs of ids of different labels in the clusters (cluster, id, label, n, fp, marks) that may be similar.

    mode "all": all of them, but for pairs that can't be similar by their marks. "first": for each id the nearest of the lesser ids of a cluster, of which only the first CROWD
    are looked at. "nearest": for each label the nearest pair with another one. A cluster's most frequent label isn't compared
    with itself, so a crowd whose members are linked already costs what the others make.
    """
    columns = ["cluster", "id", "label", "n", *(F.col("fp")[k].alias(f"w{k}") for k in range(WORDS))]
    if mode == "all":
        columns += [F.col("marks")[k].alias(f"m{k}") for k in range(MARKS)]
    dealt = members.select(*columns).repartition(shuffle_partitions(members.sparkSession), "cluster").sortWithinPartitions("cluster", "id")
    met = dealt.mapInArrow(_meeter(mode), "a long, b long, label long, bits long")
    if mode != "all":
        met = met.groupBy("label").agg(F.min(F.struct("bits", "a", "b")).alias("best")).select("best.a", "best.b")
    return met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def clusters(wide: DataFrame) -> DataFrame:
    """(cluster, id, n): clusters of sets that may be similar, from (id long, n long, fp array<long>), with distinct ids.

    n is a set's size, fp its wide_fingerprint(). Two sets are in one cluster if they agree in one of the 48 segments of 16
    bits but for one bit at most, differ in no more bits than MOST says, and have sizes that fit. The segment's wildcard is
    in one of its two bytes, so both are listed under the other byte, and of a list those meet whose other bytes differ in one
    bit or none. Clusters are components of such pairs in a list, named by their least id: those of many lists with the
    same least id are one cluster, so that a member of a crowd, whose lists' components differ by a few, is in few clusters
    instead of one for each list.

    Sets of a Jaccard similarity of s have a cosine of 2s / (1 + s) or more, and differ in a bit with a probability of its
    arccosine / pi at most: 0.152 at 0.8. Such a pair is missed with a probability of 2e-6, by the segments, MOST, FIRST and
    pairs()' FAR together; one at 0.9 with 5e-11. For very small sets majorities are coarser: four elements and one more
    differ in 0.1875 of the bits, and are missed with 1.6e-4. Nothing else is missed.

    Scale: two rows for a segment. The lists of a byte have a 256th of all sets, of which a row meets a 28th, so comparisons,
    though of a few nanoseconds, grow with the square of the sets. A crowd of near copies is searched breadth-first, where a
    row meets only what isn't reached yet.
    """
    byte = "(shiftrightunsigned(fp[cast(i div 8 as int)], 8 * cast({} % 8 as int)) & 255L)"
    code = f"shiftleft(cast(i as bigint), 48) | shiftleft({byte.format('i')}, 40) | shiftleft({byte.format('(i ^ 1)')}, 32) | n"
    listed = wide.select("id", "n", "fp", F.explode(F.sequence(F.lit(0), F.lit(8 * WORDS - 1))).alias("i"))
    listed = listed.select(F.expr(code).alias("code"), "id", *(F.col("fp")[k].alias(f"w{k}") for k in range(3)))
    dealt = listed.repartition(shuffle_partitions(wide.sparkSession), F.expr("shiftright(code, 40)")).sortWithinPartitions("code")
    return dealt.mapInArrow(_cluster, "cluster long, id long, n long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) for each row; component_id is the smallest id of the rows that links reach."""
    rows = checkpointed(fingerprints(docs, id_col, text_col, shingle_words))
    distinct = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = connected_components(checkpointed(links(distinct.select("fp"), bits)))
    labelled = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows.join(labelled.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def simhash_digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")
