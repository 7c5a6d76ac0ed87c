"""Best-fit packing of token sequences with Martello-Toth dominance reduction.

Texts become token ids plus an end id; only a document longer than a sequence is cut, into whole sequences after a first
piece that takes the remainder. So a document has at most one piece shorter than a sequence, and the packing instance is
a histogram over fewer lengths than a sequence has tokens, at any size of the corpus: the driver solves it in closed
form, by groups of equal sequences, and pieces find their place by their rank among the pieces of their length.

Solving: dominance() permanently fixes sets of one, two or three pieces that provably dominate every alternative for
their largest piece (a dominating set takes each member of any other feasible set in exchange for one as large);
best_fit() places what remains, longest first, in the fullest sequence that holds it. Both treat all copies at once.

Scale: one scan; the ranks are counted in the scan task and completed by per-task offsets, so nothing is sorted and no
length, however common, meets in one task. What is broadcast is the plan: runs of equal placements, whose number depends
on the sequence length, not on the rows (see plan()).

Defined cases: null text is empty (the end id alone); repeated rows are packed once each; special-token strings in a text
follow the tokenizer; null ids are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

CAPACITY = 1024
END_ID = 2
#: Texts of these code points are split alike by both tokenizer libraries; any other text goes the slow way.
PLAIN = re.compile(r"[\x20-\x7E\n\t¡-ɏ]*")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """The ids that the tokenizers library gives for a tokenizer file, special strings included, end id not.

    For a byte-level BPE whose ids follow the order of its merges, tiktoken gives the same ids several times faster; it
    takes texts of PLAIN characters without special strings, tokenizers the others.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.fast = self._ranks(spec)

    @staticmethod
    def _ranks(spec: dict):
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        if not plain or spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges") or model.get("byte_fallback"):
            return None
        merged = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:])):
            return None
        import public_tokenizers
        import tiktoken

        # Byte-level vocabularies write printable Latin-1 bytes as themselves and the others from U+0100 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
        special = {x["content"] for x in spec.get("added_tokens", [])}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            try:
                return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32)
            except BaseException as e:  # a panic of its regex engine on a text without end isn't an Exception
                if type(e).__name__ != "PanicException":
                    raise
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    first = n % capacity or capacity
    return [(0, min(first, n)), *((at, capacity) for at in range(first, n, capacity))]


def dominance(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths, sequences)] that are fixed for good; takes them out of counts (by length)."""
    fixed = []

    def largest(at_most: int, but: tuple[int, ...]) -> int:
        """The longest length that is left besides those in `but`, or 0."""
        for x in range(min(at_most, capacity), 0, -1):
            if counts[x] > but.count(x):
                return x
        return 0

    def smallest(n: int, but: tuple[int, ...]) -> list[int]:
        out: list[int] = []
        for x in range(1, capacity + 1):
            out += [x] * min(n - len(out), max(0, int(counts[x]) - but.count(x)))
            if len(out) == n:
                break
        return out

    def times(lengths: tuple[int, ...]) -> int:
        return min(int(counts[x]) // lengths.count(x) for x in set(lengths))

    for j in range(capacity, 0, -1):
        while counts[j]:
            room = capacity - j
            k = largest(room, (j,))
            three = smallest(3, (j,))
            if not k:
                chosen = (j,)
            elif k == room or len(three) < 2 or three[0] + three[1] > room:
                chosen = (j, k)  # fills the sequence, or only one more piece fits and this is the longest
            elif len(three) < 3 or sum(three) > room:  # at most two more pieces fit
                b = largest(min(k, room - k), (j, k))
                above = next((x for x in range(b + 1, capacity + 1) if counts[x] > (x == j)), capacity)
                if b and 2 * above > room:  # of any two that fit, one is at most b, and the other at most k
                    chosen = (j, k, b)
                elif not b and 2 * above > room:
                    chosen = (j, k)
                else:
                    break
            else:
                break
            m = times(chosen)
            for x in chosen:
                counts[x] -= m
            fixed.append((chosen, m))
    return fixed


def best_fit(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths, sequences)] that hold all of counts, longest first, each in the fullest sequence that has room."""
    rooms: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for x in range(capacity, 0, -1):
        left = int(counts[x])
        while left:
            room = next((r for r in range(x, capacity) if rooms[r]), None)
            if room is None:
                each = capacity // x
                for n, m in ((each, left // each), (left % each, 1)):
                    if n and m:
                        rooms[capacity - n * x].append(((x,) * n, m))
                break
            pattern, m = rooms[room].pop()
            used = min(m, left)
            if used < m:
                rooms[room].append((pattern, m - used))
            rooms[room - x].append(((*pattern, x), used))
            left -= used
    return [group for groups in rooms.values() for group in groups]


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[dict[int, np.ndarray], int]:
    """({length: runs}, sequences). A run (first rank, first sequence, offset) places consecutive ranks of a length.

    Each length opens at most two groups of sequences, splits at most one and fixes at most a few, so there are some
    thousands of groups and runs, whatever the counts are.
    """
    counts = counts.copy()
    groups = dominance(counts, capacity) + best_fit(counts, capacity)
    ranks: dict[int, int] = defaultdict(int)
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    sequences = 0
    for lengths, m in groups:
        offset = 0
        for x in lengths:
            runs[x].append((ranks[x], sequences, offset))
            ranks[x] += m
            offset += x
        sequences += m
    return {x: np.array(r, np.int64) for x, r in runs.items()}, sequences


def _scanner(path: str, end_id: int, capacity: int, keep_ids: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encode = TaskContext.get().partitionId(), encoder(path)
        seen, full = np.zeros(capacity, np.int64), 0
        for batch in batches:
            lengths, tails, ranks, fulls, checks, kept = [], [], [], [], [], []
            for text in batch.column("text").to_pylist():
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                n, tail = len(ids), len(ids) % capacity
                lengths.append(n)
                tails.append(tail)
                ranks.append(int(seen[tail]))
                fulls.append(full)
                seen[tail] += 1
                full += n // capacity
                checks.append([zlib.crc32(ids[a : a + k]) for a, k in cuts(n, capacity)])
                if keep_ids:
                    kept.append(ids.astype(np.int32))
            out = [pa.array([task] * len(lengths), pa.int64()), batch.column("doc_id"), pa.array(lengths, pa.int64()), pa.array(tails, pa.int64()), pa.array(ranks, pa.int64()), pa.array(fulls, pa.int64()), pa.array(checks, pa.list_(pa.int64()))]
            names = ["task", "doc_id", "n", "tail", "rank", "full", "crcs"]
            yield pa.RecordBatch.from_arrays(out + [pa.array(kept, pa.list_(pa.int32()))] * keep_ids, names=names + ["ids"] * keep_ids)

    return scan


def _placer(spark, runs: dict[int, np.ndarray], fields: list[str]):
    shared = spark.sparkContext.broadcast(runs)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails, ranks = batch.column("tail").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(tails), np.int64), np.zeros(len(tails), np.int64)
            for x in np.unique(tails[tails > 0]):
                own, run = tails == x, shared.value[int(x)]
                i = np.searchsorted(run[:, 0], ranks[own], side="right") - 1
                sequence[own] = run[i, 1] + ranks[own] - run[i, 0]
                offset[own] = run[i, 2]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in fields), pa.array(sequence), pa.array(offset)], names=[*fields, "sequence", "place"])

    return place


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if they are kept.

    tokenizer: the path of a tokenizers file, the same on all machines.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"task long, doc_id {id_type}, n long, tail long, rank long, full long, crcs array<long>" + ", ids array<int>" * keep_ids
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = checkpointed(source.mapInArrow(_scanner(tokenizer or default_tokenizer(), end_id, capacity, keep_ids), schema))
    tallies = checkpointed(rows.groupBy("task", "tail").agg(F.count("*").alias("rows"), F.sum(F.expr(f"n div {capacity}")).alias("fulls")))
    counts = np.zeros(capacity + 1, np.int64)
    for tail, n in tallies.where("tail > 0").groupBy("tail").agg(F.sum("rows")).toLocalIterator():
        counts[tail] = n
    runs, shared = plan(counts, capacity)
    ranks = tallies.selectExpr("task", "tail", "sum(rows) OVER (PARTITION BY tail ORDER BY task) - rows AS ranks_before")
    # Tasks are few beside rows: one row for each.
    fulls = tallies.groupBy("task").agg(F.sum("fulls").alias("fulls")).selectExpr("task", "sum(fulls) OVER (ORDER BY task) - fulls AS fulls_before")
    kept = ["doc_id", "n", "tail", "full", "crcs"] + ["ids"] * keep_ids
    numbered = rows.join(ranks, ["task", "tail"]).join(fulls, "task").withColumn("rank", F.col("rank") + F.col("ranks_before")).withColumn("full", F.col("full") + F.col("fulls_before"))
    schema = f"doc_id {id_type}, n long, tail long, full long, crcs array<long>" + ", ids array<int>" * keep_ids + ", sequence long, place long"
    placed = numbered.select(*kept, "rank").mapInArrow(_placer(spark, runs, kept), schema)
    pieces = placed.select("*", F.posexplode("crcs").alias("piece", "ids_crc32"))
    cut = F.expr("tail > 0 AND piece = 0")
    start = F.when(F.col("piece") == 0, F.lit(0)).when(F.col("tail") > 0, F.col("tail") + (F.col("piece") - 1) * capacity).otherwise(F.col("piece") * capacity).cast("long")
    length = F.when(cut, F.col("tail")).otherwise(F.lit(capacity)).cast("long")
    out = pieces.select(
        "doc_id",
        F.col("piece").cast("int").alias("piece"),
        start.alias("start"),
        length.alias("length"),
        "ids_crc32",
        F.when(cut, F.col("sequence")).otherwise(shared + F.col("full") + F.col("piece") - (F.col("tail") > 0).cast("long")).alias("sequence_id"),
        F.when(cut, F.col("place")).otherwise(F.lit(0)).cast("long").alias("offset"),
        *([F.slice("ids", (start + 1).cast("int"), length.cast("int")).alias("ids")] * keep_ids),
    )
    return out


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, documents): the sequences of pack(keep_ids=True); each has at most `capacity` ids."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("documents"))
