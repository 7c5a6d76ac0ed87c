"""Exact deduplication by a Golomb-coded fingerprint exchange.

1. Each scan task reduces a text to a 64-bit fingerprint of its normalised bytes (A-Z lower-cased) and its SHA-256.
   This narrow table is checkpointed: a row knows its run, the scan partition that read it.
2. Each run sorts its distinct fingerprints, cuts them by owner (a range of fingerprints) and sends every owner one
   Golomb-coded list of differences: about log2(range / entries) + 1.5 bits an entry, instead of 64.
3. An owner decodes the lists it got and answers each with a bitmap: which entries are in more than one list. An entry
   that a run holds twice needs no answer. A hot fingerprint costs one entry a run, however many rows have it.
4. A run marks its suspects from the bitmaps.
5. Only suspects' texts are shuffled. They are grouped by their bytes, with partial aggregation before the shuffle, so
   a group that holds a third of all rows sends one text a task. Scan tasks recognise suspects by a bit table of at most
   2**27 bits, the only thing that is broadcast; a false hit there forms a group of one.

Defined cases: null text counts as empty; empty texts are equal to each other; a null id sorts below all others; of rows
that repeat the largest id one stays; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_table, checkpointed, in_bit_table, shuffle_partitions

#: At most so many fingerprints in a run; a scan partition with more rows makes several.
RUN_ROWS = 1 << 19


def golomb_encode(values: np.ndarray, low: int) -> tuple[int, bytes]:
    """(k, code) of strictly increasing uint64 values from low on: differences in Golomb code with parameter 2**k.

    The code holds the quotients in unary, padded to a byte, then the k-bit remainders.
    """
    deltas = np.diff(values, prepend=np.uint64(low))
    mean = max(1.0, float(int(values[-1]) - low) / len(values))
    k = max(0, min(63, int(math.log2(mean * math.log(2))) if mean > 2 else 0))
    quotient = (deltas >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotient + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    bits = (deltas[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)
    return k, np.packbits(unary).tobytes() + np.packbits(bits.astype(np.uint8).ravel()).tobytes()


def golomb_decode(n: int, k: int, code: bytes, low: int) -> np.ndarray:
    """The n values that golomb_encode() got."""
    rest = (n * k + 7) // 8
    raw = np.frombuffer(code, np.uint8)
    ends = np.flatnonzero(np.unpackbits(raw[: len(raw) - rest]))[:n]
    quotient = np.diff(ends, prepend=-1).astype(np.uint64) - np.uint64(1)
    bits = np.unpackbits(raw[len(raw) - rest :])[: n * k].reshape(n, k).astype(np.uint64)
    remainder = (bits << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum((quotient << np.uint64(k)) + remainder, dtype=np.uint64) + np.uint64(low)


def normalised(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """Texts as UTF-8 with A-Z lower-cased; null is empty."""
    return [b"" if x is None else x.lower() for x in column.cast(pa.large_binary()).to_pylist()]


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, row = TaskContext.get().partitionId(), 0
    for batch in batches:
        texts = normalised(batch.column("text"))
        n = len(texts)
        rows = np.arange(row, row + n, dtype=np.int64)
        row += n
        fps = np.fromiter((xxhash.xxh64_intdigest(x) for x in texts), np.uint64, n)
        yield pa.RecordBatch.from_arrays(
            [pa.array((rows // RUN_ROWS) + (task << 24)), pa.array(rows + (task << 40)), batch.column("doc_id"), pa.array(fps.view(np.int64)), pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary())],
            names=["run", "row", "doc_id", "fp", "digest"],
        )


def _owners(fps: np.ndarray, owners: int) -> np.ndarray:
    return ((fps >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)


def _low(owner: int, owners: int) -> int:
    """The least fingerprint that the owner may get."""
    return -(-(owner << 32) // owners) << 32


def _encoder(owners: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            runs, fps = batch.column("run").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            for run in np.unique(runs):
                held.setdefault(int(run), []).append(fps[runs == run])
        for run, parts in held.items():
            values = np.unique(np.concatenate(parts))
            cuts = np.searchsorted(_owners(values, owners), np.arange(owners + 1, dtype=np.uint64))
            out = [(o, run, int(b - a), *golomb_encode(values[a:b], _low(o, owners))) for o, a, b in zip(range(owners), cuts[:-1], cuts[1:]) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["owner", "run", "n", "k", "code"])

    return encode


def _answerer(owners: int):
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, runs, lists = [], [], []
        for batch in batches:
            for owner, run, n, k, code in zip(*(c.to_pylist() for c in batch.columns)):
                asked.append(owner)
                runs.append(run)
                lists.append(golomb_decode(n, k, code, _low(owner, owners)))
        if not lists:
            return
        values, counts = np.unique(np.concatenate(lists), return_counts=True)
        shared = values[counts > 1]
        bitmaps = [np.packbits(np.isin(x, shared, assume_unique=True)).tobytes() for x in lists]
        yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int32()), pa.array(runs, pa.int64()), pa.array(bitmaps, pa.binary())], names=["owner", "run", "bitmap"])

    return answer


def _marker(owners: int):
    def mark(rows: pa.Table, replies: pa.Table) -> pa.Table:
        fps = rows.column("fp").to_numpy().view(np.uint64)
        values, inverse, counts = np.unique(fps, return_inverse=True, return_counts=True)
        suspect = counts > 1
        cuts = np.searchsorted(_owners(values, owners), np.arange(owners + 1, dtype=np.uint64))
        for owner, bitmap in zip(replies.column("owner").to_pylist(), replies.column("bitmap").to_pylist()):
            a, b = cuts[owner], cuts[owner + 1]
            suspect[a:b] |= np.unpackbits(np.frombuffer(bitmap, np.uint8))[: b - a].astype(bool)
        return rows.select(["row", "doc_id", "fp", "digest"]).append_column("suspect", pa.array(suspect[inverse]))

    return mark


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, fp, digest, suspect) for each row; rows of equal texts are all suspects."""
    spark = docs.sparkSession
    owners = shuffle_partitions(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    table = checkpointed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_fingerprints, f"run long, row long, doc_id {id_type}, fp long, digest binary"))
    sent = table.select("run", "fp").mapInArrow(_encoder(owners), "owner int, run long, n int, k int, code binary")
    replies = sent.repartition(owners, "owner").mapInArrow(_answerer(owners), "owner int, run long, bitmap binary")
    marked = table.groupBy("run").cogroup(replies.groupBy("run")).applyInArrow(_marker(owners), f"row long, doc_id {id_type}, fp long, digest binary, suspect boolean")
    return checkpointed(marked)


def _suspect_texts(spark, docs: DataFrame, text_col: str, table: np.ndarray) -> DataFrame:
    shared = spark.sparkContext.broadcast(table)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = normalised(batch.column("text"))
            hit = in_bit_table(shared.value, np.fromiter((xxhash.xxh64_intdigest(x) for x in texts), np.uint64, len(texts)))
            yield pa.RecordBatch.from_arrays([pa.array([texts[i] for i in np.flatnonzero(hit)], pa.binary())], names=["body"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(keep, "body binary")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of the rows with equal normalised texts, the one with the largest id is kept.
    """
    spark = docs.sparkSession
    rows = fingerprints(docs, id_col, text_col)
    suspects = rows.where("suspect")
    texts = _suspect_texts(spark, docs, text_col, bit_table(suspects, "fp"))
    verified = texts.groupBy("body").agg(F.count("*").alias("group_size")).where("group_size > 1").select(F.unhex(F.sha2("body", 256)).alias("digest"), "group_size")
    best = suspects.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("best"))
    # Of its own exchange, so that the join below can split the rows of a hot digest.
    groups = checkpointed(verified.join(best, "digest"))
    return rows.join(groups, "digest", "left").select(
        "doc_id",
        F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("best.row") == F.col("row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
