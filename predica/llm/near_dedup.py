"""Near copies by the Jaccard similarity of word shingles: SimHash finds candidates, the shingles decide.

Documents link where their sets of five-word shingles (A-Z lower-cased) have a similarity of SIMILARITY or more. Texts of
equal sets are one entry. Entries that share a cluster of simhash.clusters(), one-wildcard signatures of a wide SimHash of the
set, are candidates, and candidates link if their whole sets are similar. That is found in three rounds: each entry with the
nearest lesser one, each set of linked entries with the nearest other one, then all candidates that aren't linked by then,
but for those that can't be similar by their marks (simhash.pairs()). The first two rounds only make the third one short.

A link is missed with the probabilities that simhash.clusters() states: 0.000002 at 0.8, 0.00016 for texts of eight and nine
words, less for others. Nothing else is missed, and nothing below the similarity is linked.

Scale: texts are read twice, the second time only those of candidates; pairs are made within clusters, in tasks, and only
those that may link leave a task. A cluster is one task's: of a crowd of linked entries only the others meet all. An entry's
sketch has a fixed size. Defined cases: null text is empty; texts without words link with each other; fewer words than a
shingle give one shingle of all; null ids never become a component's id unless it has no other; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, give_back
from .graph import connected_components
from .simhash import SEED, clusters, marks, pairs, shingles, wide_fingerprint

SHINGLE, SIMILARITY = 5, 0.8


def shingle_set(text: bytes) -> np.ndarray:
    """The XXH64 of the text's distinct shingles, in order."""
    parts = shingles(text, SHINGLE)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in parts), np.uint64, len(parts)))


def _kept(df: DataFrame) -> DataFrame:
    """df checkpointed; the driver gives back what planning and running it has left, as these plans are the pipeline's largest."""
    out = checkpointed(df)
    give_back(df.sparkSession)
    return out


def _body(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), SEED) - (1 << 63)


def _sets(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [shingle_set(x or b"") for x in batch.column("text").cast(pa.large_binary()).to_pylist()]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = _sets(batch)
        columns = [pa.array([_body(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([f(s) for s in sets], pa.list_(pa.int64())) for f in (wide_fingerprint, marks))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "body", "n", "fp", "marks"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = _sets(batch)
        yield pa.RecordBatch.from_arrays([pa.array([_body(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["body", "own"])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = np.concatenate((a, b))
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= SIMILARITY * (len(a) + len(b) - shared)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column("own_a"), batch.column("own_b"))
        yes = pa.array([similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in pairs], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(yes), batch.column("b").filter(yes)], names=["a", "b"])


def _sets_of(bodies: DataFrame, entries: DataFrame, texts: DataFrame) -> DataFrame:
    """(body, own) of the entries whose bodies are given, and maybe of others: their sets as sorted 64-bit hashes."""
    wanted = bodies.distinct().join(entries, "body").select(F.col("first_id").alias("wanted_id")).distinct()
    found = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")
    return found.mapInArrow(_read, "body long, own binary").dropDuplicates(["body"])


def _with_sets(pairs: DataFrame, entries: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, own_a, own_b) of pairs (a, b) of entries; entries: (body, first_id)."""
    sets = _sets_of(pairs.select(F.col("a").alias("body")).union(pairs.select(F.col("b").alias("body"))), entries, texts)
    joined = pairs.join(sets.select(F.col("body").alias("a"), F.col("own").alias("own_a")), "a").join(sets.select(F.col("body").alias("b"), F.col("own").alias("own_b")), "b")
    return joined.select("a", "b", "own_a", "own_b")


def _linked(pairs: DataFrame, entries: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of entries whose sets are similar."""
    return _kept(_with_sets(pairs, entries, texts).mapInArrow(_verify, "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, body, component_id) for each row; component_id is the smallest id of the rows that links reach."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    rows = _kept(texts.mapInArrow(_sketch, f"doc_id {id_type}, body long, n long, fp array<long>, marks array<long>"))
    entries = _kept(rows.groupBy("body").agg(F.min("doc_id").alias("first_id")))
    found = clusters(rows.where("n > 0").dropDuplicates(["body"]).select(F.col("body").alias("id"), "n", "fp"))
    sketches = rows.select(F.col("body").alias("id"), "fp", "marks").dropDuplicates(["id"])
    members = _kept(found.join(sketches.drop("marks"), "id"))
    wanted = members.select(F.col("id").alias("body")).distinct().join(entries, "body").select(F.col("first_id").alias("wanted_id")).distinct()
    texts = _kept(texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi"))
    edges = _linked(_kept(pairs(members.withColumn("label", F.col("id")), "first")), entries, texts)
    labels = connected_components(edges)
    for mode in ("nearest", "all"):
        give_back(docs.sparkSession)
        labelled = members.join(labels, members.id == labels.node, "left").withColumn("label", F.coalesce("root", "id"))
        if mode == "all":
            several = labelled.groupBy("cluster").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("cluster")
            labelled = labelled.join(several, "cluster").join(sketches.select("id", "marks"), "id")
        edges = _linked(_kept(pairs(labelled, mode)), entries, texts)
        labels = connected_components(labels.toDF("a", "b").union(edges))  # what was linked before is in the labels
    joined = entries.join(labels, entries.body == labels.node, "left").select("body", "first_id", F.coalesce("root", "body").alias("root"))
    ids = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows.select("doc_id", "body").join(joined.join(ids, "root").select("body", "component_id"), "body").select("doc_id", "body", "component_id")
