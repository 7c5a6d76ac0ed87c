"""Stages of a corpus pipeline: a DataFrame of documents in, the documents that stay out, with the same columns.

Documents have the columns doc_id, text and source; any others are carried along. Null text is empty; of rows that repeat
an id and a text, exact deduplication keeps one. Each stage begins by giving back what the driver has freed, so that the stages
before it don't add to its memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exact_dedup, near_dedup, packing, source_mix, toxicity
from .common import give_back, unused


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that score below the threshold of toxicity, with the columns of docs.

    Null text is empty and scored like any other; repeated rows and equal texts have equal scores, so all of them stay or
    go; null ids are scored but not trained on; without labels of both kinds every document has the share of toxic ones as
    its score; no documents give none.
    """
    give_back(docs.sparkSession)
    model = toxicity.trained(docs, labels)
    (score,) = unused(docs, "score")
    return toxicity.score(docs, model, keep=docs.columns, name=score).where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def _with_digest(docs: DataFrame, name: str) -> DataFrame:
    """docs and a column of the SHA-256 of the normalised text."""
    at = docs.columns.index("text")
    names = [f"c{i}" for i in range(len(docs.columns) + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [hashlib.sha256(x).digest() for x in exact_dedup.normalised(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], names=names)

    schema = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, docs.columns))
    return docs.toDF(*names[:-1]).mapInArrow(run, f"{schema}, {names[-1]} binary").toDF(*docs.columns, name)


def _repeats_ids(docs: DataFrame) -> bool:
    return not docs.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").isEmpty()


def without_copies(docs: DataFrame) -> DataFrame:
    """One document of each group of equal normalised texts."""
    give_back(docs.sparkSession)
    digest, kept_id, kept_digest = unused(docs, "digest", "kept_id", "kept_digest")
    kept = exact_dedup.exact_groups(docs).where("kept").select(F.col("doc_id").alias(kept_id), F.unhex("text_sha256").alias(kept_digest))
    joined = _with_digest(docs, digest).join(kept, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(digest) == F.col(kept_digest)), "left_semi")
    if _repeats_ids(docs):
        joined = joined.dropDuplicates(["doc_id", digest])
    return joined.select(*docs.columns)


def without_near_copies(docs: DataFrame) -> DataFrame:
    """The document of the smallest id of each component of texts that share 80% of their five-word shingles.

    Null ids come last. Where ids repeat, documents are told apart by their texts too: of a component's rows of the
    smallest id, the one of the smallest digest stays, and different texts with one id that aren't near copies all stay.
    """
    give_back(docs.sparkSession)
    key, kept_key = unused(docs, "key", "kept_key")
    repeats = _repeats_ids(docs)
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")) if repeats else F.col("doc_id")
    keyed = docs.withColumn(key, own)
    kept = near_dedup.near_duplicates(keyed, id_col=key).where("doc_id <=> component_id").select(F.col("doc_id").alias(kept_key)).distinct()
    joined = keyed.join(kept, F.col(key).eqNullSafe(F.col(kept_key)), "left_semi")
    return (joined.dropDuplicates([key]) if repeats else joined).select(*docs.columns)


def mixed(docs: DataFrame) -> DataFrame:
    """Documents as often as the mix reads them; where a reading ends inside a text, its first words."""
    give_back(docs.sparkSession)
    out = source_mix.mixed_documents(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packed(docs: DataFrame) -> DataFrame:
    """Places of the pieces of all documents in sequences.

    Null and empty texts are pieces of one id, the end mark; repeated rows and ids are packed each by itself; pieces of one
    length may change places, which are equally good; no documents give no pieces.
    """
    give_back(docs.sparkSession)
    return packing.pack(docs)
