"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions only.

1. Sizes in words by source; source i of the order by code point (null last) weighs `weights`[i mod len]. Targets share
   the total by weight; a target stops at `most` times its source's size and the excess is shared again by weight. Sorted
   by size over weight the stopped sources come first, so prefix sums find them without iterating.
2. The schedule has one slot for each block of `block` words. Slot i is the van der Corput point of i (its bits
   reversed), mapped through the cumulative targets to a source: any stretch of the schedule has every source close to its
   share.
3. A slot's rank among its source's slots is the block that it reads, of the source's words in shuffled document order;
   past the end the source begins again, `most` times at most. So it is where blocks have one word, and for sources whose
   size and target are FULL blocks or more, which are a hundredth off their target at most. Any other source would miss its
   target by its last, partial block and by a few slots: its slots share its target, in words, equally instead, and it has
   one slot at least.
4. A document gets the overlap of its words with what the slots read.

Scale: one scan for sizes (checkpointed, narrow). Ranks and positions are prefix sums in two levels, over chunks of slots
and hash buckets of documents, so a source with a third of all rows is spread like any other; the windows over sources
and over chunk totals have a row for each source or chunk, not for each document. Slots meet sources through cells of the
unit interval and blocks by equality.

Defined cases: null text has size 0 and is never taken; null is a source of its own, the last; repeated rows are mixed
once each; without words every target and taken is 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, unused, word_count

WEIGHTS = (1, 2, 3)
MOST = 3
#: Words in a block, and slots in a schedule, at most; a small corpus has smaller blocks.
BLOCK, SLOTS = 1024, 1 << 17
#: Blocks that a source's size and target have at least if its slots are full blocks.
FULL = 1024
CHUNK = 1 << 14
BUCKET_ROWS = 4096


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, body, size) of each row; body is a hash of the text."""
    return checkpointed(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(F.col(text_col)).alias("body"), word_count(F.col(text_col)).alias("size")))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(sid, source, n_rows, source_size, target) of each source."""
    found = sized.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size"))
    order, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("sid") - 1) % len(weights) + 1).cast("int")).cast("long")
    ranked = found.withColumn("sid", F.row_number().over(order).cast("long")).withColumn("weight", weight).withColumn("total", F.sum("source_size").over(everything)).withColumn("cap", F.col("source_size") * most)
    filling = Window.orderBy(F.col("source_size") / F.col("weight"), "sid")
    before = F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    full = ranked.withColumn("full", F.col("cap").cast("double") * rest <= F.col("weight").cast("double") * (F.col("total") - before))
    left = F.col("total") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everything)
    shared = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(everything)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * left.cast("double") / shared)
    return full.select("sid", "source", "n_rows", "source_size", target.alias("target"))


def full_blocks(block: int) -> Column:
    """Whether a source's slots are full blocks."""
    return (F.least(F.col("source_size").cast("double"), F.col("target")) >= FULL * block) | F.lit(block == 1)


def schedule(sources: DataFrame, slots: int, block: int, most: int = MOST) -> DataFrame:
    """(slot, sid, rank) of the slots, in the schedule's order by slot; a source that the points miss has a slot behind it."""
    spark = sources.sparkSession
    bits = max(1, (slots - 1).bit_length())
    point = F.conv(F.reverse(F.lpad(F.bin("slot"), bits, "0")), 2, 10).cast("double") / float(1 << bits)
    total = F.sum("target").over(Window.partitionBy())
    upto = F.sum("target").over(Window.orderBy("sid"))
    count = F.count("*").over(Window.partitionBy())
    ranges = sources.where("target > 0").select("sid", ((upto - F.col("target")) / total).alias("low"), F.when(F.row_number().over(Window.orderBy(F.col("sid").desc())) == 1, F.lit(2.0)).otherwise(upto / total).alias("high"), F.greatest(F.lit(64), count * 4).alias("cells"), full_blocks(block).alias("full"), F.expr(f"(source_size + {block - 1}) div {block}").alias("n_blocks"))
    cell = lambda c: F.floor(F.least(F.col(c), F.lit(0.9999999999)) * F.col("cells")).cast("long")
    by_cell = ranges.select("*", F.explode(F.sequence(cell("low"), cell("high"))).alias("cell"))
    cells = ranges.agg(F.max("cells")).first()[0]
    points = spark.range(slots).withColumnRenamed("id", "slot").withColumn("point", point)
    drawn = points.withColumn("cell", F.floor(F.col("point") * cells).cast("long")).join(by_cell, "cell").where("point >= low AND point < high").select("slot", "sid", "full", "n_blocks", F.expr(f"slot div {CHUNK}").alias("chunk"))
    inside = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1
    chunks = drawn.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    earlier = chunks.select("sid", "chunk", (F.sum("n").over(Window.partitionBy("sid").orderBy("chunk")) - F.col("n")).alias("earlier"))
    ranked = drawn.withColumn("inside", inside).join(earlier, ["sid", "chunk"]).withColumn("rank", F.col("earlier") + F.col("inside"))
    own = ranked.where(~F.col("full") | (F.col("rank") < F.col("n_blocks") * most)).select("slot", "sid", "rank")
    missed = ranges.where(~F.col("full")).join(chunks, "sid", "left_anti").select((F.col("sid") + slots).alias("slot"), "sid", F.lit(0).cast("long").alias("rank"))
    return own.union(missed)


def positions(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Each row with its source's figures and `start`, its first word's place in the source's shuffled stream."""
    joined = sized.join(sources, sized.source.eqNullSafe(sources.source)).drop(sources.source)
    spread = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 7), 16, 10).cast("long")
    buckets = F.expr(f"n_rows div {BUCKET_ROWS} + 1")
    dealt = joined.withColumn("spread", spread).withColumn("bucket", F.shiftright(F.col("spread") * buckets, 28))
    own = Window.partitionBy("sid", "bucket").orderBy("spread", "doc_id", "body", "size").rowsBetween(Window.unboundedPreceding, 0)
    totals = dealt.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    earlier = totals.select("sid", "bucket", (F.sum("words").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("words")).alias("earlier"))
    placed = dealt.withColumn("inside", F.sum("size").over(own) - F.col("size")).join(earlier, ["sid", "bucket"])
    return placed.select("doc_id", "source", "body", "size", "sid", "source_size", "target", (F.col("earlier") + F.col("inside")).alias("start"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row for each row of docs: doc_id, source, body, size, source_size, target, taken, parts.

    taken: words that the mix takes, repeats counted; parts: the words of each reading, counted from the text's start.
    """
    sized = sizes(docs, id_col, text_col, source_col)
    sources = checkpointed(targets(sized, weights, most))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    block = max(1, min(BLOCK, total // SLOTS))
    placed = positions(sized, sources)
    if not total:
        return placed.select("doc_id", "source", "body", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.array().cast("array<bigint>").alias("parts"))
    read = checkpointed(schedule(sources, -(-total // block), block, most))
    plans = checkpointed(sources.join(read.groupBy("sid").agg(F.count("*").alias("slots")), "sid").select("sid", "slots", full_blocks(block).alias("full"), F.expr(f"(source_size + {block - 1}) div {block}").alias("n_blocks"), F.least(F.round("target").cast("long"), F.col("source_size") * most).alias("reads")))
    row = ["doc_id", "source", "body", "size", "sid", "source_size", "target", "start"]
    # The ranks of the slots that may meet a document's words; slot k of n reads words k * reads / n to (k + 1) * reads / n.
    empty, last = "cast(array() as array<struct<epoch: int, rank: bigint>>)", "least({0} * source_size + start + size, reads)"
    whole = f"if({{0}} * n_blocks < slots, transform(sequence(start div {block}, (start + size - 1) div {block}), b -> struct({{0}} as epoch, {{0}} * n_blocks + b as rank)), {empty})"
    shared = f"if({{0}} * source_size + start < reads, transform(sequence((({{0}} * source_size + start + 1) * slots - 1) div reads, ({last} * slots - 1) div reads), k -> struct({{0}} as epoch, k as rank)), {empty})"
    meets = F.concat(*(F.expr(f"if(full, {whole}, {shared})".format(e)) for e in range(most)))
    spans = placed.join(plans, "sid", "left").withColumn("meet", F.explode_outer(F.when((F.col("size") > 0) & F.col("slots").isNotNull(), meets))).select(*row, "slots", "full", "n_blocks", "reads", "meet.epoch", "meet.rank")
    first = F.expr(f"if(full, (rank - epoch * n_blocks) * {block}, (rank * reads) div slots - epoch * source_size)")
    past = F.expr(f"if(full, (rank - epoch * n_blocks + 1) * {block}, ((rank + 1) * reads) div slots - epoch * source_size)")
    overlap = F.greatest(F.lit(0), F.least(F.col("start") + F.col("size"), past) - F.greatest(F.col("start"), first))
    taken = spans.join(read.select("sid", "rank", F.lit(True).alias("is_read")), ["sid", "rank"], "left").withColumn("words", F.when(F.col("is_read"), overlap).otherwise(F.lit(0)).cast("long"))
    sums = [F.coalesce(F.sum(F.when(F.col("epoch") == e, F.col("words"))), F.lit(0)).alias(f"part{e}") for e in range(most)]
    out = taken.groupBy(*row).agg(*sums, F.count(F.when(F.col("rank").isNull(), 1)).alias("empty"))
    parts = F.array(*(F.col(f"part{e}") for e in range(most)))
    # Rows without words that agree in everything are one group: one row for each again.
    return out.select("doc_id", "source", "body", "size", "source_size", "target", sum(F.col(f"part{e}") for e in range(most)).cast("long").alias("taken"), F.filter(parts, lambda x: x > 0).alias("parts"), F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("empty").cast("int")))).alias("copy")).drop("copy")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The rows of docs that the mix takes, once for each reading.

    Where a reading ends inside a text (once in a source and epoch), the row has the text's first words only, joined by
    spaces.
    """
    body, own_id, own_source, own_body, size, parts, words = unused(docs, "body", "own_id", "own_source", "own_body", "size", "parts", "words")
    rows = docs.withColumn(body, F.xxhash64(F.col(text_col)))
    taken = checkpointed(mix(docs, id_col, text_col, source_col, weights, most).where("taken > 0").select(F.col("doc_id").alias(own_id), F.col("source").alias(own_source), F.col("body").alias(own_body), F.col("size").alias(size), F.col("parts").alias(parts)))
    if not taken.groupBy(own_id, own_source, own_body).agg(F.count("*").alias("rows")).where("rows > 1").isEmpty():  # rows that repeat in all of it
        rows = rows.dropDuplicates([id_col, source_col, body])
    joined = rows.join(taken, F.col(id_col).eqNullSafe(F.col(own_id)) & F.col(source_col).eqNullSafe(F.col(own_source)) & (F.col(body) == F.col(own_body)))
    read = joined.withColumn(words, F.explode(parts))
    cut = F.array_join(F.slice(F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != ""), F.lit(1), F.col(words).cast("int")), " ")
    return read.withColumn(text_col, F.when(F.col(words) < F.col(size), cut).otherwise(F.col(text_col))).select(*docs.columns)
