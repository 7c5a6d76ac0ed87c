"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile

import numpy as np
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A bit table has at most 2**MAX_TABLE_BITS bits: 16 MB.
MAX_TABLE_BITS = 27
#: One word: a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front until no column of df has one of them, in any case of letters."""
    taken, front = {c.lower() for c in df.columns}, "_"
    while any((front + n).lower() in taken for n in names):
        front += "_"
    return [front + n for n in names]


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one only in local mode without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="predica-")
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the cluster's shared checkpoint folder (see shared_folder()).

    Lost executors don't matter: the files are in the shared folder.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    # A checkpoint can't resolve the columns of the partitioning that a union may report.
    key = "spark.sql.unionOutputPartitioning"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def give_back(spark: SparkSession | None = None) -> None:
    """Gives the memory that this Python process, and the driver's JVM if there is a session, have freed back to the system.

    Plans, their code and the threads of shuffles and broadcasts leave free pages all over the JVM's C heap, and its Java heap
    shrinks in a full collection only. C libraries other than glibc, and JVMs without the command, give back by themselves
    or not at all.
    """
    with contextlib.suppress(OSError, AttributeError, TypeError):
        ctypes.CDLL(None).malloc_trim(0)
    if spark is not None:
        spark._jvm.System.gc()
        with contextlib.suppress(Py4JError):
            trim_jvm(spark)


def trim_jvm(spark: SparkSession) -> str:
    """Gives free pages of the JVM's C heap back; what the JVM says of it."""
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    of = jvm.java.lang.Class.forName

    def filled(kind, *items):
        out = array(kind, len(items))
        for i, x in enumerate(items):
            out[i] = x
        return out

    # By reflection on the interface: Py4J finds no methods of a class that its module doesn't export.
    kinds = filled(jvm.java.lang.Class, *map(of, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")))
    command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    given = filled(jvm.Object, command, "systemTrimNativeHeap", filled(jvm.Object), filled(jvm.String))
    return of("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def word_count(col: Column) -> Column:
    """Number of WORDs; null counts as empty."""
    return F.regexp_count(F.coalesce(col, F.lit("")), F.lit(WORD)).cast("long")


def hex64(col: Column) -> Column:
    """16 lowercase hex digits of a bigint's 64 bits."""
    return F.lower(F.lpad(F.hex(col), 16, "0"))


def bit_table(hashes: DataFrame, column: str) -> np.ndarray:
    """A set of bits: bit i is set if one of the 64-bit hashes begins with i. Its size follows the number of hashes up to
    2**MAX_TABLE_BITS bits, so it may be broadcast at any size of the input; beyond, more hashes seem to be in it."""
    n = hashes.count()
    bits = max(16, min(MAX_TABLE_BITS, 3 + max(1, n).bit_length()))
    slot = f"shiftrightunsigned({column}, {64 - bits})"
    words = hashes.select(F.expr(f"shiftrightunsigned({slot}, 6)").alias("word"), F.expr(f"shiftleft(1L, cast({slot} & 63 as int))").alias("bit"))
    out = np.zeros(1 << (bits - 6), np.int64)
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out[found.column("word").to_numpy()] = found.column("bit").to_numpy()
    return out


def in_bit_table(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether uint64 hashes may be among those of a bit table."""
    slots = hashes >> np.uint64(64 - (len(table) * 64 - 1).bit_length())
    return ((table[(slots >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (slots & np.uint64(63))) & np.uint64(1)).astype(bool)
