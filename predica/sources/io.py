"""Readers and writers of rules and rows."""

from __future__ import annotations

import dataclasses
import json
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.rules import Rule
from ..plans.ir import RuleError


def shared_folder(spark: SparkSession, prefix: str) -> str:
    """A new path below the cluster's shared folder, spark.checkpoint.dir; a local one only in local mode without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="predica-")
    return f"{folder.rstrip('/')}/{prefix}-{uuid.uuid4().hex}"


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def read_rules(spark: SparkSession, path: str) -> list[Rule]:
    """Rules of a JSON array, from any file system that Spark reads."""
    try:
        found = [json.loads(r.value) for r in _whole(spark, path).collect()]
    except ValueError as e:
        raise RuleError(f"{path}: {e}") from None
    return [Rule.of(x) for part in found for x in (part if isinstance(part, list) else [part])]


def read_users(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Rows of a JSON array of flat objects; a uid of 0, absent or not a number becomes the row's place in the array, from 1.

    Without a schema, fields get the types of all rows; read_users_variant() keeps each value's own type.
    """
    rows = read_users_variant(spark, path)
    if schema is None:
        kinds = rows.selectExpr("schema_of_variant_agg(fields) AS kind").first()[0].replace("OBJECT", "STRUCT")
        schema = kinds if kinds != "STRUCT<>" else "STRUCT<uid: BIGINT>"
    parsed = rows.select("uid", F.from_json(F.to_json("fields"), schema).alias("f"))
    names = [n for n in parsed.schema["f"].dataType.names if n != "uid"]
    return parsed.select("uid", *(F.col(f"f.`{n}`").alias(n) for n in names))


def read_users_variant(spark: SparkSession, path: str) -> DataFrame:
    """(uid, fields): fields is the row as a variant, for rules over values of mixed types."""
    each = _whole(spark, path).select(F.posexplode(F.expr("cast(parse_json(value) as array<variant>)")).alias("place", "fields"))
    return each.select(uid_of("fields", F.col("place")).alias("uid"), "fields")


def uid_of(variant: str, place: Column) -> Column:
    """The uid of a variant row: a number cut to a whole one; else the place + 1."""
    uid = F.variant_get(F.col(variant), "$.uid", "variant")
    numeric = F.schema_of_variant(uid).rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$")
    return F.coalesce(F.nullif(F.when(numeric, F.try_variant_get(uid, "$", "double")).cast("long"), F.lit(0)), (place + 1).cast("long"))


def users_of_json(df: DataFrame, column: str) -> DataFrame:
    """df with `fields`, its JSON column as a variant (null where it isn't JSON), and `uid`: 0 if it isn't a number."""
    return df.withColumn("fields", F.try_parse_json(F.col(column))).withColumn("uid", uid_of("fields", F.lit(-1)))


def users_of_records(spark: SparkSession, records: Iterable[object], schema: T.StructType | str | None = None) -> DataFrame:
    """Rows of dataclass instances or mappings. A record that is neither is an error that names its index."""
    rows = []
    for i, r in enumerate(records):
        if dataclasses.is_dataclass(r) and not isinstance(r, type):
            rows.append(dataclasses.asdict(r))
        elif isinstance(r, Mapping):
            rows.append(dict(r))
        else:
            raise RuleError(f"record {i}: {type(r).__name__} has no fields")
    if schema is None:
        names = dict.fromkeys(k for r in rows for k in r)
        schema = T.StructType([T.StructField(n, _kind([r.get(n) for r in rows])) for n in names])
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return spark.createDataFrame([tuple(_as(r.get(f.name), f.dataType) for f in kind.fields) for r in rows], kind)


def _kind(values: list) -> T.DataType:
    kinds = {type(v) for v in values if v is not None}
    if kinds <= {bool} and kinds:
        return T.BooleanType()
    if kinds and kinds <= {int}:
        return T.LongType()
    if kinds and kinds <= {int, float}:
        return T.DoubleType()
    if kinds - {str, int, float, bool}:
        return T.ArrayType(T.StringType()) if kinds <= {list, tuple} else T.MapType(T.StringType(), T.StringType())
    return T.StringType()


def _as(v: object, kind: T.DataType) -> object:
    if v is None:
        return None
    if isinstance(kind, T.DoubleType):
        return float(v)
    if isinstance(kind, T.StringType):
        return v if isinstance(v, str) else json.dumps(v)
    if isinstance(kind, T.ArrayType):
        return [str(x) for x in v]
    if isinstance(kind, T.MapType):
        return {str(a): str(b) for a, b in v.items()} if isinstance(v, Mapping) else {}
    return v


def write_rules(spark: SparkSession, rules: Iterable[Rule], path: str) -> None:
    """A JSON array of rules, indented, in one file in the folder `path`."""
    text = json.dumps([r.to_dict() for r in rules], ensure_ascii=False, indent=2)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)


def write_users(df: DataFrame, path: str) -> None:
    """Rows as JSON arrays, one in each file of the folder `path`, as read_users() reads them. Null fields are left out."""

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            lines = batch.column("value").to_pylist()
            if lines:
                texts = lines if before is None else [before, *lines]
                out = [f"  {x}," for x in texts[:-1]]
                yield pa.RecordBatch.from_arrays([pa.array((["["] if before is None else []) + out, pa.string())], names=["value"])
                before = texts[-1]
        yield pa.RecordBatch.from_arrays([pa.array([f"  {before}", "]"] if before is not None else ["[]"], pa.string())], names=["value"])

    df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("value")).mapInArrow(arrays, "value string").write.mode("overwrite").text(path)


def read_kafka(spark: SparkSession, servers: str, topic: str, latest: bool = True, most: int | None = None) -> DataFrame:
    """A stream of (key, value, timestamp) texts; `most` records a micro-batch. Needs Spark's Kafka package."""
    reader = spark.readStream.format("kafka").options(**kafka_source(servers, topic, latest, most))
    return reader.load().select(F.col("key").cast("string"), F.col("value").cast("string"), "timestamp")


def kafka_source(servers: str, topic: str, latest: bool = True, most: int | None = None) -> dict[str, str]:
    """Options of a Kafka source."""
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "latest" if latest else "earliest"} | ({"maxOffsetsPerTrigger": str(most)} if most else {})


def kafka_sink(servers: str, topic: str, options: dict[str, str] | None = None) -> dict[str, str]:
    """Options of a Kafka sink; the others are the producer's."""
    return {"kafka.bootstrap.servers": servers, "topic": topic} | {f"kafka.{k}": v for k, v in (options or {}).items()}


def kafka_rows(df: DataFrame) -> DataFrame:
    """(key, value): the first column as text, and the row as JSON."""
    return df.select(F.col(df.columns[0]).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def write_kafka(df: DataFrame, servers: str, topic: str, options: dict[str, str] | None = None):
    """Rows as JSON to a topic, keyed by the first column; returns the stream's writer, or None after a batch."""
    rows, settings = kafka_rows(df), kafka_sink(servers, topic, options)
    if df.isStreaming:
        return rows.writeStream.format("kafka").options(**settings)
    rows.write.format("kafka").options(**settings).save()
    return None


def read_jdbc_rules(spark: SparkSession, url: str, table: str, properties: dict[str, str] | None = None) -> DataFrame:
    """The enabled rules of a database table."""
    return spark.read.jdbc(url, enabled_rules(table), properties=properties or {})


def enabled_rules(table: str) -> str:
    """What is read of a rule table in a database."""
    return f"(SELECT id, name, expr, priority, enabled FROM {table} WHERE enabled = 1) rules"
