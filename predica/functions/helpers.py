"""Scalar helpers outside the rule language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Field ids whose values are masked in logs.
SENSITIVE = (
    "ID",
    "BANK_ACCOUNT",
    "CARD_HOLDER_NAME",
    "VIRTUAL_WALLET_ADDRESS",
    "VIRTUAL_WALLET_NAME",
    "E_WALLET_ACCOUNT",
    "E_WALLET_NAME",
    "QQ",
    "WECHAT_ID",
    "LINE_ID",
    "FB_ID",
    "WHATSAPP",
    "ZALO",
    "TELEGRAM",
    "VIBER",
    "TWITTER",
    "EMAIL",
    "MOBILE_NUMBER",
    "WITHDRAWER_NAME",
    "APPLE_ID",
    "KAKAO",
    "GOOGLE",
)
#: Names of interval units and their seconds.
UNITS = {1: ("SECOND", "SECONDS", "SEC", "S"), 60: ("MINUTE", "MINUTES", "MIN", "M"), 3600: ("HOUR", "HOURS", "HR", "H"), 86400: ("DAY", "DAYS", "D")}
VISIBLE = 5
QUESTION = "struct<fieldId:string,fieldName:string,fieldAttribute:string,fieldType:string,accuracy:string,score:int,valid:boolean>"
REQUEST = "struct<customerName:string,data:array<struct<item:struct<fieldId:string,fieldValue:string>,bind:boolean>>>"
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def round2(x: Column) -> Column:
    """Two decimals, half away from zero."""
    return F.round(x * 100) / 100


def round2_up(x: Column) -> Column:
    """Two decimals: half up, cut toward zero."""
    return (x * 100 + 0.5).cast("long").cast("double") / 100


def mask_value(field_id: Column, value: Column) -> Column:
    """The value; of a sensitive field, a star for each character after the fifth."""
    n = F.char_length(value)
    return F.when(field_id.isin(*SENSITIVE) & (n > VISIBLE), F.concat(F.substring(value, 1, VISIBLE), F.repeat(F.lit("*"), n - VISIBLE))).otherwise(value)


def mask_request(body: Column) -> Column:
    """A verification request's JSON with its sensitive values masked; text that isn't such JSON stays as it is."""
    parsed = F.from_json(body, REQUEST, {"mode": "PERMISSIVE"})
    items = F.transform(
        F.coalesce(parsed["data"], F.array().cast("array<struct<item:struct<fieldId:string,fieldValue:string>,bind:boolean>>")),
        lambda d: F.struct(
            F.struct(F.coalesce(d["item"]["fieldId"], F.lit("")).alias("fieldId"), F.coalesce(mask_value(d["item"]["fieldId"], d["item"]["fieldValue"]), F.lit("")).alias("fieldValue")).alias("item"),
            F.coalesce(d["bind"], F.lit(False)).alias("bind"),
        ),
    )
    masked = F.to_json(F.struct(F.coalesce(parsed["customerName"], F.lit("")).alias("customerName"), F.when(parsed["data"].isNotNull(), items).alias("data")), {"ignoreNullFields": "false"})
    return F.when(F.try_parse_json(body).isNotNull() & body.rlike(r"(?s)^\s*\{"), masked).otherwise(body)


def interval_seconds(unit: Column, interval: Column) -> Column:
    """An interval in seconds; null if the unit isn't known."""
    name = F.upper(F.regexp_replace(unit, r"(?U)^\s+|\s+$", ""))
    out = F.lit(None).cast("long")
    for seconds, names in UNITS.items():
        out = F.when(name.isin(*names), interval.cast("long") * seconds).otherwise(out)
    return out


def zero_to_null(x: Column) -> Column:
    """Null for 0 and for empty text."""
    return F.when((x.cast("string") != "0") & (x.cast("string") != ""), x)


def or_default(x: Column, default) -> Column:
    return F.coalesce(x, F.lit(default))


def time_text(x: Column) -> Column:
    """A timestamp as text; empty if null."""
    return F.coalesce(F.date_format(x, TIME_FORMAT), F.lit(""))


def flexible_time(x: Column) -> Column:
    """A timestamp from text; null if it is null, empty or something else."""
    return F.try_to_timestamp(F.nullif(x, F.lit("")), F.lit(TIME_FORMAT))


def null_int32(x: Column) -> Column:
    """The number, or -1 if null."""
    return F.coalesce(x.cast("int"), F.lit(-1))


def questions(clob: Column) -> Column:
    """map<fieldId, question> of a JSON text; null if it is empty or not such JSON."""
    return F.from_json(F.nullif(clob, F.lit("")), f"map<string,{QUESTION}>")


def valid_questions(clob: Column) -> Column:
    return F.map_filter(questions(clob), lambda _, q: F.coalesce(q["valid"], F.lit(False)))


def valid_question_infos(clob: Column) -> Column:
    """Public fields of the valid questions that have an id, by id."""
    chosen = F.filter(F.map_values(questions(clob)), lambda q: F.coalesce(q["valid"] & (q["fieldId"] != ""), F.lit(False)))
    return F.array_sort(F.transform(chosen, lambda q: F.struct(q["fieldId"].alias("fieldId"), q["fieldName"].alias("fieldName"), q["fieldAttribute"].alias("fieldAttribute"), q["fieldType"].alias("fieldType"))))


def translations(clob: Column, language: Column) -> Column:
    """map<fieldId, translation> of a language, or of EN if it has none; empty without either. Of repeated ids the last counts."""
    every = F.from_json(F.nullif(clob, F.lit("")), "map<string,array<struct<fieldId:string,fieldTranslation:string>>>")
    items = F.coalesce(F.try_element_at(every, language), F.try_element_at(every, F.lit("EN")), F.array().cast("array<struct<fieldId:string,fieldTranslation:string>>"))
    ids = F.transform(items, lambda x: x["fieldId"])
    last = F.array_distinct(ids)
    value = lambda i: F.element_at(F.filter(items, lambda x: x["fieldId"] == i), -1)["fieldTranslation"]
    return F.map_from_arrays(last, F.transform(last, value))


def profile_missing(body: Column) -> Column:
    """Whether an error body says that there is no profile; null is false."""
    return F.coalesce(F.contains(body, F.lit("profile.data_not_found")), F.lit(False))


def has_prefix(x: Column, prefix: str) -> Column:
    """Whether a value's text begins with a prefix; null is false."""
    return F.coalesce(F.startswith(x.cast("string"), F.lit(prefix)), F.lit(False))


def in_set(x: Column, *values: str) -> Column:
    """Whether a value's text is one of the values; null is false."""
    return F.coalesce(x.cast("string").isin(*values), F.lit(False))
