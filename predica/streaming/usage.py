"""Play-time accounting: seconds by day, ISO week and month for each customer and merchant.

The batch form sums a table of beats by period. The stateful form keeps one row for each key, as heartbeats update it:
usage of the day, week and month of the latest beat, which start anew when the period changes; limits keep their last
known value. Periods are in UTC.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.helpers import interval_seconds

PERIODS = ("daily", "weekly", "monthly")


def period_key(at: Column, period: str) -> Column:
    """The key of a timestamp's period: its date, ISO week (2026-W24) or month (2026-06), in the session's time zone."""
    if period == "daily":
        return F.date_format(at, "yyyy-MM-dd")
    if period == "weekly":
        return F.concat(F.extract(F.lit("YEAROFWEEK"), at).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(at).cast("string"), 2, "0"))
    if period == "monthly":
        return F.date_format(at, "yyyy-MM")
    raise ValueError(period)


def usage(beats: DataFrame, keys: list[str], at: str, seconds: str, period: str) -> DataFrame:
    """(keys, period_key, usage_sec, beats): one shuffle, after partial sums."""
    return beats.groupBy(*keys, period_key(F.col(at), period).alias("period_key")).agg(F.sum(seconds).alias("usage_sec"), F.count("*").alias("beats"))


def beats_of_json(rows: DataFrame, column: str = "value") -> DataFrame:
    """Beats of heartbeat messages; those whose unit isn't known are left out."""
    fields = F.from_json(column, "merchantCode string, intervalUnit string, timestamp bigint, customerID bigint, interval bigint").alias("b")
    beats = rows.select(fields).select(F.col("b.customerID").alias("customer_id"), F.col("b.merchantCode").alias("merchant_code"), F.timestamp_millis("b.timestamp").alias("beat_at"), interval_seconds(F.col("b.intervalUnit"), F.col("b.interval")).alias("interval_sec"))
    return beats.where("interval_sec IS NOT NULL AND customer_id IS NOT NULL")


STATE = "day string, week string, month string, daily long, weekly long, monthly long, beats long, daily_limit long, weekly_limit long, monthly_limit long, last_at timestamp"
OUTPUT = "customer_id long, merchant_code string, current_date_key string, current_week_key string, current_month_key string, daily_usage_sec long, weekly_usage_sec long, monthly_usage_sec long, beat_count_daily long, daily_limit_sec long, weekly_limit_sec long, monthly_limit_sec long, last_beat_at timestamp"


def _accumulate(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = list(state.get) if state.exists else [None, None, None, 0, 0, 0, 0, None, None, None, None]
    for beats in batches:
        if beats.empty:
            continue
        seconds = beats["interval_sec"].to_numpy(np.int64)
        for place, column in enumerate(("day", "week", "month")):
            # Only the beats since the period last changed count.
            periods = beats[column].to_numpy()
            others = np.flatnonzero(periods != periods[-1])
            first = int(others[-1]) + 1 if len(others) else 0
            goes_on = first == 0 and now[place] == periods[-1]
            now[3 + place] = (now[3 + place] if goes_on else 0) + int(seconds[first:].sum())
            if place == 0:
                now[6] = (now[6] if goes_on else 0) + len(seconds) - first
            now[place] = periods[-1]
        for place, column in enumerate(("daily_limit_sec", "weekly_limit_sec", "monthly_limit_sec")):
            known = beats[column].dropna()
            now[7 + place] = int(known.iloc[-1]) if len(known) else now[7 + place]
        now[10] = beats["beat_at"].iloc[-1].to_pydatetime()
    state.update(tuple(now))
    yield pd.DataFrame([(*key, *now)], columns=[c.strip().split(" ")[0] for c in OUTPUT.split(",")])


def accumulate(beats: DataFrame) -> DataFrame:
    """The current row of each key with a new beat, after each micro-batch; beats count in order of arrival.

    beats: customer_id, merchant_code, beat_at, interval_sec and, if known, daily_limit_sec, weekly_limit_sec,
    monthly_limit_sec.
    """
    limits = [c for c in ("daily_limit_sec", "weekly_limit_sec", "monthly_limit_sec") if c not in beats.columns]
    rows = beats.withColumns({c: F.lit(None).cast("long") for c in limits})
    keyed = rows.select("customer_id", "merchant_code", "beat_at", "interval_sec", "daily_limit_sec", "weekly_limit_sec", "monthly_limit_sec", *(period_key(F.col("beat_at"), p).alias(n) for p, n in zip(PERIODS, ("day", "week", "month"))))
    return keyed.groupBy("customer_id", "merchant_code").applyInPandasWithState(_accumulate, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def at_reading(rows: DataFrame, now: Column) -> DataFrame:
    """Accumulated rows as they are to be read at a time: usage of a period that has passed is 0."""
    columns = {}
    for period, key in zip(PERIODS, ("current_date_key", "current_week_key", "current_month_key")):
        columns[f"{period}_usage_sec"] = F.when(F.col(key) == period_key(now, period), F.col(f"{period}_usage_sec")).otherwise(F.lit(0).cast("long"))
    return rows.withColumns(columns)


TERMS_KEY = ["customer_id", "merchant_code", "node_id", "version_no"]


def new_agreements(incoming: DataFrame, existing: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Agreements that aren't there yet, one for each business key: inserting them twice adds nothing."""
    key = key or TERMS_KEY
    return incoming.dropDuplicates(key).join(existing.select(*key), key, "left_anti")


def latest_agreements(rows: DataFrame, key: list[str] | None = None, id_col: str = "id") -> DataFrame:
    """The row of the largest id of each business key."""
    key = key or TERMS_KEY
    others = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*others), id_col).alias("row")).select(*key, "row.*").select(*rows.columns)
