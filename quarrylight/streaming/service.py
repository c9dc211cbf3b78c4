"""Rate limits, latency histograms and audit over event streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Upper bounds in milliseconds.
BOUNDS = (1, 2, 5, 10, 25, 50, 100, 250, 500, 1000, 2500)


def latency_histogram(rows: DataFrame, latency: str, by: list[str] | None = None) -> DataFrame:
    """Cumulative counts by bound (le_1 ... le_2500), with n and total."""
    aggs = [F.sum(F.when(F.col(latency) <= b, 1).otherwise(0)).alias(f"le_{b}") for b in BOUNDS]
    return rows.groupBy(*(by or [])).agg(*aggs, F.count(latency).alias("n"), F.sum(latency).alias("total"))


def take_token(tokens: float, last: float | None, now: float, capacity: float, refill: float) -> tuple[bool, float, float]:
    """(allowed, tokens left, time): a bucket that refills by the second."""
    if last is not None:
        tokens = min(capacity, tokens + max(0.0, now - last) * refill)
    return (True, tokens - 1.0, now) if tokens >= 1.0 else (False, tokens, now)


def rate_limit(events: DataFrame, key: str, ts: str, order: str, capacity: float, refill: float) -> DataFrame:
    """Whether a token bucket for each key allows each event, in the order of time.  A batch plan."""

    def run(pdf):
        pdf = pdf.sort_values(["now", "order"])
        tokens, last, out = float(capacity), None, []
        for now in pdf["now"]:
            ok, tokens, last = take_token(tokens, last, now, capacity, refill)
            out.append(ok)
        return pd.DataFrame({"key": pdf["key"], "order": pdf["order"], "allowed": out})

    rows = events.select(F.col(key).cast("string").alias("key"), (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("now"), F.col(order).cast("long").alias("order"))
    return rows.groupBy("key").applyInPandas(run, "key string, order long, allowed boolean")


def rate_limit_stream(events: DataFrame, key: str, ts: str, capacity: float, refill: float):
    """The same over a stream, with the bucket as state; idle keys are forgotten when their bucket is full again."""

    def run(k, frames: Iterator[pd.DataFrame], state):
        tokens, last = state.get if state.exists else (float(capacity), None)
        if state.hasTimedOut:
            state.remove()
            return
        for f in frames:
            f = f.sort_values("now")
            allowed = []
            for now in f["now"]:
                ok, tokens, last = take_token(tokens, last, now, capacity, refill)
                allowed.append(ok)
            yield pd.DataFrame({"key": k[0], "now": f["now"], "allowed": allowed})
        state.update((tokens, last))
        state.setTimeoutDuration(int(1000 * capacity / refill) + 1000)

    rows = events.select(F.col(key).cast("string").alias("key"), (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("now"))
    return rows.groupBy("key").applyInPandasWithState(run, "key string, now double, allowed boolean", "tokens double, last double", "append", "ProcessingTimeTimeout")


def audit(rows: DataFrame, path: str) -> None:
    """Append audit events (who, what, when and on what) to a table."""
    rows.write.mode("append").parquet(path)
