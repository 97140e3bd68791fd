"""Keyed state over time: a token bucket for each client, and running request counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState

from likeness.runtime import ship


def refill(tokens: float, last: float, now: float, per_minute: float) -> float:
    """Tokens at ``now``: they grow steadily, up to the capacity; time does not run back."""
    return min(per_minute, tokens + max(now - last, 0.0) * per_minute / 60)


def rate_limited(requests: DataFrame, per_minute: float, client: str = "client", ts: str = "ts", key: str = "request_id") -> DataFrame:
    """(key, client, ts, allowed, tokens left): a full bucket at a client's first request; a request takes one token or is refused.

    Rows are dealt by client and sorted by time, and each task streams over
    them with the state of one client at a time, so a client of any number of
    requests needs no memory of its own.
    """
    ship(requests.sparkSession)
    src = requests.select(F.col(key).cast("long").alias("k"), F.col(client).cast("string").alias("c"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t")).repartition("c").sortWithinPartitions("c", "t", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, tokens, last = object(), per_minute, 0.0
        for b in batches:
            ok, left = [], []
            for c, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                now = (t or 0) / 1e6
                if c != who:
                    who, tokens, last = c, per_minute, now
                tokens, last = refill(tokens, last, now, per_minute), max(last, now)
                ok.append(tokens >= 1)
                tokens -= ok[-1]
                left.append(tokens)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ok, pa.bool_()), pa.array(left, pa.float64())], names=["k", "c", "t", "allowed", "tokens"])

    out = src.mapInArrow(run, "k long, c string, t long, allowed boolean, tokens double")
    return out.select(F.col("k").alias(key), F.col("c").alias(client), F.timestamp_micros("t").alias(ts), "allowed", "tokens")


def rate_limited_stream(requests: DataFrame, per_minute: float, client: str = "client", ts: str = "ts") -> DataFrame:
    """The same on a stream: state of a client is (tokens, time of the last request); late ones refill nothing."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (per_minute, None)
        for f in frames:
            f = f.sort_values(ts)
            ok = []
            for t in f[ts]:
                now = t.timestamp()
                tokens = refill(tokens, now if last is None else last, now, per_minute)
                last = now if last is None else max(last, now)
                ok.append(tokens >= 1)
                tokens -= ok[-1]
            yield pd.DataFrame({client: f[client].astype(str), ts: f[ts], "allowed": ok})
        state.update((tokens, last))

    return requests.groupBy(client).applyInPandasWithState(step, f"{client} string, {ts} timestamp, allowed boolean", "tokens double, last double", "append", "NoTimeout")


def outcome_counts(requests: DataFrame, outcome: str = "outcome") -> DataFrame:
    """Running counts by outcome; batch, or a stream in complete mode."""
    return requests.groupBy(outcome).agg(F.count("*").alias("n"))


def put_batch(rows: DataFrame, batch: int, to: str) -> None:
    """Write a batch of the enrolment log to a folder of its number; one that is delivered again takes its own place."""
    rows.write.mode("overwrite").parquet(f"{to}/batch={batch}")


def enrolment_stream(samples: DataFrame, to: str, checkpoint: str):
    """Log the enrolled samples of a stream, each batch once, however often it is delivered after a restart."""
    return samples.writeStream.foreachBatch(lambda rows, batch: put_batch(rows, batch, to)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def enrolled(log: DataFrame, key: tuple[str, ...], order: str | None = None) -> DataFrame:
    """The log's last row for each key: of the highest batch, in it the one with the largest ``order``, of equal ones the largest by its JSON text.

    ``log`` is the table that ``enrolment_stream`` writes, with its column ``batch``. The first rows to meet are
    put together before the shuffle, so a key that is enrolled very often is not collected.
    """
    cols = [c for c in log.columns if c != "batch"]
    whole = F.struct(*[F.col(f"`{c}`") for c in cols])
    rank = F.struct(F.col("batch").cast("long"), *[F.col(order)] * (order is not None), F.to_json(whole))
    return log.groupBy(*key).agg(F.max_by(whole, rank).alias("_row")).select("_row.*")
