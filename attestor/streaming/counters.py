"""Live counters of sessions: a batch, and Structured Streaming with the same rows.

A session's counters live for a day after its last event and then begin anew. In a batch that is a session window; in a
stream it is a state with a timeout, so state doesn't grow without end. Each micro-batch writes the sessions it changed to
a folder of its own number: running it again after a failure writes the same rows, and `latest` reads the newest of each.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window as W

from ..session import ship

TTL = "24 hours"
FINISHED = ("purchase",)
_COUNTS = "events long, errors long, value double, first timestamp, last timestamp, state string"


def _aggregates() -> list[Column]:
    return [
        F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.sum("value"), 2).alias("value"),
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.max_by("event_type", F.struct("ts", "event_id")).alias("state"),
    ]


def lives(events: DataFrame, ttl: str = TTL) -> DataFrame:
    """(user_id, events, errors, value, first, last, state) for each stretch of events without a gap of `ttl` or more."""
    return events.groupBy("user_id", F.session_window("ts", ttl)).agg(*_aggregates()).drop("session_window")


def counters(events: DataFrame, ttl: str = TTL) -> DataFrame:
    """The last life of each session."""
    fields = ["events", "errors", "value", "first", "last", "state"]
    best = lives(events, ttl).groupBy("user_id").agg(F.max_by(F.struct(*fields), "last").alias("x"))
    return best.select("user_id", "x.*")


def fleet(sessions: DataFrame) -> DataFrame:
    """One row over all sessions."""
    return sessions.agg(F.count("*").alias("sessions"), F.sum("events").alias("events"), F.sum("errors").alias("errors"), F.round(F.sum("value"), 2).alias("value"))


def active(sessions: DataFrame, as_of: Column, ttl: str = TTL) -> DataFrame:
    """Sessions that are neither finished nor expired; the others are pruned from the set of active ones."""
    return sessions.filter(~F.col("state").isin(*FINISHED) & (F.col("last") + F.expr(f"INTERVAL {ttl}") > as_of))


def completed(sessions: DataFrame, n: int = 50) -> DataFrame:
    """The newest finished sessions."""
    return sessions.filter(F.col("state").isin(*FINISHED)).orderBy(F.desc("last"), "user_id").limit(n)


def _step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One session in one micro-batch. Its state is the lives that an event may still join: those that ended less than the
    lifetime before the watermark, and the last one. A late event in the gap between two lives makes them one, as in a batch."""
    if state.hasTimedOut:
        state.remove()
        return
    ttl = int(pd.Timedelta(TTL).total_seconds() * 1_000_000)
    lives = json.loads(state.get[0]) if state.exists else []  # [first, last, events, errors, value, kind, newest id]
    for p in parts:
        times = p["ts"].astype("datetime64[us]").astype("int64")
        lives += [[t, t, 1, int(what == "error"), 0.0 if pd.isna(v) else float(v), what, int(i)] for t, i, what, v in zip(times, p["event_id"], p["event_type"], p["value"], strict=True)]
    merged: list[list] = []
    for life in sorted(lives, key=lambda x: x[:2]):
        if merged and life[0] - merged[-1][1] < ttl:
            m = merged[-1]
            if (life[1], life[6]) >= (m[1], m[6]):
                m[5:] = life[5:]
            m[1:5] = [max(m[1], life[1]), m[2] + life[2], m[3] + life[3], m[4] + life[4]]
        else:
            merged.append(life)
    reached = state.getCurrentWatermarkMs() * 1000 - ttl
    state.update((json.dumps([x for x in merged if x[1] > reached or x is merged[-1]]),))
    first, last, events, errors, value, kind, _ = merged[-1]
    state.setTimeoutTimestamp((last + ttl) // 1000)
    times = [pd.Timestamp(t, unit="us") for t in (first, last)]
    yield pd.DataFrame({"user_id": [key[0]], "events": [events], "errors": [errors], "value": [round(value, 2)], "first": times[:1], "last": times[1:], "state": [kind]})


def stream(events: DataFrame) -> DataFrame:
    """The counters of a stream's sessions, those that a micro-batch changed. Events may come in any order, up to a day after the
    newest one seen; later ones are dropped."""
    ship(events.sparkSession)
    kind = dict(events.dtypes)["ts"]
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", TTL)  # watermarks need instants
    timed = timed.filter("user_id IS NOT NULL AND ts IS NOT NULL").select("user_id", "ts", "event_id", "event_type", "value")
    rows = timed.groupBy("user_id").applyInPandasWithState(_step, f"user_id long, {_COUNTS}", "lives string", "update", GroupStateTimeout.EventTimeTimeout)
    return rows.withColumns({c: F.col(c).cast(kind) for c in ("first", "last")})


def follow(spark: SparkSession, folder: str, schema, checkpoint: str, out: str, files: int = 1) -> StreamingQuery:
    """Counters of a folder of parquet files, in `out` by micro-batch."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch:09d}")

    return stream(source).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The newest row of each session in what `follow` has written."""
    rows = spark.read.parquet(out)
    fields = [c for c in rows.columns if c not in {"user_id", "batch"}]
    return rows.groupBy("user_id").agg(F.max_by(F.struct(*fields), F.col("batch").cast("long")).alias("x")).select("user_id", "x.*")


def limited(attempts: DataFrame, key: str, ts: str, most: int = 5, seconds: float = 60.0) -> DataFrame:
    """(key, ts, allowed): whether each attempt is let through, where `most` that were let through within `seconds` before
    it bar it. Refused attempts don't count, so a range frame can't tell; the sorted rows of a partition are read as a stream
    and a key's state is the times of its last `most` that passed. Null keys are one key."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, passed = object(), []
        for b in batches:
            out = []
            for k, t in zip(b[key], b[ts], strict=True):
                same = k == now or (pd.isna(k) and pd.isna(now))
                now, passed = k, [p for p in passed if (t - p).total_seconds() < seconds] if same else []
                out.append(len(passed) < most)
                if out[-1]:
                    passed.append(t)
            yield b.assign(allowed=out)

    ship(attempts.sparkSession)
    rows = attempts.select(key, ts).repartition(key).sortWithinPartitions(key, ts)
    kinds = dict(rows.dtypes)
    return rows.mapInPandas(of, f"`{key}` {kinds[key]}, `{ts}` {kinds[ts]}, allowed boolean")


def carried_forward(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """`rows` with the last filled value up to each."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, True).over(w))
