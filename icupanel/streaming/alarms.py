"""Streaming jobs: hourly means, the complete hourly grid, and each stay's first alarm."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, path: str, schema: str, pattern: str | None = None, files_a_batch: int | None = 1) -> DataFrame:
    """The Parquet files of a folder as a stream, `files_a_batch` at a time or, with None, all that are there."""
    reader = spark.readStream.schema(schema)
    reader = reader if files_a_batch is None else reader.option("maxFilesPerTrigger", files_a_batch)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).parquet(path)


def hourly_means(events: DataFrame, ts: str = "ts", late: str = "2 hours", by: tuple[str, ...] = ("user_id", "event_type"), value: str = "value") -> DataFrame:
    """Mean value of each hour and group; rows later than the watermark are dropped."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, "1 hour").alias("w"), *by).agg(F.avg(value).alias("mean"), F.count("*").alias("n")).select(F.col("w.start").alias("hour"), *by, "mean", "n")


def first_alarms(events: DataFrame, cut: float, id: str = "user_id", ts: str = "ts", value: str = "value") -> DataFrame:
    """(stay_id, alarm_ts, value): a stay's first value of at least `cut`, in order of arrival; each stay comes out once.

    The state is one flag a stay.
    """
    rows = events.select(F.col(id).cast("long").alias("stay_id"), F.col(ts).cast("timestamp").alias("alarm_ts"), F.col(value).cast("double").alias("value"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        found = None
        for pdf in batches:
            hit = pdf[pdf["value"] >= cut].sort_values("alarm_ts").head(1)
            if len(hit) and (found is None or hit["alarm_ts"].iloc[0] < found["alarm_ts"].iloc[0]):
                found = hit
        if not state.exists and found is not None:
            state.update((True,))
            yield found[["stay_id", "alarm_ts", "value"]]

    return rows.groupBy("stay_id").applyInPandasWithState(step, "stay_id long, alarm_ts timestamp, value double", "alarmed boolean", "append", GroupStateTimeout.NoTimeout)


def _timed(events: DataFrame, id: str, ts: str, late: str, **columns) -> DataFrame:
    """(stay_id, ts, us, …columns) under a watermark; us is ts in microseconds, free of any time zone."""
    at = F.col(ts).cast("timestamp")
    rows = events.select(F.col(id).cast("long").alias("stay_id"), at.alias("ts"), F.unix_micros(at).alias("us"), *[c.alias(n) for n, c in columns.items()])
    return rows.where("ts is not null and stay_id is not null").withWatermark("ts", late)


def _wake(state: GroupState, ms: int) -> None:
    """Call the group again once the watermark has reached `ms`."""
    state.setTimeoutTimestamp(max(ms - 1, state.getCurrentWatermarkMs() + 1))


def first_alarms_by_time(events: DataFrame, cut: float, id: str = "user_id", ts: str = "ts", value: str = "value", late: str = "2 hours", forget_ms: int = 30 * 86_400_000) -> DataFrame:
    """(stay_id, alarm_ts, value): a stay's first value of at least `cut` by event time, whatever the order of arrival.

    An alarm waits in the state until the watermark has reached it; until then an
    earlier one that comes late takes its place.  So each stay comes out once,
    with the alarm that a batch over the same rows would find, except for rows
    later than the watermark, which are dropped.  Of values at one time the
    smallest counts.  The state of a stay, three numbers, is forgotten
    `forget_ms` after its alarm; a stay that goes on after that could be told anew.
    Rows without a stay or a time are left out.
    """
    rows = _timed(events, id, ts, late, value=F.col(value).cast("double"))
    # all rows move the watermark on; a filter that doesn't look at the time would be pushed below it
    rows = rows.where(F.when(F.col("ts").isNotNull(), F.col("value") >= cut))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        us, found, told = state.get if state.exists else (None, None, False)
        if told and us // 1000 + forget_ms <= state.getCurrentWatermarkMs():
            if state.hasTimedOut:
                state.remove()
                return
            us, found, told = None, None, False  # its time was over before these rows came
        if not state.hasTimedOut:
            for pdf in batches:
                if not told:
                    first = min(zip(pdf["us"].tolist(), pdf["value"].tolist()))
                    us, found = first if us is None else min(first, (us, found))
        if not told and us // 1000 <= state.getCurrentWatermarkMs():
            told = True
            yield pd.DataFrame({"stay_id": [key[0]], "us": [us], "value": [found]})
        state.update((us, found, told))
        _wake(state, us // 1000 + (forget_ms if told else 0))

    told = rows.groupBy("stay_id").applyInPandasWithState(step, "stay_id long, us long, value double", "us long, value double, told boolean", "append", GroupStateTimeout.EventTimeTimeout)
    return told.select("stay_id", F.timestamp_micros("us").alias("alarm_ts"), "value")


HOUR = 3_600_000_000


def _hours(start: int, end: int, means: dict[tuple[int, int], float], held: Sequence[float | None]) -> tuple[np.ndarray, np.ndarray]:
    """Means by (hour, column) as an array from hour `start` to before `end`, and the same with the last value carried on, first from `held`; NaN is missing."""
    raw = np.full((end - start, len(held)), np.nan)
    for (h, c), v in means.items():
        raw[h - start, c] = v
    whole = np.vstack([np.array(held, dtype=float), raw])
    last = np.maximum.accumulate(np.where(np.isnan(whole), 0, np.arange(len(whole))[:, None]), axis=0)
    return raw, np.take_along_axis(whole, last, axis=0)[1:]


def hourly_grid(events: DataFrame, names: dict[str, str], id: str = "user_id", ts: str = "ts", concept: str = "event_type", value: str = "value", late: str = "2 hours", forget_ms: int = 30 * 86_400_000) -> DataFrame:
    """(stay_id, stay_time, …raw, …locf): the panel's complete hourly grid, hour by hour as the watermark closes them.

    `names` gives each concept's raw column, such as hr_raw; its last value is
    carried on as hr_locf.  Hours count from a stay's first event, of any
    concept.  An hour is told once the watermark has passed its end and an event
    in it or after it is known: so empty hours between events come out, and
    those after the last event don't.  Rows later than the watermark are
    dropped; all else equals the batch panel up to the watermark.

    The state of a stay is its first time, the next hour, the values carried on
    and the events of its open hours, bounded by what arrives within the
    watermark's delay.  It is forgotten `forget_ms` after its last told hour; a
    stay that goes on after that begins anew.
    Values that are null count for the grid only.
    """
    rows = _timed(events, id, ts, late, concept=F.col(concept), value=F.col(value).cast("double"))
    concepts, raw = list(names), list(names.values())
    locf = [c.removesuffix("_raw") + "_locf" for c in raw]
    place = {c: k for k, c in enumerate(concepts)}

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, hour, held, at, what, values = state.get if state.exists else (None, 0, [None] * len(raw), [], [], [])
        waiting = list(zip(at, what, values))
        if first is not None and not waiting and (first + hour * HOUR) // 1000 + forget_ms <= state.getCurrentWatermarkMs():
            first, hour, held = None, 0, [None] * len(raw)
        if not state.hasTimedOut:
            for pdf in batches:
                for us, c, v in zip(pdf["us"].tolist(), pdf["concept"], pdf["value"].tolist()):
                    waiting.append((us, place.get(c, -1), None if v != v else v))
        now = state.getCurrentWatermarkMs()
        if not waiting:
            state.remove()
            return
        least, most = min(w[0] for w in waiting), max(w[0] for w in waiting)
        if first is None and least // 1000 <= now:
            first = least  # whatever comes from now on is later
        told = None
        if first is not None:
            closed = min((now * 1000 - first) // HOUR, (most - first) // HOUR + 1)
            open_, by_hour = [], {}
            for us, c, v in waiting:
                h = (us - first) // HOUR
                if h >= closed:
                    open_.append((us, c, v))
                elif c >= 0 and v is not None and h >= hour:
                    by_hour.setdefault((h, c), []).append(v)
            if closed > hour:
                told = _hours(hour, closed, {at: sum(x) / len(x) for at, x in by_hour.items()}, held)
                held = [None if v != v else v for v in told[1][-1].tolist()]
            hour, waiting = max(hour, closed), open_
        if waiting:
            due = min(w[0] for w in waiting) // 1000 if first is None else (first + (hour + 1) * HOUR) // 1000 + 1
        else:
            due = (first + hour * HOUR) // 1000 + forget_ms
        state.update((first, hour, held, [w[0] for w in waiting], [w[1] for w in waiting], [w[2] for w in waiting]))
        _wake(state, due)
        if told is not None:
            n = len(told[0])
            times = {"stay_id": np.full(n, key[0]), "stay_time": np.arange(hour - n, hour)}
            yield pd.DataFrame(times | {c: v[:, k] for v, names_ in zip(told, (raw, locf)) for k, c in enumerate(names_)})

    out = "stay_id long, stay_time long, " + ", ".join(f"{c} double" for c in [*raw, *locf])
    kept = "first long, hour long, held array<double>, at array<long>, what array<int>, value array<double>"
    return rows.groupBy("stay_id").applyInPandasWithState(step, out, kept, "append", GroupStateTimeout.EventTimeTimeout)


def run_to_table(stream: DataFrame, table: str, checkpoint: str, mode: str = "append") -> None:
    """Run over all that is there now and stop; exactly once into a Parquet folder."""
    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint).format("parquet").option("path", table).start()
    query.awaitTermination()
