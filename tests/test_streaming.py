"""Streaming jobs over several files, late rows and restarts against batch answers."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from icupanel.functions import windows
from icupanel.operators import panel as P
from icupanel.streaming import alarms

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"
START = dt.datetime(2024, 3, 1, 10, 17, 31)
NAMES = {"a": "hr_raw", "b": "map_raw"}


def events(seed=3, users=6, hours=60):
    """Rows in order of arrival, up to an hour late, with gaps of many hours in each user's time."""
    rng = random.Random(seed)
    rows = []
    for u in range(users):
        times = rng.sample(range(hours * 3600), 12) + [rng.randrange(hours * 3600 - 1) + 1] * 2
        rows += [(START + dt.timedelta(seconds=t), u, rng.choice("abc"), float(rng.randrange(400))) for t in times]
    rows.append((START + dt.timedelta(hours=hours + 5), 99, "a", 1.0))  # moves the watermark on
    rows.sort(key=lambda r: (r[0] + dt.timedelta(seconds=rng.randrange(3600)), r[1:]))
    return [(i, *r) for i, r in enumerate(rows)]


def run(spark, tmp_path, rows, job, files=7, a_batch=1, restarts=(2, 5)):
    """The told rows after all files; the job is stopped and begun anew before the files in `restarts`."""
    source = f"{tmp_path}/in"
    cut = [rows[len(rows) * k // files : len(rows) * (k + 1) // files] for k in range(files)]
    for k, part in enumerate(cut):
        if k in restarts:
            alarms.run_to_table(job(alarms.read_stream(spark, source, SCHEMA, files_a_batch=a_batch)), f"{tmp_path}/out", f"{tmp_path}/mark")
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    alarms.run_to_table(job(alarms.read_stream(spark, source, SCHEMA, files_a_batch=a_batch)), f"{tmp_path}/out", f"{tmp_path}/mark")
    return spark.read.parquet(f"{tmp_path}/out")


@pytest.mark.parametrize("seed", [3, 4])
def test_first_alarm_equals_batch(spark, tmp_path, seed):
    rows = events(seed)
    got = {r.stay_id: (r.alarm_ts, r.value) for r in run(spark, tmp_path, rows, lambda s: alarms.first_alarms_by_time(s, 250.0)).collect()}
    want = {}
    for _, ts, u, _, v in sorted(rows, key=lambda r: (r[1], r[4])):
        if v >= 250:
            want.setdefault(u, (ts, v))
    assert got == want and len(got) > 4
    by_arrival = {}
    for _, ts, u, _, v in rows:
        if v >= 250:
            by_arrival.setdefault(u, (ts, v))
    assert seed != 3 or by_arrival  # rows do arrive out of order:
    assert any(a[1] > b[1] for a, b in zip(rows, rows[1:]))


def test_a_late_earlier_alarm_wins_and_state_goes(spark, tmp_path):
    at = lambda h, m=0: START + dt.timedelta(hours=h, minutes=m)
    rows = [
        (0, at(3), 1, "a", 300.0), (1, at(2, 30), 1, "a", 400.0),  # the second comes late and wins
        (2, at(9), 2, "a", 10.0), (3, at(2), 1, "a", 500.0), (4, at(9, 30), 1, "a", 600.0),  # too late; told already
        (5, at(60), 2, "a", 10.0), (6, at(61), 1, "a", 700.0), (7, at(70), 2, "a", 5.0)]
    job = lambda s: alarms.first_alarms_by_time(s, 250.0, forget_ms=48 * 3_600_000)
    got = sorted((r.stay_id, r.alarm_ts, r.value) for r in run(spark, tmp_path, rows, job, files=8, restarts=(3,)).collect())
    assert got == [(1, at(2, 30), 400.0), (1, at(61), 700.0)]  # forgotten after two days, so told anew


@pytest.mark.parametrize(("seed", "a_batch"), [(3, 1), (5, None)])
def test_grid_equals_batch_panel(spark, tmp_path, seed, a_batch):
    rows = events(seed)
    got = run(spark, tmp_path, rows, lambda s: alarms.hourly_grid(s, NAMES), a_batch=a_batch).collect()
    batch = windows.locf(P.to_panel(P.to_concepts(spark.createDataFrame(rows, SCHEMA), "user_id", "ts", "event_type", "value"), NAMES), list(NAMES.values()))
    want = {(r.stay_id, r.stay_time): (r.hr_raw, r.map_raw, r.hr_locf, r.map_locf) for r in batch.collect() if r.stay_id != 99}
    assert {(r.stay_id, r.stay_time): (r.hr_raw, r.map_raw, r.hr_locf, r.map_locf) for r in got} == want and len(got) == len(want)
    assert sum(v[:2] == (None, None) for v in want.values()) > 100  # empty hours are told


def test_grid_of_odd_rows(spark, tmp_path):
    at = lambda h: START + dt.timedelta(hours=h)
    rows = [(0, at(0), 1, "c", 5.0), (1, at(0), 1, "a", None), (2, None, 1, "a", 1.0), (3, at(1), None, "a", 1.0), (4, at(3), 1, "a", 2.0), (5, at(3), 1, "a", 4.0), (6, at(20), 2, None, None)]
    got = run(spark, tmp_path, rows, lambda s: alarms.hourly_grid(s, NAMES), files=3, restarts=()).orderBy("stay_time").collect()
    assert [tuple(r) for r in got] == [(1, h, 3.0 if h == 3 else None, None, 3.0 if h == 3 else None, None) for h in range(4)]


def test_hourly_means(spark, tmp_path):
    rows = events(6)
    got = {(r.hour, r.user_id, r.event_type): (r.mean, r.n) for r in run(spark, tmp_path, rows, alarms.hourly_means).collect()}
    hour = F.date_trunc("hour", "ts")
    want = {(r.h, r.user_id, r.event_type): (r.m, r.n) for r in spark.createDataFrame(rows, SCHEMA).groupBy(hour.alias("h"), "user_id", "event_type").agg(F.avg("value").alias("m"), F.count("*").alias("n")).collect() if r.user_id != 99}
    assert got == want
