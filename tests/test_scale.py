"""What keeps large tables going: no join or shuffle of the grid, no panel broadcast, no overflow, folds of one class."""

from collections import defaultdict

from pyspark.sql import functions as F

from icupanel.operators import panel as P
from icupanel.operators import stats as ST
from icupanel.plans import fitted
from icupanel.plans import models as M
from icupanel.queries import base, jobs
from icupanel.sources import io

DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_grid_equals_loop(spark):
    """Gaps, repeated times, times off the step, null times and stays, against a plain loop."""
    rows = [(1, 0, 1.0), (1, 4, None), (1, 9, 3.0), (1, 9, 4.0), (2, 5, 6.0), (2, None, 7.0), (3, -2, 8.0), (3, 1, 9.0), (None, 1, 5.0), (None, 3, 5.0), (None, 3, 6.0), (4, None, 1.0)]
    df = spark.createDataFrame(rows, "stay_id long, stay_time long, v double")
    for step in (1, 2, 3):
        times = defaultdict(list)
        for i, t, _ in rows:
            if t is not None:
                times[i].append(t)
        want = []
        for i, ts in times.items():
            for t in range(min(ts), max(ts) + 1, step):
                want += [(i, t, v) for j, u, v in rows if i is not None and (j, u) == (i, t)] or [(i, t, None)]
        got = P.complete_grid(df, step)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and got.columns == df.columns
    held = [tuple(r) for r in P.complete_grid(df.where("stay_id = 3").withColumn("w", F.col("v")), carried=["w"]).orderBy("stay_time").collect()]
    assert held == [(3, -2, 8.0, 8.0), (3, -1, None, 8.0), (3, 0, None, 8.0), (3, 1, 9.0, 9.0)]


def test_panel_is_shuffled_once(spark):
    """Only the events are dealt, by stay; the panel is neither joined nor shuffled nor sorted."""
    p = plan(base.filled(spark, DIR))
    assert "Join" not in p and p.count("Exchange") == 1


def test_panel_is_not_broadcast(spark):
    """A panel's size isn't seen in its bytes, so the stays are the side that is built."""
    joins = [line for line in plan(jobs._model_rows(spark, DIR)).split("\n") if "Join" in line]
    assert "ShuffledHashJoin [stay_id" in joins[0] and ", BuildRight" in joins[0]


def test_signed_ranks_of_millions(spark):
    """The number of differences cubed is beyond 64 bits."""
    n = 3_000_000
    rows = spark.range(n).select((F.col("id") % 3).cast("double").alias("a"), F.lit(1.0).alias("b"))
    got = ST.paired_tests(rows, "a", "b").first()
    m = 2 * n // 3
    assert got.n == n and got.w == m / 2 * (m + 1) / 2 and abs(got.z) < 1e-9
    rows = spark.range(n).select((F.col("id") % 4).cast("double").alias("a"), F.lit(-1.0).alias("b"), F.lit("x").alias("g"))
    assert ST.paired_tests(rows, "a", "b").first().w == ST.paired_tests_by(rows, "a", "b", ["g"]).first().w == n * (n + 1) / 2


def test_training_rows_of_one_class(spark):
    """Folds and repetitions whose training stays are all controls are judged like others."""
    rows = spark.createDataFrame([(i, t, float(i == 0), i % 2, float(i + t)) for i in range(8) for t in range(3)], "stay_id long, stay_time long, label double, fold int, x double")
    cv = M.search(rows, "logistic", ["x"], {"regParam": [0.0, 0.1], "maxIter": [5]}, "fold")
    assert len(cv.avgMetrics) == 2
    splits = spark.createDataFrame([(i, r, ("test", "validation", "train", "train")[i % 4]) for i in range(8) for r in range(2)], "stay_id long, rep int, split string")
    assert [r[0] for r in M.refit(rows, splits, "logistic", ["x"], {"maxIter": 5})] == [0, 1]


def test_isotonic_takes_a_row_a_score(spark):
    """Repeated scores count by their number."""
    data = [(i, 0, float((i * 7) % 5 < 2 + (i % 10) // 3), (i % 10) / 10) for i in range(500)]
    t = spark.createDataFrame(data, "stay_id long, stay_time long, label double, score double")
    got = {r.score: r.calibrated for r in M.recalibrated(t, t, "isotonic").collect()}
    blocks = []
    for s in sorted(got):
        ys = [y for _, _, y, x in data if x == s]
        blocks.append([sum(ys), len(ys), [s]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            a, n, xs = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a, blocks[-1][1] + n, blocks[-1][2] + xs]
    assert all(abs(got[s] - a / n) < 1e-9 for a, n, xs in blocks for s in xs)


def test_folders_are_listed_by_few_tasks(spark, tmp_path):
    """A hundred folders of a patient each take no task a folder, and the session's setting stays."""
    for k in range(100):
        (tmp_path / f"psv/stay_id={k}").mkdir(parents=True)
        (tmp_path / f"psv/stay_id={k}/x.csv").write_text(f"stay_time|v\n{k}|NaN\n")
    key, sc = "spark.sql.sources.parallelPartitionDiscovery.parallelism", spark.sparkContext
    before = spark.conf.get(key)
    sc.setJobGroup("listing", "listing")
    got = io.read_psv(spark, str(tmp_path / "psv"), "stay_time long, v double", r"stay_id=(\d+)/")
    sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert tasks and max(tasks) <= 4 * sc.defaultParallelism < 100 and spark.conf.get(key) == before
    assert sorted((r.stay_id, r.stay_time, r.v) for r in got.collect()) == [(k, k, None) for k in range(100)]


def test_search_over_counted_rows(spark, monkeypatch):
    """Distinct rows with their numbers are fitted and judged as all rows are; the query searches those."""
    rows = spark.range(6000).select(F.col("id").alias("stay_id"), (F.col("id") % 3).cast("int").alias("fold"), (F.col("id") % 7).cast("double").alias("x"), F.when(F.col("id") % 5 > 0, (F.col("id") % 5).cast("double")).alias("y"), F.when(F.pmod(F.xxhash64("id"), F.lit(10)) < F.col("id") % 7, 1.0).otherwise(0.0).alias("label"))
    grid = {"regParam": [0.0, 0.1], "maxIter": [5]}
    few = M.counted(rows, ["x", "y"], ["label", "fold"])
    assert few.agg(F.sum("weight")).first()[0] == 6000 and few.count() <= 210
    one, two = M.search(rows, "logistic", ["x", "y"], grid, "fold").avgMetrics, M.search(few, "logistic", ["x", "y"], grid, "fold", weight="weight").avgMetrics
    assert max(abs(a - b) for a, b in zip(one, two)) < 1e-3
    seen, search = [], M.search
    monkeypatch.setattr(M, "search", lambda rows, *a, **k: seen.append(rows) or search(rows, *a, **k))
    assert jobs.logistic_cv(spark, DIR).count() == 2 and seen[0].count() < base.panel(spark, DIR).count() / 2


def test_windows_run_once_in_a_fit(spark, monkeypatch):
    """Rows are stored after the windows and before the first fitted step; states are the same as without."""
    rows = spark.createDataFrame([(i, t, float(i + t) if t % 2 else None) for i in range(9) for t in range(8)], "stay_id long, stay_time long, a_raw double")
    steps = [("carry on", "locf", {"columns": ["a_raw"]}), ("only these", "select", {"columns": ["stay_id", "a_locf"]}), ("fill", "impute_median", {"columns": ["a_locf"]}), ("normalise", "zscore", {"columns": ["a_locf"]})]
    stored = []
    made = fitted.fit(rows, steps, kept=lambda df: stored.append(df) or base.once(df, "test-carried"))
    assert [df.columns for df in stored] == [["stay_id", "a_locf"]] and "Window" in plan(stored[0]) and "Window" not in plan(made.states[-1])
    plain = fitted.fit(rows, steps)
    assert [s and s.collect() for s in made.states] == [s and s.collect() for s in plain.states]
