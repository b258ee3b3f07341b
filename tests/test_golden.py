"""Known results of utilities, labels, curves, signatures and splits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from icupanel import schema
from icupanel.functions import targets as T
from icupanel.functions import windows as W
from icupanel.operators import cohort as C
from icupanel.operators import evaluate as E
from icupanel.operators import panel as P
from icupanel.operators import splits as SP
from icupanel.operators import stats as ST
from icupanel.plans import models as M
from icupanel.sources import io


def rows(spark, *stays, label="sep3", other="pred"):
    """Stays given as (labels, others), hourly from 0."""
    out = [(i, t, None if a is None else float(a), None if b is None else float(b)) for i, (x, y) in enumerate(stays) for t, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(out, f"stay_id long, stay_time long, {label} double, {other} double")


@pytest.mark.parametrize(("stays", "shift", "want"), [
    ([([0] * 20 + [1], [0] * 9 + [1] * 12)], 0, 1.0),
    ([([0] * 5 + [None] * 4 + [0] * 11 + [1], [0] * 5 + [None] * 4 + [1] * 12)], 0, 1.0),
    ([([0] * 20 + [1], [0] * 9 + [1] * 12), ([0, 0, None, 0, 0], [0, 0, None, 0, 0])], 0, 1.0),
    ([([0] * 20 + [1], [0] * 21)], 0, 0.0),
])
def test_normalised_utility(spark, stays, shift, want):
    assert T.normalised_utility(rows(spark, *stays), "pred", shift=shift).first().normalised == pytest.approx(want)


def test_observed_utility_of_shifted_labels(spark):
    df = rows(spark, ([0, 0, 0, 0, 1, 1], [0, 0, 1, 1, 1, 1]))
    assert T.normalised_utility(df, "pred", shift=6).first().observed == pytest.approx(3.388888888888889)


def test_auc_with_ties_and_accuracy(spark):
    r = spark.createDataFrame([(0, 0.3), (0, 0.4), (0, 0.6), (0, 0.7), (1, 0.8), (1, 0.8)], "label int, score double")
    got = E.auroc_auprc(r).first()
    assert got.auroc == pytest.approx(1.0) and got.auprc == pytest.approx(1.0)
    c = E.confusion(spark.createDataFrame([(0, 0), (0, 0), (0, 1), (0, 1), (1, 1), (1, 1)], "label int, pred int"), "pred", "label").first()
    assert c.accuracy == pytest.approx(2 / 3) and c.f_measure == pytest.approx(2 / 3)


def test_label_shift_with_gap(spark):
    df = spark.createDataFrame([(1, t, x) for t, x in ((0, 0.0), (1, 0.0), (3, 0.0), (4, 1.0))] + [(2, t, 0.0) for t in (0, 2)], "stay_id long, stay_time long, sep3 double")
    got = P.shift_label(P.complete_grid(df), left=1).orderBy("stay_id", "stay_time").collect()
    assert [r.shifted for r in got if r.stay_id == 1] == [0, 0, None, 1, 1]
    assert [r.shifted for r in got if r.stay_id == 2] == [0, None, 0]


def test_checks_raise(spark):
    bad = rows(spark, ([0, 1, 0], [0, 0, 0]))
    with pytest.raises(ValueError):
        P.checked(P.onset_violations(bad), "onset")
    with pytest.raises(ValueError):
        P.checked(P.value_violations(rows(spark, ([0, None], [0, 1])), ["sep3"]), "missing")
    P.checked(P.alignment_violations(bad, bad), "keys")
    with pytest.raises(Exception, match="keys differ"):
        E.pooled([bad.select("stay_id", F.col("pred").alias("score")).limit(1), bad.select(F.lit(99).cast("long").alias("stay_id"), F.col("pred").alias("score")).limit(1)], ["stay_id"]).collect()


def test_first_alarms_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    data = [(int(i), int(t), float(rng.random() < 0.1), float(np.round(rng.random(), 3))) for i in range(30) for t in range(20)]
    df = spark.createDataFrame(data, "stay_id long, stay_time long, label double, score double")
    cuts = [0.2, 0.5, 0.9, 0.99]
    for strict in (False, True):
        got = {(r.stay_id, r.thres_no): r.alarm_time for r in E.first_alarms(df, cuts, strict=strict).collect()}
        want = {}
        for i, t, _, s in data:
            for k, c in enumerate(cuts):
                if s > c or (s == c and not strict):
                    want.setdefault((i, k), t)
        assert got == want


def test_missing_runs_at_the_limit(spark):
    data = [(s, t, None if 0 < t <= n else 1.0) for s, n in ((1, 12), (2, 13)) for t in range(20)]
    df = spark.createDataFrame(data, "stay_id long, stay_time long, x double")
    assert {r.stay_id for r in C.without_long_gaps(df, ["x"], 12).select("stay_id").distinct().collect()} == {1}


def test_lookback_of_one_row_has_no_variance(spark):
    df = spark.createDataFrame([(1, 0, 2.0), (1, 1, None), (1, 2, 4.0)], "stay_id long, stay_time long, hr_raw double")
    got = W.lookback(df, ["hr_raw"], [4]).orderBy("stay_time").collect()
    assert [r.hr_var_4_hours for r in got] == [None, None, 2.0] and [r.hr_median_4_hours for r in got] == [2.0, 2.0, 3.0]


def test_signature_of_a_line():
    got = M.signature(np.array([[0.0, 0.0], [1.0, 2.0], [2.0, 4.0]]), 3)
    x = np.array([2.0, 4.0])
    want = np.concatenate([x, np.outer(x, x).ravel() / 2, np.einsum("i,j,k->ijk", x, x, x).ravel() / 6])
    assert np.allclose(got, want)
    both = M.signatures(np.array([[[0.0, 0.0], [1.0, 2.0], [2.0, 4.0]], [[0.0, 0.0], [0.0, 1.0], [3.0, 1.0]]]), 3)
    assert np.allclose(both[0], want) and np.allclose(both[1], M.signature(np.array([[0.0, 0.0], [0.0, 1.0], [3.0, 1.0]]), 3))


def test_splits_are_disjoint_and_stratified(spark):
    stays = spark.range(200).select(F.col("id").alias("stay_id"), (F.col("id") % 5 == 0).cast("int").alias("label"))
    checks = SP.split_checks(SP.stratified_split(stays)).collect()
    assert all(r.shared == 0 for r in checks) and all(abs(r.prevalence - 0.2) < 0.03 for r in checks)
    assert {r.stays for r in checks if r.split == "test"} == {20}
    p = [r.p for r in SP.subsample(stays).groupBy("draw").agg(F.avg("label").alias("p")).collect()]
    assert len(p) == 10 and all(0.15 < x < 0.226 for x in p)


def test_files(spark, tmp_path):
    (tmp_path / "psv").mkdir()
    (tmp_path / "psv/p7.psv").write_text("HR|ICULOS\n80|1\nNaN|2\n")
    got = io.read_psv(spark, str(tmp_path / "psv"), "HR double, ICULOS long").orderBy("ICULOS").collect()
    assert [(r.stay_id, r.HR) for r in got] == [(7, 80.0), (7, None)]
    doc = '{"total": {"ids": [1,2,3,4]}, "dev": {"total": {"ids": [1,2,3]}, "split_0": {"train": [1,2], "validation": [3]}}, "test": {"total": {"ids": [4]}, "split_0": [4]}}'
    (tmp_path / "split.json").write_text(doc)
    assert {tuple(r) for r in io.read_splits(spark, str(tmp_path / "split.json")).collect()} == {(1, "train", 0), (2, "train", 0), (3, "validation", 0), (4, "test", 0)}
    assert io.newest(["a_1.9.0", "a_1.10.0", "b_2"]) == {"a": "a_1.10.0", "b": "b_2"}


def test_column_sets():
    cols = [*schema.KEYS, "sep3", "hr_raw", "hr_locf", "hr_count", "lact_raw", "lact_count", "age_static", "hr_mean_4_hours", "SIRS_derived", "sofa"]
    assert schema.feature_set(cols, "raw_vitals") == ["stay_id", "stay_time", "hr_raw", "age_static"]
    assert schema.feature_set(cols, "counts_labs") == ["stay_id", "stay_time", "lact_count", "age_static"]
    assert "hr_mean_4_hours" not in schema.feature_set(cols, "small") and "SIRS_derived" in schema.feature_set(cols, "small")
    assert schema.base_name("hr_raw") == "hr" and schema.base_name("draw") == "draw"
    assert len(schema.core_set()) == 2 + 1 + 4 + 11 + 2 * 59
    assert schema.to_normalise(cols) == ["hr_raw", "hr_locf", "hr_count", "lact_raw", "lact_count", "age_static", "hr_mean_4_hours", "SIRS_derived"]


def test_tests_and_intervals(spark):
    df = spark.createDataFrame([(float(i), float(i) + (1 if i % 3 else -2)) for i in range(30)], "a double, b double")
    got = ST.paired_tests(df, "b", "a").first()
    assert got.n == 30 and abs(got.mean_difference) < 1e-12 and 0 <= got.p <= 1
    assert ST.percentile_interval(df, "a").first().low == pytest.approx(0.725)


def test_documents_are_bounded(spark):
    df = spark.range(200).selectExpr("'a' AS model", "id AS stay_id", "explode(sequence(0L, 9L)) AS stay_time").withColumns({"label": F.lit(0.0), "score": F.col("stay_time") / 10})
    docs = io.to_documents(df, ["model"], rows_a_document=100)
    assert docs.count() > 10 and docs.agg(F.max(F.size("ids"))).first()[0] < 40
    back = io.from_documents(docs, ["model"])
    assert sorted(back.select(*df.columns).collect()) == sorted(df.collect())


def test_repeats_and_draws_differ(spark):
    """Other seeds give other sets, as unlike as random ones; large ids don't overflow."""
    from icupanel.operators import splits
    from icupanel.plans.models import random_predictions

    base = (1 << 62) - 3000
    stays = spark.createDataFrame([(base + i, i % 5 == 0) for i in range(1000)], "stay_id long, label boolean").selectExpr("stay_id", "cast(label as int) as label")
    sets = {}
    for r in splits.stratified_split(stays).where("split = 'validation'").collect():
        sets.setdefault(r.rep, set()).add(r.stay_id)
    assert len(sets) == 5 and all(len(sets[a] & sets[b]) < 40 for a in sets for b in sets if a < b)
    draws = {}
    for r in splits.subsample(stays, prevalence=0.3, draws=4).where("label = 0").collect():
        draws.setdefault(r.draw, set()).add(r.stay_id)
    n = len(draws[0])
    assert len(draws) == 4 and all(abs(len(draws[a] & draws[b]) - n * n / 800) < 40 for a in draws for b in draws if a < b)
    rows = stays.selectExpr("stay_id", "cast(7 as long) as stay_time")
    coins = random_predictions(rows, [0.5], 2).groupBy("stay_id").agg({"prediction": "sum"}).collect()
    assert 400 < sum(r[1] == 1 for r in coins) < 600


def test_next_event_keeps_repeated_rows(spark):
    from icupanel.operators.cohort import next_event

    rows = spark.createDataFrame([(1, 5, "a"), (1, 5, "a"), (1, 9, "b"), (2, 1, "c"), (1, None, "d"), (None, 3, "e")], "stay_id long, at long, tag string")
    events = spark.createDataFrame([(1, 5), (1, 7), (2, 0), (None, 4)], "stay_id long, t long")
    got = lambda strict: sorted((r.tag, r.next_time) for r in next_event(rows, events, "at", "t", strict).collect())
    assert got(True) == [("a", 7), ("a", 7), ("b", None), ("c", None), ("d", None), ("e", None)]
    assert got(False)[:2] == [("a", 5), ("a", 5)]


def test_row_groups_are_bounded(spark, tmp_path):
    import pyarrow.parquet as pq

    df = spark.range(9000).selectExpr("id div 90 AS stay_id", "id % 90 AS stay_time", "id AS x")
    io.write_panel(df, f"{tmp_path}/p")
    files = [pq.ParquetFile(p) for p in (tmp_path / "p").glob("*.parquet")]
    groups = [f.metadata.row_group(k) for f in files for k in range(f.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 9000 and max(g.num_rows for g in groups) <= 2000
    of_stay = lambda g: g.column(0).statistics
    assert sum(of_stay(g).min <= 42 <= of_stay(g).max for g in groups) <= 2
    assert [r.x for r in io.one_stay(spark, f"{tmp_path}/p", 42).collect()] == list(range(3780, 3870))


def test_registry(spark, tmp_path):
    for name in ("demo_1.9.0", "demo_1.10.0.parquet", "other_2", "notes"):
        spark.createDataFrame([(name,)], "name string").write.parquet(f"{tmp_path}/{name}")
    assert {k: v.rpartition("/")[2] for k, v in io.registry(spark, str(tmp_path)).items()} == {"demo": "demo_1.10.0.parquet", "other": "other_2"}
    assert io.open_source(spark, str(tmp_path), "demo").first().name == "demo_1.10.0.parquet"
    with pytest.raises(ValueError, match="no source lost"):
        io.open_source(spark, str(tmp_path), "lost")


def test_subsets_of_training_and_validation(spark):
    stays = spark.range(400).select(F.col("id").alias("stay_id"), (F.col("id") % 4 == 0).cast("int").alias("label"))
    splits = SP.stratified_split(stays, reps=2)
    sizes = {}
    for r in SP.training_subsets(splits).collect():
        sizes.setdefault(r.size, set()).add((r.stay_id, r.label))
    train = {(r.stay_id, r.label) for r in splits.where("rep = 0 AND split = 'train'").collect()}
    assert sorted(sizes) == [0.2, 0.3, 0.4, 0.5] and all(abs(len(s) / 320 - k / 0.8) < 0.02 and s <= train for k, s in sizes.items())
    assert sizes[0.2] < sizes[0.3] < sizes[0.5] and abs(sum(y for _, y in sizes[0.3]) / len(sizes[0.3]) - 0.25) < 0.02
    got = SP.resplit(splits).groupBy("rep", "share", "split").agg(F.count("*").alias("n")).collect()
    assert {(r.rep, r.share, r.split): r.n for r in got} == {(rep, s, p): n for rep in (0, 1) for s, p, n in ((0.9, "train", 36), (0.9, "validation", 4), (0.7, "train", 28), (0.7, "validation", 12))}


def test_calibration_bands_equal_interpolation(spark):
    rng = np.random.default_rng(9)
    data = [(rep, float(s), int(rng.random() < s)) for rep in range(3) for s in rng.beta(2, 3, 80)] + [(0, None, 1)]
    got = {r.grid_no: r for r in E.calibration_bands(spark.createDataFrame(data, "rep int, score double, label int")).collect()}
    curves, counts = [], []
    for rep in range(3):
        s, y = (np.array([d[k] for d in data if d[0] == rep and d[1] is not None]) for k in (1, 2))
        at = np.minimum((s * 10).astype(int), 9)
        bins = sorted(set(at.tolist()))
        curves.append(np.interp(np.linspace(0, 1, 10), [s[at == b].mean() for b in bins], [y[at == b].mean() for b in bins]))
        counts.append([(at == b).sum() for b in range(10)])
    assert [got[k].mean for k in range(10)] == pytest.approx(np.mean(curves, 0).tolist())
    assert [got[k].std for k in range(10)] == pytest.approx(np.std(curves, 0).tolist())
    assert [got[k].n_mean for k in range(10)] == pytest.approx(np.mean(counts, 0).tolist()) and [got[k].n_std for k in range(10)] == pytest.approx(np.std(counts, 0).tolist())
