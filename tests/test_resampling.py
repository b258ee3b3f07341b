"""Bootstrap draws, tail probabilities, code maps, random utility, online scores and grouped quantiles against loops and known values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from icupanel.functions import probability as PR
from icupanel.functions import targets as T
from icupanel.operators import evaluate as E
from icupanel.operators import online, ordered
from icupanel.operators import splits as SP
from icupanel.operators import stats as ST
from icupanel.plans import models as M


def stays(spark, n=400, none=False):
    rows = [(i, i % 4 == 0) for i in range(n)] + ([(None, True)] if none else [])
    return spark.createDataFrame(rows, "stay_id long, label boolean").select("stay_id", F.col("label").cast("int").alias("label"))


# --- bootstrap ------------------------------------------------------------

def test_draws_are_multinomial(spark):
    got = SP.bootstrap_draws(stays(spark, none=True), 60).collect()
    per = {}
    for r in got:
        per.setdefault(r.draw, {})[r.stay_id] = r.times
    assert len(per) == 60 and all(sum(d.values()) == 400 and None not in d for d in per.values())
    times = np.array([[d.get(i, 0) for i in range(400)] for d in per.values()])
    shares = [(times == k).mean() for k in range(4)]
    assert np.allclose(shares, [math.exp(-1) / math.factorial(k) for k in range(4)], atol=0.01)  # binomial(400, 1/400) is near Poisson(1)
    assert abs(times.var() - 1) < 0.05 and len({tuple(t) for t in times}) == 60
    assert abs(np.corrcoef(times)[np.triu_indices(60, 1)].mean()) < 0.02  # draws don't depend on each other
    again = SP.bootstrap_draws(stays(spark), 2, seed=12).collect()
    assert {(r.stay_id, r.times) for r in again if r.draw == 0} != set(per[0].items())


def test_draws_by_stratum_and_units(spark):
    draws = SP.bootstrap_draws(stays(spark, 100), 5, by=("label",))
    assert {(r.label, r.draw, r.n) for r in draws.groupBy("label", "draw").agg(F.sum("times").alias("n")).collect()} == {(y, d, 25 if y else 75) for y in (0, 1) for d in range(5)}
    units = SP.bootstrap_units(draws)
    assert units.count() == 500 and units.select("unit_id").distinct().count() == 500
    rows = stays(spark, 100).select("stay_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("stay_time"))
    assert SP.bootstrap(rows, units).count() == 1500
    assert SP.bootstrap_draws(stays(spark, 0), 3).count() == 0


def test_weighted_measures_equal_repeated_rows(spark):
    rng = random.Random(1)
    rows = [(i, rng.random() < 0.4, round(rng.random(), 1), rng.randrange(4)) for i in range(200)]
    df = spark.createDataFrame(rows, "stay_id long, label boolean, score double, times int").withColumn("label", F.col("label").cast("int"))
    repeated = df.where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    a, b = E.auroc_auprc(df, weight="times").first(), E.auroc_auprc(repeated).first()
    assert tuple(a) == pytest.approx(tuple(b))
    draws = df.select(F.lit(0).alias("draw"), "stay_id", "times")
    values = df.select("stay_id", F.when(F.col("stay_id") % 5 > 0, F.col("score")).alias("score"))
    want = [r[2] for r in rows for _ in range(r[3]) if r[0] % 5]
    assert SP.bootstrap_means(values, draws, ["score"]).first().score == pytest.approx(np.mean(want))


# --- probabilities --------------------------------------------------------

def test_known_tails(spark):
    """Values of published tables and of closed forms, to 1e-9."""
    df = spark.createDataFrame([(2.0, 10), (12.706204736432095, 1), (2.2281388519649385, 10), (1.0, 1), (0.0, 3), (3.0, 2), (-2.0, 10)], "t double, n int")
    got = [r.p for r in df.select(PR.t_two_sided(F.col("t"), F.col("n")).alias("p")).collect()]
    assert got == pytest.approx([0.0733880347707404, 0.05, 0.05, 0.5, 1.0, 1 - 3 / math.sqrt(11), 0.0733880347707404], abs=1e-9)
    z = [0.0, 0.5, 1.959963984540054, 2.9999, 3.0001, 6.0, 20.0, -1.0]
    got = [r.p for r in spark.createDataFrame([(x,) for x in z], "z double").select(PR.normal_two_sided(F.col("z")).alias("p")).collect()]
    assert got == pytest.approx([math.erfc(abs(x) / math.sqrt(2)) for x in z], rel=1e-9)
    k = [0.3, 0.5, 0.9999, 1.0001, 1.3580986393225507, 2.0]
    got = [r.p for r in spark.createDataFrame([(x,) for x in k], "x double").select(PR.kolmogorov_tail(F.col("x")).alias("p")).collect()]
    want = [2 * math.fsum((-1) ** (i - 1) * math.exp(-2 * i * i * x * x) for i in range(1, 400)) for x in k]
    assert got == pytest.approx(want, abs=1e-9) and got[4] == pytest.approx(0.05, abs=1e-6)


def test_signed_rank_by_enumeration(spark):
    cases = [(w, n) for n in (1, 3, 6, 9) for w in range(n * (n + 1) // 2 + 1)]
    df = spark.createDataFrame([(float(w), n) for w, n in cases], "w double, n int")
    got = [r.p for r in df.select(PR.signed_rank_two_sided(F.col("w"), F.col("n")).alias("p")).collect()]
    for (w, n), p in zip(cases, got):
        sums = [sum(k + 1 for k in range(n) if m >> k & 1) for m in range(1 << n)]
        low = min(w, n * (n + 1) / 2 - w)
        assert p == pytest.approx(min(1, 2 * sum(s <= low for s in sums) / (1 << n)))


def test_paired_tests_by_group(spark):
    rng = random.Random(2)
    rows = [("exact", float(i), float(i) + x) for i, x in enumerate([1.1, -0.3, 0.7, 2.0, 0.2, -0.9, 1.4, 0.05])] + [("ties", float(i), float(i) + rng.choice([-1, 0, 1, 2])) for i in range(80)]
    rows += [("same", 1.0, 1.0)] * 3 + [("one", 1.0, 2.0), (None, 1.0, 3.0), ("exact", None, 1.0)]
    got = {r.g: r for r in ST.paired_tests_by(spark.createDataFrame(rows, "g string, a double, b double"), "b", "a", ["g"]).collect()}
    d = [b - a for g, a, b in rows if g == "exact" and a is not None]
    t = np.mean(d) / (np.std(d, ddof=1) / math.sqrt(len(d)))
    assert got["exact"].t == pytest.approx(t) and got["exact"].n == 8
    order = sorted(range(8), key=lambda i: abs(d[i]))
    assert got["exact"].w == sum(k + 1 for k, i in enumerate(order) if d[i] > 0)
    e = np.array([b - a for g, a, b in rows if g == "ties" and a != b])
    size = np.abs(e)
    rank = np.array([(size < s).sum() + ((size == s).sum() + 1) / 2 for s in size])
    m, ties = len(e), sum((size == s).sum() ** 3 - (size == s).sum() for s in set(size))
    z = (rank[e > 0].sum() - m * (m + 1) / 4) / math.sqrt(m * (m + 1) * (2 * m + 1) / 24 - ties / 48)
    assert got["ties"].m == m and got["ties"].p_w == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))
    assert (got["same"].t, got["same"].p_t, got["same"].m, got["same"].p_w) == (None, None, 0, None)
    assert got["one"].p_t is None and got["one"].p_w == 1.0 and got[None].n == 1


def test_ks_tests(spark):
    rng = np.random.default_rng(3)
    data = {"far": (rng.normal(0, 1, 60), rng.normal(1, 1, 50)), "near": (rng.normal(0, 1, 40), rng.normal(0, 1, 70))}
    rows = [(g, side, round(float(x), 1)) for g, two in data.items() for side, xs in zip((True, False), two) for x in xs] + [("lone", True, 1.0)]
    got = {r.g: r for r in ST.ks_tests(spark.createDataFrame(rows, "g string, inside boolean, x double"), "inside", "x", ["g"]).collect()}
    for g in data:
        a, b = (np.sort([x for h, s, x in rows if h == g and s == side]) for side in (True, False))
        at = np.concatenate([a, b])
        d = np.abs(np.searchsorted(a, at, "right") / len(a) - np.searchsorted(b, at, "right") / len(b)).max()
        lam = d * math.sqrt(len(a) * len(b) / (len(a) + len(b)))
        assert got[g].statistic == pytest.approx(d)
        assert got[g].p == pytest.approx(2 * math.fsum((-1) ** (i - 1) * math.exp(-2 * i * i * lam * lam) for i in range(1, 500)), abs=1e-9)
    assert got["far"].p < 0.01 and got["lone"].statistic is None and got["lone"].p is None


def test_first_values(spark):
    rows = [(1, 3, "a", 5.0), (1, 2, "a", None), (1, 2, "b", 7.0), (1, 3, "a", 4.0), (2, 0, "a", 1.0), (3, 0, "a", None)]
    got = ST.first_values(spark.createDataFrame(rows, "stay_id long, stay_time long, c string, v double"), "v", ["c"]).collect()
    assert sorted(map(tuple, got)) == [(1, "a", 4.0), (1, "b", 7.0), (2, "a", 1.0)]


# --- codes ----------------------------------------------------------------

def test_longest_prefix_wins(spark):
    mapping = spark.createDataFrame([("25", "diabetes"), ("250", "plain"), ("2504", "renal"), ("250", "zz"), ("", "never"), (None, "never"), ("496", "lung")], "prefix string, group string")
    codes = spark.createDataFrame([(1, "25040, more"), (1, "2501"), (2, "259"), (3, "49"), (3, None), (4, ""), (4, " 496 "), (4, "496")], "stay_id long, code string")
    got = ST.mapped_codes(codes, "code", mapping).collect()
    assert sorted((r.stay_id, r.code or "", r.group or "") for r in got) == [
        (1, "2501", "plain"), (1, "25040, more", "renal"), (2, "259", "diabetes"), (3, "", ""), (3, "49", ""), (4, "", ""), (4, " 496 ", "lung"), (4, "496", "lung")]
    flags = {r.stay_id: (r.renal, r.lung) for r in ST.group_flags(codes, "code", mapping, ["renal", "lung"]).collect()}
    assert flags == {1: (1, 0), 2: (0, 0), 3: (0, 0), 4: (0, 1)}


# --- random utility -------------------------------------------------------

def panel(spark, onsets, length=30):
    rows = [(i, t, None if t == 7 and i == 2 else float(o is not None and t >= o)) for i, o in enumerate(onsets) for t in range(length)]
    return spark.createDataFrame(rows, "stay_id long, stay_time long, sep3 double")


def test_random_utility_by_explicit_coins(spark):
    """The same coins thrown row by row and scored as predictions give the same curve."""
    df, ps = panel(spark, [None, 12, 3, None, 29, 0]), [0.0, 0.3, 0.8, 1.0]
    got = {(r.p, r.draw): r for r in M.random_utility(df, ps, 3).collect()}
    assert len(got) == 12
    thrown = M.random_predictions(df, ps, 3)
    for p, draw in got:
        one = T.normalised_utility(thrown.where((F.col("p") == p) & (F.col("draw") == draw) & F.col("sep3").isNotNull()).select("stay_id", "stay_time", "sep3", "prediction").unionByName(
            df.where("sep3 IS NULL").withColumn("prediction", F.lit(None).cast("int"))), "prediction").first()
        assert got[p, draw].observed == pytest.approx(one.observed) and got[p, draw].normalised == pytest.approx(one.normalised)
    assert got[0.0, 0].alarms == 0 and got[0.0, 0].normalised == 0 and got[1.0, 2].alarms == df.where("sep3 IS NOT NULL").count()


# --- online scores --------------------------------------------------------

KEYS = "stay_id long, stay_time long, "


def both(spark, rows):
    return spark.createDataFrame([r[:3] for r in rows], KEYS + "label double"), spark.createDataFrame([(*r[:2], r[3]) for r in rows], KEYS + "prediction double")


def test_gaps_are_filled_on_the_range_of_predictions(spark):
    labels, predictions = both(spark, [(1, 2, 0.0, 0.0), (1, 5, 1.0, 1.0), (2, 0, 0.0, 1.0)])
    got = online.aligned(labels, predictions).orderBy("stay_id", "stay_time").collect()
    assert [tuple(r) for r in got] == [(1, 2, 0.0, 0.0), (1, 3, None, None), (1, 4, None, None), (1, 5, 1.0, 1.0), (2, 0, 0.0, 1.0)]


def test_online_score_of_shifted_labels(spark):
    rows = [(1, t, float(t >= 20), float(t >= 9)) for t in range(21) if t not in (3, 4)] + [(2, t, 0.0, 0.0) for t in range(5)]
    labels, predictions = both(spark, rows)
    plain = online.online_score(labels, predictions).first()
    gaps = spark.createDataFrame([(1, t, float(t >= 20), None if t in (3, 4) else float(t >= 9)) for t in range(21)] + [(2, t, 0.0, 0.0) for t in range(5)], KEYS + "label double, prediction double")
    assert plain.normalised == pytest.approx(T.normalised_utility(gaps, "prediction", "label").first().normalised)
    moved = online.online_score(labels, predictions, shift_left=6).first()
    want = T.normalised_utility(gaps.withColumn("label", F.when(F.col("stay_time").isin(3, 4) & (F.col("stay_id") == 1), None).when((F.col("stay_id") == 1) & (F.col("stay_time") >= 14), 1.0).otherwise(0.0)), "prediction", "label").first()
    assert moved.normalised == pytest.approx(want.normalised) and moved.normalised != pytest.approx(plain.normalised)
    count = lambda rows, prediction, label: rows.agg(F.count(prediction).alias("n"), F.count("*").alias("hours"))
    assert tuple(online.online_score(labels, predictions, count).first()) == (24, 26)


@pytest.mark.parametrize(("labels", "predictions", "said"), [
    ([(1, 0, 0.0)], [(1, 1, 0.0)], "aren't aligned"), ([(1, 0, 0.0), (2, 0, 0.0)], [(1, 0, 0.0)], "aren't aligned"), ([(1, 0, None)], [(1, 0, 0.0)], "label is missing"),
    ([(1, 0, 0.0)], [(1, 0, float("nan"))], "prediction is missing"), ([(1, 0, 1.0), (1, 1, 0.0)], [(1, 0, 0.0), (1, 1, 0.0)], "isn't an onset")])
def test_violations_raise(spark, labels, predictions, said):
    a, b = spark.createDataFrame(labels, KEYS + "label double"), spark.createDataFrame(predictions, KEYS + "prediction double")
    with pytest.raises(Exception, match=said):
        online.online_score(a, b).collect()


# --- quantiles ------------------------------------------------------------

def test_grouped_quantiles(spark):
    rng = np.random.default_rng(5)
    groups = {"a": rng.normal(size=301), "b": np.repeat([1.0, 2.0], [3, 4]), None: np.array([5.0]), "none": np.array([])}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("none", None), ("a", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    shares = [0.0, 0.025, 0.5, 0.9, 1.0]
    got = {r.g: r.q for r in E.quantiles(df, "x", shares, ["g"]).collect()}
    assert set(got) == {"a", "b", None} and all(got[g] == pytest.approx(np.quantile(groups[g], shares).tolist()) for g in got)
    table = {r.g: (r.n, r.q25, r.median, r.q75) for r in ST.median_iqr(df, ["x"], ["g"]).collect()}
    assert table["none"] == (0, None, None, None) and table["b"] == (7, *np.quantile(groups["b"], [0.25, 0.5, 0.75]))
    assert E.quantiles(df.where("false"), "x", shares, ["g"]).count() == 0


def test_buckets_depend_on_values_alone(spark):
    """However rows are dealt over partitions, a value's bucket is the same, so sums of buckets fit the rows they are met with."""
    rng = np.random.default_rng(6)
    values = {"even": rng.permutation(30_000).astype(float), "skewed": np.unique(rng.lognormal(0, 3, 20_000)), "few": np.array([2.0, 1.0])}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double")
    dealt = [{(r.g, r.v): r._bucket for r in ordered.bucketed(d, "v", ["g"], 64).collect()} for d in (df.repartition(2), df.repartition(13, "v"), df.orderBy("v"))]
    assert dealt[0] == dealt[1] == dealt[2] and len(dealt[0]) == len(rows)
    for g, vs in values.items():
        own = [dealt[0][g, float(v)] for v in np.sort(vs)]
        assert own == sorted(own) and max(np.bincount(own)) <= max(1, 3 * len(vs) / 64)
    sums = {(r.g, r.v): (r.n_sum, r.n_all) for r in ordered.running_sums(df.withColumn("n", F.lit(1)), "v", ["n"], ["g"]).collect()}
    assert sums == {(g, float(v)): (k + 1, len(vs)) for g, vs in values.items() for k, v in enumerate(np.sort(vs))}
    one = ordered.running_sums(df.where("g = 'skewed'").withColumn("n", F.lit(1)), "v", ["n"]).collect()
    assert {r.v: r.n_sum for r in one} == {float(v): k + 1 for k, v in enumerate(np.sort(values["skewed"]))}


def test_split_histograms_cover_all_values(spark):
    rows = [(i, t, float(i * t), 3.0) for i in range(6) for t in range(10)]
    df = spark.createDataFrame(rows, "stay_id long, stay_time long, x double, flat double")
    splits = spark.createDataFrame([(i, 0, "test" if i == 5 else "train") for i in range(6)], "stay_id long, rep int, split string")
    got = ST.split_histograms(df, splits, ["x", "flat"], bins=9).collect()
    for split, ids in (("test", [5]), ("train", range(5))):
        n = {r.bin: r.n for r in got if r.split == split and r.variable == "x"}
        values = [i * t for i in ids for t in range(10)]
        assert n == {b: sum(min(int(v / 5), 8) == b for v in values) for b in n} and sum(n.values()) == len(values)
        assert [(r.bin, r.n) for r in got if r.split == split and r.variable == "flat"] == [(0, 10 * len(ids))]
    assert sum(r.share for r in got) == pytest.approx(4)
