import math
import random

import pytest
from pyspark.sql import functions as F

from featureline.operators import drift
from featureline.operators.gate import compare_models
from conftest import rows


def numbers(spark, n=3000):
    rng = random.Random(3)
    pick = lambda: rng.choice([0.0, -0.0, None, float("nan"), float("inf"), rng.gauss(0, 1e-6), rng.lognormvariate(3, 4), -rng.random() * 50])
    return spark.createDataFrame([(k, k % 7, pick(), rng.randint(-5, 5)) for k in range(n)], "id long, day int, x double, k int")


def test_merged_sketches_are_the_sketch_of_all_rows(spark):
    df = numbers(spark)
    by_day = drift.feature_sketches(df, ["x", "k"], F.col("day"))
    direct = drift.feature_sketches(df, ["x", "k"], F.lit(0)).drop("period")
    assert rows(drift.merge_sketches(by_day)) == rows(direct.select("feature", "n_rows", "n_missing", "sketch"))
    twice = drift.merge_sketches(drift.merge_sketches(by_day.where("period < 3").unionByName(by_day.where("period >= 3"))))
    assert rows(twice) == rows(drift.merge_sketches(by_day))


@pytest.mark.parametrize("error", [0.01, 0.2])
def test_quantiles_keep_the_stated_error(spark, error):
    df = numbers(spark)
    shares = [0, 0.01, 0.2, 0.5, 0.77, 0.99, 1]
    found = drift.sketch_quantiles(drift.feature_sketches(df, ["x", "k"], F.col("day"), error), shares, error=error).collect()
    assert len(found) == 2 * len(shares)
    for name in ("x", "k"):
        exact = sorted(v for (v,) in df.select(F.col(name).cast("double")).collect() if v is not None and not math.isnan(v))
        for r in found:
            if r.feature == name:
                want = exact[max(math.ceil(r.share * len(exact)), 1) - 1]
                assert r.value == want or abs(r.value - want) <= error * abs(want) * (1 + 1e-9)


def brute_drift(base, now, error, bins=10):
    g = (1 + error) / (1 - error)

    def bucket(x):
        return 0 if x == 0 else int(math.copysign(math.ceil(math.log(abs(x)) / math.log(g)) + drift.SHIFT, x))

    base, now = sorted(map(bucket, base)), sorted(map(bucket, now))
    cells, distance = {}, 0
    for k in sorted({*base, *now}):
        cell = min(bins - 1, bins * sum(x < k for x in base) // len(base))
        p, q = cells.get(cell, (0, 0))
        cells[cell] = (p + now.count(k), q + base.count(k))
        distance = max(distance, abs(sum(x <= k for x in now) / len(now) - sum(x <= k for x in base) / len(base)))
    m, psi = len(cells), 0
    for p, q in cells.values():
        p, q = (p + 0.5) / (len(now) + 0.5 * m), (q + 0.5) / (len(base) + 0.5 * m)
        psi += (p - q) * math.log(p / q)
    return psi, distance


def test_drift_equals_counting_by_hand(spark):
    rng = random.Random(5)
    made = [(0, rng.gauss(5, 2)) for _ in range(400)] + [(1, rng.gauss(5, 2)) for _ in range(300)] + [(2, rng.gauss(9, 2)) for _ in range(200)]
    made += [(3, None)] * 5
    df = spark.createDataFrame(made, "period int, x double")
    sketches = drift.feature_sketches(df, ["x"], F.col("period"))
    out = {r.period: r for r in drift.feature_drift(sketches.where("period = 0"), sketches.where("period > 0")).collect()}
    base = [x for p, x in made if p == 0]
    for period in (1, 2):
        psi, distance = brute_drift(base, [x for p, x in made if p == period], 0.01)
        assert math.isclose(out[period].psi, psi, rel_tol=1e-9) and math.isclose(out[period].distance, distance)
    assert out[2].drifted and out[2].psi > out[1].psi
    assert (out[3].psi, out[3].distance, out[3].drifted, out[3].n_missing) == (None, None, False, 5)
    nothing = drift.feature_drift(sketches.where("period > 8"), sketches.where("period = 1")).collect()
    assert [(r.psi, r.drifted) for r in nothing] == [(None, False)]
    assert drift.feature_drift(sketches, sketches.where("period > 8")).count() == 0


def brute_gate(made):
    made = [r for r in made if None not in r and not any(isinstance(x, float) and math.isnan(x) for x in r)]
    pos, neg = ([r for r in made if r[0] == t] for t in (True, False))
    psi = lambda x, y: 1.0 if x > y else 0.5 if x == y else 0.0
    v10 = [[sum(psi(p[m], q[m]) for q in neg) / len(neg) for p in pos] for m in (1, 2)]
    v01 = [[sum(psi(p[m], q[m]) for p in pos) / len(pos) for q in neg] for m in (1, 2)]
    mean = lambda v: sum(v) / len(v)
    cov = lambda v, w: sum((x - mean(v)) * (y - mean(w)) for x, y in zip(v, w)) / (len(v) - 1)
    s = {(i, j): cov(v10[i], v10[j]) / len(pos) + cov(v01[i], v01[j]) / len(neg) for i in (0, 1) for j in (0, 1)}
    return mean(v10[0]), mean(v10[1]), s[0, 0], s[1, 1], s[0, 1]


@pytest.mark.parametrize("range_scores", [1_000_000, 7])
def test_gate_equals_all_pairs(spark, range_scores):
    rng = random.Random(8)
    made = []
    for _ in range(160):
        t = rng.random() < 0.4
        made.append((t, round(rng.gauss(0.5 + 0.05 * t, 0.2), 1), round(rng.gauss(0.4 + 0.3 * t, 0.2), 2)))
    made += [(None, 0.5, 0.5), (True, None, 0.1), (False, float("nan"), 0.2), (True, 0.0, -0.0), (False, -0.0, 0.0)]
    df = spark.createDataFrame(made, "t boolean, old double, `new.x` double").repartition(5)
    r = compare_models(df, "t", "old", "new.x", range_scores=range_scores).first()
    want = brute_gate(made)
    for got, exact in zip((r.champion_auc, r.candidate_auc, r.champion_variance, r.candidate_variance, r.covariance), want):
        assert math.isclose(got, exact, rel_tol=1e-9, abs_tol=1e-12)
    assert math.isclose(r.z, (want[1] - want[0]) / math.sqrt(want[2] + want[3] - 2 * want[4]), rel_tol=1e-9)
    whole = [x for x in made if None not in x and not math.isnan(x[1])]
    only = [sum(((x[1] > 0.5) == x[0]) != ((x[2] > 0.5) == x[0]) and ((x[m] > 0.5) == x[0]) for x in whole) for m in (1, 2)]
    assert [r.only_champion_right, r.only_candidate_right] == only and r.n_unscored == 3 and r.promote
    back = compare_models(df, "t", "new.x", "old").first()
    assert not back.promote and math.isclose(back.z, -r.z, rel_tol=1e-9)


def test_gate_without_a_difference_or_a_class(spark):
    same = spark.createDataFrame([(k % 3 == 0, k / 10, k / 10) for k in range(10)], "t boolean, a double, b double")
    r = compare_models(same, "t", "a", "b").first()
    assert r.champion_auc == r.candidate_auc and r.z is None and r.mcnemar is None and not r.promote
    one = compare_models(same.where("t"), "t", "a", "b").first()
    assert one.champion_auc is None and one.z is None and not one.promote and one.n_positive == 4
    none = compare_models(same.where("a > 5"), "t", "a", "b").first()
    assert (none.n_positive, none.n_negative, none.n_unscored, none.promote) == (0, 0, 0, False)
