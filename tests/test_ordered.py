"""Sliced windows and exact quantiles against brute force, with a third of all rows in one group."""

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from ratiowatch.operators import calibration, ordered, profile
from ratiowatch.operators.quantiles import exact_quantiles
from ratiowatch.operators.typing_rules import inspect


@pytest.fixture(scope="module")
def skewed(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("record_id"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 17 == 1, F.lit(None)).otherwise(
            F.concat(F.lit("k"), (F.col("id") % 40).cast("string"))).alias("company_id"),
        F.when(F.col("id") % 11 != 0, F.expr("date_add(date'2000-01-01', cast(id * 37 % 200 as int))")).alias("period"),
        F.when(F.col("id") % 7 != 0, (F.col("id") * 7919 % 1000).cast("double")).alias("value"))
    return rows.repartition(6).cache()


def test_prior_values_equal_a_plain_window(skewed):
    window = Window.partitionBy("company_id").orderBy(F.col("period").asc_nulls_last(), "record_id")
    plain = skewed.select("record_id", F.lag("value").over(window).alias("v"), F.lag("period").over(window).alias("p"))
    sliced = ordered.prior_values(skewed, "company_id", ["period", "record_id"], ["value", "period"], slices=9)
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(
        map(tuple, sliced.select("record_id", "prior_value", "prior_period").collect()), key=str)


def test_running_totals_and_numbers_equal_a_plain_window(skewed):
    window = Window.orderBy("record_id").rowsBetween(Window.unboundedPreceding, 0)
    data = skewed.select("record_id", F.coalesce("value", F.lit(0.0)).cast("bigint").alias("n"))
    plain = data.select("record_id", F.sum("n").over(window)).collect()
    sliced = ordered.running_totals(data, [F.col("record_id").asc()], ["n"], slices=7).select("record_id", "cum_n").collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, sliced))
    numbered = ordered.numbered(data, [F.col("record_id").desc()], slices=5).collect()
    assert all(r.position == 3000 - r.record_id for r in numbered)


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    groups = {"wide": rng.normal(0, 1e6, 4001), "tiny": rng.uniform(-1e-4, 1e-4, 1500), "one": np.array([5.0]),
              "near": 1e9 + rng.uniform(0, 3, 3000), "hot": np.concatenate([np.full(3000, 12.5), rng.exponential(10, 2000)]), "ints": rng.integers(-5, 5, 999)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("wide", None), ("hot", float("nan"))]
    wanted = {f"q{int(p * 1000)}": p for p in (0.0, 0.05, 0.25, 0.5, 0.77, 0.95, 1.0)}
    for bounded in (True, False):
        found = exact_quantiles(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v", wanted, bounded)
        for row in found.collect():
            for name, p in wanted.items():
                assert row[name] == pytest.approx(float(np.quantile(groups[row.g], p)), rel=1e-12, abs=1e-15)


def test_auc_and_average_precision_by_brute_force(spark):
    rng = np.random.default_rng(5)
    p, y = np.round(rng.random(400), 2), rng.integers(0, 2, 400)
    rows = [(float(a), int(b)) for a, b in zip(p, y)]
    found = calibration.ranking_sums(calibration.valid_pairs(spark.createDataFrame(rows, "probability double, label int"))).first()
    pos, neg = p[y == 1], p[y == 0]
    auc = np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))
    ap, last = 0.0, 0.0
    for cut in sorted(set(p), reverse=True):
        flagged = p >= cut
        recall = y[flagged].sum() / y.sum()
        ap, last = ap + (recall - last) * y[flagged].mean(), recall
    assert found.roc_auc == pytest.approx(auc) and found.pr_auc == pytest.approx(ap)
    mirrored = spark.createDataFrame([(1 - a, b) for a, b in rows], "probability double, label int")
    assert calibration.ranking_sums(calibration.valid_pairs(mirrored)).first().roc_auc == pytest.approx(1 - auc)


def test_correlations_equal_pairwise_numpy(spark):
    rng = np.random.default_rng(9)
    a = rng.normal(1e6, 3, 500)
    b, flat = a * 2 + rng.normal(0, 5, 500), np.full(500, 7.0)
    rows = [(i, float(a[i]), float(b[i]) if i % 5 else None, float(flat[i])) for i in range(500)]
    shape = inspect(spark.createDataFrame(rows, "pk bigint, a double, b double, flat double"))
    pairs = {(r.variable_a, r.variable_b): r for r in profile.correlation_pairs(shape, ["a", "b", "flat"]).collect()}
    keep = np.arange(500) % 5 != 0
    assert pairs[("a", "b")].correlation == pytest.approx(np.corrcoef(a[keep], b[keep])[0, 1], abs=1e-6)
    assert pairs[("a", "b")].n == 400 and pairs[("a", "flat")].correlation is None


def test_top_decile_counts_ties_once(spark):
    values = [10.0] * 15 + [1.0] * 5
    shape = inspect(spark.createDataFrame([(f"r{i}", v) for i, v in enumerate(values)], "label_text string, amount double"))
    found = profile.top_decile_share(shape, ["amount"]).first()
    assert found.top_decile_share == pytest.approx(20 / sum(values), abs=1e-6)


def test_unbounded_history_gives_the_same_features(spark):
    from ratiowatch.operators import features
    rows = [(i, "hot" if i % 3 == 0 else f"c{i % 25}", f"20{i % 20:02d}-12-31", float((i * 37) % 900), float((i * 53) % 400))
            for i in range(600)]
    data = spark.createDataFrame(rows, "record_id bigint, company_id string, period string, Revenue double, EBITDA double")

    def result(unbounded):
        scored = features.early_warnings(features.engineer_features(data, unbounded))
        return sorted(map(tuple, scored.select("record_id", "Sales_Growth", "EBITDA_Margin", "warning_signals").collect()))

    assert result(False) == result(True)
