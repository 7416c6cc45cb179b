"""Bracketed order statistics, stability from rows and from stored states."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ratiowatch.operators import brackets, monitoring
from ratiowatch.operators.brackets import order_statistics
from ratiowatch.operators.quantiles import exact_quantiles
from ratiowatch.session import scratch_path

PLACES = {"low": 0.0, "p5": 0.05, "mid": 0.5, "p95": 0.95, "high": 1.0, "cut": lambda n: n - max(1, -(-n // 10))}


def columns(n, seed):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"plain": rng.normal(0, 1, n), "ties": rng.integers(0, 4, n).astype(float), "wide": np.where(rng.random(n) < 0.3, np.nan, np.exp(rng.normal(0, 9, n))),
                         "flat": np.full(n, 7.0), "steps": np.sort(rng.integers(-3, 3, n)) * 1e300, "none": np.full(n, np.nan)})


@pytest.mark.parametrize("n", [1, 2, 9, 60, 900, 30_000])
def test_order_statistics_are_exact(spark, n):
    data = columns(n, n)
    frame = spark.createDataFrame(data).repartition(5)
    known = order_statistics(frame, {c: F.col(c) for c in data}, PLACES, lambda v: {"total": F.sum(v)})
    for name in data:
        values = np.sort(data[name].dropna().to_numpy())
        found = known[name]
        assert found.n == len(values)
        if not len(values):
            assert set(found.values.values()) == {None}
            continue
        for label, place in PLACES.items():
            at = place(len(values)) if callable(place) else (len(values) - 1) * place
            low, high = values[math.floor(at)], values[math.ceil(at)]
            assert found.values[label] == pytest.approx(low + (high - low) * (at - math.floor(at)), rel=1e-12), (name, label)
        above = values[values > found.values["cut"]]
        assert found.above["cut"][0] == len(above) and found.above["cut"][1] == pytest.approx(above.sum(), rel=1e-9, abs=1e-9)


def test_a_bracket_that_misses_is_an_error_and_few_values_are_counted_one_by_one(spark, monkeypatch):
    seen = []
    keep = brackets.cut_lineage
    monkeypatch.setattr(brackets, "cut_lineage", lambda frame: seen.append(keep(frame)) or seen[-1])
    frame = spark.range(200_000).select(F.rand(3).alias("v"))
    monkeypatch.setattr(brackets, "drop_scratch", lambda *tables: None)
    order_statistics(frame, {"v": F.col("v")}, {"mid": 0.5})
    assert seen[0].count() < 1000  # of 200,000 distinct values
    monkeypatch.setattr(brackets, "_reach", lambda n: 2e-4)
    monkeypatch.setattr(brackets, "ACCURACY", 5)
    with pytest.raises(ArithmeticError):
        order_statistics(frame, {"v": F.col("v")}, {f"p{k}": k / 100 for k in range(7, 60, 9)})


def test_without_places_only_facts_are_read(spark):
    known = order_statistics(spark.range(100).select(F.col("id").alias("a")), {"a": F.col("a")}, {}, lambda v: {"top": F.max(v)})
    assert (known["a"].n, known["a"].values, known["a"].facts) == (100, {}, {"top": 99.0})
    assert order_statistics(spark.range(3), {}, {"p": 0.5}) == {}


def plain_psi(base, latest, bins=10):
    base, latest = base[~np.isnan(base)], latest[~np.isnan(latest)]
    inner = np.unique(np.quantile(base, np.arange(bins + 1) / bins))[1:-1]
    if not len(inner) or latest.min() == latest.max():
        return None
    a = np.bincount(np.searchsorted(inner, base, "right"), minlength=len(inner) + 1) / len(base)
    b = np.bincount(np.searchsorted(inner, latest, "right"), minlength=len(inner) + 1) / len(latest)
    return float(np.sum((b - a) * np.log((b + 1e-6) / (a + 1e-6))))


def test_stability_from_rows_and_from_states(spark):
    base, latest = columns(700, 1), columns(500, 2)
    latest["plain"] += 0.4
    names = [*base.columns, "absent"]
    expected = {n: plain_psi(base[n].to_numpy(), latest[n].to_numpy()) if n in base and base[n].notna().any() else None for n in names}
    a, b = spark.createDataFrame(base), spark.createDataFrame(latest)
    rows = {r.feature: r for r in monitoring.psi(a, b, names).collect()}

    def state(frame):
        parts = [monitoring.distributions(p.withColumn("revision", F.lit(1)), "revision", names) for p in (frame.limit(100), frame.subtract(frame.limit(100)))]
        assert sum(p.agg(F.sum("records")).first()[0] for p in parts) == monitoring.merged(*parts).agg(F.sum("records")).first()[0]
        return monitoring.distributions(frame.withColumn("revision", F.lit(1)), "revision", names).drop("revision")

    stored = {r.feature: r for r in monitoring.stored_psi(state(a), state(b), names).collect()}
    for name in names:
        assert rows[name] == stored[name]
        assert (rows[name].psi is None) == (expected[name] is None) and (expected[name] is None or abs(rows[name].psi - expected[name]) < 1e-6)
    assert rows["absent"].status == "Not comparable"


def test_snapshots_in_a_folder(spark):
    folder = scratch_path(spark)
    first = spark.createDataFrame([(1, 1.0, "x"), (1, 2.0, "x"), (1, None, "y")], "revision int, Revenue double, company string")
    second = spark.createDataFrame([(2, float(n), "x") for n in range(4)], "revision int, Revenue double, company string")
    monitoring.save_snapshot(first.unionByName(second.limit(1)), "revision", folder)
    monitoring.save_snapshot(second, "revision", folder)  # replaces revision 2, keeps 1
    found = monitoring.stored_drift(spark, folder, 1, 2).orderBy("place").collect()
    plain = monitoring.drift_report(first.drop("revision"), second.drop("revision")).orderBy("place").collect()
    assert found == plain and [(r.baseline, r.current) for r in found[:1]] == [(3.0, 4.0)]
    with pytest.raises(ValueError):
        monitoring.stored_drift(spark, folder, 1, 3)


def test_weighted_quantiles_equal_those_of_the_rows(spark):
    data = columns(400, 5)
    frame = spark.createDataFrame(data)
    folded = frame.groupBy(F.col("ties").alias("v")).agg(F.count(F.lit(1)).alias("w"))
    marks = {"a": 0.1, "b": 0.5, "c": 0.77}
    assert exact_quantiles(folded, [], "v", marks, weight="w").first() == exact_quantiles(frame, [], "ties", marks).first()


def mixed(spark, n=20_000):
    return spark.range(n).select(
        F.col("id").cast("string").alias("key"), (F.col("id") % 21).alias("just_over"), (F.col("id") % 20).cast("string").alias("just_at"),
        F.lit(None).cast("string").alias("empty"), F.lit("x").alias("one"), F.floor(F.pow(F.rand(1), F.lit(5)) * n).cast("string").alias("skewed"),
        F.when(F.col("id") % 3 == 0, F.col("id") % 5).cast("string").alias("gaps"), (F.col("id") / 2).cast("bigint").cast("string").alias("half"))


def test_distinct_counts_decide_by_sketch_and_show_exact_numbers(spark, monkeypatch):
    from ratiowatch.operators import sketches

    frame, counted = mixed(spark), []
    plain = sketches.distinct_counts
    monkeypatch.setattr(sketches, "distinct_counts", lambda data, names: counted.append(sorted(names)) or plain(data, names))
    counts = sketches.DistinctCounts(frame)
    found = counts.decided(["key", "just_over", "just_at", "one"], 20, 0.5 * 20_000)
    assert counted == [["just_at", "just_over"]] and (found["just_at"], found["just_over"]) == (20, 21) and found["key"] > 15_000
    assert {n: counts[n] for n in counts} == plain(frame, frame.columns) | {"empty": 0}
    order = counts.ordered(frame.columns)
    assert sorted(order, key=lambda n: (order[n], n)) == sorted(counts, key=lambda n: (counts[n], n))
    with pytest.raises(KeyError):
        counts["other"]
    assert sketches.DistinctCounts(frame, approximate=True)["one"] == 1


@pytest.mark.parametrize("tracked", [64, 400, 10_000])
def test_frequent_values_are_exact_or_left_open(spark, tracked):
    from ratiowatch.operators import sketches

    frame = mixed(spark).cache()
    names = [n for n in frame.columns]
    found, rest = sketches.frequent_values(frame, names, 10, 20_000, tracked)
    assert set(found) | set(rest) == set(names) and (tracked < 10_000 or "skewed" in found) and "key" in rest
    for name, values in found.items():
        plain = frame.groupBy(F.coalesce(F.col(name).cast("string"), F.lit("Missing")).alias("v")).count().orderBy(F.desc("count"), "v").limit(10).collect()
        assert values == [(r["v"], r["count"]) for r in plain], name
    frame.unpersist()


def test_top_values_of_settled_and_open_columns(spark):
    from ratiowatch.operators import profile, typing_rules

    words = mixed(spark).select(*[F.concat(F.lit("v"), F.col(n).cast("string")).alias(n) for n in ("key", "gaps", "empty")])
    shape = typing_rules.inspect(words.cache())
    rows = profile.top_values(shape, ["gaps", "key"], 3).orderBy("variable", "place").collect()
    assert [(r.variable, r.value, r.records) for r in rows] == [
        ("gaps", "Missing", 13333), ("gaps", "v0", 1334), ("gaps", "v3", 1334), ("key", "v0", 1), ("key", "v1", 1), ("key", "v10", 1)]
    assert shape.identifiers == ["key"] and shape.kinds["empty"] == "Categorical"
