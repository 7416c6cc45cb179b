"""Folds, models and anomaly scores on a small separable table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratiowatch.ml import anomaly, folds, models
from ratiowatch.operators import typing_rules
from ratiowatch.schema import MODEL_FEATURES


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    data = []
    for i in range(400):
        label = int(rng.random() < 0.4)
        values = [float(rng.normal(label * 2 if j == 0 else 0, 1)) if j < 4 else None for j in range(len(MODEL_FEATURES))]
        data.append((i, f"C{0 if i % 3 == 0 else i % 60}", label, *values))
    schema = "record_id bigint, company_id string, label int, " + ", ".join(f"{n} double" for n in MODEL_FEATURES)
    return spark.createDataFrame(data, schema).cache()


def test_folds_keep_companies_together(rows):
    placed = folds.with_folds(rows, "record_id")
    assert placed.count() == 400
    assert placed.groupBy("company_id").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0
    assert placed.select("fold").distinct().count() == 5
    plain = folds.with_folds(rows.drop("company_id"), "record_id").groupBy("fold").count().collect()
    assert [r["count"] for r in plain] == [80] * 5


def test_comparison_and_contributions(spark, rows):
    result = models.compare(rows, "record_id", models.candidates(trees=5, rounds=3), folds=3)
    table = models.comparison_table(result, spark).collect()
    assert len(table) == 3 and sum(r.selected for r in table) == 1
    assert all(0 <= r[m] <= 1 for r in table for m in models.METRICS) and max(r.roc_auc for r in table) > 0.8
    sample = models.calibration_sample(result["held_out"])
    assert sample.count() > 0 and sample.first().basis == "held-out"
    linear = models.pipeline(models.candidates()["Logistic Regression"], result["features"]).fit(models.weighted(rows))
    explained = models.linear_contributions(linear, result["features"], rows)
    strongest = models.global_contributions(explained).orderBy(F.col("mean_absolute").desc()).first()
    assert strongest.feature == MODEL_FEATURES[0]
    logit = explained.select("record_id", F.expr("aggregate(parts, 0D, (a, x) -> a + x.contribution)").alias("total"))
    scored = models.score(linear, rows).select("record_id", "p").join(logit, "record_id")
    spread = scored.select((F.log(F.col("p") / (1 - F.col("p"))) - F.col("total")).alias("d")).agg(F.stddev("d")).first()[0]
    assert spread < 1e-6


def test_holdout_kinds(spark):
    frame = spark.createDataFrame([(f"r{i}", i, float(i * 1.75 + i % 3), "x" if i % 2 else "y") for i in range(200)],
                                  "row_code string, driver int, target double, side string")
    shape = typing_rules.inspect(frame)
    assert shape.targets == ["target"]
    found = {r.name: r.value for r in models.holdout(shape, "target", "row_code", trees=10).collect()}
    assert found["r2"] > 0.9 and "mae" in found
    tiny = typing_rules.inspect(frame.limit(20))
    assert models.holdout(tiny, "target", "row_code").first().value is None


def test_anomalies_stand_out(spark):
    rng = np.random.default_rng(2)
    data = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 1, (600, 2)))] + [(1000, 25.0, -30.0), (1001, None, None)]
    frame = spark.createDataFrame(data, "k bigint, a double, b double").repartition(4)
    scored = anomaly.anomaly_scores(frame, "k", ["a", "b"], 602)
    top = scored.orderBy(F.col("anomaly_score").desc()).first()
    assert scored.count() == 602 and top.k == 1000 and top.anomaly
    assert scored.filter("k = 1001").first().pattern == "High missingness; interpretation is limited"


def test_slope_recovers_a_known_calibration(spark):
    from ratiowatch.operators import calibration
    rng = np.random.default_rng(4)
    p = rng.uniform(0.05, 0.95, 6000)
    y = rng.random(6000) < p
    pairs = calibration.valid_pairs(spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "probability double, label int"))
    assert calibration.calibration_slope(pairs).first().slope == pytest.approx(1.0, abs=0.1)


def test_split_is_exact_in_every_class(spark):
    from ratiowatch.ml.holdout import stratified_split

    frame = spark.range(1003).select(F.col("id"), F.when(F.col("id") % 10 == 0, "rare").otherwise("common").alias("kind")).repartition(7)
    found = {(r["kind"], r["is_test"]): r["count"] for r in stratified_split(frame, "id", F.col("kind"), ["rare", "common"]).groupBy("kind", "is_test").count().collect()}
    assert found == {("rare", True): 25, ("rare", False): 76, ("common", True): 226, ("common", False): 676}  # of 101 and 902
    again = stratified_split(frame.repartition(2), "id", F.col("kind"), ["common", "rare"])
    assert again.filter("is_test").select("id").exceptAll(stratified_split(frame, "id", F.col("kind"), ["rare", "common"]).filter("is_test").select("id")).count() == 0


def test_holdout_of_classes(spark):
    rows = [(f"k{i}", float(i % 7), None if i % 50 == 0 else ("red" if i % 3 else "blue"), f"odd{i}" if i % 40 == 0 else "plain", i % 3 == 0) for i in range(400)]
    frame = spark.createDataFrame([(k, n, c, o, "yes" if t else "no") for k, n, c, o, t in rows], "code string, n double, colour string, odd string, label string")
    shape = typing_rules.inspect(frame)
    found = models.holdout(shape, "label", "code", trees=15).collect()
    kinds = {k: {r.name: r.value for r in found if r.kind == k} for k in {r.kind for r in found}}
    assert kinds["split"] == {"no test": 66.0, "no train": 200.0, "yes test": 34.0, "yes train": 100.0}  # of 266 and 134; halves go to even
    assert sum(kinds["confusion"].values()) == kinds["metric"]["test_rows"] == 100.0
    assert kinds["metric"]["accuracy"] > 0.9 and kinds["metric"]["roc_auc"] > 0.9
    assert kinds["confusion"]["no as no"] + kinds["confusion"]["no as yes"] == 66.0
    rising = [r.value for r in found if r.kind == "roc true positives"]
    assert rising == sorted(rising) and rising[-1] == 1.0
    assert max(kinds["importance"], key=kinds["importance"].get).startswith("colour=") and not any("odd4" in n for n in kinds["importance"])


def test_starts_advance_together_and_find_the_clusters(spark):
    from ratiowatch.ml import segments

    rng = np.random.default_rng(5)
    centres = np.array([[0, 0], [9, 0], [0, 9], [9, 9]])
    data = np.concatenate([c + rng.normal(0, 0.5, (n, 2)) for c, n in zip(centres, (400, 300, 200, 100))])
    frame = spark.createDataFrame([(i, float(a), float(b), None if i % 9 == 0 else float(a)) for i, (a, b) in enumerate(data)], "id long, a double, b double, c double").repartition(3)
    points = frame.select("a", "b")
    found = segments.fit_centres(points, 4, starts=6)
    assert np.abs(found - centres).max() < 0.2
    sums = segments._sums(points, np.stack([centres, centres[::-1]]).astype(float))
    assert sums["n"].tolist() == [400, 300, 200, 100, 100, 200, 300, 400] and abs(sums["cost"][:4].sum() - sums["cost"][4:].sum()) < 1e-6
    shape = typing_rules.inspect(frame.select("a", "b", "id"))
    rows = segments.segments(shape, "id").collect()
    assert sum(r.records for r in rows) == 1000 and len(rows) == 4
    scaled = frame.select(*[v.alias(n) for n, v in segments.scaled_columns(frame, ["a", "c"], 1000).items()]).toPandas()
    assert np.abs(scaled.mean()).max() < 1e-9 and np.abs(scaled.std(ddof=0) - 1).max() < 1e-9


def test_permutation_importance_of_every_candidate(spark, rows):
    from ratiowatch.ml import importance

    names = models.usable_features(rows)
    copies = importance.exchanged(rows, names, "record_id", group_rows=90)
    assert copies.count() == 400 * (len(names) + 1)
    for j, name in enumerate(names):  # the same values, elsewhere, and every other column in place
        moved = copies.filter(F.col("column") == j).select(name)
        assert moved.exceptAll(rows.select(name)).count() == 0
    assert copies.filter("column = -1").select(*names).exceptAll(rows.select(*names)).count() == 0
    for name, classifier in models.candidates(trees=10, rounds=5).items():
        fitted = models.pipeline(classifier, names).fit(models.weighted(rows))
        found = {r.feature: r.importance for r in importance.permutation_importance(fitted, rows, names, "record_id").collect()}
        assert set(found) == set(names) and max(found, key=found.get) == names[0] and found[names[0]] > 0.05, name
        again = {r.feature: r.importance for r in importance.permutation_importance(fitted, rows.repartition(7), names, "record_id").collect()}
        assert all(abs(found[n] - again[n]) < 1e-9 for n in names)


def test_bad_targets_are_errors(spark):
    frame = spark.createDataFrame([("yes", 1, True), ("No", 0, False), ("distress", 1, True)], "word string, number int, flag boolean")
    assert [[r.label for r in models.with_binary_target(frame, c).collect()] for c in frame.columns] == [[1, 0, 1]] * 3
    for bad in ("maybe", None):
        with pytest.raises(ValueError, match="must be binary"):
            models.with_binary_target(spark.createDataFrame([("yes",), (bad,)], "word string"), "word")


def test_report_of_a_comparison(spark, rows):
    result = models.compare(rows, "record_id", models.candidates(trees=4, rounds=2), folds=2)
    found = models.report(result, spark, "company_id").collect()
    parts = {p: [r for r in found if r.part == p] for p in ("cross-validation", "held-out", "importance", "fairness")}
    assert len(parts["cross-validation"]) == 18 and len(parts["held-out"]) == 6 and len(parts["importance"]) == 4
    assert sum(r.value for r in parts["fairness"] if r.metric == "n") == result["test"].count()
