"""Forests: the same trees however they are grown, scored and kept."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from ratiowatch.ml import forest, models
from ratiowatch.ml.forest import Bins, Forest, cut_points
from ratiowatch.operators import typing_rules


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=(1500, 3)), rng.integers(0, 2, (1500, 8))])
    label = (x[:, 0] + x[:, 3] + rng.normal(0, 0.5, 1500) > 0.5).astype(int) + (x[:, 1] > 1)
    rows = [(i, float(y), float(1 + (y == 2)), float(v[0] * 2 + v[3]), *map(float, v)) for i, (y, v) in enumerate(zip(label, x))]
    names = [f"x{j}" for j in range(11)]
    frame = spark.createDataFrame(rows, "id long, label double, weight double, number double, " + ", ".join(f"{n} double" for n in names)).repartition(3, "id")
    return VectorAssembler(inputCols=names, outputCol="features").transform(frame).cache()


def scores(model, rows):
    return np.array([r["prediction"] for r in model.transform(rows).orderBy("id").select("prediction").collect()])


def shares(model, rows):
    return np.array([r["probability"].toArray() for r in model.transform(rows).orderBy("id").select("probability").collect()])


def test_passes_and_groups_grow_the_same_trees(table, monkeypatch):
    whole = Forest(6, 30, weight="weight").fit(table)
    found = shares(whole, table)
    assert found.shape == (1500, 3) and np.abs(found.sum(axis=1) - 1).max() < 1e-6 and whole.held is not None
    labels = np.array([r["label"] for r in table.orderBy("id").select("label").collect()])
    assert (found.argmax(axis=1) == labels).mean() > 0.9
    monkeypatch.setattr(forest, "GROUP_ROWS", 150)
    monkeypatch.setattr(forest, "PASS_NODES", 5)
    split = Forest(6, 30, weight="weight").fit(table)
    assert all(len(t.feature) > 3 for t in split.tops) and np.abs(shares(split, table) - found).max() < 1e-6
    assert np.abs(split.featureImportances.toArray() - whole.featureImportances.toArray()).max() < 1e-9
    assert whole.featureImportances.toArray().sum() == pytest.approx(1) and whole.featureImportances.toArray()[:4].argmax() == 0


def test_large_forests_score_alike(table, monkeypatch, tmp_path):
    near = Forest(4, 30, weight="weight").fit(table)
    numbers = Forest(4, 30, classify=False)
    rows = table.withColumn("label", F.col("number"))
    near_numbers = scores(numbers.fit(rows), rows)
    monkeypatch.setattr(forest, "GROUP_ROWS", 200)
    monkeypatch.setattr(forest, "BLOCK_ROWS", 128)
    monkeypatch.setattr(forest, "HELD_NODES", 10)
    far = Forest(4, 30, weight="weight").fit(table)
    assert far.held is None and far.transform(table).count() == 1500 and far.transform(table.limit(0)).count() == 0
    assert set(far.transform(table).columns) == set(near.transform(table).columns)
    assert shares(far, table).argmax(axis=1).tolist() == scores(far, table).astype(int).tolist()
    far.write().save(str(tmp_path / "far"))
    assert np.abs(shares(forest.ForestModel.load(str(tmp_path / "far")), table) - shares(far, table)).max() < 1e-12
    far_numbers = scores(numbers.fit(rows), rows)
    truth = np.array([r["number"] for r in table.orderBy("id").select("number").collect()])
    for found in (near_numbers, far_numbers):
        assert 1 - ((found - truth) ** 2).sum() / ((truth - truth.mean()) ** 2).sum() > 0.95


def test_leaves_in_the_top_are_counted_near_and_far(spark, monkeypatch):
    """A large pure node is a leaf of the top: its rows meet no group."""
    frame = spark.range(600).select("id", (F.col("id") % 3 == 0).cast("double").alias("label"), (F.col("id") % 3 == 0).cast("double").alias("a"), F.lit(1.0).alias("b"))
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(frame)
    monkeypatch.setattr(forest, "GROUP_ROWS", 50)
    near = Forest(5).fit(rows)
    monkeypatch.setattr(forest, "HELD_NODES", -1)
    far = Forest(5).fit(rows)
    assert any(t.leaves for t in near.tops) and far.held is None
    assert np.abs(shares(near, rows) - shares(far, rows)).max() < 1e-9
    assert (shares(near, rows).argmax(axis=1) == (np.arange(600) % 3 == 0).astype(int)).all()


def test_a_forest_is_kept_and_loaded(spark, table, tmp_path):
    data = table.select("id", "weight", F.when(F.col("label") > 0, 1).otherwise(0).alias("label"), "x0", "x1", "x2")
    model = models.pipeline(models.candidates(trees=3)["Random Forest"], ["x0", "x1", "x2"]).fit(data)
    model.write().overwrite().save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    first, second = ([r["p"] for r in models.score(m, data).orderBy("id").select("p").collect()] for m in (model, again))
    assert first == second and len(set(first)) > 10


def test_cuts_keep_heavy_and_rare_values_apart(spark):
    rows = spark.range(4000).select(F.array(
        F.when(F.col("id") < 40, F.col("id") / 100).otherwise(7.0), F.when(F.col("id") < 3, 1.0).otherwise(0.0), F.col("id").cast("double"), F.lit(5.0)).alias("x"))
    bins = Bins(cut_points(rows, 4))
    assert bins.counts[1:].tolist() == [2, 32, 1] and bins.counts[0] <= 32
    codes = bins.codes(np.array([[0.39, 1, 3999, 5], [7.0, 0, 0, 5]]))
    assert codes[0, 0] < codes[1, 0] and codes[:, 1].tolist() == [1, 0] and codes[:, 2].tolist() == [31, 0]
    assert (bins.unpacked(bins.packed(codes)) == codes).all()


def test_deeper_trees_take_no_more_passes(spark):
    """A pass for every level of every tree is what a forest of full depth took too long for."""
    rng = np.random.default_rng(8)
    frame = spark.createDataFrame([(f"k{i}", float(a), float(b), "yes" if c else "no") for i, (a, b, c) in enumerate(
        zip(rng.normal(size=400), rng.normal(size=400), rng.integers(0, 2, 400)))], "code string, a double, b double, label string")
    shape, taken = typing_rules.inspect(frame), []
    for depth in (1, 30):
        group = f"depth {depth} {id(frame)}"
        spark.sparkContext.setJobGroup(group, group)
        models.holdout(shape, "label", "code", trees=3, depth=depth)
        taken.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert taken[1] <= taken[0] + 3


def test_the_candidates_forest_takes_no_pass_per_level(spark):
    """Six rows make a tree of a level or two, rows without a rule make deep ones: as many jobs."""
    rng, names, taken = np.random.default_rng(9), ["x0", "x1"], []
    for rows in (6, 900):
        frame = spark.createDataFrame([(float(a), float(b), int(c) if rows > 6 else i % 2, 1.0) for i, (a, b, c) in enumerate(
            zip(rng.normal(size=rows), rng.normal(size=rows), rng.integers(0, 2, rows)))], "x0 double, x1 double, label int, weight double")
        ready = VectorAssembler(inputCols=names, outputCol="features").transform(frame)
        group = f"rows {rows} {id(frame)}"
        spark.sparkContext.setJobGroup(group, group)
        models.candidates(trees=3)["Random Forest"].fit(ready)
        taken.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert taken[1] <= taken[0] + 3


def test_sibling_leaves_of_one_class_are_one_leaf(spark, monkeypatch):
    """As in Spark's trees: a split that only parts rows of the same class is taken back, in groups and across their borders."""
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.range(800).select(
        "id", (F.col("id") % 2).cast("double").alias("a"), F.lit(0.0).alias("b"), F.when(F.col("id") % (F.col("id") % 2 * 15 + 5) == 1, 1).otherwise(0).alias("label")))
    shown = []
    for most in (1 << 17, 300):
        monkeypatch.setattr(forest, "GROUP_ROWS", most)
        model = Forest(8).fit(rows)
        shown.append(shares(model, rows))
        assert all((forest._opened(blob)[0] < 0).all() for _, _, _, blob in model.held) and not any(t.gains for t in model.tops)
        assert not model.featureImportances.toArray().any()
    assert np.abs(shown[0] - shown[1]).max() < 1e-6 and len(np.unique(shown[0], axis=0)) == 1
