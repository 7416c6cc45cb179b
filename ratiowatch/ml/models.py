"""Model comparison on company-disjoint folds, hold-out evaluation, scoring, explanations."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F, types as T

from ratiowatch.functions import bands, status
from ratiowatch.ml.folds import with_folds
from ratiowatch.ml.forest import Forest
from ratiowatch.ml.holdout import FULL_DEPTH, holdout  # noqa: F401
from ratiowatch.ml.importance import permutation_importance
from ratiowatch.ml.segments import segments  # noqa: F401
from ratiowatch.operators import calibration
from ratiowatch.schema import MODEL_FEATURES
from ratiowatch.session import cut_lineage

C = F.col
METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc")


def candidates(trees: int = 250, rounds: int = 220) -> dict:
    """Unfitted classifiers; the defaults are full-size, tests may shrink them."""
    shared = dict(labelCol="label", featuresCol="features", weightCol="weight", seed=42)
    return {
        "Logistic Regression": LogisticRegression(labelCol="label", featuresCol="scaled", weightCol="weight", maxIter=2000,
                                                  regParam=0.001),
        "Random Forest": Forest(trees, FULL_DEPTH, least=2, weight="weight"),
        "Boosted Trees": GBTClassifier(maxIter=rounds, maxDepth=3, stepSize=0.04, subsamplingRate=0.85,
                                       featureSubsetStrategy="0.85", **shared),
    }


def usable_features(rows: DataFrame, names=MODEL_FEATURES) -> list[str]:
    """Columns with at least one value; a median exists only for those."""
    seen = rows.agg(*[F.count(n).alias(n) for n in names]).first()
    return [n for n in names if seen[n]]


def preparation(names: list[str]) -> list:
    filled = [f"in_{n}" for n in names]
    return [Imputer(strategy="median", inputCols=names, outputCols=filled),
            VectorAssembler(inputCols=filled, outputCol="features"),
            StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)]


def pipeline(classifier, names: list[str]) -> Pipeline:
    return Pipeline(stages=[*preparation(names), classifier])


def with_binary_target(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``label`` (0 or 1) from a column; any other value, or none, is an error."""
    numeric = isinstance(rows.schema[column].dataType, (T.NumericType, T.BooleanType))
    made = rows.withColumn("label", status.binary_target(C(column).cast("int") if rows.schema[column].dataType == T.BooleanType() else C(column), numeric))
    bad = made.filter(C("label").isNull()).groupBy(C(column).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "v").limit(5).collect()
    if bad:
        raise ValueError(f"{column} must be binary; it also holds " + ", ".join(f"{r['v']!r} ({r['n']} times)" for r in bad))
    return made


def weighted(rows: DataFrame) -> DataFrame:
    """Class weights from one aggregate, so both classes count the same."""
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos")).first()
    if not counts["pos"] or counts["pos"] == counts["n"]:
        raise ValueError("Training requires both classes.")
    positive, negative = counts["n"] / (2 * counts["pos"]), counts["n"] / (2 * (counts["n"] - counts["pos"]))
    return rows.withColumn("weight", F.when(C("label") == 1, positive).otherwise(negative))


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Probability, band and distance from the midpoint for every row."""
    p = F.get(vector_to_array("probability"), 1)
    scored = model.transform(rows).withColumn("p", p)
    return scored.withColumns({"risk_category": bands.risk_band3(C("p")), "confidence": F.abs(C("p") - 0.5) * 2})


def fold_metrics(predictions: DataFrame) -> dict[str, float]:
    scored = cut_lineage(predictions.select("p", C("label").alias("y")))
    hit = C("p") >= 0.5
    n = scored.agg(F.count(F.lit(1)).alias("n"), F.count_if(hit & (C("y") == 1)).alias("tp"),
                   F.count_if(hit & (C("y") == 0)).alias("fp"), F.count_if(~hit & (C("y") == 1)).alias("fn")).first()
    result = {"accuracy": (n["n"] - n["fp"] - n["fn"]) / n["n"],
              "precision": n["tp"] / max(n["tp"] + n["fp"], 1), "recall": n["tp"] / max(n["tp"] + n["fn"], 1),
              "f1": 2 * n["tp"] / max(2 * n["tp"] + n["fp"] + n["fn"], 1)}
    ranked = calibration.ranking_sums(scored.select("p", "y")).first().asDict()
    return result | {name: value or 0.0 for name, value in ranked.items()}  # a fold of one class ranks nothing


#: Fits that share the cluster at a time; a fit of small data leaves most of it idle.
PARALLEL = 6


def compare(rows: DataFrame, key: str, models: dict | None = None, folds: int = 5, parallel: int = PARALLEL) -> dict:
    """Cross-validated means per candidate on the training part, the winner by ROC-AUC,
    and its metrics on a part with other companies. Data is written once and read per fit;
    fits of all folds and candidates run beside one another."""
    data = cut_lineage(weighted(with_folds(rows, key, folds=folds)))
    names = usable_features(data)
    train, test = data.filter(C("fold") != 0).drop("fold"), data.filter(C("fold") == 0)
    inner = cut_lineage(with_folds(train, key, folds=folds))
    chosen_models = models or candidates()
    kept, parts = ("label", "weight", "features", "scaled"), []
    for fold in range(folds):
        # Medians and scales come from the fold's training rows and serve every candidate.
        prepared = Pipeline(stages=preparation(names)).fit(inner.filter(C("fold") != fold))
        parts.append(tuple(prepared.transform(inner.filter(side)).select(*kept).persist() for side in (C("fold") != fold, C("fold") == fold)))

    def measured(task: tuple[str, int]) -> dict[str, float]:
        name, fold = task
        fit_rows, check_rows = parts[fold]
        return fold_metrics(score(chosen_models[name].copy().fit(fit_rows), check_rows))

    tasks = [(name, fold) for name in reversed(chosen_models) for fold in range(folds)]  # the longest first
    with ThreadPool(parallel) as pool:
        results = dict(zip(tasks, pool.map(measured, tasks, chunksize=1)))
        for pair in parts:
            for part in pair:
                part.unpersist()
        table = {name: {m: sum(results[name, f][m] for f in range(folds)) / folds for m in METRICS} for name in chosen_models}
        winner = max(table, key=lambda n: table[n]["roc_auc"])
        chosen = pipeline(chosen_models[winner], names)
        on_train, on_all = pool.map(lambda part: chosen.copy().fit(part), [train, data], chunksize=1)
    held_out = score(on_train, test)
    return {"cv": table, "selected": winner, "held_out": held_out, "model": on_all, "train_model": on_train, "test": test, "features": names}


def comparison_table(result: dict, spark) -> DataFrame:
    """Means over the folds per candidate."""
    rows = [(name, *[metrics[m] for m in METRICS], name == result["selected"]) for name, metrics in result["cv"].items()]
    return spark.createDataFrame(rows, "model string, " + ", ".join(f"{m} double" for m in METRICS) + ", selected boolean")


def report(result: dict, spark, group: str | None = None) -> DataFrame:
    """(part, name, metric, value): cross-validation means, the chosen model on held-out companies, its importances, and its rates per group."""
    rows = [("cross-validation", name, m, metrics[m]) for name, metrics in result["cv"].items() for m in METRICS]
    held_out = cut_lineage(result["held_out"].select(*[c for c in ("p", "label", group) if c]))
    found = fold_metrics(held_out)
    rows += [("held-out", result["selected"], m, found[m]) for m in METRICS]
    table = spark.createDataFrame(rows, "part string, name string, metric string, value double")
    important = permutation_importance(result["train_model"], result["test"], result["features"], "record_id").select(
        F.lit("importance").alias("part"), C("feature").alias("name"), F.lit("log loss").alias("metric"), C("importance").alias("value"))
    table = table.unionByName(important)
    if group:
        rates = calibration.fairness(held_out.withColumn("y", C("label")), group)
        table = table.unionByName(rates.unpivot([C("group_value").cast("string").alias("name")], [
            C(m).cast("double").alias(m) for m in ("n", "positive_label_rate", "true_positive_rate", "false_positive_rate")], "metric", "value").select(
            F.lit("fairness").alias("part"), "name", "metric", "value"))
    return table


def calibration_sample(held_out: DataFrame | None, model: PipelineModel | None = None, rows: DataFrame | None = None) -> DataFrame:
    """Held-out pairs when there are any, else in-sample ones marked as such."""
    basis, scored = ("held-out", held_out) if held_out is not None else ("in-sample", score(model, rows))
    return calibration.valid_pairs(scored.withColumn("probability_value", C("p")), "probability_value", "label").withColumn(
        "basis", F.lit(basis))


def linear_contributions(model: PipelineModel, names: list[str], rows: DataFrame, most: int = 5) -> DataFrame:
    """Coefficient times distance from the background mean, strongest of each sign per row."""
    imputed = model.stages[0].transform(rows)
    scaler, linear = model.stages[2], model.stages[3]
    parts = []
    for place, name in enumerate(names):
        spread = float(scaler.std[place]) or 1.0
        distance = (C(f"in_{name}") - float(scaler.mean[place])) / spread
        parts.append(F.struct((distance * float(linear.coefficients[place])).alias("contribution"), F.lit(name).alias("feature")))
    listed = imputed.withColumn("parts", F.array_sort(F.array(*parts)))
    up = F.slice(F.reverse(F.filter("parts", lambda x: x["contribution"] > 0)), 1, most)
    down = F.slice(F.filter("parts", lambda x: x["contribution"] < 0), 1, most)
    return listed.withColumns({"risk_factors": up, "protective_factors": down})


def global_contributions(contributed: DataFrame) -> DataFrame:
    return contributed.select(F.explode("parts").alias("x")).groupBy(C("x.feature").alias("feature")).agg(
        F.avg(F.abs("x.contribution")).alias("mean_absolute"))
