"""Calibration, discrimination, cutoffs and fairness over (probability, label) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ratiowatch.functions import bands, ratios
from ratiowatch.operators.ordered import running_totals

C = F.col
BINS = 10


def valid_pairs(frame: DataFrame, probability: str = "probability", label: str = "label") -> DataFrame:
    """Rows with a finite probability, clipped to [0, 1], and a 0/1 label."""
    p = ratios.finite(C(probability))
    outcome = ratios.finite(C(label))
    return frame.withColumns({"p": ratios.clip(p, 0.0, 1.0), "y": outcome.try_cast("int")}).filter(
        p.isNotNull() & outcome.isin(0.0, 1.0))


def _bin(p: Column, bins: int) -> Column:
    """Right-closed bins with the lowest value included: inner edges below ``p``."""
    return ratios.count_true(*[p > F.lit(edge / bins) for edge in range(1, bins)])


def calibration_table(pairs: DataFrame, bins: int = BINS) -> DataFrame:
    """Populated probability bands with their own edges; gaps are not rounded first."""
    grouped = pairs.groupBy(_bin(C("p"), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("records"), F.avg("p").alias("predicted"), F.avg("y").alias("observed"))
    return grouped.select(
        F.format_string("%d%%-%d%%", (C("bin") * 100 / bins).cast("int"), ((C("bin") + 1) * 100 / bins).cast("int"))
        .alias("band"),
        (C("bin") / F.lit(float(bins))).alias("lower"), ((C("bin") + 1) / F.lit(float(bins))).alias("upper"),
        "records", F.round(C("predicted") * 100, 6).alias("predicted_percent"),
        F.round(C("observed") * 100, 6).alias("observed_percent"),
        F.round((C("predicted") - C("observed")) * 100, 6).alias("gap"))


def ranking_sums(pairs: DataFrame) -> DataFrame:
    """AUC and step-wise average precision from counts per distinct score.

    Scores are counted before ordering, and the running sums are taken slice by slice,
    so no task sees all scores.
    """
    scores = pairs.groupBy("p").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n")).withColumn(
        "neg", C("n") - C("pos"))
    running = running_totals(scores, [C("p").asc()], ["pos", "neg"])
    totals = scores.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    above_pos = totals.select("all_pos").scalar() - C("cum_pos") + C("pos")
    above_neg = totals.select("all_neg").scalar() - C("cum_neg") + C("neg")
    area = C("pos") * (C("cum_neg") - C("neg")) + C("pos") * C("neg") * F.lit(0.5)
    return running.agg(
        F.sum(area).alias("area"), F.sum(C("pos") * above_pos / (above_pos + above_neg)).alias("precision_sum"),
        F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg")).select(
        F.try_divide(C("area"), C("all_pos").cast("double") * C("all_neg")).alias("roc_auc"),
        F.when(C("all_neg") > 0, F.try_divide(C("precision_sum"), C("all_pos"))).alias("pr_auc"))


def _single_row(*frames: DataFrame) -> DataFrame:
    """Put one-row frames side by side: stack them and keep the only value of each column."""
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked.agg(*[F.max(name).alias(name) for name in stacked.columns])


def reliability(pairs: DataFrame, bins: int = BINS) -> DataFrame:
    """Brier score, calibration error, base rates, AUC and lift at one half."""
    flagged = C("p") >= 0.5
    squared = (C("p") - C("y")) * (C("p") - C("y"))
    per_bin = pairs.groupBy(_bin(C("p"), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("p").alias("sp"), F.sum("y").alias("sy"), F.sum(squared).alias("sq"),
        F.count_if(flagged).alias("nf"), F.sum(F.when(flagged, C("y"))).alias("yf"))
    rate = F.sum("sy") / F.sum("n")
    summary = per_bin.agg(
        F.sum("n").alias("records"), rate.alias("observed_rate"), F.round(F.sum("sp") / F.sum("n"), 6).alias("predicted_rate"),
        F.round(F.sum("sq") / F.sum("n"), 6).alias("brier_score"),
        F.round(F.sum(F.abs(C("sp") - C("sy"))) / F.sum("n"), 6).alias("calibration_error"),
        F.round(F.try_divide(F.try_divide(F.sum("yf"), F.sum("nf")), rate), 6).alias("lift"))
    ranking = ranking_sums(pairs).select(F.round("roc_auc", 6).alias("roc_auc"))
    return _single_row(summary, ranking)


def threshold_table(pairs: DataFrame, cutoffs=(0.3, 0.4, 0.5, 0.6, 0.7)) -> DataFrame:
    """Volume, precision and recall at each cutoff, from a single aggregate."""
    sums = [F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")]
    for place, cutoff in enumerate(cutoffs):
        flagged = C("p") >= cutoff
        sums += [F.count_if(flagged).alias(f"f{place}"), F.sum(F.when(flagged, C("y")).otherwise(0)).alias(f"t{place}")]
    wide = pairs.agg(*sums)
    rows = wide.select("n", "pos", F.explode(F.array(*[
        F.struct(F.lit(float(cutoff)).alias("cutoff"), C(f"f{place}").alias("flagged"), C(f"t{place}").alias("hits"))
        for place, cutoff in enumerate(cutoffs)])).alias("r")).select("n", "pos", "r.*")
    precision = F.try_divide(C("hits"), C("flagged"))
    return rows.select(
        "cutoff", "flagged", F.try_divide(C("flagged"), C("n")).alias("flagged_share"), precision.alias("precision"),
        (C("hits") / F.greatest(C("pos"), F.lit(1))).alias("recall"),
        F.try_divide(precision, C("pos") / C("n")).alias("precision_over_base"))


def band_distribution(frame: DataFrame, fraction: Column, cutoffs=bands.DEFAULT_CUTOFFS) -> DataFrame:
    """Counts and shares of all five bands, including empty ones, from a single aggregate."""
    banded = frame.select(bands.risk_band4(fraction, cutoffs).alias("band"))
    wide = banded.agg(F.count(F.lit(1)).alias("n"), *[
        F.count_if(C("band") == name).alias(f"b{place}") for place, name in enumerate(bands.BAND_ORDER)])
    return wide.select("n", F.explode(F.array(*[
        F.struct(F.lit(name).alias("risk_category"), C(f"b{place}").alias("records"))
        for place, name in enumerate(bands.BAND_ORDER)])).alias("r")).select(
        "r.risk_category", "r.records", F.round(C("r.records") * 100.0 / F.greatest("n", F.lit(1)), 6).alias("share_percent"))


def band_shift(frame: DataFrame, fraction: Column, cutoffs, reference=bands.DEFAULT_CUTOFFS) -> DataFrame:
    """Tuned against default counts; both sides have five rows."""
    tuned = band_distribution(frame, fraction, cutoffs).select(
        "risk_category", C("records").alias("tuned_records"), C("share_percent").alias("tuned_share"))
    default = band_distribution(frame, fraction, reference).select(
        "risk_category", C("records").alias("default_records"), C("share_percent").alias("default_share"))
    return tuned.join(F.broadcast(default), "risk_category").withColumn(
        "change", C("tuned_records") - C("default_records"))


def binary_metrics(pairs: DataFrame, cutoff: float = 0.5) -> DataFrame:
    hit = C("p") >= cutoff
    counts = pairs.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hit & (C("y") == 1)).alias("tp"),
        F.count_if(hit & (C("y") == 0)).alias("fp"), F.count_if(~hit & (C("y") == 1)).alias("fn"))
    precision = F.coalesce(F.try_divide(C("tp"), C("tp") + C("fp")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(C("tp"), C("tp") + C("fn")), F.lit(0.0))
    rates = counts.select(
        ((C("n") - C("fp") - C("fn")) / C("n")).alias("accuracy"), precision.alias("precision"), recall.alias("recall"),
        F.coalesce(F.try_divide(2 * C("tp"), 2 * C("tp") + C("fp") + C("fn")), F.lit(0.0)).alias("f1"))
    ranking = ranking_sums(pairs).select(F.round("roc_auc", 6).alias("roc_auc"), F.round("pr_auc", 6).alias("pr_auc"))
    return _single_row(rates, ranking)


def fairness(pairs: DataFrame, group: str, cutoff: float = 0.5) -> DataFrame:
    """Label rate and error rates per group; rows without a group are left out."""
    hit = (C("p") >= cutoff).cast("int")
    return pairs.filter(C(group).isNotNull()).groupBy(C(group).alias("group_value")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("positive_label_rate"),
        F.avg(F.when(C("y") == 1, hit)).alias("true_positive_rate"),
        F.avg(F.when(C("y") == 0, hit)).alias("false_positive_rate"))


def calibration_slope(pairs: DataFrame) -> DataFrame:
    """Unregularised logistic recalibration on the log-odds; 1 means no systematic bias."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    p = ratios.clip(C("p"), 1e-6, 1 - 1e-6)
    counted = pairs.groupBy("p", "y").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    data = counted.withColumn("logit", F.log(p / (1 - p)))
    seen = data.agg(F.sum("weight").alias("n"), F.countDistinct("y").alias("classes")).first()
    if not seen["n"] or seen["n"] < 10 or seen["classes"] < 2:
        return pairs.sparkSession.createDataFrame([(None, None)], "slope double, intercept double")
    vectors = VectorAssembler(inputCols=["logit"], outputCol="features").transform(data)
    model = LogisticRegression(labelCol="y", weightCol="weight", maxIter=1000).fit(vectors)
    return pairs.sparkSession.createDataFrame(
        [(float(model.coefficients[0]), float(model.intercept))], "slope double, intercept double")
