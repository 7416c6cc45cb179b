"""Snapshots, population stability, drift and prediction stability between revisions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ratiowatch.functions import bands
from ratiowatch.operators.brackets import order_statistics
from ratiowatch.operators.quantiles import exact_quantiles, to_long
from ratiowatch.schema import MONITORED_FEATURES

C = F.col
PSI_BINS = 10
PSI_FLOOR = 1e-6


def snapshots(frame: DataFrame, revision: str) -> DataFrame:
    """Records, columns, missing share and duplicate rows per revision.

    Equal rows are first folded into one row with a count, on the map side, so a row
    repeated any number of times costs one row in the shuffle.
    """
    columns = [name for name in frame.columns if name != revision]
    missing = F.lit(0)
    for name in columns:
        missing = missing + C(name).isNull().cast("int")
    distinct = frame.groupBy(revision, *columns).agg(F.count(F.lit(1)).alias("copies"))
    grouped = distinct.groupBy(revision).agg(
        F.sum("copies").alias("records"), F.sum(C("copies") - 1).alias("duplicates"),
        F.sum(missing * C("copies")).alias("missing_cells"))
    return grouped.select(
        revision, "records", F.lit(len(columns)).cast("bigint").alias("columns"),
        F.round(C("missing_cells") * 100.0 / (C("records") * len(columns)), 6).alias("missing_percent"),
        "duplicates")


def _index(base: dict[int, int], latest: dict[int, int]) -> float:
    """Stability index of two sets of bin counts."""
    n_base, n_latest = sum(base.values()), sum(latest.values())
    total = 0.0
    for k in sorted(base.keys() | latest.keys()):
        before, now = base.get(k, 0) / n_base, latest.get(k, 0) / n_latest
        total += (now - before) * math.log((now + PSI_FLOOR) / (before + PSI_FLOOR))
    return total


def _stability_table(spark: SparkSession, columns: list[str], found: dict[str, float | None]) -> DataFrame:
    rows = [(name, place, found.get(name)) for place, name in enumerate(columns)]
    table = spark.createDataFrame(rows, "feature string, place int, psi double").withColumn("psi", F.round("psi", 6))
    return table.withColumn("status", bands.psi_label(C("psi")))


def _inner(edges: list[float | None]) -> list[float]:
    """Borders between bins: distinct quantiles without the ends."""
    return sorted({e for e in edges if e is not None})[1:-1]


def _bin(value: Column, inner: list[float]) -> Column:
    """Number of borders at or below the value."""
    number = F.when(value < F.lit(inner[0]), 0)
    for k, edge in enumerate(inner[1:], 1):
        number = number.when(value < F.lit(edge), k)
    return number.otherwise(len(inner))


def psi(baseline: DataFrame, current: DataFrame, columns: list[str], bins: int = PSI_BINS) -> DataFrame:
    """Stability index per column: bins are the baseline's quantiles, left-closed.

    The baseline is read twice for its exact quantiles, then each side once for its counts.
    Null where a side is empty or constant, a column is absent, or fewer than two bins remain.
    """
    spark = baseline.sparkSession
    shared = [n for n in columns if n in baseline.columns and n in current.columns]
    places = {f"e{i}": i / bins for i in range(bins + 1)}
    known = order_statistics(baseline, {n: C(n) for n in shared}, places)
    inner = {n: _inner(list(known[n].values.values())) for n in shared}
    wanted = [n for n in shared if inner[n]]
    if not wanted:
        return _stability_table(spark, columns, {})

    def counted(frame: DataFrame, side: str) -> DataFrame:
        cells = [F.struct(F.lit(n).alias("feature"), C(n).cast("double").alias("value"), _bin(C(n).cast("double"), inner[n]).alias("bin")) for n in wanted]
        rows = frame.select(F.explode(F.array(*cells)).alias("r")).select("r.*").filter(C("value").isNotNull() & ~F.isnan("value"))
        return rows.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).withColumn(
            "side", F.lit(side))

    rows = counted(baseline, "base").unionByName(counted(current, "latest")).collect()  # a row per column, bin and side
    return _stability_table(spark, columns, _indices(wanted, rows))


def _indices(names: list[str], rows: list) -> dict[str, float | None]:
    """Index per feature from its bin counts; null where a side is empty or constant."""
    found: dict[str, float | None] = {}
    for name in names:
        mine = {side: [r for r in rows if r["feature"] == name and r["side"] == side] for side in ("base", "latest")}
        varied = all(part and min(r["low"] for r in part) < max(r["high"] for r in part) for part in mine.values())
        found[name] = _index(*({r["bin"]: r["n"] for r in mine[side]} for side in ("base", "latest"))) if varied else None
    return found


def distributions(frame: DataFrame, revision: str, columns: list[str]) -> DataFrame:
    """(revision, feature, value, records): every feature's values with their counts, nulls left out.

    States of parts of a revision are merged by ``merged``; equal values fold on the map side.
    """
    present = [n for n in columns if n in frame.columns]
    return to_long(frame, [revision], present).filter(C("value").isNotNull() & ~F.isnan("value")).groupBy(
        revision, C("variable").alias("feature"), "value").agg(F.count(F.lit(1)).alias("records"))


def merged(*states: DataFrame) -> DataFrame:
    """The state of all rows that the states stand for."""
    revision, feature, value, records = states[0].columns
    both = states[0]
    for state in states[1:]:
        both = both.unionByName(state)
    return both.groupBy(revision, feature, value).agg(F.sum(records).alias(records))


def stored_psi(base: DataFrame, latest: DataFrame, columns: list[str], bins: int = PSI_BINS) -> DataFrame:
    """``psi`` from two stored states (feature, value, records), without the rows they came from."""
    places = {f"e{i}": i / bins for i in range(bins + 1)}
    edges = {r["feature"]: _inner([r[e] for e in places]) for r in exact_quantiles(
        base, ["feature"], "value", places, bounded_groups=True, weight="records").collect()}
    wanted = [n for n in columns if edges.get(n)]
    if not wanted:
        return _stability_table(base.sparkSession, columns, {})
    number = F.coalesce(*[F.when(C("feature") == n, _bin(C("value"), edges[n])) for n in wanted])
    both = base.select("feature", "value", "records", F.lit("base").alias("side")).unionByName(
        latest.select("feature", "value", "records", F.lit("latest").alias("side")))
    rows = both.filter(C("feature").isin(wanted)).groupBy("side", "feature", number.alias("bin")).agg(
        F.sum("records").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).collect()
    return _stability_table(base.sparkSession, columns, _indices(wanted, rows))


def save_snapshot(frame: DataFrame, revision: str, folder: str, features=MONITORED_FEATURES) -> None:
    """Keep the state of the revisions in ``frame`` in a folder: shape and distributions, partitioned by revision.

    A revision that is saved again replaces its earlier state; others stay.
    """
    for name, table in (("shape", snapshots(frame, revision)), ("distributions", distributions(frame, revision, list(features)))):
        table.withColumnRenamed(revision, "revision").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "revision").parquet(f"{folder}/{name}")


def stored_drift(spark: SparkSession, folder: str, base, latest, features=MONITORED_FEATURES) -> DataFrame:
    """``drift_report`` between two revisions in a snapshot folder; only their own files are read."""
    shapes = spark.read.parquet(f"{folder}/shape").filter(C("revision").isin(base, latest))
    sided = shapes.withColumn("side", F.when(C("revision") == base, "base").otherwise("latest")).drop("revision")
    states = spark.read.parquet(f"{folder}/distributions")

    def state(revision) -> DataFrame:
        return states.filter(C("revision") == revision).select("feature", "value", "records")

    if shapes.select("revision").distinct().count() < 2:
        raise ValueError("Both revisions must have been saved.")
    present = {r["feature"] for r in states.filter(C("revision").isin(base, latest)).select("feature").distinct().collect()}
    return _report(sided, stored_psi(state(base), state(latest), [n for n in features if n in present]))


def drift_report(baseline: DataFrame, current: DataFrame, features=MONITORED_FEATURES) -> DataFrame:
    """Shape metrics and one stability row per monitored feature present on either side."""
    def shape(frame: DataFrame, side: str) -> DataFrame:
        return snapshots(frame.withColumn("side", F.lit(side)), "side")

    present = [name for name in features if name in baseline.columns or name in current.columns]
    return _report(shape(baseline, "base").unionByName(shape(current, "latest")), psi(baseline, current, present))


def _report(shapes: DataFrame, stable: DataFrame) -> DataFrame:
    """Shape metrics of both sides, and the stability rows."""
    def at(side: str, name: str) -> Column:
        return F.max(F.when(C("side") == side, C(name).cast("double")))

    rows = (("Records", "records", ""), ("Variables", "columns", ""), ("Missing cells", "missing_percent", "%"),
            ("Duplicate records", "duplicates", ""))
    wide = shapes.agg(*[at(side, name).alias(f"{side}_{name}") for side in ("base", "latest") for _, name, _ in rows])
    metrics = wide.select(F.explode(F.array(*[F.struct(
        F.lit(place).alias("place"), F.lit(label).alias("metric"), C(f"base_{name}").alias("baseline"),
        C(f"latest_{name}").alias("current"), F.lit(unit).alias("unit"), F.lit("").alias("status"))
        for place, (label, name, unit) in enumerate(rows)])).alias("r")).select("r.*")
    stability = stable.select(
        (C("place") + len(rows)).alias("place"), F.concat(F.lit("PSI · "), C("feature")).alias("metric"),
        F.lit(None).cast("double").alias("baseline"), C("psi").alias("current"), F.lit("PSI").alias("unit"), "status")
    return metrics.unionByName(stability).withColumn("change", F.round(C("current") - C("baseline"), 6))


def prediction_stability(scores: DataFrame, revision: str, index: str = "risk_index") -> DataFrame:
    """Index distribution per revision. The index takes few distinct values, so the
    built-in median holds a small map."""
    value = C(index)
    return scores.groupBy(revision).agg(
        F.count(value).alias("scored_records"), F.round(F.avg(value), 6).alias("mean_index"),
        F.round(F.median(value), 6).alias("median_index"),
        F.count_if(value >= bands.ELEVATED_INDEX).alias("elevated_records"),
        F.try_divide(F.count_if(value >= bands.ELEVATED_INDEX), F.count(value)).alias("elevated_share"))


def monitoring_alerts(drift: DataFrame, stability: DataFrame, revision: str) -> DataFrame:
    """Alert rows from the two small reports."""
    def named(status: str) -> Column:
        listed = F.array_sort(F.collect_list(F.when(C("status") == status, F.struct("place", "metric"))))
        return F.array_join(F.transform(listed, lambda item: item["metric"]), ", ")

    wide = drift.agg(named("Significant shift").alias("significant"), named("Watch").alias("watch"),
                     F.max(F.when(C("metric") == "Records", C("change"))).cast("bigint").alias("moved"))
    texts = wide.select(F.explode(F.array(
        F.when(C("significant") != "", F.concat(F.lit("Significant shift: "), C("significant"))),
        F.when(C("watch") != "", F.concat(F.lit("Moderate shift: "), C("watch"))),
        F.when(C("moved") != 0, F.format_string("Record count moved by %+d", C("moved"))))).alias("alert"))
    ends = stability.agg(F.min_by("elevated_share", revision).alias("first"),
                         F.max_by("elevated_share", revision).alias("last"), F.count(F.lit(1)).alias("n"))
    delta = C("last") - C("first")
    share = ends.select(F.when((C("n") >= 2) & (F.abs(delta) >= 0.05), F.format_string(
        "Elevated share is %.1f%% %s than in the first revision", F.abs(delta) * 100,
        F.when(delta > 0, "higher").otherwise("lower"))).alias("alert"))
    return texts.unionByName(share).filter(C("alert").isNotNull())
