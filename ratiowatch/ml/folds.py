"""Folds that keep every company on one side, balanced on positives."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ratiowatch.operators import ordered

C = F.col


def company_folds(rows: DataFrame, company: str = "company_id", label: str = "label", folds: int = 5) -> DataFrame:
    """One row per company with its fold: companies ranked by positives and size are dealt
    out back and forth. The ranking is sliced, so any number of companies is fine."""
    sizes = rows.groupBy(C(company).cast("string").alias("company")).agg(
        F.sum(label).cast("bigint").alias("positives"), F.count(F.lit(1)).alias("n_rows"))
    ranked = ordered.numbered(sizes, [C("positives").desc(), C("n_rows").desc(), C("company").asc()])
    turn = (C("position") - 1) % (2 * folds)
    fold = F.when(turn < folds, turn).otherwise(2 * folds - 1 - turn)
    return ranked.select("company", "positives", "n_rows", fold.cast("int").alias("fold"))


def with_folds(rows: DataFrame, key: str, company: str = "company_id", label: str = "label", folds: int = 5) -> DataFrame:
    """Rows with their fold; plain stratified folds when there are fewer companies than folds."""
    if company in rows.columns and rows.select(company).distinct().limit(folds).count() >= folds:
        assigned = company_folds(rows, company, label, folds).select(C("company").alias("fold_company"), "fold")
        return rows.join(assigned, C(company).cast("string") == C("fold_company")).drop("fold_company")
    placed = ordered.numbered(rows, [C(label).asc(), F.xxhash64(C(key)).asc(), C(key).asc()])
    return placed.withColumn("fold", ((C("position") - 1) % folds).cast("int")).drop("position")
