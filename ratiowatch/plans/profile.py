"""Named profiling queries over tables treated as unfamiliar."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratiowatch.operators import profile, typing_rules
from ratiowatch.session import cut_lineage
from ratiowatch.sources import driver

C = F.col


def loan_shape(spark, sf_dir):
    return typing_rules.inspect(cut_lineage(driver.loan_table(spark, sf_dir)))


def event_shape(spark, sf_dir):
    return typing_rules.inspect(driver.events_table(spark, sf_dir))


def loan_outline(spark, sf_dir):
    return typing_rules.outline(driver.loan_table(spark, sf_dir))


def event_outline(spark, sf_dir):
    return typing_rules.outline(driver.events_table(spark, sf_dir))


def statement_outline(spark, sf_dir):
    return typing_rules.outline(cut_lineage(driver.statement_profile_table(spark, sf_dir)))


def statement_shape(spark, sf_dir):
    """Statements are several steps from the source, so they are written once."""
    return typing_rules.inspect(cut_lineage(driver.statement_profile_table(spark, sf_dir)))


def _facts(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def q_column_types(spark, sf_dir):
    shape = typing_rules.parse_columns(driver.messy_table(spark, sf_dir))
    return _facts(spark, [(n, k, shape.missing[n]) for n, k in shape.kinds.items()],
                  "variable string, kind string, missing bigint")


def q_column_roles(spark, sf_dir):
    shape = loan_outline(spark, sf_dir)
    return _facts(spark, [(n, ", ".join(r)) for n, r in shape.roles.items()], "variable string, roles string")


def q_identifier_columns(spark, sf_dir):
    shape = loan_shape(spark, sf_dir)
    return _facts(spark, [(n, shape.distinct[n]) for n in shape.identifiers], "variable string, distinct_values bigint")


def q_target_columns(spark, sf_dir):
    shape = loan_shape(spark, sf_dir)
    return _facts(spark, [(n, shape.distinct[n]) for n in shape.targets], "variable string, distinct_values bigint")


def q_model_features(spark, sf_dir):
    shape = loan_shape(spark, sf_dir)
    kept = typing_rules.model_features(shape, "loan_status")
    return _facts(spark, [(n, shape.distinct[n], shape.missing[n]) for n in kept],
                  "variable string, distinct_values bigint, missing bigint")


def q_dataset_type(spark, sf_dir):
    shapes = {"loans": loan_outline(spark, sf_dir), "events": event_outline(spark, sf_dir)}
    return _facts(spark, [(n, typing_rules.dataset_type(s, n), s.rows) for n, s in shapes.items()],
                  "table_name string, dataset_type string, n_rows bigint")


def q_ranked_columns(spark, sf_dir):
    shape = loan_shape(spark, sf_dir)
    rows = [("category", i, n) for i, n in enumerate(typing_rules.ranked_categories(shape))]
    rows += [("numeric", i, n) for i, n in enumerate(typing_rules.ranked_numeric(shape))]
    return _facts(spark, rows, "kind string, place int, variable string")


def q_column_profile(spark, sf_dir):
    return profile.column_profile(loan_shape(spark, sf_dir), "loan_id")


def q_dataset_quality(spark, sf_dir):
    return profile.dataset_quality(typing_rules.parse_columns(driver.loan_table(spark, sf_dir)))


def q_numeric_summary(spark, sf_dir):
    return profile.numeric_summary(event_outline(spark, sf_dir))


def q_categorical_summary(spark, sf_dir):
    return profile.categorical_summary(loan_shape(spark, sf_dir))


def q_correlations(spark, sf_dir):
    return profile.correlations(statement_outline(spark, sf_dir))


def q_correlation_matrix(spark, sf_dir):
    return profile.correlation_matrix(statement_shape(spark, sf_dir))


def q_strongest_pair(spark, sf_dir):
    return profile.strongest_pair(statement_shape(spark, sf_dir))


def q_numeric_trends(spark, sf_dir):
    return profile.numeric_trends(statement_outline(spark, sf_dir))


def q_record_frequency(spark, sf_dir):
    return profile.record_frequency(loan_outline(spark, sf_dir))


def q_target_distribution(spark, sf_dir):
    return profile.target_distribution(loan_outline(spark, sf_dir), "risk_status")


def q_risk_segments(spark, sf_dir):
    return profile.risk_segments(loan_shape(spark, sf_dir), "loan_status")


def q_top_decile_share(spark, sf_dir):
    return profile.top_decile_share(typing_rules.outline(driver.loans(spark, sf_dir, places=False)))


def q_financial_metrics(spark, sf_dir):
    return profile.financial_metrics(statement_outline(spark, sf_dir), "record_id")


def q_missing_ranking(spark, sf_dir):
    return profile.missing_ranking(statement_outline(spark, sf_dir))


def q_column_answer(spark, sf_dir):
    return profile.column_answers(loan_shape(spark, sf_dir))


def q_histogram(spark, sf_dir):
    return profile.histogram(event_outline(spark, sf_dir), ["value"])


def q_median_by_category(spark, sf_dir):
    return profile.median_by_category(loan_shape(spark, sf_dir), ["segment", "region", "risk_status"], "loan_amount")


def q_category_counts(spark, sf_dir):
    return profile.category_counts(loan_shape(spark, sf_dir), ["segment", "country", "risk_status"])


def q_median_series(spark, sf_dir):
    return profile.median_series(loan_outline(spark, sf_dir), ["loan_amount", "credit_score"])


def q_balance_totals(spark, sf_dir):
    return profile.balance_totals(statement_outline(spark, sf_dir), "Total_Assets", "Total_Liabilities")


def q_numeric_means(spark, sf_dir):
    return profile.numeric_means(loan_shape(spark, sf_dir))


def q_profile_warnings(spark, sf_dir):
    shape = statement_outline(spark, sf_dir)
    return profile.profile_warnings(shape, profile.numeric_trends(shape))


def q_profile_findings(spark, sf_dir):
    return profile.profile(statement_shape(spark, sf_dir), "record_id")["findings"]


def q_profile_recommendations(spark, sf_dir):
    """All rules on the loan book, with the flags of anomalous rows left to the modelling queries."""
    shape = loan_shape(spark, sf_dir)
    return profile.recommendations(shape, profile.numeric_trends(shape), profile.correlations(shape))


QUERIES = {name[2:]: function for name, function in list(globals().items()) if name.startswith("q_")}
