"""Keyed runs: what a retry still owes, and how its results replace earlier ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# An error says nothing about the data, so its dataset is scanned again.
ANSWERED = ("pass", "warn", "fail", "skipped")
OF_RUN = ["run_id", "datasource", "dataset"]


def answered(dataset_runs: DataFrame) -> DataFrame:
    """The datasets of each run an earlier attempt has an answer for."""
    return dataset_runs.where(F.col("outcome").isin(*ANSWERED)).select(*OF_RUN)


def datasets_to_scan(selected: DataFrame, dataset_runs: DataFrame) -> DataFrame:
    """Datasets of the checks selected for a run that it has no answer for yet.

    `selected` holds `run_id, check_id, datasource, dataset`, for one run that
    is resumed or for many.
    """
    return selected.select(*OF_RUN).distinct().join(answered(dataset_runs), OF_RUN, "left_anti")


def unevaluated_checks(
    selected: DataFrame, dataset_runs: DataFrame, results: DataFrame
) -> DataFrame:
    """Selected checks a retry passes over although no attempt recorded them."""
    done = selected.join(answered(dataset_runs), OF_RUN, "left_semi")
    return done.join(results.select("run_id", "check_id"), ["run_id", "check_id"], "left_anti")


def replace_attempt(results: DataFrame, attempt: DataFrame) -> DataFrame:
    """Results after a retry: an attempt's rows replace its datasets' earlier
    rows of the same run, whatever checks those were of."""
    kept = results.join(attempt.select(*OF_RUN).distinct(), OF_RUN, "left_anti")
    return kept.unionByName(attempt)
