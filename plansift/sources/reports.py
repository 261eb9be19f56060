"""Reports of benchmark runs: results, summaries, manifests and the comparison with a baseline.

A report is a folder of four tables, each with one folder per run:
``results`` (a row per case), ``summary`` (a row per run), ``run_manifest`` and
``baseline_manifest``. Writing replaces the folders of the runs at hand and
touches no other run, so a job that is run again gives the same report.

Columns of ``results``: run_id, case_id, success, needs_review, meets_thresholds
(null: not judged), normalized, elapsed_ms, more as given. Columns of ``runs``:
run_id, dataset, backend, is_baseline, more as given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plansift.functions.numeric import round_to
from plansift.sources.files import read_or_empty

RESULTS, SUMMARY, RUNS, BASELINES = "results", "summary", "run_manifest", "baseline_manifest"


def replace_runs(rows: DataFrame, path: str) -> None:
    """Write ``rows`` below ``path``, one folder per run; folders of other runs stay as they are.

    Small runs are gathered in one file and a run that holds most rows is
    split over tasks, whatever the number of input partitions.
    """
    rows.hint("rebalance", "run_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def summarize(results: DataFrame) -> DataFrame:
    """Counts, rates and mean time of every run. A run without results has no row."""
    count = F.count_if
    totals = results.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total"), count(F.col("success")).alias("passed"), count(F.col("meets_thresholds")).alias("threshold_passed"),
        count(~F.col("meets_thresholds")).alias("threshold_failed"), count(F.col("needs_review")).alias("in_review"),
        F.sum("elapsed_ms").alias("elapsed_ms"), count(F.col("normalized")).alias("normalized_case_count"))

    def rate(of: str) -> Column:
        return round_to(F.coalesce(F.col(of), F.lit(0)) / F.col("total"), 6)

    return totals.select(
        "run_id", "total", "passed", (F.col("total") - F.col("passed")).alias("failed"), rate("passed").alias("pass_rate"),
        "threshold_passed", "threshold_failed", rate("threshold_passed").alias("threshold_pass_rate"), rate("in_review").alias("review_rate"),
        rate("elapsed_ms").alias("avg_elapsed_ms"), "normalized_case_count", (F.col("total") - F.col("normalized_case_count")).alias("native_case_count"))


def write(results: DataFrame, runs: DataFrame, path: str) -> None:
    """Results, summary and manifest of the runs in ``runs``; a baseline manifest of those flagged.

    The summary is made from the results as written, so they are computed once.
    A run that loses its flag keeps the baseline manifest it had.
    """
    replace_runs(results, f"{path}/{RESULTS}")
    written = read(results.sparkSession, path, RESULTS).join(runs.select("run_id"), "run_id", "left_semi")
    replace_runs(summarize(written), f"{path}/{SUMMARY}")
    replace_runs(runs, f"{path}/{RUNS}")
    replace_runs(runs.filter("is_baseline"), f"{path}/{BASELINES}")


def read(spark: SparkSession, path: str, table: str, run_id: str | None = None) -> DataFrame:
    """One table of a report; with ``run_id``, the folder of that run alone is read.

    Names of runs stay strings, digits and leading zeros included. Where no run
    was flagged, the baseline manifest is empty.
    """
    shape = spark.read.parquet(f"{path}/{RUNS if table == BASELINES else table}").schema
    names = T.StructType([T.StructField(f.name, T.StringType()) if f.name == "run_id" else f for f in shape])
    rows = read_or_empty(spark, f"{path}/{table}", names)
    return rows if run_id is None else rows.filter(F.col("run_id") == run_id)


def baseline_of(runs: DataFrame, baselines: DataFrame) -> DataFrame:
    """The baseline of every run: of the same dataset and backend, the last by name; itself is none."""
    known = baselines.select("dataset", "backend", F.col("run_id").alias("baseline_id"))
    return runs.join(known, ["dataset", "backend"]).filter("run_id <> baseline_id").groupBy("run_id").agg(F.max("baseline_id").alias("baseline_id"))


def against_baseline(results: DataFrame, runs: DataFrame, baselines: DataFrame) -> DataFrame:
    """Per run with a baseline: shared cases, those only one side has, changes of success, mean change of time.

    Cases meet by their id in one shuffled join. A case that a side names
    twice counts once: successful if all its rows are, with the longest time.
    """
    cases = results.groupBy("run_id", "case_id").agg(F.min(F.coalesce("success", F.lit(False))).alias("ok"), F.max("elapsed_ms").alias("ms"))
    chosen = baseline_of(runs, baselines)
    base = cases.join(chosen.withColumnRenamed("run_id", "of"), F.col("run_id") == F.col("baseline_id")).select(
        F.col("of").alias("run_id"), "case_id", F.col("ok").alias("base_ok"), F.col("ms").alias("base_ms"))
    both = cases.join(chosen.select("run_id"), "run_id", "left_semi").join(base, ["run_id", "case_id"], "full")
    shared = F.col("ok").isNotNull() & F.col("base_ok").isNotNull()
    return both.groupBy("run_id").agg(
        F.count_if(shared).alias("shared"), F.count_if(F.col("base_ok").isNull()).alias("added"), F.count_if(F.col("ok").isNull()).alias("missing"),
        F.count_if(F.col("base_ok") & ~F.col("ok")).alias("broken"), F.count_if(~F.col("base_ok") & F.col("ok")).alias("mended"),
        round_to(F.sum(F.when(shared, F.col("ms") - F.col("base_ms"))) / F.nullif(F.count_if(shared), F.lit(0)), 6).alias("avg_elapsed_change"),
    ).join(chosen, "run_id").select("run_id", "baseline_id", "shared", "added", "missing", "broken", "mended", "avg_elapsed_change")
