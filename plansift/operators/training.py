"""Training logs: epoch metrics, running metrics, best-so-far and early stop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plansift.functions.numeric import round_to


def epoch_metrics(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Mean loss over finite steps and the number of skipped ones; no finite step gives infinity."""
    finite = F.col("loss").isNotNull() & ~F.isnan("loss") & (F.abs("loss") != float("inf"))
    return steps.groupBy(*keys).agg(
        F.coalesce(round_to(F.avg(F.when(finite, F.col("loss"))), 6), F.lit(float("inf"))).alias("loss"),
        F.count_if(finite).alias("steps"), F.count_if(~finite).alias("skipped_steps"),
    )


def running_metrics(steps: DataFrame, keys: list[str], order: str, every: int) -> DataFrame:
    """Cumulative mean loss at every ``every``-th step."""
    w = Window.partitionBy(*keys).orderBy(order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("step", F.row_number().over(w)).withColumn("running_loss", round_to(F.avg("loss").over(so_far), 6)).filter(
        F.col("step") % every == 0).select(*keys, "step", "running_loss")


def best_so_far(epochs: DataFrame, keys: list[str], patience: int) -> DataFrame:
    """Epochs up to the early stop with the best loss so far and whether the epoch improved it."""
    w = Window.partitionBy(*keys).orderBy("epoch")
    before = F.min("val_loss").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = epochs.withColumn("improved", before.isNull() | (F.col("val_loss") < before))
    last = F.max(F.when(F.col("improved"), F.col("epoch"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    waited = marked.withColumn("best_epoch", last).withColumn("best_loss", F.min("val_loss").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    stale = waited.withColumn("no_improve", F.col("epoch") - F.col("best_epoch"))
    stopped = F.max((F.col("no_improve") >= patience).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return stale.withColumn("_stopped", F.coalesce(stopped, F.lit(0))).filter("_stopped = 0").drop("_stopped")
