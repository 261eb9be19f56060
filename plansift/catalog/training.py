"""Training log queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from plansift import views as V
from plansift.catalog.registry import query, rnd
from plansift.operators import training as T


@query("a22_epoch_metrics", "run_log", f"""SELECT run_id, CASE WHEN run_id % 11 = 0 THEN 'Infinity'::DOUBLE ELSE {rnd('avg(val_loss) FILTER (k % 10 <> 0)', 6)} END AS loss,
 CASE WHEN run_id % 11 = 0 THEN 0 ELSE count(*) FILTER (k % 10 <> 0) END AS steps, CASE WHEN run_id % 11 = 0 THEN count(*) ELSE count(*) FILTER (k % 10 = 0) END AS skipped_steps FROM run_log GROUP BY run_id""")
def _(spark, sf):
    bad = (F.col("run_id") % 11 == 0) | (F.col("k") % 10 == 0)
    steps = V.run_log(spark, sf).withColumn("loss", F.when(bad, F.lit(float("nan"))).otherwise(F.col("val_loss")))
    return T.epoch_metrics(steps, ["run_id"])


@query("w14_running_metrics", "run_log", f"""SELECT run_id, step, running_loss FROM (SELECT run_id, row_number() OVER w AS step, {rnd('avg(val_loss) OVER (PARTITION BY run_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)', 6)} AS running_loss
 FROM run_log WINDOW w AS (PARTITION BY run_id ORDER BY event_id)) WHERE step % 5 = 0""")
def _(spark, sf):
    return T.running_metrics(V.run_log(spark, sf).withColumnRenamed("val_loss", "loss"), ["run_id"], "event_id", 5)


BEST = """
ep AS (SELECT run_id, val_loss, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS epoch FROM run_log),
im AS (SELECT *, coalesce(val_loss < min(val_loss) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM ep),
be AS (SELECT *, max(CASE WHEN improved THEN epoch END) OVER w AS best_epoch, min(val_loss) OVER w AS best_loss FROM im WINDOW w AS (PARTITION BY run_id ORDER BY epoch)),
fs AS (SELECT run_id, min(epoch) AS stop FROM be WHERE epoch - best_epoch >= 8 GROUP BY run_id)"""


def epochs(spark, sf):
    number = F.row_number().over(Window.partitionBy("run_id").orderBy("ts", "event_id"))
    return V.run_log(spark, sf).select("run_id", "val_loss", number.alias("epoch"))


@query("w13_best_and_early_stop", "run_log", BEST + " SELECT be.run_id, epoch, best_epoch, best_loss, improved FROM be LEFT JOIN fs ON fs.run_id = be.run_id WHERE stop IS NULL OR epoch <= stop")
def _(spark, sf):
    return T.best_so_far(epochs(spark, sf), ["run_id"], 8).select("run_id", "epoch", "best_epoch", "best_loss", "improved")
