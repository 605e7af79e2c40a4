"""Split-conformal prediction: quantiles, sets and intervals as windows and joins.

The calibration table's order statistic is found with an exact rank; a group that
is large is ranked after a partial count per value, so equal scores combine
map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def conformal_quantile(scores: DataFrame, alpha: float, group: str | None = None) -> DataFrame:
    """``scores(score[, group])`` -> ``([group,] quantile)``: the ceil((n + 1)(1 - alpha))-th smallest, or infinity."""
    keys = [group] if group else []
    counted = scores.groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("c"))
    w = W.partitionBy(*keys).orderBy("score").rowsBetween(W.unboundedPreceding, W.currentRow) if keys else W.orderBy("score").rowsBetween(W.unboundedPreceding, W.currentRow)
    up_to = counted.withColumn("upto", F.sum("c").over(w))
    totals = counted.groupBy(*keys).agg(F.sum("c").alias("n"))
    need = F.ceil(F.round((F.col("n") + 1) * (1 - alpha), 9))
    joined = up_to.join(F.broadcast(totals), keys) if keys else up_to.crossJoin(F.broadcast(totals))  # one row of totals
    found = joined.withColumn("need", need).groupBy(*keys).agg(F.min(F.when(F.col("upto") >= F.col("need"), F.col("score"))).alias("q"))
    return found.select(*keys, F.coalesce("q", F.lit(float("inf"))).alias("quantile"))


def weighted_quantile(scores: DataFrame, alpha: float, test_weight: float) -> DataFrame:
    """``scores(score, weight)``: the least score whose cumulated weight share reaches 1 - alpha."""
    counted = scores.groupBy("score").agg(F.sum("weight").alias("w"))
    run = F.sum("w").over(W.orderBy("score").rowsBetween(W.unboundedPreceding, W.currentRow))
    total = counted.agg((F.sum("w") + test_weight).alias("total"))
    reach = F.col("run") / F.col("total") >= 1 - alpha
    found = counted.withColumn("run", run).crossJoin(F.broadcast(total)).agg(F.min(F.when(reach, F.col("score"))).alias("q"))
    return found.select(F.coalesce("q", F.lit(float("inf"))).alias("quantile"))


def mondrian_quantiles(scores: DataFrame, alpha: float, group: str) -> DataFrame:
    """A quantile for each group, and the marginal one under the key ''."""
    marginal = conformal_quantile(scores.select("score"), alpha).select(F.lit("").alias(group), "quantile")
    return conformal_quantile(scores, alpha, group).withColumn(group, F.col(group).cast("string")).unionByName(marginal)


def class_scores(probabilities: DataFrame, method: str = "lac", lam: float = 0.0, k_reg: int = 0) -> DataFrame:
    """``probabilities(id, label, p)`` -> with ``score`` of each label: LAC ``1 - p``; APS the
    cumulated probability down to the label; RAPS with ``lam`` for each rank beyond ``k_reg``."""
    if method == "lac":
        return probabilities.withColumn("score", 1 - F.col("p"))
    w = W.partitionBy("id").orderBy(F.desc("p"), "label")
    cumulated = F.sum("p").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    if method == "aps":
        return probabilities.withColumn("score", cumulated)
    return probabilities.withColumn("score", cumulated + lam * F.greatest(F.row_number().over(w) - k_reg, F.lit(0)))


def conformalize(calibration: DataFrame, truth: DataFrame, test: DataFrame, alpha: float, method: str = "lac", lam: float = 0.0, k_reg: int = 0) -> DataFrame:
    """Prediction sets ``(id, prediction_set)`` of ``test``; ``truth(id, label)`` labels the calibration rows."""
    own = class_scores(calibration, method, lam, k_reg).join(truth, ["id", "label"])
    q = conformal_quantile(own.select("score"), alpha)
    scored = class_scores(test, method, lam, k_reg).crossJoin(F.broadcast(q))  # one row
    keep = F.when(F.col("score") <= F.col("quantile") + 1e-12, F.col("label"))
    return scored.groupBy("id").agg(F.array_sort(F.collect_list(keep)).alias("prediction_set"))


def conformalize_interval(calibration: DataFrame, test: DataFrame, alpha: float) -> DataFrame:
    """``calibration(prediction, observed)``, ``test(id, prediction)`` -> ``(id, lower, upper)``."""
    q = conformal_quantile(calibration.select(F.abs(F.col("observed") - F.col("prediction")).alias("score")), alpha)
    return test.crossJoin(F.broadcast(q)).select("id", (F.col("prediction") - F.col("quantile")).alias("lower"), (F.col("prediction") + F.col("quantile")).alias("upper"))


def conformalize_cqr(calibration: DataFrame, test: DataFrame, alpha: float) -> DataFrame:
    """``calibration(lower, upper, observed)``, ``test(id, lower, upper)`` -> widened intervals."""
    score = F.greatest(F.col("lower") - F.col("observed"), F.col("observed") - F.col("upper"))
    q = conformal_quantile(calibration.select(score.alias("score")), alpha)
    return test.crossJoin(F.broadcast(q)).select("id", (F.col("lower") - F.col("quantile")).alias("lower"), (F.col("upper") + F.col("quantile")).alias("upper"))
