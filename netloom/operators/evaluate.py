"""Documented-only table work: security level and evaluation of a scored table."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.plans.sizing import durable, join_small

# Weights of threat, latency and battery.
SECURITY_WEIGHTS = (0.6, 0.25, 0.15)


def security_level(threat: Column, latency: Column, battery: Column, weights=SECURITY_WEIGHTS) -> Column:
    """Weighted sum of the three inputs."""
    a, b, c = (F.lit(float(w)) for w in weights)
    return a * threat + b * latency + c * battery


def roc_auc(df: DataFrame, label_col: str, score_col: str) -> DataFrame:
    """Area under the ROC curve with ties counted half: one row ``(positives, negatives, auc)``.

    Scores are combined by value, cut into balanced ranges, and ranked inside the
    ranges on top of the negatives in lower ranges.
    """
    one = lambda label: F.sum(F.when(F.col(label_col) == label, 1).otherwise(0)).cast("bigint")
    scores = df.groupBy(F.col(score_col).alias("score")).agg(one(1).alias("pos"), one(0).alias("neg"))
    # The ranges come from sampling, so they are fixed in a table before two uses.
    ranged = durable(
        scores.repartitionByRange("score").withColumn("part", F.spark_partition_id()), "scores"
    )
    parts = ranged.groupBy("part").agg(F.sum("neg").alias("part_neg"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("part_neg").over(earlier), F.lit(0)).alias("offset"))
    inside = (
        Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    )
    below = F.col("offset") + F.coalesce(F.sum("neg").over(inside), F.lit(0))
    won = F.col("pos") * (below + F.col("neg") / 2.0)
    totals = join_small(ranged, offsets, ["part"]).withColumn("won", won).agg(
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.sum("won").alias("won")
    )
    pairs = F.col("positives").cast("double") * F.col("negatives")
    return totals.select(
        "positives", "negatives", F.when(pairs > 0, F.col("won") / pairs).alias("auc")
    )


def threshold_metrics(df: DataFrame, label_col: str, score_col: str, threshold: float = 0.5,
                      eps: float = 1e-15) -> DataFrame:
    """Confusion counts, precision, recall, F1 and cross-entropy loss in one aggregate."""
    label, score = F.col(label_col), F.col(score_col)
    hit = score >= F.lit(float(threshold))
    count = lambda test: F.sum(F.when(test, 1).otherwise(0)).cast("bigint")
    prob = F.least(F.greatest(score, F.lit(eps)), F.lit(1 - eps))
    loss = -F.when(label == 1, F.ln(prob)).otherwise(F.ln(1 - prob))
    sums = df.agg(
        count((label == 1) & hit).alias("tp"),
        count((label != 1) & hit).alias("fp"),
        count((label == 1) & ~hit).alias("fn"),
        F.avg(loss).alias("log_loss"),
    )
    part = lambda top, bottom: F.when(bottom > 0, top / bottom).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select(
        "tp", "fp", "fn",
        part(tp, tp + fp).alias("precision"),
        part(tp, tp + fn).alias("recall"),
        part(2 * tp, 2 * tp + fp + fn).alias("f1"),
        "log_loss",
    )
