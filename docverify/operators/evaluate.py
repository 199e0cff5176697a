"""Detection metrics over labelled cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket(truth: Column, risk: Column, action: Column, strict: bool = False) -> Column:
    """TP, TN, FP, FN or SAFEGUARD. Lenient: a case sent to review counts as right; strict: only ESCALATE detects."""
    tampered, genuine = (risk == "HIGH") | (action == "ESCALATE"), (risk == "LOW") & (action == "ACCEPT")
    missed = ~tampered if strict else genuine
    return (
        F.when(truth == "TAMPERED", F.when(missed, "FN").otherwise("TP"))
        .when(truth == "GENUINE", F.when(tampered, "FP").otherwise("TN"))
        .when(truth == "UNREADABLE", "SAFEGUARD")
    )


def metrics(cases: DataFrame, strict: bool = False) -> DataFrame:
    """one row over (truth, risk, action, expected_action, expected_risk); rates in %, one decimal."""
    b = bucket(F.col("truth"), F.col("risk"), F.col("action"), strict)
    hit = (F.col("risk") == F.col("expected_risk")) | (F.col("action") == F.col("expected_action"))
    n = cases.agg(
        *[F.count_if(b == k.upper()).alias(k) for k in ("tp", "tn", "fp", "fn", "safeguard")], F.count_if(hit).alias("as_expected")
    )
    rate = lambda top, below, default: F.coalesce(F.try_divide(top, below), F.lit(default))
    tp, tn, fp, fn = (F.col(k) for k in ("tp", "tn", "fp", "fn"))
    precision, recall = rate(tp, tp + fp, 1.0), rate(tp, tp + fn, 1.0)
    rates = {
        "accuracy": rate(tp + tn, tp + tn + fp + fn, 1.0), "precision": precision, "recall": recall,
        "specificity": rate(tn, tn + fp, 1.0), "f1": rate(2 * precision * recall, precision + recall, 0.0),
        "false_positive_rate": rate(fp, fp + tn, 0.0),
    }
    return n.select("*", *[F.round(v * 100, 1).alias(k) for k, v in rates.items()])
