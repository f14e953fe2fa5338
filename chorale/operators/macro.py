"""Macro accuracy: forecast error and calibration against ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.operators.cells import SET


def estimates(cross_checks: DataFrame, cells: DataFrame) -> DataFrame:
    """(scenario_uid, phase, target, estimate, is_fallback).

    The first cross check (by pos) with a value counts; else the mean of the revised values; else the pair is absent.
    """
    keys = ["scenario_uid", "phase", "target"]
    first = cross_checks.filter("aggregated_value is not null").groupBy(*keys).agg(F.min_by("aggregated_value", "pos").alias("checked"))
    mean = cells.groupBy(*keys).agg(F.avg("revised").alias("fallback"))
    both = first.join(mean, keys, "full")
    return both.select(*keys, F.coalesce("checked", "fallback").alias("estimate"), F.col("checked").isNull().alias("is_fallback"))


def forecast(estimates: DataFrame, truth: DataFrame, keys: list[str] = SET) -> DataFrame:
    """Per set and metric: error in percent (mean, median), percentiles 10 and 90, coverage, sharpness, range count.

    `truth` has the keys it shares with the estimates (policy_id, phase, target), metric, gt, lo and hi. It is a small map
    of constants, so it is broadcast. A metric without estimates in a set has no row.
    """
    rows = estimates.join(F.broadcast(truth), ["policy_id", "phase", "target"])
    error = F.abs(F.col("estimate") - F.col("gt")) / F.abs(F.col("gt")) * 100
    out = rows.groupBy(*keys, "metric", "gt").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("is_fallback")).alias("n_fallback"),
        F.avg(error).alias("mape_mean"),
        F.percentile(error, 0.5).alias("mape_median"),
        F.percentile("estimate", 0.1).alias("p10"),
        F.percentile("estimate", 0.9).alias("p90"),
        F.count_if((F.col("estimate") < F.col("lo")) | (F.col("estimate") > F.col("hi"))).alias("n_out_of_declared_range"),
    )
    covers = (F.col("p10") <= F.col("gt")) & (F.col("gt") <= F.col("p90"))
    return out.withColumn("covers_gt", covers).withColumn("sharpness", F.col("p90") - F.col("p10"))
