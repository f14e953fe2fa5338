"""Cells: the values of all personas for one (scenario, phase, target), the unit of every numeric metric.

A long table of cells has columns scenario_uid, phase, target, persona, kg_role and the values initial and revised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CELL = ["scenario_uid", "phase", "target"]
SET = ["policy_id", "model_id"]
NUMERIC = r"^(BIGINT|DOUBLE|FLOAT|BOOLEAN|DECIMAL.*)$"


def identical(low: Column, high: Column) -> Column:
    """Whether values between low and high count as equal: within 0.1 % of the larger magnitude, or of 1."""
    return (high - low) <= 0.001 * F.greatest(F.abs(low), F.abs(high), F.lit(1.0))


def predictions(utterances: DataFrame, column: str = "prediction_values") -> DataFrame:
    """One row for each key of a JSON object in `column`: target, value (null unless a number or a boolean).

    The type is tested before the cast, since a string such as "7" would cast to a number but doesn't count as one.
    """
    parsed = utterances.withColumn("__v", F.parse_json(F.col(column)))
    each = parsed.lateralJoin(utterances.sparkSession.tvf.variant_explode(F.col("__v").outer()))
    number = F.schema_of_variant("value").rlike(NUMERIC)
    value = F.when(number, F.try_variant_get("value", "$", "double"))
    return each.select(*utterances.columns, F.col("key").alias("target"), value.alias("value"))


def lenient_cells(values: DataFrame) -> DataFrame:
    """Numeric revised values, whichever personas gave them; of repeated ones the last turn counts."""
    last = F.max_by("value", "turn_index").alias("revised")
    return values.filter("round = 'revised' and value is not null").groupBy(*CELL, "persona", "kg_role").agg(last)


def strict_cells(values: DataFrame, least: int = 3) -> DataFrame:
    """Cells in which every persona of the scenario and phase gave numbers in both rounds, at least `least` of them."""
    both = values.filter("round in ('initial', 'revised')")
    side = lambda r: F.max_by(F.when(F.col("round") == r, F.col("value")), F.when(F.col("round") == r, F.col("turn_index"))).alias(r)
    rows = both.groupBy(*CELL, "persona", "kg_role").agg(side("initial"), side("revised")).filter("initial is not null and revised is not null")
    people = both.groupBy("scenario_uid", "phase").agg(F.count_distinct("persona").alias("people"))
    full = rows.withColumn("n", F.count(F.lit(1)).over(W.partitionBy(*CELL))).join(people, ["scenario_uid", "phase"])
    return full.filter((F.col("n") == F.col("people")) & (F.col("n") >= least)).drop("n", "people")
