"""Queries of the numeric metrics on the star schema: orders are scenarios, lines personas, order status x priority sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.operators import diversity, macro, meso

from chorale.plans import fixtures
from chorale.plans.registry import query, read, rounded

_LINES = (
    "SELECT o_orderstatus AS policy_id, o_orderpriority AS model_id, l_orderkey AS scenario_uid, l_quantity AS initial, "
    "l_quantity * (1 - l_discount) AS revised, l_tax AS tax, l_returnflag AS kg_role FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        F.col("o_orderstatus").alias("policy_id"),
        F.col("o_orderpriority").alias("model_id"),
        F.col("l_orderkey").alias("scenario_uid"),
        F.lit("Outcomes").alias("phase"),
        F.lit("quantity").alias("target"),
        F.col("l_quantity").alias("initial"),
        (F.col("l_quantity") * (1 - F.col("l_discount"))).alias("revised"),
        F.col("l_tax").alias("tax"),
        F.col("l_returnflag").alias("kg_role"),
    )


_SAME = "({hi} - {lo}) <= 0.001 * greatest(abs({lo}), abs({hi}), 1.0)"


@query(
    "meso_convergence_rate",
    f"""WITH c AS ({_LINES}), p AS (
  SELECT policy_id, model_id, scenario_uid, min(tax) AS lo, max(tax) AS hi FROM c GROUP BY ALL HAVING count(*) >= 3)
SELECT policy_id, model_id, count(*) AS n_cells, count(*) FILTER ({_SAME.format(lo="lo", hi="hi")}) AS n_converged,
  round(count(*) FILTER ({_SAME.format(lo="lo", hi="hi")}) / count(*)::DOUBLE, 6) AS convergence_rate FROM p GROUP BY ALL""",
)
def convergence_rate(spark, sf_dir):
    return rounded(meso.convergence(lines(spark, sf_dir).withColumn("revised", F.col("tax"))), "convergence_rate")


_BETA = f"""WITH c AS ({_LINES}), s AS (
  SELECT *, (sum(initial) OVER w - initial) / nullif(count(*) OVER w - 1, 0) - initial AS signal, revised - initial AS change
  FROM c WINDOW w AS (PARTITION BY scenario_uid)),
p AS (SELECT policy_id, model_id, scenario_uid, count(*) AS n_personas, min(revised) AS lo, max(revised) AS hi, min(signal) AS slo, max(signal) AS shi,
  regr_slope(change, signal) AS slope FROM s GROUP BY ALL HAVING count(*) >= 3),
b AS (SELECT *, CASE WHEN {_SAME.format(lo="lo", hi="hi")} THEN 'converged' WHEN {_SAME.format(lo="slo", hi="shi")} THEN 'degenerate' ELSE 'used' END AS status FROM p)
"""


@query("meso_anchoring_cells", _BETA + "SELECT policy_id, model_id, scenario_uid, n_personas, status, round(CASE WHEN status = 'used' THEN slope END, 6) + 0.0 AS beta FROM b")
def anchoring_cells(spark, sf_dir):
    return rounded(meso.anchoring_cells(lines(spark, sf_dir)).drop("phase", "target"), "beta")


@query(
    "meso_anchoring_beta",
    _BETA
    + """SELECT policy_id, model_id, count(*) AS n_cells, count(*) FILTER (status = 'converged') AS n_converged, count(*) FILTER (status = 'degenerate') AS n_degenerate,
  count(*) FILTER (status = 'used') AS n_used, round(avg(slope) FILTER (status = 'used'), 6) + 0.0 AS mean_beta,
  round(quantile_cont(slope, 0.5) FILTER (status = 'used'), 6) + 0.0 AS median_beta FROM b GROUP BY ALL""",
)
def anchoring_beta(spark, sf_dir):
    return rounded(meso.anchoring(lines(spark, sf_dir)), "mean_beta", "median_beta")


@query(
    "meso_responsiveness",
    f"""WITH c AS (SELECT *, count(*) OVER (PARTITION BY scenario_uid) AS n FROM ({_LINES})), m AS (
  SELECT *, NOT ({_SAME.format(lo="least(initial, revised)", hi="greatest(initial, revised)")}) AS moved FROM c WHERE n >= 3)
SELECT policy_id, model_id, count(*) AS n_total, count(*) FILTER (moved) AS n_moved, round(count(*) FILTER (moved) / count(*)::DOUBLE, 6) AS moved_ratio FROM m GROUP BY ALL""",
)
def responsiveness(spark, sf_dir):
    return rounded(meso.responsiveness(lines(spark, sf_dir)), "moved_ratio")


@query(
    "div_group_variance",
    f"""WITH z AS (SELECT *, count(*) OVER w AS n, avg(revised) OVER w AS m, stddev_pop(revised) OVER w AS sd FROM ({_LINES}) WINDOW w AS (PARTITION BY scenario_uid)),
g AS (SELECT policy_id, model_id, scenario_uid, kg_role, avg((revised - m) / sd) AS a FROM z WHERE n >= 3 AND sd > 0 GROUP BY ALL),
v AS (SELECT policy_id, model_id, scenario_uid, var_pop(a) AS v FROM g GROUP BY ALL HAVING count(*) >= 2)
SELECT policy_id, model_id, count(*) AS n_cells, round(avg(v), 6) AS between_group_variance FROM v GROUP BY ALL""",
)
def group_variance(spark, sf_dir):
    return rounded(diversity.group_variance(lines(spark, sf_dir)), "between_group_variance")


# --- events: users are scenarios, event types phases, every seventh event a cross check ------------------------------------

TRUTH = [("click", 50.0), ("error", 45.0), ("purchase", 60.0), ("signup", 500.0), ("view", 48.0)]
_TRUTH = ", ".join(f"('{p}', {g})" for p, g in TRUTH)
_ESTIMATES = """
k AS (SELECT user_id, event_type, arg_min(value, event_id) AS checked FROM events WHERE event_id % 7 = 0 AND event_id % 14 <> 0 GROUP BY ALL),
f AS (SELECT user_id, event_type, avg(value) AS fallback FROM events GROUP BY ALL),
e AS (SELECT 'P' AS policy_id, CAST(user_id % 3 AS VARCHAR) AS model_id, f.user_id AS scenario_uid, f.event_type AS phase, coalesce(checked, fallback) AS estimate, checked IS NULL AS is_fallback
  FROM f LEFT JOIN k USING (user_id, event_type))
"""


def event_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("scenario_uid"), F.col("event_type").alias("phase"), F.lit("value").alias("target"), "event_id", "value")
    value = F.when(F.col("event_id") % 14 != 0, F.col("value"))
    checks = e.filter("event_id % 7 = 0").select("scenario_uid", "phase", "target", F.col("event_id").alias("pos"), value.alias("aggregated_value"))
    out = macro.estimates(checks, e.select("scenario_uid", "phase", "target", F.col("value").alias("revised")))
    return out.select(F.lit("P").alias("policy_id"), (F.col("scenario_uid") % 3).cast("string").alias("model_id"), "*")


@query("macro_estimate_fallback", f"WITH {_ESTIMATES} SELECT model_id, phase, count(*) AS n, count(*) FILTER (is_fallback) AS n_fallback, round(avg(estimate), 6) AS mean_estimate FROM e GROUP BY ALL")
def estimate_fallback(spark, sf_dir):
    out = event_estimates(spark, sf_dir).groupBy("model_id", "phase")
    return rounded(out.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_fallback").alias("n_fallback"), F.avg("estimate").alias("mean_estimate")), "mean_estimate")


@query(
    "macro_forecast",
    f"""WITH {_ESTIMATES}, t(phase, gt) AS (VALUES {_TRUTH}), x AS (SELECT *, abs(estimate - gt) / abs(gt) * 100 AS err FROM e JOIN t USING (phase)),
a AS (SELECT policy_id, model_id, phase AS metric, CAST(gt AS DOUBLE) AS gt, count(*) AS n, count(*) FILTER (is_fallback) AS n_fallback, avg(err) AS mape_mean, quantile_cont(err, 0.5) AS mape_median,
  quantile_cont(estimate, 0.1) AS p10, quantile_cont(estimate, 0.9) AS p90, count(*) FILTER (estimate < 10 OR estimate > 100) AS n_out_of_declared_range FROM x GROUP BY ALL)
SELECT policy_id, model_id, metric, gt, n, n_fallback, round(mape_mean, 6) AS mape_mean, round(mape_median, 6) AS mape_median, round(p10, 6) AS p10, round(p90, 6) AS p90,
  n_out_of_declared_range, p10 <= gt AND gt <= p90 AS covers_gt, round(p90 - p10, 6) AS sharpness FROM a""",
)
def forecast(spark, sf_dir):
    truth = spark.createDataFrame([("P", p, "value", p, g, 10.0, 100.0) for p, g in TRUTH], "policy_id string, phase string, target string, metric string, gt double, lo double, hi double")
    return rounded(macro.forecast(event_estimates(spark, sf_dir), truth), "mape_mean", "mape_median", "p10", "p90", "sharpness")


@query(
    "div_outcome_range",
    f"""WITH {_ESTIMATES}, r AS (SELECT *, min(estimate) OVER w AS lo, max(estimate) OVER w AS hi, count(*) OVER w AS n FROM e WINDOW w AS (PARTITION BY model_id, phase)),
b AS (SELECT *, CASE WHEN lo = hi THEN 0 ELSE CAST(estimate >= lo + (hi - lo) * 1 / 5 AS INT) + CAST(estimate >= lo + (hi - lo) * 2 / 5 AS INT) + CAST(estimate >= lo + (hi - lo) * 3 / 5 AS INT)
  + CAST(estimate >= lo + (hi - lo) * 4 / 5 AS INT) END AS bin FROM r WHERE n >= 2),
kk AS (SELECT model_id, phase, bin, count(*) AS k, any_value(n) AS n FROM b GROUP BY ALL),
h AS (SELECT model_id, phase, count(*) / 5.0::DOUBLE AS bin_coverage, sum(-(k / n::DOUBLE) * ln(k / n::DOUBLE)) / ln(5.0::DOUBLE) AS entropy FROM kk GROUP BY ALL),
s AS (SELECT model_id, phase, count(*) AS n, min(estimate) AS min_value, max(estimate) AS max_value, quantile_cont(estimate, 0.25) AS q1, quantile_cont(estimate, 0.75) AS q3 FROM b GROUP BY ALL)
SELECT model_id, phase, n, round(min_value, 6) AS min_value, round(max_value, 6) AS max_value, round(q1, 6) AS q1, round(q3, 6) AS q3, round(bin_coverage, 6) AS bin_coverage, round(entropy, 6) + 0.0 AS entropy
FROM s JOIN h USING (model_id, phase)""",
)
def outcome_range(spark, sf_dir):
    out = diversity.outcome_range(event_estimates(spark, sf_dir)).drop("policy_id", "target")
    return rounded(out, "min_value", "max_value", "q1", "q3", "bin_coverage", "entropy")


@query("div_trajectory_cluster")
def trajectory_cluster(spark, sf_dir):
    """K-means starts differ between engines, so there is no SQL."""
    return diversity.trajectory_clusters(event_estimates(spark, sf_dir))


# --- open-keyed predictions ------------------------------------------------------------------------------------------------

_LONG = f"""{fixtures.cte("f_predictions")},
l AS (SELECT p.* EXCLUDE (prediction_values), k AS target, CASE json_type(prediction_values, '$.' || k) WHEN 'BOOLEAN' THEN CAST(CAST(json_extract(prediction_values, '$.' || k) AS BOOLEAN) AS DOUBLE)
  WHEN 'VARCHAR' THEN NULL WHEN 'NULL' THEN NULL ELSE CAST(json_extract(prediction_values, '$.' || k) AS DOUBLE) END AS value
  FROM (SELECT *, unnest(json_keys(prediction_values)) AS k FROM f_predictions) p)"""


def _values(spark):
    from chorale.operators import cells

    return cells.predictions(fixtures.table(spark, "f_predictions")).drop("prediction_values")


@query("ir_prediction_values", f"WITH {_LONG} SELECT scenario_uid, phase, persona, kg_role, round, turn_index, target, value FROM (SELECT * EXCLUDE (k) FROM l)")
def prediction_values(spark, sf_dir):
    return _values(spark)


@query(
    "meso_strict_cells",
    f"""WITH {_LONG}, r AS (SELECT scenario_uid, phase, target, persona, kg_role, arg_max(value, turn_index) FILTER (round = 'initial') AS initial, arg_max(value, turn_index) FILTER (round = 'revised') AS revised FROM l GROUP BY ALL),
q AS (SELECT scenario_uid, phase, count(DISTINCT persona) AS people FROM f_predictions GROUP BY ALL),
n AS (SELECT *, count(*) OVER (PARTITION BY scenario_uid, phase, target) AS n FROM r WHERE initial IS NOT NULL AND revised IS NOT NULL)
SELECT scenario_uid, phase, target, persona, kg_role, initial, revised FROM n JOIN q USING (scenario_uid, phase) WHERE n = people AND n >= 3""",
)
def strict_cells(spark, sf_dir):
    from chorale.operators import cells

    return cells.strict_cells(_values(spark)).select("scenario_uid", "phase", "target", "persona", "kg_role", "initial", "revised")


@query("div_lenient_cells", f"WITH {_LONG} SELECT scenario_uid, phase, target, persona, kg_role, arg_max(value, turn_index) AS revised FROM l WHERE round = 'revised' AND value IS NOT NULL GROUP BY ALL")
def lenient_cells(spark, sf_dir):
    from chorale.operators import cells

    return cells.lenient_cells(_values(spark))


