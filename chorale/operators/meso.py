"""Meso accuracy: anchoring, convergence, responsiveness, coherence between phases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chorale.functions import text as T
from chorale.operators.cells import CELL, SET, identical
from chorale.operators.tfidf import cosine_pairs, tfidf


def convergence(cells: DataFrame, least: int = 3, keys: list[str] = SET) -> DataFrame:
    """Per set: cells with at least `least` personas, those whose revised values are identical, their share."""
    per = cells.groupBy(*keys, *CELL).agg(F.min("revised").alias("lo"), F.max("revised").alias("hi"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    out = per.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(identical(F.col("lo"), F.col("hi"))).alias("n_converged"))
    return out.withColumn("convergence_rate", F.try_divide(F.col("n_converged").cast("double"), F.col("n_cells").cast("double")))


def anchoring_cells(cells: DataFrame, least: int = 3, keys: list[str] = SET) -> DataFrame:
    """Per cell: status (converged, degenerate or used) and beta, the slope of the change on the peers' signal.

    The signal of a persona is the mean of the others' initial values less its own. A cell whose revised values are
    identical has converged, one whose signals are identical is degenerate; neither has a beta.
    """
    w = W.partitionBy(*keys, *CELL)
    peers = (F.sum("initial").over(w) - F.col("initial")) / F.when(F.count(F.lit(1)).over(w) > 1, F.count(F.lit(1)).over(w) - 1)
    rows = cells.withColumn("signal", peers - F.col("initial")).withColumn("change", F.col("revised") - F.col("initial"))
    per = rows.groupBy(*keys, *CELL).agg(
        F.count(F.lit(1)).alias("n_personas"),
        F.min("revised").alias("lo"),
        F.max("revised").alias("hi"),
        F.min("signal").alias("slo"),
        F.max("signal").alias("shi"),
        F.regr_slope("change", "signal").alias("slope"),
    )
    status = F.when(identical(F.col("lo"), F.col("hi")), "converged").when(identical(F.col("slo"), F.col("shi")), "degenerate").otherwise("used")
    per = per.filter(F.col("n_personas") >= least).withColumn("status", status)
    return per.select(*keys, *CELL, "n_personas", "status", F.when(F.col("status") == "used", F.col("slope")).alias("beta"))


def anchoring(cells: DataFrame, least: int = 3, keys: list[str] = SET) -> DataFrame:
    """Per set: cells by status, mean and median beta."""
    count = lambda s: F.count_if(F.col("status") == s)
    return (
        anchoring_cells(cells, least, keys)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_cells"),
            count("converged").alias("n_converged"),
            count("degenerate").alias("n_degenerate"),
            count("used").alias("n_used"),
            F.avg("beta").alias("mean_beta"),
            F.percentile("beta", 0.5).alias("median_beta"),
        )
    )


def responsiveness(cells: DataFrame, least: int = 3, keys: list[str] = SET) -> DataFrame:
    """Per set: share of (cell, persona) whose value moved between the rounds."""
    rows = cells.withColumn("n", F.count(F.lit(1)).over(W.partitionBy(*keys, *CELL))).filter(F.col("n") >= least)
    moved = ~identical(F.least("initial", "revised"), F.greatest("initial", "revised"))
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_total"), F.count_if(moved).alias("n_moved"))
    return out.withColumn("moved_ratio", F.try_divide(F.col("n_moved").cast("double"), F.col("n_total").cast("double")))


def consecutive(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """Each summary (scenario_uid, ord, doc_id, text) with the previous present one of its scenario."""
    w = W.partitionBy(*keys, "scenario_uid").orderBy("ord")
    return summaries.withColumn("previous_id", F.lag("doc_id").over(w)).withColumn("previous_text", F.lag("text").over(w)).filter("previous_id is not null")


def coherence(summaries: DataFrame, keys: list[str] = SET) -> DataFrame:
    """Per set: consecutive pairs of phase summaries, mean TF-IDF cosine and mean word Jaccard.

    The cosine's weights are fitted on the summaries of the set. A pair without words on either side has no Jaccard. A
    set without pairs has no row.
    """
    pairs = consecutive(summaries, keys)
    vectors = tfidf(summaries.select(*keys, "doc_id", "text"), keys)
    cos = cosine_pairs(pairs.select(*keys, F.col("previous_id").alias("a"), F.col("doc_id").alias("b")), vectors, keys)
    words = pairs.select(*keys, F.col("previous_id").alias("a"), F.col("doc_id").alias("b"), T.jaccard(T.letters(F.col("previous_text"), 4), T.letters(F.col("text"), 4)).alias("jaccard"))
    both = words.join(cos, [*keys, "a", "b"], "left")
    return both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg(F.coalesce("cosine", F.lit(0.0))).alias("mean_cosine"), F.count("jaccard").alias("n_jaccard"), F.avg("jaccard").alias("mean_jaccard")
    )
