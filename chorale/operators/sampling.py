"""Deterministic sampling by the rank of md5(seed:id), which any engine repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def draw(seed: int, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def sample(rows: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """At most n rows without replacement: the first by draw (a top-k, not a full sort)."""
    return rows.orderBy(draw(seed, key), key).limit(n)


def sample_per(rows: DataFrame, n: int | Column, seed: int, key: str, strata: list[str]) -> DataFrame:
    """At most n rows of each stratum; n may be a column."""
    rank = F.row_number().over(W.partitionBy(*strata).orderBy(draw(seed, key), key))
    return rows.withColumn("__rank", rank).filter(F.col("__rank") <= n).drop("__rank")


def largest_remainder(sizes: DataFrame, total: int, stratum: str = "stratum", size: str = "size") -> DataFrame:
    """(stratum, size, quota): total split in proportion to size; rest places go to the largest fractions, ties by name.

    The strata are a small table, so one window over all of them is what is meant.
    """
    all_ = W.partitionBy(F.lit(1))
    exact = F.col(size) * F.lit(float(total)) / F.sum(size).over(all_)
    rows = sizes.select(stratum, size, F.floor(exact).alias("floor"), (exact - F.floor(exact)).alias("fraction"))
    rest = F.lit(total) - F.sum("floor").over(all_)
    rank = F.row_number().over(all_.orderBy(F.desc(F.round("fraction", 9)), stratum))
    return rows.select(stratum, size, (F.col("floor") + (rank <= rest).cast("long")).alias("quota"))


def stratified(rows: DataFrame, total: int, seed: int, key: str, strata: list[str]) -> DataFrame:
    """About `total` rows in proportion to the strata's sizes."""
    named = rows.withColumn("stratum", F.concat_ws("|", *strata))
    quotas = largest_remainder(named.groupBy("stratum").agg(F.count(F.lit(1)).alias("size")), total)
    return sample_per(named.join(F.broadcast(quotas.select("stratum", "quota")), "stratum"), F.col("quota"), seed, key, ["stratum"]).drop("quota")


def blind(rows: DataFrame, share: float, seed: int, key: str, columns: list[str]) -> DataFrame:
    """rows with is_blind: a share of all rows (rounded half to even), whose `columns` are emptied.

    The rows are counted first; the blind ones are a top-k by draw, joined back by the (unique) key.
    """
    chosen = sample(rows.select(key), round(rows.count() * share), seed, key).withColumn("is_blind", F.lit(True))
    marked = rows.join(chosen, key, "left").select(*rows.columns, F.coalesce("is_blind", F.lit(False)).alias("is_blind"))
    return marked.select(*(F.when(F.col("is_blind"), F.lit("")).otherwise(F.col(c).cast("string")).alias(c) if c in columns else F.col(c) for c in marked.columns))
