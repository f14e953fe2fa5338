"""Roll-ups: the metrics of a set side by side in one row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.operators.cells import SET


def set_rows(parts: dict[str, DataFrame], keys: list[str] = SET) -> DataFrame:
    """One row a set that any part has: each part's other columns as a struct named after it, null where it has none.

    Parts with a row a set. The rows are sets, so the joins move next to nothing.
    """
    rows = [part.select(*keys, F.struct(*(c for c in part.columns if c not in keys)).alias(name)) for name, part in parts.items()]
    return reduce(lambda a, b: a.join(b, keys, "full_outer"), rows)


def listed(part: DataFrame, keys: list[str] = SET) -> DataFrame:
    """A part of several rows a set (a row a phase and target, say) as one row with the sorted list of them."""
    rest = F.struct(*(c for c in part.columns if c not in keys))
    return part.groupBy(*keys).agg(F.sort_array(F.collect_list(rest)).alias("rows"))


def meso(found: dict[str, DataFrame]) -> DataFrame:
    """anchoring_beta, convergence_rate, responsiveness, cross_phase_coherence of each set."""
    names = {"anchoring_beta": "anchoring", "convergence_rate": "convergence", "responsiveness": "responsiveness", "cross_phase_coherence": "coherence"}
    return set_rows({name: found[k] for name, k in names.items()})


def micro_diversity(found: dict[str, DataFrame]) -> DataFrame:
    """group_variance, distinct_1, distinct_2, self_bleu of each set."""
    return set_rows({k: found[k] for k in ("group_variance", "distinct_1", "distinct_2", "self_bleu")})


def macro_diversity(found: dict[str, DataFrame]) -> DataFrame:
    """outcome_range_and_bins (a list) and trajectory_clustering of each set."""
    return set_rows({"outcome_range_and_bins": listed(found["outcome_range"]), "trajectory_clustering": found["trajectory_clusters"]})


def diversity(found: dict[str, DataFrame]) -> DataFrame:
    """micro and macro diversity of each set."""
    return set_rows({"micro": micro_diversity(found), "macro": macro_diversity(found)})
