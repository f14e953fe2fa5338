"""Whole evaluations: from scenario files to tables, and from those to the metrics of each set.

Every function returns DataFrames by name; nothing but the clustering of trajectories runs before they are written or shown.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.functions import cues
from chorale.operators import cells, diversity, macro, meso, micro, pools, rollup, sampling, tfidf
from chorale.operators.cells import SET
from chorale.sources import files, graph, scenario
from chorale.sources.storage import cut


def parse(spark: SparkSession, config: dict[str, Any], root: str = "") -> dict[str, DataFrame]:
    """scenarios, participants, utterances, problems and checks of all sets named POLICY_MODEL in raw_data_roots."""
    sets = []
    for name, folders in config["raw_data_roots"].items():
        policy, _, model = name.partition("_")
        sets.append(scenario.read_scenarios(spark, [root + f for f in folders], policy, model))
    docs = reduce(DataFrame.unionByName, sets)
    words = config.get("policyrole_student_keywords", {})
    merge = {p: config["role_map"][p][config[k]] for p in config["role_map"] if (k := f"{p.lower()}_policyrole_merge_target") in config}
    people = scenario.resolve_roles(
        scenario.participants(docs), files.role_map(spark, config), [*words.get("ko", []), *words.get("en", [])], merge, config.get("kg_role_no_institutional_position", [])
    )
    roles = people.select("scenario_uid", F.col("name").alias("persona_name"), "stakeholder_type", "kg_role", "flag_policyrole", "mislabel_source", "deontic_status")
    posts = scenario.flatten(docs)
    unknown = posts.join(roles, ["scenario_uid", "persona_name"], "left_anti").select("scenario_uid", F.lit("unknown_persona").alias("problem")).distinct()
    errors = people.filter("error is not null").select("scenario_uid", F.col("error").alias("problem")).distinct()
    return {
        "scenarios": docs,
        "participants": people,
        "utterances": posts.join(roles, ["scenario_uid", "persona_name"]),
        "problems": scenario.violations_of_structure(docs).unionByName(unknown).unionByName(errors),
        "checks": scenario.set_checks(docs),
        "acceptance": scenario.acceptance(docs, scenario.violations_of_structure(docs)),
    }


def phase_summaries(docs: DataFrame) -> DataFrame:
    """(policy_id, model_id, scenario_uid, ord, doc_id, text) of the forward pass, missing and empty ones left out."""
    rows = docs.select(*SET, "scenario_uid", F.explode("doc.forward_pass").alias("p")).filter("p.phase_summary <> ''")
    place = F.array_position(F.array(*(F.lit(p) for p in cues.PHASES)), F.col("p.phase"))
    return rows.select(*SET, "scenario_uid", place.alias("ord"), F.concat_ws("#", "scenario_uid", "p.phase").alias("doc_id"), F.col("p.phase_summary").alias("text"))


def cross_checks(docs: DataFrame) -> DataFrame:
    rows = docs.select("scenario_uid", F.posexplode("doc.cross_checks").alias("pos", "c"))
    return rows.select("scenario_uid", F.col("c.phase").alias("phase"), F.col("c.variable").alias("target"), "pos", F.col("c.aggregated_value").alias("aggregated_value"))


def numeric(docs: DataFrame, utterances: DataFrame, truth: DataFrame) -> dict[str, DataFrame]:
    """anchoring, anchoring_cells, convergence, responsiveness, coherence, forecast, group_variance, outcome_range, trajectory_clusters, distinct_1, distinct_2, self_bleu."""
    values = cells.predictions(utterances.withColumnRenamed("persona_name", "persona")).drop("prediction_values")
    sets = docs.select(*SET, "scenario_uid")
    strict = cells.strict_cells(values).join(sets, "scenario_uid")
    lenient = cells.lenient_cells(values).join(sets, "scenario_uid")
    estimates = macro.estimates(cross_checks(docs), lenient.select("scenario_uid", "phase", "target", "revised")).join(sets, "scenario_uid")
    keys = values.filter("value is not null").select("scenario_uid", "phase", "target").join(sets, "scenario_uid").select(*SET, "phase", "target").distinct()
    late = estimates.filter(F.col("phase").isin(cues.PHASES[3:])).join(keys, [*SET, "phase", "target"], "left_semi")
    texts = utterances.filter("round = 'revised'").select(*SET, F.concat_ws("#", "scenario_uid", "phase").alias("group_id"), F.col("persona_name").alias("member"), "text")
    return {
        "anchoring": meso.anchoring(strict),
        "anchoring_cells": meso.anchoring_cells(strict),
        "convergence": meso.convergence(strict),
        "responsiveness": meso.responsiveness(strict),
        "coherence": meso.coherence(phase_summaries(docs)),
        "forecast": macro.forecast(estimates, truth),
        "group_variance": diversity.group_variance(lenient),
        "outcome_range": diversity.outcome_range(late),
        "trajectory_clusters": diversity.trajectory_clusters(estimates.join(keys, [*SET, "phase", "target"], "left_semi")),
        "distinct_1": diversity.distinct_n(texts, 1),
        "distinct_2": diversity.distinct_n(texts, 2),
        "self_bleu": diversity.self_bleu(texts),
    }


def micro_run(utterances: DataFrame, nodes: DataFrame, edges: DataFrame, vectors: DataFrame, unit_vectors: DataFrame, seed: int = 20240612) -> dict[str, DataFrame]:
    """labels, rollup, taus, sweep, distributions: thresholds by policy, rates by set.

    vectors: utterance_id, vector; unit_vectors: policy_id, unit_ord, vector of `graph.norm_units`. All are of length 1.
    """
    scope = utterances.filter(micro.in_scope(F.col("phase")))
    corpus = graph.grounding_corpus(nodes, edges)
    units = graph.norm_units(nodes, edges).withColumnRenamed("ref_id", "unit_ref").join(unit_vectors, ["policy_id", "unit_ord"])
    sims = micro.similarities(scope.select("policy_id", "utterance_id").join(vectors, "utterance_id"), units, ["policy_id"], seed=seed)
    semantic, null = micro.semantic_top1(sims, ["policy_id"]), micro.coherent_null(sims, ["policy_id"])
    lines = scope.select("policy_id", F.col("utterance_id").alias("doc_id"), "text")
    known = corpus.select("policy_id", F.col("ord").alias("doc_id"), "text")
    lexical = tfidf.max_cosine(lines, known, ["policy_id"])
    lex_null = tfidf.max_cosine(lines, tfidf.shuffled_corpus(known, seed, ["policy_id"]), ["policy_id"])
    sem_tau = micro.null_threshold(null, ["policy_id"]).withColumnRenamed("tau", "sem_tau")
    lex_tau = micro.null_threshold(lex_null, ["policy_id"], column="max_cosine").withColumnRenamed("tau", "lex_tau")
    policies = utterances.select("policy_id").distinct()
    taus = policies.join(sem_tau, "policy_id", "left").join(lex_tau, "policy_id", "left").na.fill(0.0, ["sem_tau", "lex_tau"])
    found = micro.violations(utterances, micro.norm_phrases(graph.norms(edges), graph.authority_phrases(nodes)))
    lex = lexical.select(F.col("doc_id").alias("utterance_id"), F.col("max_cosine").alias("lex_max_cosine"))
    labels = micro.utterance_labels(utterances, found, semantic, lex, taus, micro.fabrication(scope, corpus))
    basis = lambda df, column, name: df.select("policy_id", F.lit(name).alias("basis"), F.col(column).alias("value"))
    real = basis(semantic, "sem_max_cosine", "semantic").unionByName(basis(lexical, "max_cosine", "lexical"))
    nulls = basis(null, "value", "semantic").unionByName(basis(lex_null, "max_cosine", "lexical"))
    return {
        "labels": labels,
        "rollup": micro.set_rollup(labels, SET),
        "taus": taus,
        "sweep": micro.threshold_sweep(real, ["policy_id", "basis"]),
        "real": micro.distribution(real, ["policy_id", "basis"]),
        "null": micro.distribution(nulls, ["policy_id", "basis"]),
        "gap": micro.separation_gap(real, nulls, ["policy_id", "basis"]),
    }


def gold_pools(
    labels: DataFrame, nodes: DataFrame, norms: DataFrame, corpus: DataFrame, taus: DataFrame, existing: list[DataFrame], seed: int = 42
) -> dict[str, DataFrame]:
    """random (300 in proportion to sets), subsample (40 a set, with the independent rater's suggestions, a fifth blind), boundary, violation, grounding_boundary; sorted.

    existing: components from earlier tables, as `pools.violation_diff_component` and `pools.grounding_component` give them.
    """
    by_scenario = [*SET, "scenario_uid", "utterance_id"]
    labels = cut(labels)
    drawn = cut(sampling.stratified(labels, 300, seed, "utterance_id", SET))
    few = cut(sampling.sample_per(drawn, 40, seed + 1, "utterance_id", SET))
    boundary = cut(pools.boundary_pool(labels, existing, seed))
    return {
        "random": drawn.orderBy(*by_scenario),
        "subsample": pools.suggested(few, nodes, norms, corpus, seed + 2),
        "boundary": boundary,
        "violation": pools.violation_pool([drawn, boundary], labels, graph.formatted_norms(norms)).orderBy(*by_scenario),
        "grounding_boundary": pools.grounding_boundary(labels, taus.select("policy_id", F.col("sem_tau").alias("tau")), seed).orderBy("sem_max_cosine", "utterance_id"),
    }


# --- runs that write their results -----------------------------------------------------------------------------------------

LABELS = (
    "utterance_id policy_id model_id scenario_uid kg_role deontic_status violation_applicable violation violation_reason grounding_status grounded sem_max_cosine "
    "top1_norm_kind top1_norm_ref top1_norm_text lex_grounded lex_max_cosine fabrication_applicable fabricated unsupported_tokens derived_estimate derived_estimate_tokens"
).split()
TRACE = "utterance_id policy_id model_id kg_role sem_max_cosine top1_norm_kind top1_norm_ref top1_norm_text utterance_text".split()
TRACE_ROWS = 200


def label_columns(labels: DataFrame, units: DataFrame) -> DataFrame:
    """The labels under the names of LABELS, with kind and text of the matched norm. units: policy_id, unit_ref, unit_kind, unit_text."""
    matched = units.select("policy_id", F.col("unit_ref").alias("top1_norm_ref"), F.col("unit_kind").alias("top1_norm_kind"), F.col("unit_text").alias("top1_norm_text"))
    out = labels.withColumnsRenamed({"applicable": "violation_applicable", "reason": "violation_reason"}).join(matched, ["policy_id", "top1_norm_ref"], "left")
    scope = micro.in_scope(F.col("phase"))
    return out.withColumns({"grounding_status": F.when(scope, "in_scope").otherwise("out_of_scope"), "fabrication_applicable": scope})


def write_parse(parsed: dict[str, DataFrame], path: str) -> None:
    """utterances as JSON lines, the acceptance list and the summaries of sets as CSV."""
    files.write_jsonl(parsed["utterances"], f"{path}/utterances")
    files.write_csv(parsed["acceptance"], f"{path}/acceptance")
    files.write_csv(scenario.set_summary(parsed["utterances"], SET), f"{path}/set_summary")


def write_micro(found: dict[str, DataFrame], units: DataFrame, path: str, seed: int = 42) -> None:
    """Per-utterance labels, threshold sweep of each set and traceability sample as CSV, the sets' rates as JSON."""
    labels = label_columns(found["labels"], units)
    files.write_csv(labels, f"{path}/per_utterance_labels", LABELS)
    name = F.concat_ws("_", *SET).alias("set_name")
    basis = lambda column, basis: labels.select(name, F.lit(basis).alias("basis"), F.col(column).alias("value")).filter("value is not null")
    sweep = micro.threshold_sweep(basis("sem_max_cosine", "semantic").unionByName(basis("lex_max_cosine", "lexical_baseline")), ["set_name", "basis"])
    files.write_csv(sweep.orderBy("set_name", F.desc("basis"), "tau"), f"{path}/grounding_threshold_sweep", ["set_name", "basis", "tau", "n_grounded", "n", "grounded_ratio"])
    sample = sampling.sample(labels.filter("grounded"), TRACE_ROWS, seed, "utterance_id").withColumnRenamed("text", "utterance_text")
    files.write_csv(sample, f"{path}/grounding_traceability_sample", TRACE)
    files.write_results(found["rollup"], f"{path}/set_results", SET)


def write_numeric(found: dict[str, DataFrame], path: str) -> None:
    """Anchoring cells as CSV; meso, forecast and diversity of each set as JSON."""
    detail = found["anchoring_cells"].withColumn("set_name", F.concat_ws("_", *SET))
    files.write_csv(detail, f"{path}/anchoring_beta_detail", ["set_name", "scenario_uid", "phase", "target", "beta", "n"])
    files.write_results(rollup.meso(found), f"{path}/meso_set_results", SET)
    files.write_results(rollup.listed(found["forecast"]), f"{path}/accuracy_macro", SET)
    files.write_results(rollup.diversity(found), f"{path}/diversity", SET)


def write_pools(found: dict[str, DataFrame], path: str) -> None:
    """Each pool as CSV."""
    for name, pool in found.items():
        files.write_csv(pool, f"{path}/{name}")
