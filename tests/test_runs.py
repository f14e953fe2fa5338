"""Whole evaluations on generated scenario files."""

import json

import pytest
from pyspark.sql import functions as F

from chorale.operators import pools, rollup
from chorale.plans import runs
from chorale.sources import files, graph
from chorale.sources.storage import cut

CONFIG = """
raw_data_roots:
  A_m1:
    - "/one"
  A_m2:
    - "/two"
role_map:
  A:
    Student: "Student:Student"
    PolicyRole: "PolicyRole:Principle"
a_policyrole_merge_target: Student
kg_role_no_institutional_position:
  - "PolicyRole:Principle"
policyrole_student_keywords:
  en: ["student", "intern"]
gt_map:
  A:
    rate: {phase: Outcomes, var: rate, gt: 50, range: [0, 60]}
"""
PHASES = ["Inputs", "Activities", "Outputs", "Outcomes", "Impact"]


def document(n):
    people = [f"p{i}" for i in range(5)]
    said = {"p0": "I did not submit the evaluation report.", "p1": "We got S$500 million and 45%.", "p2": "", "p3": "Students submit evaluation reports every year.", "p4": "nothing of note"}

    def post(p, k, shift):
        return {"persona_name": p, "narrative": said[p] + f" {n}", "prediction_values": {"rate": 10 * k + n + shift * (5 - 2 * k), "note": "x"}}

    def phase(name):
        return {
            "phase": name, "direction": "forward", "posting_order": people, "phase_summary": f"summary of {name} with students and reports {n}",
            "initial_posts": [post(p, k, 0) for k, p in enumerate(people)], "revised_posts": [post(p, k, 1) for k, p in enumerate(people)],
        }

    kinds = [("Student", "Student | KG-Gen-1", "a student")] * 3 + [("PolicyRole", "Principle | KG-Gen-2", "intern"), ("PolicyRole", "Principle | KG-Gen-2", "minister")]
    return {
        "participants": [{"name": p, "stakeholder_type": t, "entity_name": e, "occupation": o} for p, (t, e, o) in zip(people, kinds)],
        "forward_pass": [phase(p) for p in PHASES],
        "cross_checks": [{"phase": "Outcomes", "variable": "rate", "aggregated_value": None}, {"phase": "Outcomes", "variable": "rate", "aggregated_value": 50.0 + n}] if n == 1 else [],
    }


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    for folder in ("one", "two"):
        (root / folder).mkdir()
        for n in (1, 2, 3):
            (root / folder / f"scenario_{n}.json").write_text(json.dumps(document(n)))
    return runs.parse(spark, files.parse_config(CONFIG), str(root))


def test_parse(parsed):
    assert parsed["problems"].count() == 0
    assert parsed["utterances"].count() == 2 * 3 * 5 * 2 * 5
    roles = {r.name: (r.kg_role, r.mislabel_source, r.deontic_status) for r in parsed["participants"].filter("scenario_uid = 'A_m1_01'").collect()}
    assert roles["p3"] == ("Student:Student", "policyrole_merged", "applicable")
    assert roles["p4"] == ("PolicyRole:Principle", None, "no_institutional_position_in_kg")
    assert {r.check_name: r.ok for r in parsed["checks"].filter("model_id = 'm1'").collect()} == {"scenario_count": False, "unique_uids": True, "contiguous_index": True}


@pytest.fixture(scope="module")
def numbers(spark, parsed):
    return runs.numeric(parsed["scenarios"], parsed["utterances"], files.ground_truth(spark, files.parse_config(CONFIG)))


def test_numeric(numbers):
    got = numbers
    rows = {k: v.filter("model_id = 'm1'").collect() for k, v in got.items()}
    assert rows["convergence"][0].n_cells == 15 and rows["anchoring"][0].n_used == 15
    # values move by 5 - 2k while the peers' mean less the own value falls by 12.5 a step, so the slope is 2 / 12.5
    assert abs(rows["anchoring"][0].mean_beta - 0.16) < 1e-9
    forecast = rows["forecast"][0]
    assert (forecast.n, forecast.n_fallback) == (3, 2) and forecast.gt == 50
    assert rows["coherence"][0].n_pairs == 12 and 0 < rows["coherence"][0].mean_cosine <= 1
    assert rows["self_bleu"][0].n_hypotheses == 15 * 4  # texts without words score nothing
    assert len(rows["outcome_range"]) == 2 and rows["distinct_1"][0].n_total > 0 and rows["group_variance"][0].n_cells == 15


def test_numeric_clusters_each_set_and_is_written(spark, numbers, tmp_path):
    got = numbers
    assert [r.n_scenarios for r in got["trajectory_clusters"].filter("model_id = 'm1'").collect()] == [3]
    row = rollup.meso(got).filter("model_id = 'm1'").collect()
    assert len(row) == 1 and row[0].convergence_rate.n_cells == 15 and row[0].anchoring_beta.n_used == 15 and row[0].cross_phase_coherence.n_pairs == 12
    row = rollup.diversity(got).filter("model_id = 'm1'").first()
    assert row.micro.group_variance.n_cells == 15 and len(row.macro.outcome_range_and_bins["rows"]) == 2 and row.macro.trajectory_clustering.n_scenarios == 3
    runs.write_numeric(got, str(tmp_path))
    detail = files.read_csv(spark, f"{tmp_path}/anchoring_beta_detail", ["set_name", "scenario_uid", "phase", "target", "beta", "n"])
    assert detail.count() == got["anchoring_cells"].count() and detail.filter("set_name = 'A_m1'").count() > 0
    meso = files.read_jsonl(spark, f"{tmp_path}/meso_set_results", "set string, result struct<convergence_rate:struct<n_cells:long>>")
    assert {r["set"]: r.result.convergence_rate.n_cells for r in meso.collect()} == {"A_m1": 15, "A_m2": 15}


def test_parse_is_written_and_participants_are_reviewed(spark, parsed, tmp_path):
    runs.write_parse(parsed, str(tmp_path))
    assert files.read_jsonl(spark, f"{tmp_path}/utterances").count() == parsed["utterances"].count()
    checks = {r.check_name: r.ok for r in parsed["acceptance"].filter("model_id = 'm1' or model_id is null").collect()}
    assert checks["five_participants"] and checks["phases_in_order"] and checks["five_posts_a_round"] and checks["posting_order_fits_posts"] and checks["no_equal_contents"]
    assert checks["all_uids_unique"] and not checks["all_scenarios"] and not checks["files_a_folder"] and len(checks) == 11
    people = parsed["participants"].withColumnRenamed("name", "persona_name")
    tables = pools.participant_tables(people, F.col("model_id") == "m1", F.col("model_id") == "m2", 42)
    assert tables["policy_roles"].count() == 6 and tables["policy_roles"].columns == pools.PERSONA
    flagged = tables["flagged"].collect()
    assert 0 < len(flagged) <= 15 and all(r.flag_policyrole for r in flagged) and [r.scenario_uid for r in flagged] == sorted(r.scenario_uid for r in flagged)
    types = [r.stakeholder_type for r in tables["roles_by_type"].collect()]
    assert types == sorted(types) and types.count("Student") == 10


def test_micro_and_pools(spark, parsed, tmp_path):
    nodes = spark.createDataFrame([("A", 0, "Student:Student", "Student", "Students submit evaluation reports every year", None, None)], "policy_id string, ord int, id string, type string, summary string, attributes struct<decision_authority:string>, source_spans array<struct<text:string>>")
    edges = spark.createDataFrame(
        [("A", i, f"e{i}", "DUTY", "Student:Student", "x", "must" if i == 0 else None, f"Every student must submit the evaluation report {i}", "The budget was S$500 million") for i in range(6)],
        "policy_id string, ord int, id string, type string, source string, target string, deontic string, fact string, source_text string",
    )
    u = parsed["utterances"]
    vectors = u.select("utterance_id", F.when(F.col("persona_name") == "p3", F.expr("array(1f, 0f)")).otherwise(F.expr("array(0f, 1f)")).alias("vector"))
    units = spark.range(8).select(F.lit("A").alias("policy_id"), F.col("id").cast("int").alias("unit_ord"), F.when(F.col("id") == 0, F.expr("array(1f, 0f)")).otherwise(F.expr("array(0.6f, 0.8f)")).alias("vector"))
    got = runs.micro_run(u, nodes, edges, vectors, units)
    got["labels"] = labels = cut(got["labels"])
    assert labels.count() == u.count()
    by = {r.persona_name: r for r in labels.filter("scenario_uid = 'A_m1_01' and phase = 'Inputs' and round = 'initial'").collect()}
    assert by["p0"].violation and by["p0"].reason.startswith("must_negation:")
    assert by["p3"].grounded and by["p3"].lex_grounded and by["p4"].applicable is False
    assert by["p1"].fabricated and by["p1"].unsupported_tokens == "45%"
    assert labels.filter("phase = 'Impact' and grounded is not null").count() == 0
    rollup = {r.model_id: r for r in got["rollup"].collect()}
    assert rollup["m1"].n_violation == 30 and rollup["m1"].n_no_position == 30 and rollup["m1"].fabrication_rate == 1.0
    assert {r.basis for r in got["gap"].collect()} == {"semantic", "lexical"} and got["sweep"].count() == 20
    norms = edges.select("policy_id", F.lit("Student").alias("role_type"), "deontic", "fact", "ord").filter("deontic is not null")
    earlier = pools.violation_diff_component(u.limit(2).select("utterance_id", F.lit("added").alias("status"), F.lit("a").alias("pre_reason"), F.lit(None).cast("string").alias("post_reason")))
    more = pools.grounding_component(u.limit(1).select("utterance_id", F.lit("True").alias("grounded"), F.lit(0.5).alias("max_cosine"), F.lit(0.6).alias("threshold")))
    assert [r.machine_note for r in earlier.collect()] == ["status=added; pre=a; post="] * 2 and more.first().machine_note == "grounded=True; max_cosine=0.5; threshold=0.6"
    corpus = graph.grounding_corpus(nodes, edges)
    pooled = runs.gold_pools(labels, nodes, norms, corpus, got["taus"], [])
    few = pooled["subsample"].collect()
    assert pooled["random"].count() == 300 and len(few) == 80 and sum(r.is_blind for r in few) == 16
    assert [r.scenario_uid for r in few if r.model_id == "m1"] == sorted(r.scenario_uid for r in few if r.model_id == "m1")
    assert all((r.suggested_violation, r.suggested_grounded_score, r.gold_violation) == ("", "", "") for r in few if r.is_blind)
    p3 = [r for r in few if r.persona_name == "p3" and not r.is_blind]
    assert all(r.suggested_grounded == "True" and float(r.suggested_grounded_score) > 0 for r in p3)
    assert all(r.suggested_fabrication == "" for r in few if r.persona_name == "p1")  # numbers without comma or point aren't judged
    units_named = units.select("policy_id", F.concat(F.lit("unit"), "unit_ord").alias("unit_ref"), F.lit("norm").alias("unit_kind"), F.lit("n").alias("unit_text"))
    runs.write_micro(got, units_named, f"{tmp_path}/micro")
    wrote = files.read_csv(spark, f"{tmp_path}/micro/per_utterance_labels", runs.LABELS)
    assert wrote.count() == u.count() and wrote.columns == runs.LABELS
    sweep = files.read_csv(spark, f"{tmp_path}/micro/grounding_threshold_sweep", ["set_name", "basis", "tau", "n_grounded", "n", "grounded_ratio"])
    assert {(r.set_name, r.basis) for r in sweep.collect()} == {(s, b) for s in ("A_m1", "A_m2") for b in ("semantic", "lexical_baseline")}
    assert 0 < files.read_csv(spark, f"{tmp_path}/micro/grounding_traceability_sample", runs.TRACE).count() <= 200
    runs.write_pools({k: v for k, v in pooled.items() if k == "subsample"}, f"{tmp_path}/pools")
    ids = [r.utterance_id for r in pooled["boundary"].collect()]
    assert len(ids) == len(set(ids)) > 0
    assert pooled["violation"].filter("applicable_norms like '[must]%'").count() > 0
