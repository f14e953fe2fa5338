"""Properties and edge cases of the metric operators, readers and writers."""

import functools
import hashlib
import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from chorale.functions import draws
from chorale.functions import text as T
from chorale.operators import cells, diversity, macro, meso, micro, reliability, sampling, tfidf
from chorale.sources import files, graph, scenario

CELLS = "policy_id string, model_id string, scenario_uid string, phase string, target string, persona string, kg_role string, initial double, revised double"


def cell(spark, pairs, uid="s"):
    rows = [("A", "m", uid, "Outcomes", "x", f"p{i}", f"R{i % 2}:n", float(a), float(b)) for i, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, CELLS)


def test_beta_is_one_when_all_move_to_the_peer_mean(spark):
    got = meso.anchoring(cell(spark, [(1, 4.5), (2, 4), (6, 2), (3, 3.5 - 0.5)])).first()
    values = [1, 2, 6, 3]
    moved = [(v, (sum(values) - v) / 3) for v in values]
    got = meso.anchoring(cell(spark, moved)).first()
    assert got.n_used == 1 and abs(got.mean_beta - 1) < 1e-9


def test_beta_is_zero_when_nobody_moves_and_absent_when_converged_or_degenerate(spark):
    assert meso.anchoring(cell(spark, [(1, 1), (2, 2), (5, 5)])).first().mean_beta == 0
    converged = meso.anchoring(cell(spark, [(1, 3), (2, 3), (5, 3)])).first()
    assert (converged.n_converged, converged.mean_beta) == (1, None)
    degenerate = meso.anchoring(cell(spark, [(2, 1), (2, 2), (2, 5)])).first()
    assert (degenerate.n_degenerate, degenerate.mean_beta) == (1, None)


def test_two_personas_are_no_cell(spark):
    assert meso.convergence(cell(spark, [(1, 1), (1, 1)])).count() == 0
    assert meso.responsiveness(cell(spark, [(1, 1), (1, 1)])).count() == 0


def test_group_variance_needs_spread_and_two_roles(spark):
    assert diversity.group_variance(cell(spark, [(0, 2), (0, 2), (0, 2)])).count() == 0
    assert diversity.group_variance(cell(spark, [(0, 1), (0, 2), (0, 3)])).first().n_cells == 1


def test_self_bleu_of_equal_and_disjoint_texts(spark):
    schema = "policy_id string, group_id int, member int, text string"
    same = spark.createDataFrame([("A", 1, i, "one two three four") for i in range(3)], schema)
    apart = spark.createDataFrame([("A", 1, 0, "aa bb cc"), ("A", 1, 1, "dd ee ff")], schema)
    assert abs(diversity.self_bleu(same, ["policy_id"]).first().self_bleu - 1) < 1e-12
    assert diversity.self_bleu(apart, ["policy_id"]).first().self_bleu == 0
    alone = spark.createDataFrame([("A", 1, 0, "aa"), ("A", 1, 1, "")], schema)
    assert diversity.self_bleu(alone, ["policy_id"]).first().n_hypotheses == 1


def test_self_bleu_takes_the_first_groups_only(spark):
    rows = [("A", g, m, "one two") for g in range(5) for m in range(2)]
    df = spark.createDataFrame(rows, "policy_id string, group_id int, member int, text string")
    assert diversity.self_bleu(df, ["policy_id"], max_groups=2).first().n_hypotheses == 4


def test_constant_outcomes_use_one_bin(spark):
    df = spark.createDataFrame([("A", "m", "Impact", "x", 2.0)] * 3, "policy_id string, model_id string, phase string, target string, estimate double")
    got = diversity.outcome_range(df).first()
    assert (got.bin_coverage, got.entropy, got.n) == (0.2, 0.0, 3)
    assert diversity.outcome_range(df.limit(1)).count() == 0


def test_estimates_prefer_the_first_check_with_a_value(spark):
    checks = spark.createDataFrame([("s", "P", "x", 0, None), ("s", "P", "x", 1, 7.0), ("s", "P", "x", 2, 8.0), ("t", "P", "x", 0, None)], "scenario_uid string, phase string, target string, pos int, aggregated_value double")
    values = spark.createDataFrame([("s", "P", "x", 1.0), ("t", "P", "x", 2.0), ("t", "P", "x", 4.0)], "scenario_uid string, phase string, target string, revised double")
    got = {r.scenario_uid: (r.estimate, r.is_fallback) for r in macro.estimates(checks, values).collect()}
    assert got == {"s": (7.0, False), "t": (3.0, True)}


def test_alpha_identity_without_gold_positives(spark):
    n, m = 455, 2
    rows = [(i < m, False) for i in range(n)]
    got = reliability.krippendorff(spark.createDataFrame(rows, "a boolean, b boolean"), "a", "b").first()
    assert abs(got.alpha + (m - 1) / (2 * n - m)) < 1e-12
    assert reliability.krippendorff(spark.createDataFrame([(True, True)], "a boolean, b boolean"), "a", "b").first().alpha is None
    empty = reliability.krippendorff(spark.createDataFrame([], "a boolean, b boolean"), "a", "b").first()
    assert (empty.n, empty.alpha) == (0, None)


def test_largest_remainder_sums_to_the_total(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 10), ("c", 10), ("d", 1)], "stratum string, size long")
    quotas = {r.stratum: r.quota for r in sampling.largest_remainder(sizes, 10).collect()}
    assert sum(quotas.values()) == 10 and quotas == {"a": 3, "b": 3, "c": 3, "d": 1}  # fractions .226 thrice, .323


def test_sweep_falls_with_the_threshold(spark):
    values = spark.range(100).select((F.col("id") / 100).alias("value"))
    counts = [r.n_grounded for r in micro.threshold_sweep(values, []).orderBy("tau").collect()]
    assert counts == sorted(counts, reverse=True) and len(counts) == 10


def test_coherent_null_draws_from_real_units_only(spark):
    sims = spark.createDataFrame([(u, i, "r", i / 10) for u in range(2) for i in range(9)] + [(9, i, "r", 0.5) for i in range(3)], "utterance_id int, unit_ord int, unit_ref string, sim double")
    got = micro.coherent_null(sims.withColumn("draw", F.md5(F.concat_ws(":", F.col("utterance_id").cast("string"), F.col("unit_ord").cast("string")))), []).collect()
    assert len(got) == 10 and all(r.value < 0.6 for r in got)


def test_similarities_in_blocks_keep_what_is_asked_of_them(spark):
    unit = lambda i: [float(np.cos(i)), float(np.sin(i))]
    units = spark.createDataFrame([(i, f"u{i}", unit(i * 0.37)) for i in range(40)], "unit_ord int, unit_ref string, vector array<double>")
    lines = spark.createDataFrame([(i, unit(i * 1.1)) for i in range(6)], "utterance_id int, vector array<double>")
    whole = micro.similarities(lines, units, [])
    parts = micro.similarities(lines, units, [], block=5)
    assert parts.count() > whole.count() >= 6 * 8
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(micro.semantic_top1(whole, [])) == rows(micro.semantic_top1(parts, []))
    assert rows(micro.coherent_null(whole, [])) == rows(micro.coherent_null(parts, [])) and micro.coherent_null(parts, []).count() == 30


def test_first_words_are_those_of_the_digest():
    heads = [b"20240612:" + b"7" * n for n in (0, 1, 5, 36, 46, 47, 54, 55, 56, 64, 119)]
    tails = [b":" + str(3**i).encode() for i in range(30)] + [b""]
    want = [[int(hashlib.md5(h + t).hexdigest()[:8], 16) for t in tails] for h in heads]
    assert draws.first_words(heads, tails).tolist() == want


def test_coherent_null_of_many_pairs_and_odd_vectors_against_brute_force(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(900, 16)).astype(np.float32).astype(float)
    vectors[100:160] = vectors[99]  # copies tie
    units = [(i, f"u{i}", x.tolist()) for i, x in enumerate(vectors)]
    units[7], units[8], units[9] = (7, "u7", None), (8, "u8", [1.0]), (9, "u9", [float("nan")] * 16)
    lines = [(i, (vectors[99] + i * x).tolist()) for i, x in enumerate(rng.normal(size=(700, 16)).astype(np.float32).astype(float))] + [(700, None), (701, [0.0] * 16)]
    began = time.perf_counter()
    sims = micro.similarities(spark.createDataFrame(lines, "utterance_id int, vector array<double>"), spark.createDataFrame(units, "unit_ord int, unit_ref string, vector array<double>"), [], block=300)
    null = {}
    for r in micro.coherent_null(sims, []).collect():
        null.setdefault(r.utterance_id, {})[r.unit_ord] = r.value
    top = {r.utterance_id: (r.sem_max_cosine, r.top1_norm_ref) for r in micro.semantic_top1(sims, []).collect()}
    assert time.perf_counter() - began < 30  # 630,000 pairs twice: minutes when each is an expression of its own
    assert set(null) == set(top) == set(range(702))
    for i, x in lines[::50] + lines[-2:]:
        sim = {j: functools.reduce(lambda s, p: s + p[0] * p[1], zip(x, y), 0.0) if x and y and len(x) == len(y) else None for j, _, y in units}
        order = sorted(sim, key=lambda j: (sim[j] is None, sim[j] == sim[j], -sim[j] if sim[j] is not None and sim[j] == sim[j] else 0, j))
        rest = sorted(order[3:], key=lambda j: hashlib.md5(f"20240612:{i}:{j}".encode()).hexdigest())[:5]
        assert str(null[i]) == str({j: sim[j] for j in null[i]}) and set(null[i]) == set(rest)
        assert str(top[i][0]) == str(sim[order[0]]) and top[i][1] == f"u{order[0]}"


def test_top1_needs_one_row_a_block_and_no_draws(spark):
    rng = np.random.default_rng(6)
    units = spark.createDataFrame([(i, f"u{i}", x.tolist()) for i, x in enumerate(rng.normal(size=(40, 4)))], "unit_ord int, unit_ref string, vector array<double>")
    lines = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(6, 4)))], "utterance_id int, vector array<double>")
    few = micro.similarities(lines, units, [], skip=1, take=0)
    assert few.count() == 6 and few.filter("draw is not null").isEmpty()
    rows = lambda sims: sorted(tuple(r) for r in micro.semantic_top1(sims, []).collect())
    assert rows(few) == rows(micro.similarities(lines, units, [])) == rows(micro.similarities(lines, units, [], skip=1, take=0, block=5))


def test_semantic_ties_take_the_first_unit(spark):
    sims = spark.createDataFrame([(1, 2, "b", 0.5), (1, 1, "a", 0.5)], "utterance_id int, unit_ord int, unit_ref string, sim double")
    assert micro.semantic_top1(sims, []).first().top1_norm_ref == "a"


def test_restatement_and_off_topic_by_tfidf(spark):
    corpus = spark.createDataFrame([(0, "students submit annual reports"), (1, "boards allocate research funding")], "doc_id int, text string")
    docs = spark.createDataFrame([(5, "Students submit annual reports"), (6, "nothing alike here"), (7, "")], "doc_id int, text string")
    got = {r.doc_id: r.max_cosine for r in tfidf.max_cosine(docs, corpus, []).collect()}
    assert abs(got[5] - 1) < 1e-12 and got[6] == 0 and got[7] == 0


def test_shuffled_corpus_keeps_words_and_lengths(spark):
    corpus = spark.createDataFrame([(0, "a b c d"), (1, "e f")], "doc_id int, text string")
    got = {r.doc_id: r.text.split(" ") for r in tfidf.shuffled_corpus(corpus, 1, []).collect()}
    assert sorted(got[0] + got[1]) == list("abcdef") and (len(got[0]), len(got[1])) == (4, 2)


@pytest.mark.parametrize(
    "text, want",
    [
        ("S$500 million", [("500 million", "amount", 5e8)]),
        ("S$1.2B", [("1.2B", "amount", 1.2e9)]),
        ("45 %", [("45 %", "percent", 45.0)]),
        ("1,200", [("1,200", "amount", 1200.0)]),
        ("2023", [("2023", "year", 2023.0)]),
        ("5k", [("5k", "amount", 5000.0)]),
        ("5km", []),
        ("3억", [("3억", "amount", 3e8)]),
        ("7", []),
        ("$50", []),
        ("50m", []),
    ],
)
def test_numeric_candidates(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(T.numeric_candidates(F.col("t")).alias("c")).first().c
    assert [(c.raw, c["class"], c.value) for c in got] == want


def test_windows_are_cut_at_the_ends(spark):
    df = spark.createDataFrame([("never " + "x" * 100 + " never",)], "t string")
    got = df.select(T.windows(F.col("t"), "never", 10).alias("w")).first().w
    assert got == ["never" + " " + "x" * 9, "x" * 9 + " never"]


def test_tolerance_join_finds_neighbours_across_steps(spark):
    index = spark.createDataFrame([("A", "amount", v) for v in (1.0, 100.0, 1e9, -5.0)], "policy_id string, class string, value double")
    numbers = spark.createDataFrame([("A", "amount", v) for v in (0.9905, 1.0099, 1.02, 99.5, 1.005e9, -5.04, 0.0)], "policy_id string, class string, value double")
    got = sorted(r.value for r in micro.supported_numbers(numbers, index).collect())
    assert got == [-5.04, 0.9905, 1.0099, 99.5, 1.005e9]


def test_csv_round_trip_with_quotes_and_newlines(spark, tmp_path):
    df = spark.createDataFrame([("a", 'x "y"\nz', ["p", "q"]), ("b", None, [])], "k string, t string, l array<string>")
    files.write_csv(df, str(tmp_path / "c"), ["k", "t", "l", "gone"])
    got = files.read_csv(spark, str(tmp_path / "c"), ["k", "t", "l", "gone"]).orderBy("k").collect()
    assert got[0].t == 'x "y"\nz' and got[0].l == "p; q" and got[1].k == "b"


def test_csv_with_byte_order_mark(spark, tmp_path):
    (tmp_path / "b.csv").write_bytes(b"\xef\xbb\xbfk,t\r\na,\"x \"\"y\"\"\"\r\n")
    assert files.read_csv(spark, str(tmp_path / "b.csv"), ["k", "t"]).collect() == [("a", 'x "y"')]


def test_jsonl_and_results_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("u", "대학", ["e"])], "utterance_id string, text string, evidence array<string>")
    files.write_jsonl(df, str(tmp_path / "j"))
    assert files.read_jsonl(spark, str(tmp_path / "j")).select("text", "evidence").first() == ("대학", ["e"])
    files.write_results(spark.createDataFrame([("A", "m", 3)], "policy_id string, model_id string, n int"), str(tmp_path / "r"), ["policy_id", "model_id"])
    assert files.read_results(spark, str(tmp_path / "r"), "set string, result struct<n:int>").first() == ("A_m", (3,))


def test_config_subset():
    text = """
# comment
roots:
  X_a:
    - "data/x # not a comment"
    - data/y
map:
  P: {phase: Outcomes, gt: 82.2, range: [0, 100]}  # tail
words: ["a", 'b', c]
flag: true
none:
"""
    got = files.parse_config(text)
    assert got["roots"]["X_a"] == ["data/x # not a comment", "data/y"]
    assert got["map"]["P"] == {"phase": "Outcomes", "gt": 82.2, "range": [0, 100]}
    assert got["words"] == ["a", "b", "c"] and got["flag"] is True and got["none"] is None


def _document(n):
    post = lambda p: {"persona_name": p, "narrative": f"{p} says", "prediction_values": {"x": n}}
    people = [f"p{i}" for i in range(5)]
    phase = lambda ph: {"phase": ph, "direction": "f", "posting_order": people[::-1], "initial_posts": [post(p) for p in people], "revised_posts": [post(p) for p in people]}
    return {"participants": [{"name": p} for p in people], "forward_pass": [phase(p) for p in ("Inputs", "Activities", "Outputs", "Outcomes", "Impact")]}


def test_scenario_files(spark, tmp_path):
    for folder, names in (("d1", ["scenario_2.json", "scenario_10.json", "other.json"]), ("d2", ["scenario_1.json"])):
        (tmp_path / folder).mkdir()
        for i, n in enumerate(names):
            (tmp_path / folder / n).write_text(json.dumps(_document(i)))
    folders = [str(tmp_path / "d1"), str(tmp_path / "d2")]
    rows = scenario.read_scenarios(spark, folders, "A", "m")
    assert sorted(r.scenario_uid for r in rows.collect()) == ["A_m_02", "A_m_10", "A_m_11"]
    assert scenario.violations_of_structure(rows).count() == 0
    posts = scenario.flatten(rows)
    assert posts.count() == 3 * 5 * 2 * 5 and posts.select("utterance_id").distinct().count() == 150
    assert {r.turn_index for r in posts.filter("persona_name = 'p4'").collect()} == {0}
    assert cells.predictions(posts).filter("value is not null").count() == 150
    assert scenario.duplicates(scenario.files_of(spark, folders)).first().n == 2


def test_graph_file(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"id": "A:x", "type": "A", "summary": "t", "source_spans": [{"text": "t"}, {"text": "v"}]}], "edges": [{"id": "e", "source": "A:x", "deontic": "must", "fact": "v"}], "validation_warnings": [1]}))
    n, e = graph.read_graph(spark, str(tmp_path / "g.json"), "P")
    assert [r.text for r in graph.grounding_corpus(n, e).orderBy("ord").collect()] == ["t", "v"]
    assert [(r.text, r.kind, r.ref_id) for r in graph.norm_units(n, e).orderBy("unit_ord").collect()] == [
        ("t", "node_summary", "A:x"), ("t", "source_span", "A:x#span0"), ("v", "source_span", "A:x#span1"), ("v", "deontic_norm", "e"),
    ]


def test_trajectory_clusters_find_two_groups(spark):
    rows = [(f"s{i}", "P", t, (0.0 if i < 4 else 10.0) + 0.1 * i) for i in range(8) for t in ("x", "y")]
    got = diversity.trajectory_clusters(spark.createDataFrame(rows, "scenario_uid string, phase string, target string, estimate double"), range(2, 4), 2).first()
    assert got.best_k == 2 and got.silhouette > 0.8


def test_trajectory_clusters_of_each_set_against_brute_force(spark):
    rows = [("P", m, f"s{i}", "Outcomes", t, (0.0 if i < 5 + n else 9.0 + n) + 0.3 * (i * i % 7)) for n, m in enumerate(("0", "1")) for i in range(12) for t in ("x", "y")]
    rows += [("P", "2", "s0", "Outcomes", "x", 1.0)]
    table = spark.createDataFrame(rows, "policy_id string, model_id string, scenario_uid string, phase string, target string, estimate double")
    got = {r.model_id: r for r in diversity.trajectory_clusters(table, range(2, 3), 2, block=5).collect()}
    assert {m: r.n_scenarios for m, r in got.items()} == {"0": 12, "1": 12, "2": 1} and got["2"].best_k is None
    for n, m in enumerate(("0", "1")):
        xs = [r[5] for r in rows if r[1] == m and r[4] == "x"]
        mean = sum(xs) / 12
        sd = (sum((x - mean) ** 2 for x in xs) / 12) ** 0.5
        apart = lambda i, j: abs(xs[i] - xs[j]) / sd * 2**0.5
        scores = []
        for i in range(12):
            of = {c: [apart(i, j) for j in range(12) if j != i and (j < 5 + n) == c] for c in (True, False)}
            a, b = (sum(of[c]) / len(of[c]) for c in (i < 5 + n, i >= 5 + n))
            scores.append((b - a) / max(a, b))
        assert got[m].best_k == 2 and abs(got[m].silhouette - sum(scores) / 12) < 1e-9


def test_trajectory_clusters_share_their_jobs_and_survive_copies(spark):
    rng = np.random.default_rng(3)
    rows = [("P", str(m), f"s{i}", "Outcomes", t, float(x)) for m in range(4) for i in range(30) for t, x in zip("xy", rng.normal(size=2) + 8 * (i % 3) * np.array([1, 1 + m]))]
    rows += [("P", "copies", f"s{i}", "Outcomes", "x", float(i % 2)) for i in range(9)] + [("P", "one", f"s{i}", "Outcomes", "x", 1.0) for i in range(9)]
    table = spark.createDataFrame(rows, "policy_id string, model_id string, scenario_uid string, phase string, target string, estimate double")
    spark.sparkContext.setJobGroup("clusters", "all sets")
    got = {r.model_id: r for r in diversity.trajectory_clusters(table, block=7).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("clusters"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 150  # KMeans one by one takes some thousands
    assert [got[str(m)].best_k for m in range(4)] == [3] * 4 and all(got[str(m)].silhouette > 0.5 for m in range(4))
    assert (got["copies"].best_k, got["copies"].silhouette) == (2, 1.0) and got["one"].best_k is None
    assert [r.silhouette for r in diversity.trajectory_clusters(table.repartition(7), block=50).orderBy("model_id").collect()] == pytest.approx([got[m].silhouette for m in sorted(got)])
