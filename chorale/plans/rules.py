"""Queries of the rule-based metrics, the graph tables, the parser and the pools, on inline fixtures and driver tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from chorale.functions import cues
from chorale.functions import text as T
from chorale.operators import diversity, micro, pools, reliability
from chorale.plans.fixtures import cte, table
from chorale.plans.registry import query, read, rounded
from chorale.sources import graph, scenario


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# --- the graph -----------------------------------------------------------------------------------------------------------


def nodes(spark):
    n = table(spark, "f_nodes")
    spans = F.when(F.col("span").isNotNull(), F.array(F.struct(F.col("span").alias("text"))))
    return n.withColumn("attributes", F.struct("decision_authority")).withColumn("source_spans", spans)


def edges(spark):
    return table(spark, "f_edges")


_GRAPH = f"""{cte("f_nodes")}, {cte("f_edges")}, g AS (
  SELECT policy_id, 0 AS part, ord, 0 AS place, summary AS text, 'node_summary' AS kind, id AS ref_id FROM f_nodes
  UNION ALL SELECT policy_id, 0, ord, 1, span, 'source_span', id || '#span0' FROM f_nodes
  UNION ALL SELECT policy_id, 1, ord, 0, fact, CASE WHEN deontic IN ('must', 'can', 'cannot') THEN 'deontic_norm' ELSE 'edge_fact' END, id FROM f_edges
  UNION ALL SELECT policy_id, 1, ord, 1, source_text, 'source_span', id || '#source_text' FROM f_edges),
t AS (SELECT * FROM g WHERE trim(coalesce(text, '')) <> ''),
cor AS (SELECT policy_id, CAST(row_number() OVER (PARTITION BY policy_id ORDER BY o) - 1 AS INTEGER) AS ord, text FROM (SELECT policy_id, text, min(part * 1000000 + ord * 10 + place) AS o FROM t GROUP BY ALL)),
nrm AS (SELECT policy_id, split_part(source, ':', 1) AS role_type, deontic, fact, ord FROM f_edges WHERE deontic IN ('must', 'can', 'cannot')),
aut AS (SELECT policy_id, type AS role_type, decision_authority AS phrase, ord FROM f_nodes WHERE coalesce(decision_authority, '') <> '')"""


@query("kg_corpus", f"WITH {_GRAPH} SELECT policy_id, ord, text FROM cor")
def kg_corpus(spark, sf_dir):
    return graph.grounding_corpus(nodes(spark), edges(spark))


@query(
    "kg_norm_units",
    f"""WITH {_GRAPH}, u AS (SELECT policy_id, text, kind, min(part * 1000000 + ord * 10 + place) AS o, arg_min(ref_id, part * 1000000 + ord * 10 + place) AS ref_id FROM t GROUP BY ALL)
SELECT policy_id, CAST(row_number() OVER (PARTITION BY policy_id ORDER BY o) - 1 AS INTEGER) AS unit_ord, text, kind, ref_id FROM u""",
)
def kg_norm_units(spark, sf_dir):
    return graph.norm_units(nodes(spark), edges(spark))


@query("kg_norms_by_role", f"WITH {_GRAPH} SELECT policy_id, role_type, deontic, fact, ord FROM nrm")
def kg_norms_by_role(spark, sf_dir):
    return graph.norms(edges(spark))


@query("kg_authority_phrases", f"WITH {_GRAPH} SELECT policy_id, role_type, phrase, ord FROM aut")
def kg_authority_phrases(spark, sf_dir):
    return graph.authority_phrases(nodes(spark))


_VOCAB = "voc AS (SELECT policy_id, type AS role_type, list_sort(list_distinct(flatten(list(regexp_extract_all(lower(summary), '[a-z]{5,}'))))) AS words FROM f_nodes WHERE coalesce(summary, '') <> '' GROUP BY ALL)"


@query("kg_role_vocab", f"WITH {_GRAPH}, {_VOCAB} SELECT policy_id, role_type, array_to_string(words, ' ') AS words FROM voc")
def kg_role_vocab(spark, sf_dir):
    return reliability.role_vocabulary(nodes(spark)).withColumn("words", F.array_join("words", " "))


@query(
    "kg_corpus_ngrams",
    f"""WITH {_GRAPH}, w AS (SELECT policy_id, [lower(x) FOR x IN regexp_extract_all(text, '[a-zA-Z]{{2,}}')] AS w FROM cor)
SELECT DISTINCT policy_id, array_to_string(g, ' ') AS g FROM (SELECT policy_id, unnest([list_slice(w, i, i + 3) FOR i IN range(1, len(w) - 2)]) AS g FROM w)""",
)
def kg_corpus_ngrams(spark, sf_dir):
    rows = graph.grounding_corpus(nodes(spark), edges(spark))
    return rows.select("policy_id", F.explode(T.ngrams(reliability.words_only(F.col("text")), 4)).alias("g")).distinct().withColumn("g", F.array_join("g", " "))


@query("kg_corpus_blob", f"WITH {_GRAPH} SELECT policy_id, replace(string_agg(text, ' ' ORDER BY ord), ',', '') AS blob FROM cor GROUP BY ALL")
def kg_corpus_blob(spark, sf_dir):
    return reliability.corpus_blob(graph.grounding_corpus(nodes(spark), edges(spark)), ["policy_id"])


# --- violations ----------------------------------------------------------------------------------------------------------

_STOP = ", ".join(_q(w) for w in cues.STOPWORDS)
_SIG = "[x FOR x IN list_distinct(regexp_extract_all(lower({}), '[a-z]{{4,}}')) IF NOT list_contains([" + _STOP + "], x)]"


def _windows_sql(name: str, pattern: str, around: int = 80) -> str:
    p = _q("(?i)" + pattern)
    return f"""{name}_m AS (SELECT utterance_id, text, unnest(m) AS m, unnest(range(1, len(m) + 1)) AS k, parts FROM
  (SELECT utterance_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {p}) AS m, string_split_regex(coalesce(text, ''), {p}) AS parts FROM f_utterances)),
{name}_e AS (SELECT *, sum(length(parts[k]) + length(m)) OVER (PARTITION BY utterance_id ORDER BY k) AS e FROM {name}_m),
{name} AS (SELECT utterance_id, k, substring(text, CAST(greatest(0, e - length(m) - {around}) + 1 AS BIGINT), CAST(e + {around} - greatest(0, e - length(m) - {around}) AS BIGINT)) AS near FROM {name}_e)"""


_PHRASES = f"""du AS (SELECT policy_id, role_type, ord, CASE WHEN regexp_matches(fact, '(?i)\\b(must|can|cannot)\\b\\s+') THEN regexp_extract(fact, '(?i)\\b(must|can|cannot)\\b\\s+(.*)', 2) ELSE fact END AS phrase FROM nrm WHERE deontic = 'must' AND coalesce(fact, '') <> ''),
duw AS (SELECT *, {_SIG.format("phrase")} AS words FROM du), auw AS (SELECT *, {_SIG.format("phrase")} AS words FROM aut)"""
_UTT = "ut AS (SELECT *, split_part(kg_role, ':', 1) AS role_type FROM f_utterances), rol AS (SELECT DISTINCT policy_id, role_type, true AS has FROM nrm), ua AS (SELECT ut.*, deontic_status = 'applicable' AND coalesce(has, false) AS app FROM ut LEFT JOIN rol USING (policy_id, role_type))"


def _hits_sql(name: str, least: int, cut: bool) -> str:
    shown = "left(p.phrase, 60)" if cut else "p.phrase"
    enough = f"len(p.words) > 0 AND len(list_intersect(p.words, {_SIG.format('w.near')})) >= least({least}, len(p.words))"
    return f"""{name}_h AS (
  SELECT u.utterance_id, 0 AS rule, w.k, p.ord, p.role_type AS rt, 'must_negation:' || {shown} AS reason, w.near FROM ua u JOIN neg w USING (utterance_id) JOIN duw p ON p.policy_id = u.policy_id AND p.role_type = u.role_type WHERE app AND {enough}
  UNION ALL SELECT u.utterance_id, 1, w.k, p.ord, p.role_type, 'cross_role_authority_claim:' || p.role_type || ':' || {shown}, w.near FROM ua u JOIN cla w USING (utterance_id) JOIN auw p ON p.policy_id = u.policy_id AND p.role_type <> u.role_type WHERE app AND {enough}),
{name} AS (SELECT utterance_id, arg_min(reason, rule * 1000000 + k * 1000 + ord) AS reason, arg_min(near, rule * 1000000 + k * 1000 + ord) AS near FROM {name}_h GROUP BY ALL)"""


_RULE = f"{cte('f_utterances')}, {_GRAPH}, {_PHRASES}, {_UTT}, {_windows_sql('neg', cues.NEGATION)}, {_windows_sql('cla', cues.AUTHORITY)}"


def phrases(spark):
    return micro.norm_phrases(graph.norms(edges(spark)), graph.authority_phrases(nodes(spark)))


@query("micro_violation", f"WITH {_RULE}, {_hits_sql('h', 2, True)} SELECT utterance_id, app AS applicable, CASE WHEN app THEN reason IS NOT NULL END AS violation, reason FROM ua LEFT JOIN h USING (utterance_id)")
def violation(spark, sf_dir):
    return micro.violations(table(spark, "f_utterances"), phrases(spark)).select("utterance_id", "applicable", "violation", "reason")


@query(
    "micro_violation_diff",
    f"""WITH {_RULE}, {_hits_sql('h1', 1, True)}, {_hits_sql('h2', 2, False)}
SELECT utterance_id, h1.reason IS NOT NULL AS pre, h1.reason AS pre_reason, h2.reason IS NOT NULL AS post, h2.reason AS post_reason, h2.near AS window_text, CASE WHEN h2.reason IS NOT NULL THEN 'confirmed' ELSE 'dropped' END AS status
FROM ua LEFT JOIN h1 USING (utterance_id) LEFT JOIN h2 USING (utterance_id) WHERE h1.reason IS NOT NULL OR h2.reason IS NOT NULL""",
)
def violation_diff(spark, sf_dir):
    return micro.violation_diff(table(spark, "f_utterances"), phrases(spark))


# --- numbers -------------------------------------------------------------------------------------------------------------


def _numbers_sql(name: str, source: str) -> str:
    """CTE `name` (id, policy_id, pos, raw, class, value) of source (id, policy_id, text)."""
    n, cur = _q(cues.NUMBER), " OR ".join(f"contains({{0}}, {_q(c)})" for c in cues.CURRENCIES)
    scales = " ".join(f"WHEN {_q(k)} THEN {v}::DOUBLE" for k, v in cues.SCALES.items())
    return rf"""{name}_m AS (SELECT id, policy_id, text, unnest(m) AS m, unnest(range(1, len(m) + 1)) AS k, parts FROM (SELECT id, policy_id, text, regexp_extract_all(text, {n}) AS m, string_split_regex(text, {n}) AS parts FROM {source})),
{name}_e AS (SELECT *, CAST(sum(length(parts[k]) + length(m)) OVER (PARTITION BY id, policy_id ORDER BY k) AS BIGINT) AS e FROM {name}_m),
{name}_s AS (SELECT *, lower(substring(text, greatest(0, e - length(m) - 8) + 1, e - length(m) - greatest(0, e - length(m) - 8))) AS bef, substring(text, e + 1, 15) AS aft, CAST(replace(m, ',', '') AS DOUBLE) AS num FROM {name}_e),
{name}_r AS (SELECT *, CASE WHEN regexp_matches(lower(aft), '^\s?k[a-z]') THEN '' ELSE regexp_extract(lower(aft), '^\s?(billion|million|thousand|k|억|만)', 1) END AS sc,
  CASE WHEN regexp_matches(lower(aft), '^\s?k[a-z]') THEN '' ELSE regexp_extract(lower(aft), '^\s?(billion|million|thousand|k|억|만)', 0) END AS st,
  ({cur.format("bef")}) OR ({cur.format("left(lower(aft), 6)")}) AS hc, regexp_extract(aft, '^\s*%', 0) AS pc FROM {name}_s),
{name}_q AS (SELECT *, CASE WHEN hc AND sc = '' AND NOT regexp_matches(aft, '^(M|B)[a-zA-Z]') THEN regexp_extract(aft, '^(M|B)', 1) ELSE '' END AS ab FROM {name}_r),
{name}_c AS (SELECT *, CASE WHEN pc <> '' THEN 'percent' WHEN sc <> '' OR hc THEN 'amount' WHEN regexp_full_match(m, '(19|20)\d\d') THEN 'year' WHEN contains(m, ',') THEN 'amount' END AS class FROM {name}_q),
{name} AS (SELECT id, policy_id, row_number() OVER (PARTITION BY id, policy_id ORDER BY k) AS pos, trim(m || CASE WHEN pc <> '' THEN pc WHEN ab <> '' THEN ab ELSE st END) AS raw, class,
  CASE WHEN class = 'amount' THEN num * CASE WHEN ab = 'M' THEN 1e6 WHEN ab = 'B' THEN 1e9 ELSE CASE sc {scales} ELSE 1.0::DOUBLE END END ELSE num END AS value FROM {name}_c WHERE class IS NOT NULL)"""


_UN = _numbers_sql("un", "(SELECT utterance_id AS id, policy_id, coalesce(text, '') AS text FROM f_utterances)")
_CN = _numbers_sql("cn", "(SELECT CAST(ord AS VARCHAR) AS id, policy_id, text FROM cor)")


@query("micro_numeric_candidates", f"WITH {cte('f_utterances')}, {_UN} SELECT id AS utterance_id, pos, raw, class, round(value, 6) AS value FROM un")
def numeric_candidates(spark, sf_dir):
    rows = table(spark, "f_utterances").select("utterance_id", F.posexplode(T.numeric_candidates(F.col("text"))).alias("pos", "c"))
    return rounded(rows.select("utterance_id", (F.col("pos") + 1).cast("long").alias("pos"), "c.*"), "value")


@query(
    "micro_numeric_documents",
    "WITH " + _numbers_sql("dn", "(SELECT CAST(doc_id AS VARCHAR) AS id, lang AS policy_id, coalesce(text, '') AS text FROM documents)") + " SELECT id AS doc_id, policy_id AS lang, pos, raw, class, round(value, 6) AS value FROM dn",
)
def numeric_documents(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "lang", F.posexplode(T.numeric_candidates(F.coalesce("text", F.lit("")))).alias("pos", "c"))
    return rounded(rows.select("doc_id", "lang", (F.col("pos") + 1).cast("long").alias("pos"), "c.*"), "value")


@query("kg_numeric_index", f"WITH {_GRAPH}, {_CN} SELECT DISTINCT policy_id, class, value FROM cn WHERE value <> 0")
def numeric_index(spark, sf_dir):
    return micro.numeric_index(graph.grounding_corpus(nodes(spark), edges(spark)))


_FAB = f"""{_UN}, {_CN},
sup AS (SELECT u.*, EXISTS (SELECT 1 FROM cn c WHERE c.policy_id = u.policy_id AND c.class = u.class AND c.value <> 0 AND abs(u.value - c.value) <= 0.01 * greatest(abs(u.value), abs(c.value))) AS ok FROM un u),
amo AS (SELECT id, value FROM sup WHERE ok AND class = 'amount' AND value <> 0),
can AS (SELECT a.id, unnest([a.value * b.value, a.value / b.value, a.value + b.value, a.value - b.value]) AS v FROM amo a JOIN amo b USING (id)),
jud AS (SELECT s.*, NOT ok AND class = 'amount' AND EXISTS (SELECT 1 FROM can c WHERE c.id = s.id AND abs(s.value - c.v) <= 0.03 * greatest(abs(s.value), abs(c.v), 1.0)) AS der FROM sup s),
fab AS (SELECT utterance_id, u.policy_id, count(j.id) > 0 AS fabrication_applicable, CASE WHEN count(j.id) > 0 THEN count(*) FILTER (NOT ok AND NOT der) > 0 END AS fabricated, CASE WHEN count(j.id) > 0 THEN count(*) FILTER (der) > 0 END AS derived_estimate,
  coalesce(string_agg(raw, '; ' ORDER BY pos) FILTER (NOT ok AND NOT der), '') AS unsupported_tokens, coalesce(string_agg(raw, '; ' ORDER BY pos) FILTER (der), '') AS derived_estimate_tokens
  FROM f_utterances u LEFT JOIN jud j ON j.id = u.utterance_id GROUP BY ALL)"""


@query("micro_fabrication", f"WITH {cte('f_utterances')}, {_GRAPH}, {_FAB} SELECT * FROM fab")
def fabrication(spark, sf_dir):
    return micro.fabrication(table(spark, "f_utterances"), graph.grounding_corpus(nodes(spark), edges(spark)))


# --- labels and roll-up ----------------------------------------------------------------------------------------------------

_SIM = "0.1 * (ascii(right(utterance_id, 1)) % 10)"


def labels(spark):
    u = table(spark, "f_utterances")
    sem = u.select("utterance_id", F.expr(f"CAST({_SIM} AS DOUBLE)").alias("sem_max_cosine"), F.lit("n").alias("top1_norm_ref"))
    lex = u.select("utterance_id", F.expr(f"CAST({_SIM} AS DOUBLE) / 2").alias("lex_max_cosine"))
    taus = spark.createDataFrame([("A", 0.35, 0.2), ("B", 0.25, 0.2)], "policy_id string, sem_tau double, lex_tau double")
    fab = micro.fabrication(u, graph.grounding_corpus(nodes(spark), edges(spark)))
    return micro.utterance_labels(u, micro.violations(u, phrases(spark)), sem, lex, taus, fab)


_LABELS = f"""{_RULE}, {_hits_sql('h', 2, True)}, {_FAB},
lab AS (SELECT ua.utterance_id, ua.policy_id, model_id, phase, kg_role, deontic_status, text, app AS applicable, CASE WHEN app THEN reason IS NOT NULL END AS violation, reason, phase IN ('Inputs', 'Activities') AS scope,
  CAST({_SIM.replace("utterance_id", "ua.utterance_id")} AS DOUBLE) AS sim, CASE ua.policy_id WHEN 'A' THEN 0.35 ELSE 0.25 END AS tau, fabrication_applicable, fabricated, derived_estimate, unsupported_tokens, derived_estimate_tokens
  FROM ua LEFT JOIN h USING (utterance_id) LEFT JOIN fab USING (utterance_id))"""


@query(
    "micro_utterance_labels",
    f"""WITH {_LABELS} SELECT utterance_id, policy_id, applicable, violation, reason, CASE WHEN scope THEN 'in_scope' ELSE 'out_of_scope' END AS grounding_status, CASE WHEN scope THEN sim > tau END AS grounded, CASE WHEN scope THEN sim / 2 > 0.2 END AS lex_grounded,
  scope AND fabrication_applicable AS fabrication_applicable, CASE WHEN scope THEN fabricated END AS fabricated, CASE WHEN scope THEN derived_estimate END AS derived_estimate FROM lab""",
)
def utterance_labels(spark, sf_dir):
    return labels(spark).select(
        "utterance_id", "policy_id", "applicable", "violation", "reason", "grounding_status", "grounded", "lex_grounded", "fabrication_applicable", "fabricated", "derived_estimate"
    )


@query(
    "micro_set_rollup",
    f"""WITH {_LABELS}, c AS (SELECT policy_id, model_id, count(*) AS n_utterances, count(*) FILTER (deontic_status <> 'applicable') AS n_no_position, count(*) FILTER (applicable) AS n_applicable, count(*) FILTER (violation) AS n_violation,
  count(*) FILTER (scope) AS n_in_scope, count(*) FILTER (scope AND sim > tau) AS n_grounded, count(*) FILTER (scope AND sim / 2 > 0.2) AS n_lex_grounded, count(*) FILTER (scope AND fabrication_applicable) AS n_fabrication_applicable,
  count(*) FILTER (scope AND fabricated) AS n_fabricated, count(*) FILTER (scope AND derived_estimate) AS n_derived FROM lab GROUP BY ALL)
SELECT *, round(n_violation / nullif(n_applicable, 0)::DOUBLE, 6) AS violation_rate, round(n_grounded / nullif(n_in_scope, 0)::DOUBLE, 6) AS grounded_rate, round(n_lex_grounded / nullif(n_in_scope, 0)::DOUBLE, 6) AS lex_grounded_rate,
  round(n_fabricated / nullif(n_fabrication_applicable, 0)::DOUBLE, 6) AS fabrication_rate, round(n_derived / nullif(n_fabrication_applicable, 0)::DOUBLE, 6) AS derived_rate FROM c""",
)
def set_rollup(spark, sf_dir):
    return rounded(micro.set_rollup(labels(spark), ["policy_id", "model_id"]), "violation_rate", "grounded_rate", "lex_grounded_rate", "fabrication_rate", "derived_rate")


@query("div_plausible_gate", f"WITH {_LABELS} SELECT utterance_id FROM lab WHERE scope AND sim > tau AND NOT coalesce(fabricated, false)")
def plausible_gate(spark, sf_dir):
    return diversity.plausible(table(spark, "f_utterances"), labels(spark)).select("utterance_id")


# --- the independent rater -------------------------------------------------------------------------------------------------


def _any(column: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {_q(p)})" for p in parts) + ")"


@query(
    "rater_violation",
    f"""WITH {cte('f_utterances')}, {_GRAPH}, {_VOCAB}, u AS (SELECT utterance_id, policy_id, split_part(kg_role, ':', 1) AS own, coalesce(text, '') AS text FROM f_utterances),
c AS (SELECT utterance_id, policy_id, own, k, trim(c) AS c FROM (SELECT *, unnest(string_split_regex(text, '[.!?;]')) AS c, unnest(range(1, len(string_split_regex(text, '[.!?;]')) + 1)) AS k FROM u) WHERE trim(c) <> ''),
w AS (SELECT *, regexp_extract_all(lower(c), '[a-z]{{5,}}') AS ws, lower(c) AS l FROM c),
mw AS (SELECT policy_id, role_type AS own, flatten(list(regexp_extract_all(lower(fact), '[a-z]{{5,}}'))) AS m FROM nrm WHERE deontic = 'must' AND fact IS NOT NULL GROUP BY ALL),
ng AS (SELECT DISTINCT utterance_id FROM w JOIN mw USING (policy_id, own) WHERE {_any("l", cues.RATER_NEGATIONS)} AND list_has_any(ws, m)),
oz AS (SELECT o.policy_id, o.own, coalesce(z.words, []) AS mine FROM (SELECT DISTINCT policy_id, own FROM u) o LEFT JOIN voc z ON z.policy_id = o.policy_id AND z.role_type = o.own),
ex AS (SELECT v.policy_id, o.own, v.role_type, [x FOR x IN v.words IF NOT list_contains(o.mine, x)] AS words FROM voc v JOIN oz o ON o.policy_id = v.policy_id AND o.own <> v.role_type),
cl AS (SELECT utterance_id, arg_min(role_type, struct_pack(k := k, t := role_type)) AS t FROM w JOIN ex USING (policy_id, own) WHERE {_any("l", cues.RATER_PRONOUNS)} AND {_any("l", cues.RATER_VERBS)} AND list_has_any(ws, words) GROUP BY ALL),
cx AS (SELECT utterance_id, EXISTS (SELECT 1 FROM nrm n WHERE n.policy_id = u.policy_id AND n.role_type = own) OR EXISTS (SELECT 1 FROM voc v WHERE v.policy_id = u.policy_id AND v.role_type = own) AS cx FROM u)
SELECT utterance_id, CASE WHEN cx THEN ng.utterance_id IS NOT NULL OR t IS NOT NULL END AS suggested,
  CASE WHEN NOT cx THEN 'no_role_context' WHEN ng.utterance_id IS NOT NULL THEN 'own_duty_negation_in_clause' WHEN t IS NOT NULL THEN 'exclusive_vocab_claim:' || t ELSE 'no_cue_found' END AS reason
FROM cx LEFT JOIN ng USING (utterance_id) LEFT JOIN cl USING (utterance_id)""",
)
def rater_violation(spark, sf_dir):
    return reliability.rate_violation(table(spark, "f_utterances"), graph.norms(edges(spark)), reliability.role_vocabulary(nodes(spark)))


@query(
    "rater_fabrication",
    rf"""WITH {cte('f_utterances')}, {_GRAPH}, bl AS (SELECT policy_id, replace(string_agg(text, ' ' ORDER BY ord), ',', '') AS blob FROM cor GROUP BY ALL),
n AS (SELECT utterance_id, [x FOR x IN regexp_extract_all(coalesce(text, ''), '\d[\d,]*(?:\.\d+)?') IF contains(x, ',') OR contains(x, '.')] AS n, blob FROM f_utterances JOIN bl USING (policy_id)),
m AS (SELECT *, [x FOR x IN n IF NOT contains(blob, replace(x, ',', ''))] AS miss FROM n)
SELECT utterance_id, CASE WHEN len(n) > 0 THEN len(miss) > 0 END AS suggested, array_to_string(miss, '; ') AS tokens FROM m""",
)
def rater_fabrication(spark, sf_dir):
    return reliability.rate_fabrication(table(spark, "f_utterances"), reliability.corpus_blob(graph.grounding_corpus(nodes(spark), edges(spark)), ["policy_id"]), ["policy_id"])


# --- codes -----------------------------------------------------------------------------------------------------------------


def _code(column: str, yes: list[str], no: list[str]) -> str:
    listed = lambda xs: ", ".join(map(_q, xs))
    return f"CASE WHEN upper(trim({column})) IN ({listed(yes)}) THEN true WHEN upper(trim({column})) IN ({listed(no)}) THEN false END"


_CODES = f"{cte('f_codes')}, k AS (SELECT *, {_code('machine', reliability.YES, reliability.NO)} AS m, {_code('gold', reliability.YES, reliability.NO)} AS g, {_code('gold', reliability.YES_GROUNDED, reliability.NO_GROUNDED)} AS gg FROM f_codes)"


def codes(spark):
    rows = table(spark, "f_codes")
    return rows.select("*", reliability.parse_bool(F.col("machine")).alias("m"), reliability.parse_bool(F.col("gold")).alias("g"), reliability.parse_bool(F.col("gold"), reliability.YES_GROUNDED, reliability.NO_GROUNDED).alias("gg"))


@query("rel_parse_bool", f"WITH {_CODES} SELECT row_id, m, g, gg FROM k")
def parse_bool(spark, sf_dir):
    return codes(spark).select("row_id", "m", "g", "gg")


@query(
    "rel_round_consistency",
    f"""WITH {_CODES}, p AS (SELECT scenario, max(CAST(m AS INT)) FILTER (round = 'initial') AS i, max(CAST(m AS INT)) FILTER (round = 'revised') AS r FROM k GROUP BY ALL HAVING count(*) FILTER (round = 'initial') > 0 AND count(*) FILTER (round = 'revised') > 0)
SELECT count(*) AS n_pairs, count(*) FILTER (i IS NOT NULL AND r IS NOT NULL) AS n_both_labeled, count(*) FILTER (i <> r) AS n_mismatch FROM p""",
)
def round_consistency(spark, sf_dir):
    return reliability.round_consistency(codes(spark), "m", ["scenario"])


# --- the parser --------------------------------------------------------------------------------------------------------------

KEYWORDS = ["대학원생", "박사후연구원", "학부생", "석사", "박사", "대학원", "student", "trainee", "apprentice", "apprenticeship", "intern", "grad student", "graduate student", "phd candidate"]
_BOUND = "(?i)(^|[^\\p{L}\\p{N}_])(" + "|".join(sorted(KEYWORDS, key=len, reverse=True)) + ")($|[^\\p{L}\\p{N}_])"
_FLAG = "p.stakeholder_type = 'PolicyRole' AND (" + " OR ".join(f"coalesce(regexp_matches(p.{c}, {_q(_BOUND)}), false)" for c in ("occupation", "education_level", "professional_persona")) + ")"


@query(
    "ir_role_crosswalk",
    f"""WITH {cte('f_people')}, {cte('f_roles')}, j AS (SELECT p.*, kg_role, {_FLAG} AS flag, regexp_extract(p.entity_name, '^(.*) \\| (KG-Gen-.*)$', 1) AS nm, regexp_matches(p.entity_name, '^(.*) \\| (KG-Gen-.*)$') AS formed
  FROM f_people p LEFT JOIN f_roles r ON r.policy_id = p.policy_id AND r.stakeholder_type = p.stakeholder_type)
SELECT scenario_uid, policy_id, entity_name, occupation, flag AS flag_policyrole, CASE WHEN kg_role IS NULL THEN 'unmapped_type' WHEN NOT formed THEN 'bad_entity_name' WHEN stakeholder_type || ':' || nm <> kg_role THEN 'entity_mismatch' END AS error,
  CASE WHEN policy_id = 'A' AND flag THEN 'policyrole_merged' END AS mislabel_source, CASE WHEN policy_id = 'A' AND flag THEN 'Student:Student' ELSE kg_role END AS kg_role,
  CASE WHEN (CASE WHEN policy_id = 'A' AND flag THEN 'Student:Student' ELSE kg_role END) = 'PolicyRole:Principle' THEN 'no_institutional_position_in_kg' ELSE 'applicable' END AS deontic_status FROM j""",
)
def role_crosswalk(spark, sf_dir):
    rows = scenario.resolve_roles(table(spark, "f_people"), table(spark, "f_roles"), KEYWORDS, {"A": "Student:Student"}, ["PolicyRole:Principle"])
    return rows.select("scenario_uid", "policy_id", "entity_name", "occupation", "flag_policyrole", "error", "mislabel_source", "kg_role", "deontic_status")


@query(
    "ir_natural_index",
    rf"""WITH {cte('f_paths')} SELECT path, CAST(regexp_extract(path, '(^|/)scenario_(\d+)\.json$', 2) AS INTEGER) AS local_index, CAST((folder_rank - 1) * 10 + CAST(regexp_extract(path, '(^|/)scenario_(\d+)\.json$', 2) AS INTEGER) AS INTEGER) AS global_index
FROM f_paths WHERE regexp_matches(path, '(^|/)scenario_(\d+)\.json$')""",
)
def natural_index(spark, sf_dir):
    rows = table(spark, "f_paths").withColumn("local_index", scenario.local_index(F.col("path"))).filter("local_index is not null")
    return rows.select("path", "local_index", scenario.global_index(F.col("local_index"), F.col("folder_rank"), F.lit(2)).alias("global_index"))


@query("ir_dup_hash", f"WITH {cte('f_paths')} SELECT md5(content) AS content_md5, count(*) AS n FROM f_paths GROUP BY ALL HAVING count(*) > 1")
def dup_hash(spark, sf_dir):
    return scenario.duplicates(table(spark, "f_paths").withColumn("content_md5", F.md5("content")))


@query("ir_dup_documents", "SELECT md5(text) AS content_md5, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
def dup_documents(spark, sf_dir):
    return scenario.duplicates(read(spark, sf_dir, "documents").select(F.md5("text").alias("content_md5")))


@query(
    "ir_set_summary",
    "SELECT lang AS policy_id, source AS model_id, count(*) AS n_utterances, count(DISTINCT n_chars) AS n_scenarios, count(*) FILTER (doc_id % 5 = 0) AS n_flagged, count(DISTINCT n_chars) FILTER (doc_id % 5 = 0) AS n_flagged_scenarios FROM documents GROUP BY ALL",
)
def set_summary(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.col("lang").alias("policy_id"), F.col("source").alias("model_id"), F.col("n_chars").alias("scenario_uid"), (F.col("doc_id") % 5 == 0).alias("flag_policyrole"))
    return scenario.set_summary(rows, ["policy_id", "model_id"])


def _post(name: str, text: str, **values) -> dict:
    return {"persona_name": name, "stakeholder_type": "Student", "narrative": text, "evidence": ["e1"], "judgment": {"ok": True}, "prediction_values": values or None}


DOCUMENT = {
    "scenario_id": "x",
    "participants": [],
    "forward_pass": [
        {
            "phase": "Inputs", "direction": "forward", "posting_order": ["bo", "al"], "phase_summary": "s",
            "initial_posts": [_post("al", "first", rate=1), _post("bo", "second", rate=2.5)], "revised_posts": [_post("al", "third")], "refined_posts": None,
        }
    ],
    "backward_pass": [{"phase": "Inputs", "direction": "backward", "posting_order": ["al"], "initial_posts": [_post("al", "fourth")]}],
    "cross_checks": [],
}


def parsed(spark):
    doc = F.from_json(F.col("json"), scenario.SCHEMA)
    rows = spark.createDataFrame([(json.dumps(DOCUMENT),)], "json string").select(doc.alias("doc"))
    return rows.select(F.lit("A_m_01").alias("scenario_uid"), F.lit("A").alias("policy_id"), F.lit("m").alias("model_id"), F.lit(1).alias("global_index"), "doc")


@query(
    "ir_flatten",
    """SELECT * FROM (VALUES ('A_m_01_forward_pass_Inputs_initial_t01', 'forward_pass', 'forward', 'initial', CAST(1 AS INTEGER), 'al', 'first', '{"rate":1}'), ('A_m_01_forward_pass_Inputs_initial_t00', 'forward_pass', 'forward', 'initial', 0, 'bo', 'second', '{"rate":2.5}'),
  ('A_m_01_forward_pass_Inputs_revised_t01', 'forward_pass', 'forward', 'revised', 1, 'al', 'third', NULL), ('A_m_01_backward_pass_Inputs_initial_t00', 'backward_pass', 'backward', 'initial', 0, 'al', 'fourth', NULL))
AS t(utterance_id, pass_name, direction, round, turn_index, persona_name, text, prediction_values)""",
)
def flatten(spark, sf_dir):
    return scenario.flatten(parsed(spark)).select("utterance_id", "pass_name", "direction", "round", "turn_index", "persona_name", "text", "prediction_values")


@query("ir_structure_checks", "SELECT * FROM (VALUES ('A_m_01', 'participants'), ('A_m_01', 'phase_order'), ('A_m_01', 'post_count')) AS t(scenario_uid, problem)")
def structure_checks(spark, sf_dir):
    return scenario.violations_of_structure(parsed(spark))


@query("ir_set_checks", "SELECT * FROM (VALUES ('A', 'm', 'scenario_count', false), ('A', 'm', 'unique_uids', true), ('A', 'm', 'contiguous_index', true)) AS t(policy_id, model_id, check_name, ok)")
def set_checks(spark, sf_dir):
    return scenario.set_checks(parsed(spark))


# --- pools -------------------------------------------------------------------------------------------------------------------

_NOTE = "'fabricated=' || CAST(fabricated AS VARCHAR) || '; derived_estimate=' || CAST(derived_estimate AS VARCHAR) || '; unsupported=' || unsupported_tokens || '; derived_tokens=' || derived_estimate_tokens"


def existing(spark):
    return spark.createDataFrame([("violation_diff_existing", "violation", "u03", "kept")], "pool_component string, axis string, utterance_id string, machine_note string")


@query(
    "pool_boundary_exclusive",
    f"""WITH {_LABELS}, s AS (SELECT utterance_id, applicable, violation, reason, deontic_status, text, CASE WHEN scope THEN fabricated END AS fabricated, CASE WHEN scope THEN derived_estimate END AS derived_estimate, unsupported_tokens, derived_estimate_tokens FROM lab),
p0 AS (SELECT 'violation_diff_existing' AS pool_component, 'violation' AS axis, 'u03' AS utterance_id, 'kept' AS machine_note),
p1 AS (SELECT 'cross_role_authority_claim_extra', 'violation', utterance_id, 'violation=' || coalesce(CAST(violation AS VARCHAR), 'None') || '; reason=' || coalesce(reason, 'None') FROM s
  WHERE deontic_status = 'applicable' AND regexp_matches(coalesce(text, ''), {_q("(?i)" + cues.AUTHORITY)}) AND utterance_id NOT IN (SELECT utterance_id FROM p0) ORDER BY md5('5:' || utterance_id) LIMIT 2),
p2 AS (SELECT 'fabrication_derived_estimate_all', 'fabrication', utterance_id, {_NOTE} FROM s WHERE derived_estimate AND utterance_id NOT IN (SELECT utterance_id FROM p0) AND utterance_id NOT IN (SELECT utterance_id FROM p1)),
f AS (SELECT *, EXISTS (SELECT 1 FROM (SELECT trim(unnest(string_split(unsupported_tokens, ';'))) AS t) WHERE t <> '' AND strpos(text, coalesce(nullif(regexp_extract(t, '^[\\d,.]+', 0), ''), t)) > 0 AND regexp_matches(
    substring(text, greatest(1, strpos(text, coalesce(nullif(regexp_extract(t, '^[\\d,.]+', 0), ''), t)) - 60), length(coalesce(nullif(regexp_extract(t, '^[\\d,.]+', 0), ''), t)) + 60 + strpos(text, coalesce(nullif(regexp_extract(t, '^[\\d,.]+', 0), ''), t)) - greatest(1, strpos(text, coalesce(nullif(regexp_extract(t, '^[\\d,.]+', 0), ''), t)) - 60)), {_q("(?i)" + cues.ARITHMETIC_NEAR)})) AS onehop
  FROM s WHERE fabricated AND utterance_id NOT IN (SELECT utterance_id FROM p0) AND utterance_id NOT IN (SELECT utterance_id FROM p1) AND utterance_id NOT IN (SELECT utterance_id FROM p2)),
p3 AS (SELECT 'fabrication_residual', 'fabrication', utterance_id, {_NOTE} FROM f WHERE NOT onehop ORDER BY md5('5:' || utterance_id) LIMIT 40),
p4 AS (SELECT 'fabrication_1hop_suspect', 'fabrication', utterance_id, {_NOTE} FROM f WHERE onehop ORDER BY md5('5:' || utterance_id) LIMIT 20)
SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4""",
)
def boundary_pool(spark, sf_dir):
    return pools.boundary_pool(labels(spark), [existing(spark)], 5, n_authority=2)


@query(
    "pool_violation_gold",
    f"""WITH {_LABELS}, fm AS (SELECT policy_id, role_type, string_agg('[' || deontic || '] ' || coalesce(fact, ''), ' | ' ORDER BY ord) AS applicable_norms FROM nrm GROUP BY ALL)
SELECT utterance_id, lab.policy_id, violation, coalesce(applicable_norms, {_q(cues.NO_NORMS_TEXT)}) AS applicable_norms FROM lab LEFT JOIN fm ON fm.policy_id = lab.policy_id AND fm.role_type = split_part(kg_role, ':', 1)
WHERE utterance_id IN ('u01', 'u03', 'u04', 'u06', 'u07', 'u10') AND applicable AND deontic_status = 'applicable'""",
)
def violation_gold(spark, sf_dir):
    picked = spark.createDataFrame([(u,) for u in ("u01", "u03", "u04", "u06", "u07", "u10", "u01")], "utterance_id string")
    out = pools.violation_pool([existing(spark), picked], labels(spark), graph.formatted_norms(graph.norms(edges(spark))))
    return out.select("utterance_id", "policy_id", "violation", "applicable_norms")


@query(
    "pool_grounding_boundary",
    f"""WITH {_LABELS}, n AS (SELECT utterance_id, policy_id, sim, row_number() OVER (PARTITION BY policy_id ORDER BY md5('6:' || utterance_id), utterance_id) AS r FROM lab WHERE abs(sim - tau) <= 0.16)
SELECT utterance_id, policy_id, sim AS sem_max_cosine FROM n WHERE r <= 3""",
)
def grounding_boundary(spark, sf_dir):
    taus = spark.createDataFrame([("A", 0.35), ("B", 0.25)], "policy_id string, tau double")
    return pools.grounding_boundary(labels(spark), taus, 6, band=0.16, per_policy=3).select("utterance_id", "policy_id", "sem_max_cosine")


@query(
    "pool_fabrication_split",
    f"""WITH {_LABELS}, b AS (SELECT utterance_id, CASE WHEN regexp_matches(coalesce(text, ''), {_q("(?i)" + cues.ARITHMETIC)}) THEN 'a_arithmetic_cue_nearby' ELSE 'b_no_visible_basis' END AS bucket FROM lab WHERE scope AND fabricated),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5('8:' || utterance_id), utterance_id) AS r FROM b) SELECT utterance_id, bucket FROM r WHERE r <= 15""",
)
def fabrication_split(spark, sf_dir):
    return pools.fabrication_split(labels(spark), 8).select("utterance_id", "bucket")


@query(
    "pool_traceability",
    f"WITH {_LABELS} SELECT utterance_id, text FROM lab WHERE scope AND sim > tau ORDER BY md5('9:' || utterance_id), utterance_id LIMIT 4",
)
def traceability(spark, sf_dir):
    u = table(spark, "f_utterances")
    return pools.traceability(labels(spark).drop("text"), u, 9, 4).select("utterance_id", "text")
