"""The rule-based queries once more, at the volume of the driver's tables in place of the inline fixtures.

Each bound table is one SELECT that Spark and DuckDB both read, so a query `<name>_tables` differs from `<name>` in its
input only: documents are utterances (the sentences of the fixture follow their texts, so that rules have something to
find), parts are nodes and edges of policy graphs of fifty each, labels are codes, customers people, lines predictions.
Graphs beside utterances stay inline: a policy has tens of norms, whatever the number of utterances.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chorale.plans import fixtures, numeric, rules  # noqa: F401 (their queries have to be registered first)
from chorale.plans.registry import ORACLES, QUERIES, query, read

_SENTENCES = [row[-1] for row in fixtures.TABLES["f_utterances"][1]]
_SENTENCE = "CASE doc_id % {} {} END".format(len(_SENTENCES), " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_SENTENCES)))

_PREDICTION = """SELECT CAST(l_orderkey AS STRING) AS scenario_uid, 'Outcomes' AS phase, CAST(l_linenumber AS STRING) AS persona, concat(l_returnflag, ':', l_linestatus) AS kg_role,
  '{round}' AS round, CAST(l_linenumber AS INT) AS turn_index,
  concat(chr(123), '"rate":', CAST(CAST(floor({rate}) AS INT) AS STRING), CASE WHEN l_partkey % 9 = 0 THEN ',"none":null' ELSE ',"none":4' END,
    CASE WHEN l_suppkey % 2 = 0 THEN ',"flag":true' ELSE ',"flag":false' END, CASE WHEN l_partkey % 5 = 0 THEN ',"text":"7"' ELSE '' END, chr(125)) AS prediction_values
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS copy FROM lineitem) l WHERE copy = 1"""

#: Fixture: the table it is bound to, and the SELECT.
BOUND = {
    "f_utterances": (
        "documents",
        f"""SELECT concat(CASE WHEN doc_id < 10 THEN 'u0' ELSE 'u' END, CAST(doc_id AS STRING)) AS utterance_id, CASE doc_id % 2 WHEN 0 THEN 'A' ELSE 'B' END AS policy_id,
  CASE WHEN doc_id % 17 < 9 THEN 'm1' ELSE 'm2' END AS model_id, CASE WHEN doc_id % 11 < 5 THEN 'Inputs' WHEN doc_id % 11 < 9 THEN 'Activities' ELSE 'Outputs' END AS phase,
  CASE WHEN doc_id % 7 < 3 THEN 'Student:One' WHEN doc_id % 7 < 6 THEN 'Board:Main' ELSE 'Clerk:Nine' END AS kg_role,
  CASE doc_id % 13 WHEN 0 THEN 'no_institutional_position_in_kg' ELSE 'applicable' END AS deontic_status, concat(coalesce(text, ''), ' ', {_SENTENCE}) AS text FROM documents""",
    ),
    "f_nodes": (
        "part",
        """SELECT concat('G', CAST(CAST(floor(p_partkey / 50) AS INT) AS STRING)) AS policy_id, CAST(p_partkey % 50 AS INT) AS ord, concat(p_type, ':', CAST(p_partkey AS STRING)) AS id, p_type AS type,
  concat('Parts such as ', p_name, ' of ', p_brand) AS summary, CASE WHEN p_partkey % 3 = 0 THEN concat('allocate every ', p_name) END AS decision_authority,
  CASE WHEN p_partkey % 4 = 0 THEN p_name WHEN p_partkey % 4 = 1 THEN '' END AS span FROM part""",
    ),
    "f_edges": (
        "part",
        """SELECT concat('G', CAST(CAST(floor(p_partkey / 50) AS INT) AS STRING)) AS policy_id, CAST(p_partkey % 50 AS INT) AS ord, concat('e', CAST(p_partkey AS STRING)) AS id, 'DUTY' AS type,
  concat(p_type, ':', p_brand) AS source, concat(p_brand, ':', p_type) AS target, CASE p_partkey % 5 WHEN 0 THEN 'must' WHEN 1 THEN 'can' WHEN 2 THEN 'cannot' END AS deontic,
  concat('Every ', p_name, ' must cost USD ', CAST(CAST(floor(p_retailprice) AS INT) AS STRING), ' or ', CAST(p_size AS STRING), '% less') AS fact, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS source_text FROM part""",
    ),
    "f_people": (
        "customer",
        """SELECT concat('s', CAST(c_nationkey AS STRING)) AS scenario_uid, CASE c_custkey % 2 WHEN 0 THEN 'A' ELSE 'B' END AS policy_id,
  CASE c_custkey % 3 WHEN 0 THEN 'PolicyRole' WHEN 1 THEN 'Student' ELSE 'Stranger' END AS stakeholder_type,
  concat(CASE c_custkey % 5 WHEN 0 THEN 'Groups | x' WHEN 1 THEN 'Principle' ELSE 'Student' END, CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE ' | ' END, 'KG-Gen-', CAST(c_custkey AS STRING)) AS entity_name,
  CASE c_custkey % 11 WHEN 0 THEN 'PhD candidate' WHEN 1 THEN 'internal auditor' WHEN 2 THEN CAST(NULL AS STRING) ELSE c_mktsegment END AS occupation,
  CASE WHEN c_custkey % 13 = 0 THEN 'trainee' ELSE c_name END AS education_level, c_name AS professional_persona FROM customer""",
    ),
    "f_predictions": (
        "lineitem",
        _PREDICTION.format(round="initial", rate="l_quantity") + " UNION ALL " + _PREDICTION.format(round="revised", rate="l_quantity * (1 - l_discount)"),
    ),
    "f_paths": (
        "documents",
        """SELECT concat('/d', CAST(doc_id % 3 + 1 AS STRING), CASE doc_id % 5 WHEN 0 THEN '/other_' ELSE '/scenario_' END, CAST(doc_id AS STRING), '.json') AS path,
  CAST(doc_id % 3 + 1 AS INT) AS folder_rank, text AS content FROM documents""",
    ),
    "f_codes": (
        "labels",
        """SELECT CAST(doc_id AS INT) AS row_id, CAST(CAST(floor(doc_id / 2) AS BIGINT) AS STRING) AS scenario, CASE doc_id % 2 WHEN 0 THEN 'initial' ELSE 'revised' END AS round,
  CASE quality WHEN 1 THEN 'True' ELSE ' no' END AS machine, CASE WHEN toxic = 1 THEN ' yes ' WHEN doc_id % 7 = 0 THEN 'not_grounded' WHEN doc_id % 7 = 1 THEN '' ELSE 'FALSE' END AS gold FROM labels""",
    ),
}

#: Which queries are bound, by the fixtures that are replaced.
TWINS = {
    ("f_utterances",): (
        "micro_violation micro_violation_diff micro_numeric_candidates micro_fabrication micro_utterance_labels micro_set_rollup div_plausible_gate rater_violation rater_fabrication "
        "pool_boundary_exclusive pool_violation_gold pool_grounding_boundary pool_fabrication_split pool_traceability"
    ),
    ("f_nodes", "f_edges"): "kg_corpus kg_norm_units kg_norms_by_role kg_authority_phrases kg_role_vocab kg_corpus_ngrams kg_corpus_blob kg_numeric_index",
    ("f_people",): "ir_role_crosswalk",
    ("f_predictions",): "ir_prediction_values meso_strict_cells div_lenient_cells",
    ("f_paths",): "ir_natural_index ir_dup_hash",
    ("f_codes",): "rel_parse_bool rel_round_consistency",
}


class Bound:
    """A session in which some fixtures are bound to the tables of a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, names: tuple[str, ...]):
        self.spark, self.sf_dir, self.names = spark, sf_dir, names

    def __getattr__(self, name: str):
        return getattr(self.spark, name)

    def fixture(self, name: str) -> DataFrame | None:
        if name not in self.names:
            return None
        source, select = BOUND[name]
        read(self.spark, self.sf_dir, source).createOrReplaceTempView(f"bound_{source}")
        return self.spark.sql(select.replace(f"FROM {source}", f"FROM bound_{source}"))


def _twin(name: str, names: tuple[str, ...]) -> None:
    sql = ORACLES[name]
    for n in names:
        sql = sql.replace(fixtures.cte(n), f"{n} AS ({BOUND[n][1]})")
    own = QUERIES[name]
    query(f"{name}_tables", sql)(lambda spark, sf_dir: own(Bound(spark, sf_dir, names), sf_dir))


for _names, _queries in TWINS.items():
    for _query in _queries.split():
        _twin(_query, _names)
