"""Small inline tables for rules that generated data never triggers, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES: dict[str, tuple[str, list[tuple]]] = {
    "f_utterances": (
        "utterance_id string, policy_id string, model_id string, phase string, kg_role string, deontic_status string, text string",
        [
            ("u01", "A", "m1", "Inputs", "Student:One", "applicable", "I did not submit the evaluation report this year."),
            ("u02", "A", "m1", "Inputs", "Student:One", "applicable", "We never argue here. " + "x " * 60 + "The evaluation report was submitted."),
            ("u03", "A", "m1", "Activities", "Student:One", "applicable", "I will allocate research funding to every group of students."),
            ("u04", "A", "m1", "Activities", "Board:Main", "applicable", "I will allocate research funding to every group of students."),
            ("u05", "A", "m2", "Outputs", "Board:Main", "applicable", "Nobody failed to attend, so evaluation went well."),
            ("u06", "A", "m2", "Inputs", "Guest:Two", "applicable", "I never report anything on evaluation."),
            ("u07", "A", "m2", "Inputs", "Student:One", "no_institutional_position_in_kg", "I did not submit the evaluation report."),
            ("u08", "A", "m2", "Activities", "Board:Main", "applicable", "The budget is S$500 million, of which 45 % went to 1,200 people in 2023."),
            ("u09", "B", "m1", "Inputs", "Board:Main", "applicable", "We approved S$1.2B and 300 usd; 5k paid, 5km away, 7 left, 3억 more."),
            ("u10", "B", "m1", "Activities", "Board:Main", "applicable", "Costs of usd 200 plus usd 300 make usd 500, or 12.5%."),
            ("u11", "B", "m1", "Impact", "Student:One", "applicable", "SGD 99 thousand in 1999 and USD 0; 50% of 2,000,000 원."),
            ("u12", "B", "m2", "Inputs", "Student:One", "applicable", ""),
            ("u13", "B", "m2", "Inputs", "Student:One", "applicable", "we decide nothing; I never skip the training course"),
            ("u14", "B", "m2", "Activities", "Clerk:Nine", "applicable", "Our team will recommend patents for everyone. All fine!"),
            ("u15", "A", "m1", "Inputs", "Student:One", "applicable", "Every student must submit the evaluation report every year, they say."),
        ],
    ),
    "f_nodes": (
        "policy_id string, ord int, id string, type string, summary string, decision_authority string, span string",
        [
            ("A", 0, "Student:Student", "Student", "Students who attend courses and submit reports", None, "Students attend courses."),
            ("A", 1, "Board:Board", "Board", "The board allocates research funding", "allocate research funding", None),
            ("A", 2, "Office:Office", "Office", "The board allocates research funding", "issue", "Same words as elsewhere."),
            ("B", 0, "Board:Board", "Board", "Boards oversee USD 200 and SGD 300 thousand budgets", "approve patents quickly", "The grant was USD 300 in 1998."),
            ("B", 1, "Student:Student", "Student", None, None, ""),
            ("B", 2, "Clerk:Clerk", "Clerk", "Clerks file documents", None, "A rate of 12.4% was 2,000,100 원 once."),
        ],
    ),
    "f_edges": (
        "policy_id string, ord int, id string, type string, source string, target string, deontic string, fact string, source_text string",
        [
            ("A", 0, "e0", "DUTY", "Student:Student", "Board:Board", "must", "Every student must submit the evaluation report every year", "Same words as elsewhere."),
            ("A", 1, "e1", "MAY", "Board:Board", "Student:Student", "can", "The board can attend", None),
            ("A", 2, "e2", "PART", "Office:Office", "Board:Board", None, "The office is part of S$500 million works in 2023", ""),
            ("A", 3, "e3", "DUTY", "Board:Board", "Board:Board", "must", "Evaluation", "The board allocates research funding"),
            ("B", 0, "e0", "DUTY", "Student:Student", "Board:Board", "must", "Students must finish the training course", "Students finish."),
            ("B", 1, "e1", "BAN", "Clerk:Clerk", "Board:Board", "cannot", "Clerks cannot sign", "Clerks file documents"),
        ],
    ),
    "f_people": (
        "scenario_uid string, policy_id string, stakeholder_type string, entity_name string, occupation string, education_level string, professional_persona string",
        [
            ("s1", "A", "PolicyRole", "Groups | x | KG-Gen-1", "internal auditor", "school", "helps students with work"),
            ("s1", "A", "PolicyRole", "Groups | x | KG-Gen-1", None, "PhD candidate", None),
            ("s2", "A", "PolicyRole", "Groups | x | KG-Gen-1", "I am a student", None, ""),
            ("s2", "B", "PolicyRole", "Principle | KG-Gen-2", "Apprenticeship lead", None, None),
            ("s2", "B", "PolicyRole", "Principle | KG-Gen-2", "서울 대학원생 대표", None, None),
            ("s3", "B", "PolicyRole", "Principle | KG-Gen-2", "대학원생입니다", None, None),
            ("s3", "A", "Student", "Student | KG-Gen-3", "student", "x", "y"),
            ("s3", "A", "Student", "Student KG-Gen-3", "student", "x", "y"),
            ("s4", "A", "Student", "Learner | KG-Gen-3", "nurse", "x", "y"),
            ("s4", "A", "Stranger", "Stranger | KG-Gen-9", "nurse", "x", "y"),
        ],
    ),
    "f_roles": (
        "policy_id string, stakeholder_type string, kg_role string",
        [("A", "PolicyRole", "PolicyRole:Groups | x"), ("A", "Student", "Student:Student"), ("B", "PolicyRole", "PolicyRole:Principle")],
    ),
    "f_predictions": (
        "scenario_uid string, phase string, persona string, kg_role string, round string, turn_index int, prediction_values string",
        [
            ("s1", "Outcomes", "p1", "A:1", "initial", 0, '{"rate":10,"cost":1.5,"flag":true,"text":"7","none":null}'),
            ("s1", "Outcomes", "p2", "A:2", "initial", 1, '{"rate":20,"cost":2.5e1,"flag":false,"none":4}'),
            ("s1", "Outcomes", "p3", "B:1", "initial", 2, '{"rate":60,"cost":3,"flag":true,"none":5}'),
            ("s1", "Outcomes", "p1", "A:1", "revised", 0, '{"rate":40,"cost":1.5,"flag":true,"text":"7","none":3}'),
            ("s1", "Outcomes", "p2", "A:2", "revised", 1, '{"rate":35,"cost":9,"flag":true,"none":3}'),
            ("s1", "Outcomes", "p3", "B:1", "revised", 2, '{"rate":15,"cost":3.25,"flag":true,"none":3}'),
            ("s1", "Outcomes", "p3", "B:1", "revised", 4, '{"rate":16}'),
            ("s2", "Impact", "p1", "A:1", "initial", 0, '{"rate":1}'),
            ("s2", "Impact", "p2", "A:2", "initial", 1, '{"rate":2}'),
            ("s2", "Impact", "p1", "A:1", "revised", 0, '{"rate":2,"extra":1}'),
            ("s2", "Impact", "p2", "A:2", "revised", 1, '{"rate":3}'),
        ],
    ),
    "f_paths": (
        "path string, folder_rank int, content string",
        [
            ("/d1/scenario_2.json", 1, "aa"),
            ("/d1/scenario_10.json", 1, "ab"),
            ("/d2/scenario_1.json", 2, "aa"),
            ("/d2/other_3.json", 2, "aa"),
            ("/d2/scenario_7.json.bak", 2, "ac"),
        ],
    ),
    "f_codes": (
        "row_id int, scenario string, round string, machine string, gold string",
        [
            (1, "a", "initial", "True", " yes "), (2, "a", "revised", "1", "NO"), (3, "b", "initial", "false", "0"), (4, "b", "revised", "N", ""),
            (5, "c", "initial", "Y", "y"), (6, "c", "revised", "no", "true"), (7, "d", "initial", "n", "FALSE"), (8, "e", "revised", "0", "maybe"),
            (9, "f", "initial", "TRUE", "o"), (10, "f", "revised", "no", "not_grounded"),
        ],
    ),
}


def table(spark: SparkSession, name: str) -> DataFrame:
    """The fixture, or what a session of `bound.Bound` puts in its place."""
    if (bound := getattr(spark, "fixture", lambda n: None)(name)) is not None:
        return bound
    schema, rows = TABLES[name]
    return spark.createDataFrame(rows, schema)


def _literal(v) -> str:
    if v is None:
        return "NULL"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def cte(name: str) -> str:
    """`name AS (...)` for a WITH clause."""
    schema, rows = TABLES[name]
    columns = [c.split(" ") for c in schema.split(", ")]
    kinds = {"string": "VARCHAR", "int": "INTEGER"}
    values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    cast = ", ".join(f"CAST({n} AS {kinds[k]}) AS {n}" for n, k in columns)
    return f"{name} AS (SELECT {cast} FROM (VALUES {values}) AS t({', '.join(n for n, _ in columns)}))"
