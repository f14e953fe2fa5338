"""Scenario documents: nested JSON files to the tables `scenarios` and `utterances`.

Parsing is lossless: raw fields stay as they came, derived ones are added. Open-keyed objects (prediction_values,
judgment, scenario_impact) stay JSON text, read later as VARIANT.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.functions import cues

_POST = "struct<persona_name:string,stakeholder_type:string,narrative:string,evidence:array<string>,judgment:variant,prediction_values:variant>"
_PHASE = (
    "struct<phase:string,direction:string,posting_order:array<string>,phase_summary:string,"
    f"initial_posts:array<{_POST}>,revised_posts:array<{_POST}>,refined_posts:array<{_POST}>>"
)
PASSES = ["forward_pass", "backward_pass", "fwd_bwd_fwd_pass", "fwd_bwd_fwd_bwd_pass"]
ROUNDS = ["initial_posts", "revised_posts", "refined_posts"]
PARTICIPANT = "struct<name:string,stakeholder_type:string,entity_name:string,occupation:string,education_level:string,professional_persona:string>"
CHECK = "struct<phase:string,variable:string,aggregated_value:double>"
SCHEMA = (
    f"scenario_id string, participants array<{PARTICIPANT}>, "
    + ", ".join(f"{p} array<{_PHASE}>" for p in PASSES)
    + f", cross_checks array<{CHECK}>, scenario_impact variant, scenario_confidence variant"
)
FILE = r"scenario_(\d+)\.json$"


def local_index(path: Column) -> Column:
    """The number in scenario_<n>.json, as a number, so that 10 comes after 2; null for other names."""
    return F.regexp_extract(path, "(?:^|/)" + FILE, 1).try_cast("int")


def global_index(local: Column, folder_rank: Column, folders: Column, per_folder: int = 10) -> Column:
    """The local index, or with several folders of per_folder files each the index through all of them."""
    return F.when(folders > 1, (folder_rank - 1) * per_folder + local).otherwise(local)


def files_of(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(path, folder_rank, local_index, global_index, content_md5) of the scenario files in the folders, in their order."""
    parts = []
    for rank, folder in enumerate(folders, 1):
        raw = spark.read.format("binaryFile").option("pathGlobFilter", "scenario_*.json").load(folder)
        parts.append(raw.select("path", F.lit(rank).alias("folder_rank"), F.md5("content").alias("content_md5")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.filter(~F.contains("path", F.lit("__MACOSX"))).withColumn("local_index", local_index(F.col("path"))).filter("local_index is not null")
    return rows.withColumn("global_index", global_index(F.col("local_index"), F.col("folder_rank"), F.lit(len(folders))))


def duplicates(files: DataFrame, digest: str = "content_md5") -> DataFrame:
    """(digest, n) of contents that more than one file has."""
    return files.groupBy(digest).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def read_scenarios(spark: SparkSession, folders: list[str], policy_id: str, model_id: str) -> DataFrame:
    """One row a file with the raw document in `doc`, its path, indexes and scenario_uid."""
    parts = []
    for rank, folder in enumerate(folders, 1):
        raw = spark.read.schema(SCHEMA).option("multiLine", True).option("pathGlobFilter", "scenario_*.json").json(folder)
        parts.append(raw.select(F.struct(*raw.columns).alias("doc"), F.col("_metadata.file_path").alias("src_path"), F.lit(rank).alias("folder_rank")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.filter(~F.contains("src_path", F.lit("__MACOSX"))).withColumn("local_index", local_index(F.col("src_path"))).filter("local_index is not null")
    rows = rows.withColumn("global_index", global_index(F.col("local_index"), F.col("folder_rank"), F.lit(len(folders))))
    return rows.select(
        F.format_string("%s_%s_%02d", F.lit(policy_id), F.lit(model_id), "global_index").alias("scenario_uid"),
        F.lit(policy_id).alias("policy_id"),
        F.lit(model_id).alias("model_id"),
        "global_index",
        "src_path",
        "doc",
    )


def flatten(scenarios: DataFrame) -> DataFrame:
    """One row a post: pass, phase and round flattened, missing ones skipped; turn_index is the persona's first place.

    The id holds the pass too, so that posts of a backward pass don't collide with those of the forward pass.
    """
    keys = ["scenario_uid", "policy_id", "model_id"]
    passes = F.array(*(F.struct(F.lit(p).alias("pass_name"), F.col(f"doc.{p}").alias("phases")) for p in PASSES))
    rows = scenarios.select(*keys, F.explode(passes).alias("p")).select(*keys, "p.pass_name", F.explode("p.phases").alias("ph"))
    rounds = F.array(*(F.struct(F.lit(r.removesuffix("_posts")).alias("round"), F.col(f"ph.{r}").alias("posts")) for r in ROUNDS))
    rows = rows.select(*keys, "pass_name", "ph", F.explode(rounds).alias("r")).select(*keys, "pass_name", "ph", "r.round", F.explode("r.posts").alias("post"))
    turn = (F.array_position("ph.posting_order", F.col("post.persona_name")) - 1).cast("int")
    rows = rows.withColumn("turn_index", turn)
    uid = F.concat_ws("_", "scenario_uid", "pass_name", F.col("ph.phase"), "round", F.format_string("t%02d", "turn_index"))
    return rows.select(
        uid.alias("utterance_id"),
        *keys,
        "pass_name",
        F.col("ph.direction").alias("direction"),
        F.col("ph.phase").alias("phase"),
        "round",
        "turn_index",
        F.col("post.persona_name").alias("persona_name"),
        F.col("post.stakeholder_type").alias("post_type"),
        F.coalesce("post.narrative", F.lit("")).alias("text"),
        F.coalesce("post.evidence", F.expr("cast(array() as array<string>)")).alias("evidence"),
        F.nullif(F.to_json("post.judgment"), F.lit("null")).alias("judgment"),
        F.nullif(F.to_json("post.prediction_values"), F.lit("null")).alias("prediction_values"),
    )


def participants(scenarios: DataFrame) -> DataFrame:
    return scenarios.select("scenario_uid", "policy_id", "model_id", F.explode("doc.participants").alias("p")).select("scenario_uid", "policy_id", "model_id", "p.*")


def keyword_flag(people: DataFrame, keywords: list[str]) -> Column:
    """Whether a PolicyRole's own description names a student or trainee: whole words, any case, longest first."""
    ordered = sorted(keywords, key=len, reverse=True)
    pattern = r"(?iU)\b(?:" + "|".join(k.replace(".", r"\.") for k in ordered) + r")\b"
    hit = F.lit(False)
    for field in ("occupation", "education_level", "professional_persona"):
        hit = hit | F.coalesce(people[field].rlike(pattern), F.lit(False))
    return (people["stakeholder_type"] == "PolicyRole") & hit


def resolve_roles(people: DataFrame, role_map: DataFrame, keywords: list[str], merge: dict[str, str], no_position: list[str]) -> DataFrame:
    """kg_role, flag_policyrole, mislabel_source, deontic_status and error of each participant.

    role_map (policy_id, stakeholder_type, kg_role) is a small dimension and broadcast. A type without an entry, an
    entity_name without " | KG-Gen-", or one whose name doesn't fit the mapping is an error (named, not raised). In a
    policy of `merge` a flagged PolicyRole takes the role of the type given there.
    """
    rows = people.join(F.broadcast(role_map), ["policy_id", "stakeholder_type"], "left").withColumn("flag_policyrole", keyword_flag(people, keywords))
    name = F.regexp_extract("entity_name", r"(?s)^(.*) \| (KG-Gen-.*)$", 1)
    formed = F.coalesce(F.col("entity_name").rlike(r"(?s)^(.*) \| (KG-Gen-.*)$"), F.lit(False))
    error = (
        F.when(F.col("kg_role").isNull(), "unmapped_type")
        .when(~formed, "bad_entity_name")
        .when(F.concat("stakeholder_type", F.lit(":"), name) != F.col("kg_role"), "entity_mismatch")
    )
    merged, target = F.lit(False), F.col("kg_role")
    for policy, to in merge.items():
        here = (F.col("policy_id") == policy) & F.col("flag_policyrole")
        merged, target = merged | here, F.when(here, F.lit(to)).otherwise(target)
    rows = rows.withColumn("error", error).withColumn("mislabel_source", F.when(merged, "policyrole_merged")).withColumn("kg_role", target)
    status = F.when(F.col("kg_role").isin(no_position), "no_institutional_position_in_kg").otherwise("applicable")
    return rows.withColumn("deontic_status", status)


def violations_of_structure(scenarios: DataFrame) -> DataFrame:
    """(scenario_uid, problem) of every broken invariant; none for a sound table."""
    base = scenarios.select("scenario_uid", "doc")
    phases = F.transform("doc.forward_pass", lambda p: p["phase"])
    wrong = F.array_compact(
        F.array(
            F.when(F.coalesce(F.size("doc.participants"), F.lit(0)) != 5, "participants"),
            F.when(F.col("doc.forward_pass").isNull(), "no_forward_pass"),
            F.when(F.col("doc.forward_pass").isNotNull() & (phases != F.array(*(F.lit(p) for p in cues.PHASES))), "phase_order"),
            F.when(F.exists("doc.forward_pass", lambda p: (F.size(p["initial_posts"]) != 5) | (F.size(p["revised_posts"]) != 5)), "post_count"),
            F.when(
                F.exists(
                    "doc.forward_pass",
                    lambda p: F.array_sort(F.array_distinct(F.transform(p["initial_posts"], lambda q: q["persona_name"]))) != F.array_sort(F.array_distinct(p["posting_order"])),
                ),
                "persona_set",
            ),
        )
    )
    return base.select("scenario_uid", F.explode(wrong).alias("problem"))


def set_checks(scenarios: DataFrame, per_set: int = 50) -> DataFrame:
    """(policy_id, model_id, check_name, ok): cardinality, contiguous indexes and unique ids of each set."""
    per = scenarios.groupBy("policy_id", "model_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("scenario_uid").alias("u"), F.min("global_index").alias("lo"), F.max("global_index").alias("hi"), F.count_distinct("global_index").alias("d")
    )
    checks = F.array(
        F.struct(F.lit("scenario_count").alias("check_name"), (F.col("n") == per_set).alias("ok")),
        F.struct(F.lit("unique_uids").alias("check_name"), (F.col("u") == F.col("n")).alias("ok")),
        F.struct(F.lit("contiguous_index").alias("check_name"), ((F.col("lo") == 1) & (F.col("hi") == F.col("n")) & (F.col("d") == F.col("n"))).alias("ok")),
    )
    return per.select("policy_id", "model_id", F.explode(checks).alias("c")).select("policy_id", "model_id", "c.*")


def acceptance(scenarios: DataFrame, problems: DataFrame, per_set: int = 50, per_folder: int = 10) -> DataFrame:
    """(policy_id, model_id, check_name, ok): the acceptance list, a named row a check and set, then those over all sets (ids null).

    problems: `violations_of_structure` and the like. Contents are equal if their files' md5 are.
    """
    sets = ["policy_id", "model_id"]
    named = {"participants": "five_participants", "phase_order": "phases_in_order", "post_count": "five_posts_a_round", "persona_set": "posting_order_fits_posts"}
    broken = scenarios.select(*sets, "scenario_uid").join(problems, "scenario_uid").groupBy(*sets).agg(F.collect_set("problem").alias("broken"))
    sound = scenarios.select(*sets).distinct().join(broken, sets, "left")
    rows = [F.struct(F.lit(name).alias("check_name"), (~F.coalesce(F.array_contains("broken", problem), F.lit(False))).alias("ok")) for problem, name in named.items()]
    sound = sound.select(*sets, F.explode(F.array(*rows)).alias("c")).select(*sets, "c.*")
    folder = F.regexp_extract("src_path", r"^(.*)/[^/]*$", 1)
    folders = scenarios.groupBy(*sets, folder.alias("folder")).agg(F.count(F.lit(1)).alias("n")).groupBy(*sets)
    folders = folders.agg((F.max(F.col("n") != per_folder) == F.lit(False)).alias("ok")).select(*sets, F.lit("files_a_folder").alias("check_name"), "ok")
    alike = scenarios.groupBy(*sets).agg((F.count_distinct(F.md5(F.to_json("doc"))) == F.count(F.lit(1))).alias("ok"))
    every = scenarios.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("scenario_uid").alias("u"), F.count_distinct(*sets).alias("s"))
    every = every.select(
        F.explode(
            F.array(
                F.struct(F.lit("all_scenarios").alias("check_name"), (F.col("n") == F.col("s") * per_set).alias("ok")),
                F.struct(F.lit("all_uids_unique").alias("check_name"), (F.col("u") == F.col("n")).alias("ok")),
            )
        ).alias("c")
    ).select(*(F.lit(None).cast("string").alias(c) for c in sets), "c.*")
    parts = [set_checks(scenarios, per_set), sound, folders, alike.select(*sets, F.lit("no_equal_contents").alias("check_name"), "ok"), every]
    return reduce(DataFrame.unionByName, parts)


def set_summary(utterances: DataFrame, keys: list[str]) -> DataFrame:
    """Utterances and scenarios per set, and those with a flag."""
    flag = F.coalesce("flag_policyrole", F.lit(False))
    return utterances.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_utterances"),
        F.count_distinct("scenario_uid").alias("n_scenarios"),
        F.count_if(flag).alias("n_flagged"),
        F.count_distinct(F.when(flag, F.col("scenario_uid"))).alias("n_flagged_scenarios"),
    )
