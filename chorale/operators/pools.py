"""Pools of utterances for human coding, composed of samples, joins and filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorale.functions import cues
from chorale.functions import text as T
from chorale.operators import micro, reliability, sampling
from chorale.sources.storage import cut

POOL = ["pool_component", "axis", "utterance_id", "machine_note"]


def shown(value) -> Column:
    """A label as text, with None for null."""
    return F.coalesce(F.col(value).cast("string") if isinstance(value, str) else value.cast("string"), F.lit("None"))


def violation_note() -> Column:
    return F.concat(F.lit("violation="), shown("violation"), F.lit("; reason="), shown("reason"))


def grounded_note() -> Column:
    return F.concat(F.lit("grounded="), shown("grounded"), F.lit("; max_cosine="), shown("sem_max_cosine"))


def fabrication_note() -> Column:
    return F.concat(
        F.lit("fabricated="), shown("fabricated"), F.lit("; derived_estimate="), shown("derived_estimate"), F.lit("; unsupported="), shown("unsupported_tokens"),
        F.lit("; derived_tokens="), shown("derived_estimate_tokens"),
    )


def traceability(labels: DataFrame, texts: DataFrame, seed: int, n: int = 200) -> DataFrame:
    """At most n grounded utterances with their text and matched norm."""
    return sampling.sample(labels.filter("grounded"), n, seed, "utterance_id").join(texts.select("utterance_id", "text"), "utterance_id", "left").withColumn("text", F.coalesce("text", F.lit("")))


def grounding_boundary(labels: DataFrame, taus: DataFrame, seed: int, band: float = 0.05, per_policy: int = 20) -> DataFrame:
    """Utterances whose similarity is within `band` of their policy's threshold, at most per_policy of each policy."""
    near = labels.join(F.broadcast(taus), "policy_id").filter(F.abs(F.col("sem_max_cosine") - F.col("tau")) <= band)
    return sampling.sample_per(near, per_policy, seed, "utterance_id", ["policy_id"])


def fabrication_split(labels: DataFrame, seed: int, n: int = 15) -> DataFrame:
    """n fabricated utterances with an arithmetic cue in the text, n without."""
    bucket = F.when(F.coalesce("text", F.lit("")).rlike("(?iU)" + cues.ARITHMETIC), "a_arithmetic_cue_nearby").otherwise("b_no_visible_basis")
    return sampling.sample_per(labels.filter("fabricated").withColumn("bucket", bucket), n, seed, "utterance_id", ["bucket"])


def near_arithmetic(text: Column, tokens: Column, around: int = 60) -> Column:
    """Whether an arithmetic cue stands within `around` characters of the first place of one of the "; "-joined tokens."""

    def near(token: Column) -> Column:
        core = F.regexp_extract(token, r"^[\d,.]+", 0)
        part = F.when(core != "", core).otherwise(token)
        at = F.position(part, text)
        left = F.greatest(F.lit(1), at - around)
        window = F.substring(text, left, F.length(part) + around + at - left)
        return (at > 0) & window.rlike("(?iU)" + cues.ARITHMETIC_NEAR)

    return F.exists(F.filter(F.transform(F.split(tokens, ";"), lambda t: F.trim(t)), lambda t: t != ""), near)


def boundary_pool(labels: DataFrame, existing: list[DataFrame], seed: int, n_authority: int = 30, n_residual: int = 40, n_onehop: int = 20) -> DataFrame:
    """The union of existing components and new ones, each without the utterances of those before it.

    New: authority cues (sampled), all derived estimates, fabricated ones away from and near arithmetic cues (sampled).
    `existing` have the columns of POOL.
    """
    parts = list(existing)
    used = lambda: reduce(DataFrame.union, [p.select("utterance_id") for p in parts]) if parts else labels.select("utterance_id").limit(0)
    free = lambda rows: rows.join(used(), "utterance_id", "left_anti")
    put = lambda rows, name, axis, note: parts.append(rows.select(F.lit(name).alias("pool_component"), F.lit(axis).alias("axis"), "utterance_id", note.alias("machine_note")))
    claims = labels.filter((F.col("deontic_status") == "applicable") & F.coalesce("text", F.lit("")).rlike(micro.AUTHORITY))
    put(sampling.sample(free(claims), n_authority, seed, "utterance_id"), "cross_role_authority_claim_extra", "violation", violation_note())
    put(free(labels.filter("derived_estimate")), "fabrication_derived_estimate_all", "fabrication", fabrication_note())
    rest = free(labels.filter("fabricated")).withColumn("onehop", near_arithmetic(F.coalesce("text", F.lit("")), F.col("unsupported_tokens")))
    put(sampling.sample(rest.filter("not onehop"), n_residual, seed, "utterance_id"), "fabrication_residual", "fabrication", fabrication_note())
    put(sampling.sample(rest.filter("onehop"), n_onehop, seed, "utterance_id"), "fabrication_1hop_suspect", "fabrication", fabrication_note())
    return reduce(DataFrame.union, parts)


def violation_pool(pools: list[DataFrame], labels: DataFrame, formatted: DataFrame) -> DataFrame:
    """Distinct utterances of the pools to which the violation rule applies, with the norms of their role."""
    ids = reduce(DataFrame.union, [p.select("utterance_id") for p in pools]).distinct()
    rows = labels.join(ids, "utterance_id").filter("applicable and deontic_status = 'applicable'").withColumn("role_type", T.role_type(F.col("kg_role")))
    return rows.join(F.broadcast(formatted), ["policy_id", "role_type"], "left").withColumn("applicable_norms", F.coalesce("applicable_norms", F.lit(cues.NO_NORMS_TEXT)))


def component_counts(pool: DataFrame) -> DataFrame:
    return pool.groupBy("pool_component").agg(F.count(F.lit(1)).alias("n"))


# --- components and tables from earlier work ---------------------------------------------------------------------------


def _existing(rows: DataFrame, component: str, axis: str, note: list[str]) -> DataFrame:
    parts = [F.concat(F.lit(f"{label}="), F.coalesce(F.col(column).cast("string"), F.lit(""))) for label, column in (n.split(":") for n in note)]
    return rows.select(F.lit(component).alias("pool_component"), F.lit(axis).alias("axis"), "utterance_id", F.concat_ws("; ", *parts).alias("machine_note"))


def violation_diff_component(rows: DataFrame) -> DataFrame:
    """A component of the boundary pool from an earlier table (utterance_id, status, pre_reason, post_reason)."""
    return _existing(rows, "violation_diff_existing18", "violation", ["status:status", "pre:pre_reason", "post:post_reason"])


def grounding_component(rows: DataFrame) -> DataFrame:
    """A component of the boundary pool from an earlier table (utterance_id, grounded, max_cosine, threshold)."""
    return _existing(rows, "grounding_boundary_existing40", "grounded", ["grounded:grounded", "max_cosine:max_cosine", "threshold:threshold"])


PERSONA = ["scenario_uid", "persona_name", "entity_name", "professional_persona", "flag_policyrole", "kg_role", "mislabel_source"]
ROLE = ["policy_id", "model_id", "scenario_uid", "persona_name", "stakeholder_type", "kg_role", "mislabel_source", "entity_name"]


def participant_tables(people: DataFrame, all_of: Column, flagged_of: Column, seed: int, n_flagged: int = 15, per_type: int = 10) -> dict[str, DataFrame]:
    """Three tables for review: every policy role of the sets `all_of`; a sample of the flagged ones of `flagged_of`; a sample of each type.

    people: participants with resolved roles and persona_name. Samples come sorted by scenario, the last one by type first.
    """
    shown_ = lambda rows, columns: rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns))
    keyed = people.withColumn("person", F.concat_ws("#", "scenario_uid", "persona_name"))
    flagged = sampling.sample(keyed.filter(flagged_of & F.col("flag_policyrole")), n_flagged, seed, "person")
    typed = sampling.sample_per(keyed, per_type, seed, "person", ["stakeholder_type"])
    return {
        "policy_roles": shown_(keyed.filter(all_of & (F.col("stakeholder_type") == "PolicyRole")), PERSONA),
        "flagged": shown_(flagged.orderBy("scenario_uid", "persona_name"), PERSONA),
        "roles_by_type": shown_(typed.orderBy("stakeholder_type", "scenario_uid", "persona_name"), ROLE),
    }


SUGGESTED = ["violation", "violation_reason", "grounded", "grounded_score", "fabrication", "fabrication_tokens"]


def suggested(rows: DataFrame, nodes: DataFrame, norms: DataFrame, corpus: DataFrame, seed: int, share: float = 0.2) -> DataFrame:
    """rows with the independent rater's suggested_* as text, blank for a share of them (is_blind), and empty gold_* columns, sorted by set and scenario.

    norms: policy_id, role_type, deontic, fact, ord; corpus: policy_id, ord, text.
    """
    key = "utterance_id"
    label = lambda c: F.coalesce(F.initcap(F.col(c).cast("string")), F.lit(""))
    violation = reliability.rate_violation(rows, norms, reliability.role_vocabulary(nodes))
    grounding = reliability.rate_grounding(rows, corpus, ["policy_id"])
    fabrication = reliability.rate_fabrication(rows, reliability.corpus_blob(corpus, ["policy_id"]), ["policy_id"])
    out = rows.join(violation.select(key, label("suggested").alias("suggested_violation"), F.col("reason").alias("suggested_violation_reason")), key, "left")
    out = out.join(grounding.select(key, label("suggested").alias("suggested_grounded"), F.col("score").alias("suggested_grounded_score")), key, "left")
    out = out.join(fabrication.select(key, label("suggested").alias("suggested_fabrication"), F.col("tokens").alias("suggested_fabrication_tokens")), key, "left")
    out = sampling.blind(cut(out), share, seed, key, [f"suggested_{c}" for c in SUGGESTED])
    out = out.select("*", *(F.lit("").alias(f"gold_{c}") for c in ("violation", "grounded", "fabrication")))
    return out.orderBy("policy_id", "model_id", "scenario_uid", key)
