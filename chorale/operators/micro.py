"""Micro accuracy: rule-based norm violations, numeric fabrication, lexical and semantic grounding."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

import chorale
from chorale.functions import cues, draws
from chorale.functions import text as T

# Functions of this package travel inside the task, so executors need no copy of the repository.
cloudpickle.register_pickle_by_value(chorale)

NEGATION, AUTHORITY = "(?iU)" + cues.NEGATION, "(?iU)" + cues.AUTHORITY
SWEEP = [round(0.10 + 0.05 * i, 2) for i in range(10)]

# --- violations --------------------------------------------------------------------------------------------------------


def norm_phrases(norms: DataFrame, authority: DataFrame) -> DataFrame:
    """(policy_id, own, others): per policy its duty and authority phrases with their words, in order.

    norms: policy_id, role_type, deontic, fact, ord; authority: policy_id, role_type, phrase, ord. A policy has tens of
    phrases, so an array of them rides along with each utterance of the policy instead of a join by overlap.
    """
    duty = norms.filter("deontic = 'must' and fact is not null and fact <> ''").select("policy_id", "role_type", T.after_deontic(F.col("fact")).alias("phrase"), "ord")
    pack = lambda df, name: df.groupBy("policy_id").agg(
        F.sort_array(F.collect_list(F.struct("ord", "role_type", "phrase", T.significant_words(F.col("phrase")).alias("words")))).alias(name)
    )
    roles = norms.groupBy("policy_id").agg(F.collect_set("role_type").alias("roles"))
    return roles.join(pack(duty, "duties"), "policy_id", "left").join(pack(authority, "authorities"), "policy_id", "left")


def strong_enough(words: Column, window: Column, least: int) -> Column:
    """Whether a phrase shares `least` words with a window, or its only word; a phrase without words never does."""
    return (F.size(words) > 0) & (F.size(F.array_intersect(words, window)) >= F.least(F.lit(least), F.size(words)))


def violations(utterances: DataFrame, phrases: DataFrame, least: int = 2, around: int = 80, cut: int | None = 60) -> DataFrame:
    """utterances (utterance_id, policy_id, kg_role, deontic_status, text) with applicable, violation, reason, window.

    First a negation cue near words of an own duty, else an authority cue near words of another role's authority. The
    first cue, then the first phrase in order gives the reason. `cut` limits the phrase in it; None keeps it whole.
    """
    text, role = F.coalesce("text", F.lit("")), T.role_type(F.col("kg_role"))
    rows = utterances.join(F.broadcast(phrases), "policy_id", "left")
    applicable = (F.col("deontic_status") == "applicable") & F.coalesce(F.array_contains("roles", role), F.lit(False))
    shown = lambda p: p if cut is None else F.substring(p, 1, cut)

    def hits(pattern: str, own: Column, prefix) -> Column:
        def of(near: Column) -> Column:
            words = T.significant_words(near)
            return T.let(words, lambda w: F.transform(F.filter(own, lambda p: strong_enough(p["words"], w, least)), lambda p: F.struct(F.concat(prefix(p), shown(p["phrase"])).alias("reason"), near.alias("near"))))

        return F.flatten(F.transform(T.windows(text, pattern, around), of))

    kind = "array<struct<ord:int,role_type:string,phrase:string,words:array<string>>>"
    duties = F.filter(F.coalesce("duties", F.expr(f"cast(array() as {kind})")), lambda p: p["role_type"] == role)
    others = F.filter(F.coalesce("authorities", F.expr(f"cast(array() as {kind})")), lambda p: p["role_type"] != role)
    negated = hits(NEGATION, duties, lambda p: F.lit("must_negation:"))
    claimed = hits(AUTHORITY, others, lambda p: F.concat(F.lit("cross_role_authority_claim:"), p["role_type"], F.lit(":")))
    first = F.when(applicable, F.get(F.concat(negated, claimed), F.lit(0)))
    rows = rows.withColumn("__hit", first)
    return rows.select(
        *utterances.columns,
        applicable.alias("applicable"),
        F.when(applicable, F.col("__hit").isNotNull()).alias("violation"),
        F.col("__hit.reason").alias("reason"),
        F.col("__hit.near").alias("window"),
    )


def violation_diff(utterances: DataFrame, phrases: DataFrame) -> DataFrame:
    """Utterances that the lenient rule (one shared word) or the strict rule finds: confirmed, or dropped by the strict one."""
    before = violations(utterances, phrases, least=1).select("utterance_id", F.col("violation").alias("pre"), F.col("reason").alias("pre_reason"))
    after = violations(utterances, phrases, cut=None).select("utterance_id", F.col("violation").alias("post"), F.col("reason").alias("post_reason"), F.col("window").alias("window_text"))
    both = before.join(after, "utterance_id").filter("coalesce(pre, false) or coalesce(post, false)")
    return both.withColumn("status", F.when(F.coalesce("post", F.lit(False)), "confirmed").otherwise("dropped"))


# --- fabrication -------------------------------------------------------------------------------------------------------


def numeric_index(corpus: DataFrame) -> DataFrame:
    """(policy_id, class, value) of the distinct numbers other than 0 in the corpus."""
    found = corpus.select("policy_id", F.explode(T.numeric_candidates(F.col("text"))).alias("c"))
    return found.select("policy_id", "c.class", "c.value").filter("value <> 0").distinct()


def supported_numbers(numbers: DataFrame, index: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Rows (policy_id, class, value) of `numbers` within the tolerance of a number of the index.

    An equi-join on policy, class and the step of the logarithm: numbers within 1 % of each other have the same sign and lie in
    the same or in neighbouring steps of 5 %. Then the exact test.
    """
    step = lambda v: F.when(v == 0, F.lit(0)).otherwise(F.signum(v) * (F.floor(F.ln(F.abs(v)) / F.lit(0.05)) + 1000)).cast("long")
    near = index.select("policy_id", "class", F.col("value").alias("known"), F.explode(F.array(*(step(F.col("value")) + i for i in (-1, 0, 1)))).alias("step"))
    close = F.abs(F.col("value") - F.col("known")) <= tolerance * F.greatest(F.abs("value"), F.abs("known"))
    rows = numbers.select("policy_id", "class", "value").distinct().withColumn("step", step(F.col("value")))
    return rows.join(near, ["policy_id", "class", "step"]).filter(close).select("policy_id", "class", "value").distinct()


def derivable(value: Column, amounts: Column, tolerance: float = 0.03) -> Column:
    """Whether the product, ratio, sum or difference of two of the amounts other than 0 comes within the tolerance."""
    near = lambda c: F.abs(value - c) <= tolerance * F.greatest(F.abs(value), F.abs(c), F.lit(1.0))
    return T.let(
        F.filter(amounts, lambda v: v != 0),
        lambda good: F.exists(good, lambda a: F.exists(good, lambda b: near(a * b) | near(a / b) | near(a + b) | near(a - b))),
    )


def fabrication(utterances: DataFrame, corpus: DataFrame) -> DataFrame:
    """Per utterance: applicable, fabricated, derived, the unsupported and the derived raw numbers.

    Numbers without support in the policy's corpus are fabricated, unless an amount is derivable from supported amounts
    of the same utterance. Without any number the utterance isn't applicable.
    """
    rows = utterances.select("utterance_id", "policy_id", T.numeric_candidates(F.coalesce("text", F.lit(""))).alias("found"))
    each = rows.select("utterance_id", "policy_id", F.posexplode("found").alias("pos", "c")).select("utterance_id", "policy_id", "pos", "c.*")
    good = supported_numbers(each, numeric_index(corpus)).withColumn("ok", F.lit(True))
    each = each.join(good, ["policy_id", "class", "value"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    per = each.groupBy("utterance_id").agg(F.sort_array(F.collect_list(F.struct("pos", "raw", "class", "value", "ok"))).alias("n"))
    amounts = F.transform(F.filter("n", lambda c: c["ok"] & (c["class"] == "amount")), lambda c: c["value"])
    judged = per.withColumn("amounts", amounts)
    derived = lambda c: ~c["ok"] & (c["class"] == "amount") & derivable(c["value"], F.col("amounts"))
    raws = lambda keep: F.transform(F.filter("n", keep), lambda c: c["raw"])
    judged = judged.select("utterance_id", raws(lambda c: ~c["ok"] & ~derived(c)).alias("unsupported"), raws(derived).alias("derived_tokens"))
    out = utterances.select("utterance_id", "policy_id").join(judged, "utterance_id", "left")
    return out.select(
        "utterance_id",
        "policy_id",
        F.col("unsupported").isNotNull().alias("fabrication_applicable"),
        (F.size("unsupported") > 0).alias("fabricated"),
        (F.size("derived_tokens") > 0).alias("derived_estimate"),
        F.coalesce(F.array_join("unsupported", "; "), F.lit("")).alias("unsupported_tokens"),
        F.coalesce(F.array_join("derived_tokens", "; "), F.lit("")).alias("derived_estimate_tokens"),
    ).withColumn("fabricated", F.when(F.col("fabrication_applicable"), F.col("fabricated"))).withColumn("derived_estimate", F.when(F.col("fabrication_applicable"), F.col("derived_estimate")))


# --- thresholds --------------------------------------------------------------------------------------------------------


def null_threshold(values: DataFrame, keys: list[str], percentile: float = 0.95, column: str = "value") -> DataFrame:
    """(keys, tau): the percentile of the null values; a global one without values is 0."""
    agg = F.coalesce(F.percentile(column, percentile), F.lit(0.0)).alias("tau")
    return values.groupBy(*keys).agg(agg) if keys else values.agg(agg)


def distribution(values: DataFrame, keys: list[str], column: str = "value") -> DataFrame:
    """n, mean, median, p25, p75, min and max; nulls where there are no values."""
    p = lambda q: F.percentile(column, q)
    aggs = [F.count(column).alias("n"), F.avg(column).alias("mean"), p(0.5).alias("median"), p(0.25).alias("p25"), p(0.75).alias("p75"), F.min(column).alias("min"), F.max(column).alias("max")]
    return values.groupBy(*keys).agg(*aggs) if keys else values.agg(*aggs)


def threshold_sweep(values: DataFrame, keys: list[str], taus: list[float] = SWEEP, column: str = "value") -> DataFrame:
    """(keys, tau, n_grounded, n, grounded_ratio), counting values strictly above each tau; one pass over the values."""
    per = values.groupBy(*keys).agg(F.count(column).alias("n"), *(F.count_if(F.col(column) > t).alias(f"t{i}") for i, t in enumerate(taus)))
    rows = F.array(*(F.struct(F.lit(t).alias("tau"), F.col(f"t{i}").alias("n_grounded")) for i, t in enumerate(taus)))
    out = per.select(*keys, "n", F.explode(rows).alias("s")).select(*keys, "s.tau", "s.n_grounded", "n")
    return out.withColumn("grounded_ratio", F.try_divide(F.col("n_grounded").cast("double"), F.col("n").cast("double")))


def null_false_positive_rate(values: DataFrame, tau: DataFrame, keys: list[str], column: str = "value") -> DataFrame:
    """(keys, fpr): share of null values strictly above tau. tau has one row a key."""
    rows = values.join(F.broadcast(tau), keys) if keys else values.crossJoin(F.broadcast(tau))
    return rows.groupBy(*keys).agg(F.avg((F.col(column) > F.col("tau")).cast("double")).alias("null_fpr"))


def fpr_is_sane(fpr: DataFrame, percentile: float = 0.95, slack: float = 0.03) -> DataFrame:
    return fpr.withColumn("sane", F.abs(F.col("null_fpr") - (1 - percentile)) < slack)


def separation_gap(real: DataFrame, null: DataFrame, keys: list[str], column: str = "value") -> DataFrame:
    """(keys, separation_gap): median of real less median of null values."""
    a = distribution(real, keys, column).select(*keys, F.col("median").alias("a"))
    b = distribution(null, keys, column).select(*keys, F.col("median").alias("b"))
    both = a.join(b, keys) if keys else a.crossJoin(b)
    return both.select(*keys, (F.col("a") - F.col("b")).alias("separation_gap"))


# --- semantic grounding --------------------------------------------------------------------------------------------------


#: Utterances met by a block of units at once.
LINES = 2048


def row_blocks(rows: DataFrame, keys: list[str], by: str, columns: list[str], name: str, size: int) -> DataFrame:
    """(keys, name): the columns of the rows in arrays of about `size`, dealt by the column `by`."""
    n = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).alias("blocks"))
    rows = rows.join(n, keys) if keys else rows.crossJoin(F.broadcast(n))  # one row
    block = F.pmod(F.xxhash64(by), F.col("blocks"))
    return rows.groupBy(*keys, block.alias("block")).agg(F.collect_list(F.struct(*columns)).alias(name)).drop("block")


def similarities(utterances: DataFrame, units: DataFrame, keys: list[str], skip: int = 3, take: int = 5, seed: int = 20240612, block: int = 4096) -> DataFrame:
    """(keys, utterance_id, unit_ord, unit_ref, sim, draw): of the dot products of unit vectors those that `semantic_top1` and `coherent_null` need.

    Blocks of utterances meet blocks of units of their policy. An utterance keeps of each block its skip most similar
    units and the skip + take first by draw, md5(seed:utterance:unit): whatever the skip best of all units are, the `take`
    first of the others are among them. So rows grow with utterances times blocks, not with pairs. Every pair is
    computed, in matrices; see `_near`. With take 0 there are no draws: enough for `semantic_top1`, also with skip 1.
    """
    spark = utterances.sparkSession
    text = F.col("utterance_id").cast("string").alias("text")
    lines = row_blocks(utterances.select(*keys, "utterance_id", text, "vector"), keys, "utterance_id", ["utterance_id", "text", "vector"], "lines", LINES)
    tail = F.concat(F.lit(":"), F.col("unit_ord").cast("string")).alias("text")
    blocks = row_blocks(units.select(*keys, "unit_ord", "unit_ref", tail, "vector"), keys, "unit_ord", ["unit_ord", "unit_ref", "text", "vector"], "units", block)
    met = lines.join(blocks, keys) if keys else lines.crossJoin(blocks)
    met = met.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    fields = [*(utterances.schema[c] for c in keys), utterances.schema["utterance_id"], units.schema["unit_ord"], units.schema["unit_ref"]]
    schema = StructType([StructField(f.name, f.dataType) for f in fields] + [StructField("sim", DoubleType()), StructField("draw", StringType())])
    best, drawn, head = max(skip, 1), skip + take if take else 0, str(seed)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                u, v = batch.column("lines")[i].values, batch.column("units")[i].values
                heads = [(head if t is None else f"{head}:{t}").encode() for t in u.field("text").to_pylist()]
                tails = [(t or "").encode() for t in v.field("text").to_pylist()]
                order = v.field("unit_ord")
                order = np.where(order.is_null(), np.iinfo(np.int64).max, order.fill_null(0).to_numpy(zero_copy_only=False))
                r, c, sim, draw = _near(_matrix(u.field("vector")), _matrix(v.field("vector")), heads, tails, order, best, drawn)
                columns = [batch.column(k).take(pa.array(np.full(len(r), i))) for k in keys]
                columns += [u.field("utterance_id").take(pa.array(r)), v.field("unit_ord").take(pa.array(c)), v.field("unit_ref").take(pa.array(c)), sim, draw]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return met.mapInArrow(run, schema)


def _matrix(vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as rows of doubles, shorter ones filled with 0, and their lengths: -1 for null or a null within."""
    lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy().astype(np.int64)
    held = np.maximum(lengths, 0)
    flat = vectors.flatten().cast(pa.float64())
    out = np.zeros((len(lengths), int(held.max(initial=0))))
    row = np.repeat(np.arange(len(held)), held)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(held) - held, held)] = flat.fill_null(0.0).to_numpy()
    if flat.null_count:
        lengths[row[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
    return out, lengths


def _least(keys: np.ndarray, k: int) -> np.ndarray:
    """Per row a number that at least k of its keys reach: the k-th largest, or that of the maxima of groups."""
    n, groups = keys.shape[1], 128
    if k < groups <= n // 2:
        keys = keys[:, : n // groups * groups].reshape(len(keys), -1, groups).max(1)
    at = max(keys.shape[1] - k, 0)
    return np.partition(keys, at, axis=1)[:, at]


def _places(rows: np.ndarray) -> np.ndarray:
    """The place of each entry among the entries of its row; equal rows stand together."""
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.empty(0, np.int64)
    return np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))


def _near(lines: tuple, units: tuple, heads: list[bytes], tails: list[bytes], order: np.ndarray, best: int, drawn: int, cells: int = 1 << 20):
    """Rows and columns of the pairs that are kept, their dot products (null without vectors of one length) and draws.

    A matrix product finds all pairs within its rounding error of the `best` largest of a line; those are computed again
    as `text.dot` does, in the order of the elements, and these values decide; of equal ones the first unit by `order`.
    null comes last, NaN first. Draws are compared by their first 32 bits, the first of them as a whole.
    """
    (u, u_len), (v, v_len) = lines, units
    d, n = max(u.shape[1], v.shape[1]), len(v)
    u, v = (np.pad(x, ((0, 0), (0, d - x.shape[1]))) for x in (u, v))
    by_u, by_v = np.ascontiguousarray(u.T), np.ascontiguousarray(v.T)
    with np.errstate(all="ignore"):
        slack = 8 * (d + 1) * 2.0**-53 * np.sqrt((u * u).sum(1)) * np.sqrt((v * v).sum(1).max())
    whole = len({*u_len.tolist(), *v_len.tolist()}) == 1 and v_len[0] >= 0
    out = []
    for lo in range(0, len(u), max(1, cells // n)):
        part = slice(lo, min(lo + max(1, cells // n), len(u)))

        def exact(r, c):
            s = np.zeros(len(r))
            with np.errstate(all="ignore"):
                for x, y in zip(by_u, by_v):
                    s += x[part][r] * y[c]
            return s, (u_len[part][r] != v_len[c]) | (v_len[c] < 0)

        with np.errstate(all="ignore"):
            near = u[part] @ v.T
        near[np.isnan(near)] = np.inf
        if not whole:
            near[(u_len[part, None] != v_len[None]) | (v_len[None] < 0)] = -np.inf
        with np.errstate(all="ignore"):
            least = _least(near, best) - slack[part]
        least[np.isnan(least)] = -np.inf
        r, c = np.nonzero(near >= least[:, None])
        s, missing = exact(r, c)
        kind = np.where(missing, 2, np.where(np.isnan(s), 0, 1))
        by = np.lexsort((order[c], -np.where(kind == 1, s, 0.0), kind, r))
        by = by[_places(r[by]) < best]
        pairs = r[by] * n + c[by]
        draw = None
        if drawn:
            words = ~draws.first_words(heads[part], tails)
            hits = np.flatnonzero((words >= _least(words, drawn)[:, None]).ravel())
            first = np.union1d(pairs, hits)
            r, c = first // n, first % n
            text = np.array([hashlib.md5(heads[lo + i] + tails[j], usedforsecurity=False).hexdigest() for i, j in zip(r.tolist(), c.tolist())], "S32")
            by = np.lexsort((order[c], text, r))
            by = by[(_places(r[by]) < drawn) | np.isin(first[by], pairs)]
            pairs, draw = first[by], text[by]
        r, c = pairs // n, pairs % n
        s, missing = exact(r, c)
        out.append((r + lo, c, pa.array(s, mask=missing), pa.nulls(len(r), pa.string()) if draw is None else pa.array(draw.astype(str), pa.string())))
    r, c, s, draw = zip(*out)
    return np.concatenate(r), np.concatenate(c), pa.concat_arrays(s), pa.concat_arrays(draw)


def semantic_top1(sims: DataFrame, keys: list[str]) -> DataFrame:
    """The most similar unit of each utterance; of equal ones the first."""
    best = F.max(F.struct("sim", (-F.col("unit_ord")).alias("o"), "unit_ref")).alias("b")
    return sims.groupBy(*keys, "utterance_id").agg(best).select(*keys, "utterance_id", F.col("b.sim").alias("sem_max_cosine"), F.col("b.unit_ref").alias("top1_norm_ref"))


def coherent_null(sims: DataFrame, keys: list[str], skip: int = 3, take: int = 5) -> DataFrame:
    """(keys, utterance_id, unit_ord, value): per utterance the `take` units first by draw of those beyond its `skip` best.

    skip and take are those of `similarities`. With `skip` units or fewer there are none.
    """
    w = W.partitionBy(*keys, "utterance_id")
    rest = sims.withColumn("rank", F.row_number().over(w.orderBy(F.desc("sim"), "unit_ord"))).filter(F.col("rank") > skip)
    drawn = rest.withColumn("place", F.row_number().over(w.orderBy("draw", "unit_ord"))).filter(F.col("place") <= take)
    return drawn.select(*keys, "utterance_id", "unit_ord", F.col("sim").alias("value"))


# --- roll-up -----------------------------------------------------------------------------------------------------------


def in_scope(phase: Column) -> Column:
    """Grounding and fabrication are judged in the first two phases only."""
    return phase.isin(cues.PHASES[:2])


def utterance_labels(utterances: DataFrame, violation: DataFrame, semantic: DataFrame, lexical: DataFrame, taus: DataFrame, fabricated: DataFrame) -> DataFrame:
    """One row an utterance with all labels; grounding and fabrication are null out of scope.

    taus has policy_id, sem_tau and lex_tau: thresholds are those of the policy, all models together.
    """
    rows = utterances.join(violation.select("utterance_id", "applicable", "violation", "reason"), "utterance_id")
    rows = rows.join(semantic.select("utterance_id", "sem_max_cosine", "top1_norm_ref"), "utterance_id", "left")
    rows = rows.join(lexical.select("utterance_id", "lex_max_cosine"), "utterance_id", "left")
    rows = rows.join(fabricated.drop("policy_id"), "utterance_id", "left").join(F.broadcast(taus), "policy_id", "left")
    scope = in_scope(F.col("phase"))
    rows = rows.withColumn("grounding_status", F.when(scope, "in_scope").otherwise("out_of_scope"))
    rows = rows.withColumn("grounded", F.when(scope, F.col("sem_max_cosine") > F.col("sem_tau")))
    rows = rows.withColumn("lex_grounded", F.when(scope, F.col("lex_max_cosine") > F.col("lex_tau")))
    return rows.withColumn("fabrication_applicable", scope & F.coalesce("fabrication_applicable", F.lit(False))).withColumn("fabricated", F.when(scope, F.col("fabricated"))).withColumn(
        "derived_estimate", F.when(scope, F.col("derived_estimate"))
    )


def set_rollup(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and rates per set; each rate has its own denominator and is null where that is 0."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    rate = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    out = labels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_utterances"),
        n(F.col("deontic_status") != "applicable").alias("n_no_position"),
        n(F.col("applicable")).alias("n_applicable"),
        n(F.col("violation")).alias("n_violation"),
        n(F.col("grounding_status") == "in_scope").alias("n_in_scope"),
        n(F.col("grounded")).alias("n_grounded"),
        n(F.col("lex_grounded")).alias("n_lex_grounded"),
        n(F.col("fabrication_applicable")).alias("n_fabrication_applicable"),
        n(F.col("fabricated")).alias("n_fabricated"),
        n(F.col("derived_estimate")).alias("n_derived"),
    )
    rates = {"violation_rate": ("n_violation", "n_applicable"), "grounded_rate": ("n_grounded", "n_in_scope"), "lex_grounded_rate": ("n_lex_grounded", "n_in_scope")}
    rates |= {"fabrication_rate": ("n_fabricated", "n_fabrication_applicable"), "derived_rate": ("n_derived", "n_fabrication_applicable")}
    return out.select("*", *(rate(a, b).alias(k) for k, (a, b) in rates.items()))
