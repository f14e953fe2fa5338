"""Reliability: agreement of coders, thresholds against gold labels, an independent rater."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorale.functions import cues
from chorale.functions import text as T

YES, NO = ["TRUE", "1", "YES", "Y"], ["FALSE", "0", "NO", "N"]
YES_GROUNDED, NO_GROUNDED = [*YES, "GROUNDED", "O"], [*NO, "NOT_GROUNDED", "X"]


def parse_bool(text: Column, yes: list[str] = YES, no: list[str] = NO) -> Column:
    value = F.upper(F.trim(text))
    return F.when(value.isin(yes), True).when(value.isin(no), False)


def krippendorff(pairs: DataFrame, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    """Nominal alpha of two coders with two codes, over rows with both: 1 - Do / De in closed form; null if De is 0.

    With N rows, m mismatches and n0, n1 codes of either kind: Do = m / N and De = 2 n0 n1 / (2N (2N - 1)).
    """
    rows = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    ones = F.sum(F.col(a).cast("long") + F.col(b).cast("long"))
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(F.col(a) != F.col(b)).alias("mismatches"), F.coalesce(ones, F.lit(0)).alias("n1")]
    out = rows.groupBy(*(keys or [])).agg(*aggs)
    total = 2 * F.col("n").cast("double")
    expected = F.try_divide(2 * (total - F.col("n1")) * F.col("n1"), total * (total - 1))
    observed = F.try_divide(F.col("mismatches").cast("double"), F.col("n").cast("double"))
    return out.select(*(keys or []), "n", "mismatches", (1 - F.try_divide(observed, expected)).alias("alpha"))


def validated(alpha: Column, least: float = 0.667) -> Column:
    return F.coalesce(alpha >= least, F.lit(False))


def confusion(rows: DataFrame, machine: str, gold: str, keys: list[str] | None = None) -> DataFrame:
    m, g = F.col(machine), F.col(gold)
    rows = rows.filter(m.isNotNull() & g.isNotNull())
    out = rows.groupBy(*(keys or [])).agg(
        F.count_if(m & g).alias("tp"), F.count_if(m & ~g).alias("fp"), F.count_if(~m & g).alias("fn"), F.count_if(~m & ~g).alias("tn")
    )
    rate = lambda x: F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col(x)).cast("double"))
    return out.withColumn("precision", rate("fp")).withColumn("recall", rate("fn"))


def round_consistency(rows: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """Pairs of initial and revised rows with the same keys, pairs labelled in both, mismatches among those."""
    side = lambda r: F.max(F.when(F.col("round") == r, F.col(label).cast("int"))).alias(r)
    have = lambda r: F.count_if(F.col("round") == r)
    per = rows.groupBy(*keys).agg(side("initial"), side("revised"), have("initial").alias("hi"), have("revised").alias("hr")).filter("hi > 0 and hr > 0")
    return per.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("initial").isNotNull() & F.col("revised").isNotNull()).alias("n_both_labeled"), F.count_if(F.col("initial") != F.col("revised")).alias("n_mismatch"))


def prf(rows: DataFrame, taus: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tau, tp, fp, fn, precision, recall, f1) of score >= tau against gold; taus has the keys and tau."""
    both = rows.join(taus, keys) if keys else rows.crossJoin(taus)
    said, gold = F.col("score") >= F.col("tau"), F.col("gold")
    out = both.groupBy(*keys, "tau").agg(F.count_if(said & gold).alias("tp"), F.count_if(said & ~gold).alias("fp"), F.count_if(~said & gold).alias("fn"))
    rate = lambda x: F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col(x)).cast("double"))
    out = out.withColumn("precision", rate("fp")).withColumn("recall", rate("fn"))
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when((p > 0) & (r > 0), 2 * p * r / (p + r)))


def data_taus(rows: DataFrame, keys: list[str], step: float = 0.02) -> DataFrame:
    """Thresholds from the least to the largest score in steps, rounded to 4 places."""
    ends = rows.groupBy(*keys).agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    steps = F.sequence(F.lit(0), F.floor((F.col("hi") - F.col("lo")) / step + 1e-9).cast("int"))
    return ends.select(*keys, F.explode(steps).alias("i"), "lo").select(*keys, F.round(F.col("lo") + F.col("i") * step, 4).alias("tau"))


def best_f1(swept: DataFrame, keys: list[str]) -> DataFrame:
    """The least tau with the largest F1; keys without an F1 are absent."""
    best = F.max(F.struct("f1", (-F.col("tau")).alias("t"))).alias("b")
    return swept.filter("f1 is not null").groupBy(*keys).agg(best).select(*keys, (-F.col("b.t")).alias("best_tau"), F.col("b.f1").alias("best_f1"))


# --- the independent rater ---------------------------------------------------------------------------------------------


def role_vocabulary(nodes: DataFrame) -> DataFrame:
    """(policy_id, role_type, words): distinct words of five letters in the summaries of a type's nodes."""
    words = nodes.filter("summary is not null and summary <> ''").select("policy_id", F.col("type").alias("role_type"), F.explode(T.letters(F.col("summary"), 5)).alias("w"))
    return words.groupBy("policy_id", "role_type").agg(F.array_sort(F.collect_set("w")).alias("words"))


def rate_violation(utterances: DataFrame, norms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(utterance_id, suggested, reason) by clauses: an own duty negated, else words only another role uses, claimed."""
    kind = "array<struct<role_type:string,words:array<string>>>"
    vocab = vocabulary.groupBy("policy_id").agg(F.array_sort(F.collect_list(F.struct("role_type", "words"))).alias("vocab"))
    duty = norms.groupBy("policy_id", F.col("role_type").alias("own")).agg(
        T.letters(F.concat_ws(" ", F.collect_list(F.when(F.col("deontic") == "must", F.col("fact")))), 5).alias("must"), F.lit(True).alias("has_norms")
    )
    rows = utterances.withColumn("own", T.role_type(F.col("kg_role"))).join(F.broadcast(vocab), "policy_id", "left").join(F.broadcast(duty), ["policy_id", "own"], "left")
    vocab = F.coalesce("vocab", F.expr(f"cast(array() as {kind})"))
    mine = F.flatten(F.transform(F.filter(vocab, lambda v: v["role_type"] == F.col("own")), lambda v: v["words"]))
    others = F.transform(
        F.filter(vocab, lambda v: v["role_type"] != F.col("own")), lambda v: F.struct(v["role_type"].alias("role_type"), F.array_except(v["words"], mine).alias("words"))
    )
    context = F.coalesce("has_norms", F.lit(False)) | F.exists(vocab, lambda v: v["role_type"] == F.col("own"))
    rows = rows.select("utterance_id", T.clauses(F.coalesce("text", F.lit(""))).alias("clauses"), F.coalesce("must", F.expr("cast(array() as array<string>)")).alias("must"), others.alias("others"), context.alias("context"))
    negated = F.exists("clauses", lambda c: T.contains_any(F.lower(c), cues.RATER_NEGATIONS) & F.arrays_overlap(T.letters(c, 5), F.col("must")))
    claims = F.filter("clauses", lambda c: T.contains_any(F.lower(c), cues.RATER_PRONOUNS) & T.contains_any(F.lower(c), cues.RATER_VERBS))
    claimed = F.get(F.flatten(F.transform(claims, lambda c: F.transform(F.filter("others", lambda o: F.arrays_overlap(T.letters(c, 5), o["words"])), lambda o: o["role_type"]))), F.lit(0))
    rows = rows.withColumn("negated", negated).withColumn("claimed", claimed)
    reason = F.when(~F.col("context"), "no_role_context").when(F.col("negated"), "own_duty_negation_in_clause")
    reason = reason.when(F.col("claimed").isNotNull(), F.concat(F.lit("exclusive_vocab_claim:"), F.col("claimed"))).otherwise("no_cue_found")
    return rows.select("utterance_id", F.when(F.col("context"), F.col("negated") | F.col("claimed").isNotNull()).alias("suggested"), reason.alias("reason"))


def words_only(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[a-zA-Z]{2,}"), F.lit(0)), lambda w: F.lower(w))


def rate_grounding(utterances: DataFrame, corpus: DataFrame, keys: list[str], n: int = 4, least: float = 0.08) -> DataFrame:
    """(keys, utterance_id, suggested, score): share of an utterance's distinct n-grams that stand in the corpus; null without any."""
    # the words of an n-gram hold no blank, so joined ones are equal where the n-grams are
    grams = F.array_distinct(F.transform(T.ngrams(words_only(F.col("text")), n), lambda g: F.array_join(g, " ")))
    gram = lambda df, *c: df.select(*keys, *c, F.explode(grams).alias("g"))
    known = gram(corpus).distinct().withColumn("hit", F.lit(1))
    per = gram(utterances, "utterance_id").join(known, [*keys, "g"], "left").groupBy(*keys, "utterance_id").agg(F.count(F.lit(1)).alias("t"), F.count("hit").alias("h"))
    share = F.col("h").cast("double") / F.col("t")
    out = utterances.select(*keys, "utterance_id").join(per.select(*keys, "utterance_id", share.alias("share")), [*keys, "utterance_id"], "left")
    return out.select(*keys, "utterance_id", (F.col("share") >= least).alias("suggested"), F.coalesce(F.bround("share", 4), F.lit(0.0)).alias("score"))


def corpus_blob(corpus: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, blob): a policy's whole corpus in order, one blank between texts, without commas. A corpus is a table of norms."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"])
    return corpus.groupBy(*keys).agg(F.replace(F.array_join(ordered, " "), F.lit(",")).alias("blob"))


def rate_fabrication(utterances: DataFrame, blob: DataFrame, keys: list[str]) -> DataFrame:
    """(utterance_id, suggested, tokens): numbers with a comma or a point whose plain form isn't part of the blob."""
    numbers = F.filter(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\d[\d,]*(?:\.\d+)?"), F.lit(0)), lambda x: F.contains(x, F.lit(",")) | F.contains(x, F.lit(".")))
    rows = utterances.withColumn("numbers", numbers).join(F.broadcast(blob), keys, "left")
    missing = F.filter("numbers", lambda x: ~F.contains(F.coalesce("blob", F.lit("")), F.replace(x, F.lit(","))))
    rows = rows.withColumn("missing", missing)
    return rows.select("utterance_id", F.when(F.size("numbers") > 0, F.size("missing") > 0).alias("suggested"), F.array_join("missing", "; ").alias("tokens"))
