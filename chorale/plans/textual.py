"""Queries of the text and vector metrics: conversations are groups of utterances, benchmark items the corpus of norms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.operators import diversity, meso, micro, reliability, sampling, tfidf
from chorale.plans.registry import query, read, rounded

# --- distinct-n, self-BLEU ----------------------------------------------------------------------------------------------

_WORDS = "[lower(w) FOR w IN regexp_extract_all(text, '[a-zA-Z가-힣]{2,}')]"
_GRAMS = "[list_slice(w, i, i + {n} - 1) FOR i IN range(1, len(w) - {n} + 2)]"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))


def _distinct_sql(n: int) -> str:
    return f"""WITH t AS (SELECT role, {_WORDS} AS w FROM conversations), g AS (SELECT role, unnest({_GRAMS.format(n=n)}) AS g FROM t)
SELECT role, count(*) AS n_total, count(DISTINCT g) AS n_distinct, round(count(DISTINCT g) / count(*)::DOUBLE, 6) AS distinct_ratio FROM g GROUP BY role"""


@query("div_distinct_1", _distinct_sql(1))
def distinct_1(spark, sf_dir):
    return rounded(diversity.distinct_n(turns(spark, sf_dir), 1, ["role"]), "distinct_ratio")


@query("div_distinct_2", _distinct_sql(2))
def distinct_2(spark, sf_dir):
    return rounded(diversity.distinct_n(turns(spark, sf_dir), 2, ["role"]), "distinct_ratio")


_SELF_BLEU = f"""WITH t AS (SELECT CAST(conv_id % 2 AS VARCHAR) AS policy_id, conv_id, turn, {_WORDS} AS w FROM conversations),
o AS (SELECT policy_id, conv_id, row_number() OVER (PARTITION BY policy_id ORDER BY conv_id) AS r FROM (SELECT DISTINCT policy_id, conv_id FROM t)),
s AS (SELECT t.* FROM t JOIN o USING (policy_id, conv_id) WHERE {{kept}}),
c AS (SELECT policy_id, conv_id, turn, 1 AS n, g, count(*) AS c FROM (SELECT policy_id, conv_id, turn, unnest({_GRAMS.format(n=1)}) AS g FROM s) GROUP BY ALL
  UNION ALL SELECT policy_id, conv_id, turn, 2 AS n, g, count(*) AS c FROM (SELECT policy_id, conv_id, turn, unnest({_GRAMS.format(n=2)}) AS g FROM s) GROUP BY ALL),
m AS (SELECT a.policy_id, a.conv_id, a.turn, a.n, a.g, a.c, coalesce(max(b.c), 0) AS other FROM c a LEFT JOIN c b ON a.conv_id = b.conv_id AND a.n = b.n AND a.g = b.g AND a.turn <> b.turn GROUP BY ALL),
p AS (SELECT policy_id, conv_id, turn, sum(least(c, other)) FILTER (n = 1) AS m1, coalesce(sum(least(c, other)) FILTER (n = 2), 0) AS m2, sum(c) FILTER (n = 1) AS t1, coalesce(sum(c) FILTER (n = 2), 0) AS t2 FROM m GROUP BY ALL),
l AS (SELECT a.policy_id, a.conv_id, a.turn, len(a.w) AS h, min(struct_pack(d := abs(len(b.w) - len(a.w)), x := len(b.w))).x AS r FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.turn <> b.turn WHERE len(a.w) > 0 GROUP BY ALL),
f AS (SELECT l.policy_id, CASE WHEN m1 = 0 THEN 0.0 ELSE (CASE WHEN h > r THEN 1.0 ELSE exp(1 - r / h::DOUBLE) END) * sqrt(m1 / greatest(1, t1)::DOUBLE * (CASE WHEN m2 > 0 THEN m2::DOUBLE ELSE 0.1 END) / greatest(1, t2)::DOUBLE) END AS b
  FROM l JOIN p USING (conv_id, turn))
SELECT policy_id, count(*) AS n_hypotheses, round(avg(b), 6) AS self_bleu FROM f GROUP BY ALL"""


def _self_bleu(spark, sf_dir, max_groups):
    rows = turns(spark, sf_dir).select((F.col("conv_id") % 2).cast("string").alias("policy_id"), F.col("conv_id").alias("group_id"), F.col("turn").alias("member"), "text")
    return rounded(diversity.self_bleu(rows, ["policy_id"], max_groups), "self_bleu")


@query("div_self_bleu", _SELF_BLEU.replace("{kept}", "true"))
def self_bleu(spark, sf_dir):
    return _self_bleu(spark, sf_dir, None)


@query("div_self_bleu_first_200", _SELF_BLEU.replace("{kept}", "r <= 200"))
def self_bleu_first_200(spark, sf_dir):
    return _self_bleu(spark, sf_dir, 200)


# --- coherence of consecutive turns --------------------------------------------------------------------------------------

_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"


@query(
    "meso_phase_coherence",
    rf"""WITH d AS (SELECT CAST(conv_id % 3 AS VARCHAR) AS policy_id, conv_id, turn, conv_id * 1000 + turn AS doc_id, coalesce(text, '') AS text FROM conversations),
t AS (SELECT policy_id, doc_id, term, count(*) AS tf FROM (SELECT policy_id, doc_id, unnest({_TOKENS}) AS term FROM d) GROUP BY ALL),
n AS (SELECT policy_id, count(*) AS n FROM d GROUP BY ALL),
i AS (SELECT policy_id, term, ln((1 + any_value(n)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM t JOIN n USING (policy_id) GROUP BY ALL),
w AS (SELECT policy_id, doc_id, term, tf * idf AS w FROM t JOIN i USING (policy_id, term)),
v AS (SELECT policy_id, doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM w),
p AS (SELECT policy_id, doc_id AS b, lag(doc_id) OVER o AS a, list_distinct(regexp_extract_all(lower(text), '[a-zA-Z]{{4,}}')) AS wb, list_distinct(regexp_extract_all(lower(lag(text) OVER o), '[a-zA-Z]{{4,}}')) AS wa
  FROM d WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
c AS (SELECT p.policy_id, p.a, p.b, sum(x.w * y.w) AS cosine FROM p JOIN v x ON x.doc_id = p.a JOIN v y ON y.doc_id = p.b AND y.term = x.term GROUP BY ALL),
j AS (SELECT policy_id, a, b, len(list_intersect(wa, wb)) / nullif(len(list_distinct(list_concat(wa, wb))), 0)::DOUBLE AS jaccard FROM p WHERE a IS NOT NULL)
SELECT policy_id, count(*) AS n_pairs, round(avg(coalesce(cosine, 0)), 6) AS mean_cosine, count(jaccard) AS n_jaccard, round(avg(jaccard), 6) AS mean_jaccard FROM j LEFT JOIN c USING (policy_id, a, b) GROUP BY ALL""",
)
def phase_coherence(spark, sf_dir):
    rows = turns(spark, sf_dir).select((F.col("conv_id") % 3).cast("string").alias("policy_id"), F.col("conv_id").alias("scenario_uid"), F.col("turn").alias("ord"), (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return rounded(meso.coherence(rows, ["policy_id"]), "mean_cosine", "mean_jaccard")


# --- TF-IDF grounding and its null --------------------------------------------------------------------------------------

SEED = 20240612


def documents(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def corpus(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")


def _cosine_sql(name: str, source: str) -> str:
    """CTE `name` (doc_id, max_cosine) of the documents against the corpus `source` (doc_id, text)."""
    return rf"""
{name}_t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM {source}) GROUP BY ALL),
{name}_i AS (SELECT term, ln((1 + (SELECT count(*) FROM {source})) / (1 + count(*))::DOUBLE) + 1 AS idf FROM {name}_t GROUP BY ALL),
{name}_w AS (SELECT doc_id, term, tf * idf AS w FROM {name}_t JOIN {name}_i USING (term)),
{name}_v AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM {name}_w),
{name}_x AS (SELECT doc_id, term, tf * idf AS w FROM dt JOIN {name}_i USING (term)),
{name}_y AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM {name}_x),
{name}_c AS (SELECT y.doc_id, v.doc_id AS u, sum(y.w * v.w) AS c FROM {name}_y y JOIN {name}_v v USING (term) GROUP BY ALL),
{name} AS (SELECT d.doc_id, coalesce(max(c), 0.0) AS max_cosine FROM documents d LEFT JOIN {name}_c USING (doc_id) GROUP BY ALL)"""


_DOCS = rf"""b AS (SELECT item_id AS doc_id, text FROM benchmark),
dt AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY ALL)"""
_DECOY = rf"""
dw AS (SELECT doc_id, place, w[place + 1] AS word FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS place FROM (SELECT doc_id, [x FOR x IN string_split_regex(text, '\s+') IF x <> ''] AS w FROM b))),
dr AS (SELECT word, row_number() OVER (ORDER BY md5('{SEED}:' || doc_id || ':' || place), doc_id, place) AS r FROM dw),
ds AS (SELECT doc_id, place, row_number() OVER (ORDER BY md5('slot:{SEED}:' || doc_id || ':' || place), doc_id, place) AS r FROM dw),
decoy AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS text FROM ds JOIN dr USING (r) GROUP BY doc_id)"""
_REAL, _NULL = _cosine_sql("real", "b"), _cosine_sql("nul", "decoy")


def real_values(spark, sf_dir):
    return tfidf.max_cosine(documents(spark, sf_dir), corpus(spark, sf_dir), [])


def null_values(spark, sf_dir):
    return tfidf.max_cosine(documents(spark, sf_dir), tfidf.shuffled_corpus(corpus(spark, sf_dir), SEED, []), [])


def values(df, places: int = 9):
    return df.select(F.round("max_cosine", places).alias("value"))


@query("micro_tfidf_max_cosine", f"WITH {_DOCS}, {_REAL} SELECT doc_id, round(max_cosine, 6) AS max_cosine FROM real")
def tfidf_max_cosine(spark, sf_dir):
    return rounded(real_values(spark, sf_dir), "max_cosine")


@query("micro_decoy_corpus", f"WITH {_DOCS}, {_DECOY} SELECT doc_id, text FROM decoy")
def decoy_corpus(spark, sf_dir):
    return tfidf.shuffled_corpus(corpus(spark, sf_dir), SEED, [])


@query("micro_decoy_cosine", f"WITH {_DOCS}, {_DECOY}, {_NULL} SELECT doc_id, round(max_cosine, 6) AS max_cosine FROM nul")
def decoy_cosine(spark, sf_dir):
    return rounded(null_values(spark, sf_dir), "max_cosine")


@query("micro_null_threshold", f"WITH {_DOCS}, {_DECOY}, {_NULL} SELECT round(coalesce(quantile_cont(round(max_cosine, 9), 0.95), 0), 6) AS tau FROM nul")
def null_threshold(spark, sf_dir):
    return rounded(micro.null_threshold(values(null_values(spark, sf_dir)), []), "tau")


@query(
    "micro_distribution",
    f"""WITH {_DOCS}, {_REAL}, v AS (SELECT round(max_cosine, 9) AS v FROM real) SELECT count(v) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median,
  round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.75), 6) AS p75, round(min(v), 6) AS min, round(max(v), 6) AS max FROM v""",
)
def distribution(spark, sf_dir):
    return rounded(micro.distribution(values(real_values(spark, sf_dir)), []), "mean", "median", "p25", "p75", "min", "max")


@query(
    "micro_threshold_sweep",
    f"""WITH {_DOCS}, {_REAL}, v AS (SELECT round(max_cosine, 9) AS v FROM real), t AS (SELECT CAST(unnest([0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55]) AS DOUBLE) AS tau)
SELECT tau, count(*) FILTER (v > tau) AS n_grounded, count(v) AS n, round(count(*) FILTER (v > tau) / count(v)::DOUBLE, 6) AS grounded_ratio FROM v, t GROUP BY tau""",
)
def threshold_sweep(spark, sf_dir):
    return rounded(micro.threshold_sweep(values(real_values(spark, sf_dir)), []), "grounded_ratio")


@query(
    "micro_null_fpr",
    f"""WITH {_DOCS}, {_DECOY}, {_NULL}, v AS (SELECT round(max_cosine, 9) AS v FROM nul), t AS (SELECT quantile_cont(v, 0.9) + 1e-7 AS tau FROM v)
SELECT round(avg(CAST(v > tau AS DOUBLE)), 6) AS null_fpr, abs(avg(CAST(v > tau AS DOUBLE)) - 0.1) < 0.03 AS sane FROM v, t""",
)
def null_fpr(spark, sf_dir):
    nulls = values(null_values(spark, sf_dir))
    tau = micro.null_threshold(nulls, [], 0.9).select((F.col("tau") + 1e-7).alias("tau"))
    return rounded(micro.fpr_is_sane(micro.null_false_positive_rate(nulls, tau, []), 0.9), "null_fpr")


@query(
    "micro_separation_gap",
    f"WITH {_DOCS}, {_DECOY}, {_REAL}, {_NULL} SELECT round((SELECT quantile_cont(round(max_cosine, 9), 0.5) FROM real) - (SELECT quantile_cont(round(max_cosine, 9), 0.5) FROM nul), 6) + 0.0 AS separation_gap",
)
def separation_gap(spark, sf_dir):
    return rounded(micro.separation_gap(values(real_values(spark, sf_dir)), values(null_values(spark, sf_dir)), []), "separation_gap")


# --- vectors: label 0 are norm units, other labels utterances --------------------------------------------------------------

_SIMS = "s AS (SELECT u.vec_id AS utterance_id, n.vec_id AS unit_ord, list_dot_product(u.embedding::DOUBLE[], n.embedding::DOUBLE[]) AS sim FROM embeddings u, embeddings n WHERE u.label <> 0 AND n.label = 0)"


def sims(spark, sf_dir, **kept):
    e = read(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector")
    units = e.filter("label = 0").select(F.col("vec_id").alias("unit_ord"), F.concat(F.lit("unit"), F.col("vec_id").cast("string")).alias("unit_ref"), "vector")
    return micro.similarities(e.filter("label <> 0").withColumnRenamed("vec_id", "utterance_id"), units, [], seed=SEED, **kept)


@query("micro_semantic_top1", f"WITH {_SIMS} SELECT utterance_id, round(max(sim), 6) AS sem_max_cosine, 'unit' || arg_max(unit_ord, struct_pack(a := sim, b := -unit_ord)) AS top1_norm_ref FROM s GROUP BY ALL")
def semantic_top1(spark, sf_dir):
    return rounded(micro.semantic_top1(sims(spark, sf_dir, skip=1, take=0), []), "sem_max_cosine")


@query(
    "micro_coherent_null",
    f"""WITH {_SIMS}, r AS (SELECT *, row_number() OVER (PARTITION BY utterance_id ORDER BY sim DESC, unit_ord) AS k FROM s),
d AS (SELECT *, row_number() OVER (PARTITION BY utterance_id ORDER BY md5('{SEED}:' || utterance_id || ':' || unit_ord), unit_ord) AS q FROM r WHERE k > 3)
SELECT utterance_id, unit_ord, round(sim, 6) + 0.0 AS value FROM d WHERE q <= 5""",
)
def coherent_null(spark, sf_dir):
    return rounded(micro.coherent_null(sims(spark, sf_dir), []), "value")


# --- the independent rater on whole tables ---------------------------------------------------------------------------------

_ASCII = "[lower(w) FOR w IN regexp_extract_all(coalesce(text, ''), '[a-zA-Z]{2,}')]"


@query(
    "rater_ngram_grounded",
    f"""WITH d AS (SELECT doc_id, {_ASCII} AS w FROM documents), c AS (SELECT DISTINCT unnest({_GRAMS.format(n=4)}) AS g FROM (SELECT {_ASCII} AS w FROM benchmark)),
g AS (SELECT DISTINCT doc_id, unnest({_GRAMS.format(n=4)}) AS g FROM d), s AS (SELECT doc_id, count(c.g) / count(*)::DOUBLE AS share FROM g LEFT JOIN c USING (g) GROUP BY ALL)
SELECT d.doc_id AS utterance_id, share >= 0.08 AS suggested, coalesce(round_even(share, 4), 0.0) AS score FROM d LEFT JOIN s USING (doc_id)""",
)
def ngram_grounded(spark, sf_dir):
    return reliability.rate_grounding(documents(spark, sf_dir).withColumnRenamed("doc_id", "utterance_id"), corpus(spark, sf_dir), [])


# --- labels against a rule on the text -------------------------------------------------------------------------------------

_CODED = r"WITH r AS (SELECT doc_id, lang, quality = 1 AS gold, NOT regexp_matches(text, '[|!$%&*#]{1}') AS machine FROM labels JOIN documents USING (doc_id))"


def coded(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents"), "doc_id")
    return rows.select("doc_id", "lang", (F.col("quality") == 1).alias("gold"), (~F.col("text").rlike("[|!$%&*#]")).alias("machine"))


@query(
    "rel_alpha",
    _CODED
    + """, a AS (SELECT lang, count(*) AS n, count(*) FILTER (gold <> machine) AS mismatches, CAST(sum(CAST(gold AS INT) + CAST(machine AS INT)) AS DOUBLE) AS n1 FROM r GROUP BY ALL)
SELECT lang, n, mismatches, round(1 - (mismatches / n::DOUBLE) / nullif(2 * (2 * n - n1) * n1 / (2 * n * (2 * n - 1))::DOUBLE, 0), 6) + 0.0 AS alpha,
  coalesce(1 - (mismatches / n::DOUBLE) / nullif(2 * (2 * n - n1) * n1 / (2 * n * (2 * n - 1))::DOUBLE, 0) >= 0.667, false) AS validated FROM a""",
)
def alpha(spark, sf_dir):
    out = reliability.krippendorff(coded(spark, sf_dir), "machine", "gold", ["lang"])
    return rounded(out.withColumn("validated", reliability.validated(F.col("alpha"))), "alpha")


@query(
    "rel_confusion",
    _CODED
    + """, c AS (SELECT lang, count(*) FILTER (machine AND gold) AS tp, count(*) FILTER (machine AND NOT gold) AS fp, count(*) FILTER (NOT machine AND gold) AS fn, count(*) FILTER (NOT machine AND NOT gold) AS tn FROM r GROUP BY ALL)
SELECT *, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall FROM c""",
)
def confusion(spark, sf_dir):
    return rounded(reliability.confusion(coded(spark, sf_dir), "machine", "gold", ["lang"]), "precision", "recall")


_SCORED = "s AS (SELECT lang AS policy_id, round(len(regexp_extract_all(text, '[^a-z ]')) / greatest(1, length(text))::DOUBLE, 4) AS score, toxic = 1 AS gold FROM labels JOIN documents USING (doc_id))"
_PRF = """CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)::DOUBLE) * (tp / (tp + fn)::DOUBLE) / (tp / (tp + fp)::DOUBLE + tp / (tp + fn)::DOUBLE) END"""
_SWEPT = f"""{_SCORED}, e AS (SELECT policy_id, min(score) AS lo, max(score) AS hi FROM s GROUP BY ALL),
t AS (SELECT policy_id, round(lo + i * 0.02, 4) AS tau FROM (SELECT policy_id, lo, unnest(range(0, CAST(floor((hi - lo) / 0.02 + 1e-9) AS BIGINT) + 1)) AS i FROM e)),
c AS (SELECT policy_id, tau, count(*) FILTER (score >= tau AND gold) AS tp, count(*) FILTER (score >= tau AND NOT gold) AS fp, count(*) FILTER (score < tau AND gold) AS fn FROM s JOIN t USING (policy_id) GROUP BY ALL)"""


def swept(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents"), "doc_id")
    share = F.size(F.regexp_extract_all("text", F.lit("[^a-z ]"), F.lit(0))) / F.greatest(F.lit(1), F.length("text"))
    rows = rows.select(F.col("lang").alias("policy_id"), F.round(share, 4).alias("score"), (F.col("toxic") == 1).alias("gold"))
    return reliability.prf(rows, reliability.data_taus(rows, ["policy_id"]), ["policy_id"])


@query(
    "rel_threshold_prf",
    f"WITH {_SWEPT} SELECT policy_id, tau, tp, fp, fn, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall, round({_PRF}, 6) AS f1 FROM c",
)
def threshold_prf(spark, sf_dir):
    return rounded(swept(spark, sf_dir), "precision", "recall", "f1")


@query("rel_best_f1", f"WITH {_SWEPT}, f AS (SELECT policy_id, tau, {_PRF} AS f1 FROM c) SELECT policy_id, arg_max(tau, struct_pack(a := f1, b := -tau)) AS best_tau, round(max(f1), 6) AS best_f1 FROM f WHERE f1 IS NOT NULL GROUP BY ALL")
def best_f1(spark, sf_dir):
    return rounded(reliability.best_f1(swept(spark, sf_dir), ["policy_id"]), "best_f1")


# --- sampling ------------------------------------------------------------------------------------------------------------

_QUOTAS = """z AS (SELECT source || '|' || lang AS stratum, count(*) AS size FROM documents GROUP BY ALL),
x AS (SELECT *, size * {n}::DOUBLE / sum(size) OVER () AS e FROM z), y AS (SELECT *, floor(e) AS f, e - floor(e) AS fr FROM x),
q AS (SELECT stratum, size, CAST(f + CAST(row_number() OVER (ORDER BY round(fr, 9) DESC, stratum) <= {n} - sum(f) OVER () AS INT) AS BIGINT) AS quota FROM y)"""


@query("pool_largest_remainder", f"WITH {_QUOTAS.format(n=300)} SELECT stratum, size, quota FROM q")
def largest_remainder(spark, sf_dir):
    sizes = read(spark, sf_dir, "documents").groupBy(F.concat_ws("|", "source", "lang").alias("stratum")).agg(F.count(F.lit(1)).alias("size"))
    return sampling.largest_remainder(sizes, 300)


@query(
    "pool_stratified_sample",
    f"""WITH {_QUOTAS.format(n=300)}, d AS (SELECT doc_id, source || '|' || lang AS stratum, row_number() OVER (PARTITION BY source || '|' || lang ORDER BY md5('11:' || doc_id), doc_id) AS r FROM documents)
SELECT doc_id, stratum FROM d JOIN q USING (stratum) WHERE r <= quota""",
)
def stratified_sample(spark, sf_dir):
    return sampling.stratified(read(spark, sf_dir, "documents").select("doc_id", "source", "lang"), 300, 11, "doc_id", ["source", "lang"]).select("doc_id", "stratum")


@query("pool_fixed_sample", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('12:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 40")
def fixed_sample(spark, sf_dir):
    return sampling.sample_per(read(spark, sf_dir, "documents").select("doc_id", "lang"), 40, 12, "doc_id", ["lang"])


@query(
    "pool_blind_mask",
    "SELECT doc_id, r <= round_even(0.2 * n, 0) AS is_blind, CASE WHEN r <= round_even(0.2 * n, 0) THEN '' ELSE CAST(quality AS VARCHAR) END AS quality FROM (SELECT doc_id, quality, row_number() OVER (ORDER BY md5('13:' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM labels)",
)
def blind_mask(spark, sf_dir):
    return sampling.blind(read(spark, sf_dir, "labels").select("doc_id", "quality"), 0.2, 13, "doc_id", ["quality"])
