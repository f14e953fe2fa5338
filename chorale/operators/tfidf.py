"""TF-IDF in long sparse form: (doc_id, term, weight). Cosines are equi-joins on the term, never a dense matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chorale.functions import text as T


def term_counts(docs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, doc_id, term, tf)."""
    return docs.select(*keys, "doc_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy(*keys, "doc_id", "term").agg(F.count(F.lit(1)).cast("double").alias("tf"))


def inverse_frequency(docs: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, term, idf) with idf = ln((1 + n) / (1 + df)) + 1 over the fitted documents."""
    df = counts.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("df"))
    n = docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    both = df.join(F.broadcast(n), keys) if keys else df.crossJoin(F.broadcast(n))
    return both.select(*keys, "term", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def weights(counts: DataFrame, idf: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, doc_id, term, weight), each document of length 1; terms without idf are left out before."""
    raw = counts.join(idf, [*keys, "term"]).withColumn("w", F.col("tf") * F.col("idf"))
    norm = raw.groupBy(*keys, "doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, [*keys, "doc_id"]).select(*keys, "doc_id", "term", (F.col("w") / F.col("norm")).alias("weight"))


def tfidf(docs: DataFrame, keys: list[str]) -> DataFrame:
    counts = term_counts(docs, keys)
    return weights(counts, inverse_frequency(docs, counts, keys), keys)


def cosine_pairs(pairs: DataFrame, vectors: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b, cosine) for given pairs; pairs without a shared term are absent."""
    a = vectors.select(*keys, F.col("doc_id").alias("a"), "term", F.col("weight").alias("wa"))
    b = vectors.select(*keys, F.col("doc_id").alias("b"), "term", F.col("weight").alias("wb"))
    return pairs.join(a, [*keys, "a"]).join(b, [*keys, "b", "term"]).groupBy(*keys, "a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))


def max_cosine(docs: DataFrame, corpus: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, doc_id, max_cosine) of each document against the corpus it shares keys with; 0 without a shared term.

    Weights are fitted on the corpus. The corpus is a table of norms; documents that share no term with it don't take
    part in the join.
    """
    counts = term_counts(corpus, keys)
    idf = inverse_frequency(corpus, counts, keys)
    known = weights(counts, idf, keys).select(*keys, F.col("doc_id").alias("unit"), "term", F.col("weight").alias("wu"))
    own = weights(term_counts(docs, keys), idf, keys)
    cos = own.join(known, [*keys, "term"]).groupBy(*keys, "doc_id", "unit").agg(F.sum(F.col("weight") * F.col("wu")).alias("cosine"))
    best = cos.groupBy(*keys, "doc_id").agg(F.max("cosine").alias("best"))
    return docs.select(*keys, "doc_id").join(best, [*keys, "doc_id"], "left").select(*keys, "doc_id", F.coalesce("best", F.lit(0.0)).alias("max_cosine"))


def _rank_by_digest(rows: DataFrame, keys: list[str], digest: str, ties: list[str]) -> DataFrame:
    """rows with r: the rank of a hexadecimal digest within the keys.

    Rows of a key are ranked in 4,096 ranges of the digest, each with the number of rows in the ranges before it, so no
    task ranks them all.
    """
    ranged = rows.withColumn("range", F.substring(digest, 1, 3))
    counts = ranged.groupBy(*keys, "range").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy(*keys).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*keys, "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(W.partitionBy(*keys, "range").orderBy(digest, *ties))
    return ranged.join(offsets, [*keys, "range"]).withColumn("r", F.col("offset") + within).drop("range", "offset")


def shuffled_corpus(corpus: DataFrame, seed: int, keys: list[str]) -> DataFrame:
    """A corpus of the same lengths whose words are dealt anew.

    Words rank by md5(seed:doc:place), slots by md5(slot:seed:doc:place); the word at rank r fills the slot at rank r.
    """
    words = corpus.select(*keys, "doc_id", F.posexplode(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")).alias("place", "word"))
    place = F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("place").cast("string"))
    ties = ["doc_id", "place"]
    cards = _rank_by_digest(words.withColumn("digest", F.md5(place)), keys, "digest", ties).select(*keys, "word", "r")
    slots = _rank_by_digest(words.withColumn("digest", F.md5(F.concat(F.lit("slot:"), place))), keys, "digest", ties).select(*keys, *ties, "r")
    dealt = slots.join(cards, [*keys, "r"]).groupBy(*keys, "doc_id").agg(F.sort_array(F.collect_list(F.struct("place", "word"))).alias("s"))
    return dealt.select(*keys, "doc_id", F.array_join(F.transform("s", lambda x: x["word"]), " ").alias("text"))
