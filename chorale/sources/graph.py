"""Policy knowledge graphs: JSON with nodes and edges, and the tables derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chorale.functions import text as T

SCHEMA = (
    "nodes array<struct<id:string,type:string,summary:string,source_spans:array<struct<text:string>>,attributes:struct<decision_authority:string>>>, "
    "edges array<struct<id:string,type:string,source:string,target:string,deontic:string,fact:string,source_text:string>>"
)


def read_graph(spark: SparkSession, path: str, policy_id: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of one policy, with ord, the place in the file. Warnings in the file are not read."""
    raw = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    part = lambda c: raw.select(F.posexplode(c).alias("ord", "x")).select(F.lit(policy_id).alias("policy_id"), "ord", "x.*")
    return part("nodes"), part("edges")


def _texts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every text with its kind and reference: node summaries and spans in node order, then edge facts and sources."""
    n = nodes.select(
        "policy_id",
        "ord",
        F.lit(0).alias("part"),
        F.posexplode(
            F.concat(
                F.array(F.struct(F.col("summary").alias("text"), F.lit("node_summary").alias("kind"), F.col("id").alias("ref_id"))),
                F.transform(
                    F.coalesce("source_spans", F.expr("cast(array() as array<struct<text:string>>)")),
                    lambda s, i: F.struct(s["text"].alias("text"), F.lit("source_span").alias("kind"), F.concat("id", F.lit("#span"), i.cast("string")).alias("ref_id")),
                ),
            )
        ).alias("place", "t"),
    )
    deontic = F.when(F.col("deontic").isin("must", "can", "cannot"), "deontic_norm").otherwise("edge_fact")
    e = edges.select(
        "policy_id",
        "ord",
        F.lit(1).alias("part"),
        F.posexplode(
            F.array(
                F.struct(F.col("fact").alias("text"), deontic.alias("kind"), F.col("id").alias("ref_id")),
                F.struct(F.col("source_text").alias("text"), F.lit("source_span").alias("kind"), F.concat("id", F.lit("#source_text")).alias("ref_id")),
            )
        ).alias("place", "t"),
    )
    rows = n.unionByName(e).select("policy_id", "part", "ord", "place", "t.*")
    return rows.filter("text is not null and trim(text) <> ''")


def _first(rows: DataFrame, by: list[str]) -> DataFrame:
    """Of equal rows the first, numbered in order within the policy."""
    w = W.partitionBy(*by).orderBy("part", "ord", "place")
    kept = rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    return kept.withColumn("unit_ord", (F.row_number().over(W.partitionBy("policy_id").orderBy("part", "ord", "place")) - 1).cast("int"))


def grounding_corpus(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(policy_id, ord, text): distinct texts in the order they first come."""
    return _first(_texts(nodes, edges), ["policy_id", "text"]).select("policy_id", F.col("unit_ord").alias("ord"), "text")


def norm_units(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(policy_id, unit_ord, text, kind, ref_id): distinct by text and kind; the first reference stays."""
    return _first(_texts(nodes, edges), ["policy_id", "text", "kind"]).select("policy_id", "unit_ord", "text", "kind", "ref_id")


def norms(edges: DataFrame) -> DataFrame:
    """(policy_id, role_type, deontic, fact, ord) of the edges that oblige, allow or forbid."""
    return edges.filter(F.col("deontic").isin("must", "can", "cannot")).select("policy_id", T.role_type(F.col("source")).alias("role_type"), "deontic", "fact", "ord")


def authority_phrases(nodes: DataFrame) -> DataFrame:
    """(policy_id, role_type, phrase, ord); repeated phrases stay."""
    rows = nodes.filter("attributes.decision_authority is not null and attributes.decision_authority <> ''")
    return rows.select("policy_id", F.coalesce("type", T.role_type(F.col("id"))).alias("role_type"), F.col("attributes.decision_authority").alias("phrase"), "ord")


def formatted_norms(norms: DataFrame) -> DataFrame:
    """(policy_id, role_type, applicable_norms): the norms of a role as one line."""
    each = F.transform(F.sort_array(F.collect_list(F.struct("ord", "deontic", "fact"))), lambda n: F.concat(F.lit("["), n["deontic"], F.lit("] "), F.coalesce(n["fact"], F.lit(""))))
    return norms.groupBy("policy_id", "role_type").agg(F.array_join(each, " | ").alias("applicable_norms"))
