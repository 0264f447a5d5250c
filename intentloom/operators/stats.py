"""Counts over the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import IntentGraph


def nodes_by_kind(graph: IntentGraph) -> DataFrame:
    """(kind, declared, derived, both, with_intent)"""
    told = graph.clauses.select("qname").distinct().withColumn("told", F.lit(True))
    n = graph.nodes.join(told, "qname", "left").groupBy("kind")
    return n.agg(*(F.count_if(F.col("origin") == o).alias(o.lower()) for o in ("Declared", "Derived", "Both")), F.count_if("told").alias("with_intent"))


def edges_by_layer(graph: IntentGraph) -> DataFrame:
    return graph.edges.groupBy("layer").agg(F.count("*").alias("n"))


def claims_by_status(graph: IntentGraph) -> DataFrame:
    return graph.edges.filter("layer = 'Declared' AND status IS NOT NULL").groupBy("status").agg(F.count("*").alias("n"))


def findings_summary(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))


def totals(graph: IntentGraph) -> DataFrame:
    return graph.nodes.agg(F.count("*").alias("nodes")).crossJoin(graph.edges.agg(F.count("*").alias("edges")))
