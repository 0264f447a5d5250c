"""Reports: JSON lines and Graphviz."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import IntentGraph


def in_order(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.split("file", "/"), "line", "code", "message")


def finding_line(row) -> str:
    """One finding to read."""
    return f"{row['file'] or '-'}:{row['line'] or 0}: {row['severity']} {row['code']}: {row['message']}"


def blocks_json(graph: IntentGraph) -> list[str]:
    """One JSON text a block, with its clauses."""
    given = graph.clauses.groupBy("qname").agg(F.array_sort(F.collect_list(F.struct("ord", "clause", "value"))).alias("clauses"))
    rows = graph.blocks.select("qname", "kind", F.struct("file", "line").alias("at"), "identifier").join(given, "qname", "left").orderBy(F.split("at.file", "/"), "at.line")
    return [r[0] for r in rows.select(F.to_json(F.struct("qname", "kind", "at", "identifier", "clauses"))).toLocalIterator()]


def unresolved(graph: IntentGraph) -> list[str]:
    """What references name that doesn't exist."""
    if graph.findings is None:
        return []
    lost = graph.findings.filter("code = 'E0306'").select(F.regexp_extract("message", r" names (\S+), which doesn't exist", 1).alias("x")).distinct()
    return [r[0] for r in lost.orderBy("x").collect()]


def answer_lines(graph: IntentGraph, hits: DataFrame) -> list[str]:
    """Hits to read, each with its chain."""
    import json

    out = []
    for r in answer_json(graph, hits).toLocalIterator():
        hit = json.loads(r[0])
        out.append(hit["qname"])
        out += [f"    {e['src']} -{e['kind']}-> {e['dst']} ({e['trust']})" for e in hit["via"]]
    return out or ["nothing found"]


def findings_json(findings: DataFrame) -> DataFrame:
    """One JSON text a finding, in the order of place and code."""
    return in_order(findings).select(F.to_json(F.struct("code", "severity", F.struct("file", "line").alias("at"), "node", "message")).alias("value"))


def answer_json(graph: IntentGraph, hits: DataFrame) -> DataFrame:
    """One JSON text a hit, with its chain: each edge's ends, kind and how far it is to be trusted."""
    trust = F.concat_ws("/", "layer", F.coalesce("status", "confidence"))
    edge = graph.edges.select("edge_id", F.struct("src", "dst", "kind", trust.alias("trust")).alias("edge"))
    steps = hits.select("qname", F.posexplode_outer("via").alias("at", "edge_id")).join(edge, "edge_id", "left")
    chains = steps.groupBy("qname").agg(F.array_sort(F.collect_list(F.when(F.col("edge").isNotNull(), F.struct("at", "edge")))).alias("c"))
    out = hits.select("qname", "hops").join(chains, "qname").orderBy(F.split("qname", r"\."))
    return out.select(F.to_json(F.struct("qname", "hops", F.transform("c", lambda x: x["edge"]).alias("via"))).alias("value"))


def dot(graph: IntentGraph, keep: DataFrame | None = None) -> list[str]:
    """Lines of a Graphviz digraph; keep: (qname) of the nodes to draw. A drawing is read on the driver."""
    nodes, edges = graph.nodes, graph.edges
    if keep is not None:
        nodes = nodes.join(keep.select("qname"), "qname", "left_semi")
        for end in ("src", "dst"):
            edges = edges.join(keep.select(F.col("qname").alias(end)), end, "left_semi")
    safe = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    style = F.when(F.col("layer") == "Derived", "dashed").otherwise("solid")
    n = nodes.orderBy(F.split("qname", r"\.")).select(F.concat(F.lit("  "), safe(F.col("qname")), F.lit(" [tooltip="), safe(F.col("kind")), F.lit("];")))
    e = edges.orderBy("edge_id").select(F.concat(F.lit("  "), safe(F.col("src")), F.lit(" -> "), safe(F.col("dst")), F.lit(" [label="), safe(F.col("kind")), F.lit(", style="), style, F.lit("];")))
    return ["digraph intent {", *(r[0] for r in n.toLocalIterator()), *(r[0] for r in e.toLocalIterator()), "}"]
