"""The intent graph: nodes, edges, clauses and findings as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import schema


@dataclass(frozen=True)
class IntentGraph:
    """nodes are unique by qname; edges are a multigraph in the order of edge_id."""

    nodes: DataFrame
    edges: DataFrame
    clauses: DataFrame
    findings: DataFrame | None = None
    #: of a project on disk: (qname, kind, file, line, end_line, subject_line, subject_end) of its blocks
    blocks: DataFrame | None = None

    @property
    def spark(self):
        return self.nodes.sparkSession

    def of_kind(self, *kinds: str) -> DataFrame:
        return self.nodes.filter(F.col("kind").isin(*kinds))

    def edges_of(self, *kinds: str) -> DataFrame:
        return self.edges.filter(F.col("kind").isin(*kinds))

    def with_findings(self, findings: DataFrame) -> "IntentGraph":
        out = replace(self, findings=findings)
        out.__dict__["_local"] = self.__dict__.setdefault("_local", {})
        return out

    def local(self, most: int):
        """The graph in the driver's memory if it has at most ``most`` edges, else None; loaded once."""
        kept = self.__dict__.setdefault("_local", {})
        if most not in kept:
            from .operators import local

            kept[most] = local.load(self.nodes, self.edges, most) if most else None
        return kept[most]

    def ask(self, text: str, **options) -> DataFrame:
        from .plans import compile as plan

        return plan.ask(self, text, **options)


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """The columns of ``ddl``, null where ``df`` lacks one."""
    columns = [c.strip().rsplit(" ", 1) for c in ddl.split(",")]
    return df.select(*((F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in columns))


def nodes_of(df: DataFrame) -> DataFrame:
    return conform(df, schema.NODES)


def edges_of(df: DataFrame) -> DataFrame:
    return conform(df, schema.EDGES)


def clauses_of(df: DataFrame) -> DataFrame:
    return conform(df, schema.CLAUSES)


def finding(df: DataFrame, code, message, node="qname", file="file", line="line") -> DataFrame:
    """Rows of ``df`` as findings; severity follows the code's first letter."""
    c = F.lit(code) if isinstance(code, str) else code
    cols = {n: F.col(n) if n in df.columns else F.lit(None) for n in (file, line, node)}
    out = df.select(c.alias("code"), F.when(F.substring(c, 1, 1) == "E", "error").otherwise("warning").alias("severity"), cols[file].alias("file"), cols[line].alias("line"), cols[node].alias("node"), message.alias("message"))
    return conform(out, schema.FINDINGS)
