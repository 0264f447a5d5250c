"""A Query as a DataFrame plan of two primitives: selection of nodes, and traversal of hops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions.names import segments
from ..graph import IntentGraph
from ..operators import hierarchy as H
from ..operators import traverse as T
from ..operators.local import Hit, LocalGraph
from ..operators.local import table as in_memory
from .query import Query, QueryError, parse

_FIRST = {"affects": ["Affects"], "reads": ["Reads"], "touches": ["Affects", "Reads"], "callers": ["Triggers", "Calls"], "callees": ["Triggers", "Calls"], "emits": ["Emits"], "handlers": ["Handles"], "depends": ["DependsOn"], "dependents": ["DependsOn"]}
_REVERSE = {"affects", "reads", "callers", "emits", "handlers", "dependents"}


def _nearest(graph: IntentGraph, qname: str) -> str | None:
    return graph.nodes.select(F.min_by("qname", F.struct(F.levenshtein("qname", F.lit(qname)), F.col("qname")))).first()[0]


def lookup(graph: IntentGraph, qname: str, kind: str | None = None, local: LocalGraph | None = None) -> str:
    """The name, if a node has it (and is of that kind)."""
    if local is not None:
        found = local.kinds.get(qname)
    else:
        row = graph.nodes.filter(F.col("qname") == qname).select("kind").first()
        found = row and row["kind"]
    if found is None:
        raise QueryError(f"there is no {qname}; nearest: {_nearest(graph, qname)}")
    if kind and found != kind:
        raise QueryError(f"{qname} is no {kind} but a {found}")
    return qname


def _selected(graph: IntentGraph, q: Query, local: LocalGraph | None) -> DataFrame:
    if q.form == "owner":
        nodes = H.effective_owners(graph.nodes, graph.clauses).filter(F.col("owner") == q.args[0]).select("qname")
    else:
        nodes = graph.clauses.filter("clause = 'unknown'").select("qname").distinct()
        if q.scope:
            nodes = H.inside(nodes, lookup(graph, q.scope[1], q.scope[0], local))
    return nodes.select("qname", F.lit(0).alias("hops"), F.expr("cast(array() as array<bigint>)").alias("via"))


def _check(q: Query, all_paths: bool, max_len: int | None) -> None:
    if q.form == "path" and all_paths and max_len is None:
        raise QueryError("all paths need a greatest length")


def hits(graph: IntentGraph, q: Query, all_paths: bool = False, max_len: int | None = None, chains: bool = True) -> DataFrame:
    """(qname, hops, via) of every form but show, before filters."""
    form, reverse = q.form, q.form in _REVERSE
    if form == "tagged":
        return graph.spark.createDataFrame([], T.HITS)
    if form in ("owner", "unknown"):
        return _selected(graph, q, None)
    if form == "path":
        start, goal = q.args
        if start == goal:
            return graph.spark.createDataFrame([], T.HITS)
        if all_paths:
            return T.simple_paths(T.hops(graph, schema.REACH, True, paired=True), start, goal, max_len)
        return T.closure(T.hops(graph, schema.REACH, True), T.start_at(graph, start), goal=goal, chains=chains)
    arg = q.args[0]
    if form == "reaches":
        return T.closure(T.hops(graph, schema.REACH, True), T.start_at(graph, arg), chains=chains)
    first = T.one_hop(graph, arg, _FIRST[form], reverse)
    if not q.star:
        return first
    if form in ("affects", "reads"):
        more = T.closure(T.hops(graph, schema.CAUSES, True, True), first, chains=chains)
        return T.backwards(T.shorter(first, more, without=arg))
    if form == "touches":
        inner = T.closure(T.hops(graph, schema.CAUSES, True), T.start_at(graph, arg), chains=chains)
        effects = graph.edges_of("Affects", "Reads").select(F.col("src").alias("_at"), F.col("dst").alias("_to"), "edge_id")
        more = inner.join(effects, inner["qname"] == effects["_at"]).select(F.col("_to").alias("qname"), (F.col("hops") + 1).alias("hops"), F.concat("via", F.array("edge_id")).alias("via"))
        return T.shorter(first, more, without=arg)
    found = T.closure(T.hops(graph, _FIRST[form], False, reverse), T.start_at(graph, arg), chains=chains)
    return T.backwards(found) if reverse else found


def local_hits(local: LocalGraph, q: Query) -> list[Hit]:
    """``hits`` over a graph in memory, of the forms that walk along edges."""
    form, reverse = q.form, q.form in _REVERSE
    backwards = lambda hits: [(n, c, via[::-1]) for n, c, via in hits]
    if form == "path":
        start, goal = q.args
        return [] if start == goal else local.closure(schema.REACH, True, False, [(start, ())], goal=goal)
    arg = q.args[0]
    if form == "reaches":
        return local.closure(schema.REACH, True, False, [(arg, ())])
    first = local.one_hop(arg, _FIRST[form], reverse)
    if not q.star:
        return first
    if form in ("affects", "reads"):
        more = local.closure(schema.CAUSES, True, True, [(n, tuple(via)) for n, _, via in first])
        return backwards(local.shorter(first, more, without=arg))
    if form == "touches":
        return local.shorter(first, local.effects_of(local.closure(schema.CAUSES, True, False, [(arg, ())])), without=arg)
    found = local.closure(_FIRST[form], False, reverse, [(arg, ())])
    return backwards(found) if reverse else found


def filtered(graph: IntentGraph, found: DataFrame, q: Query) -> DataFrame:
    """Filters restrict what is reported, never what is walked through."""
    for f in q.filters:
        if f.what in ("module", "service"):
            found = H.inside(found, lookup(graph, f.value, f.what))
        elif f.what == "owned_by":
            found = found.join(H.effective_owners(graph.nodes, graph.clauses).filter(F.col("owner") == f.value).select("qname"), "qname", "left_semi")
        else:
            found = found.join(graph.of_kind(f.value).select("qname"), "qname", "left_semi")
    return found


def ask(graph: IntentGraph, text: str, all_paths: bool = False, max_len: int | None = None, small: int = T.SMALL, chains: bool = True) -> DataFrame:
    """The answer: (qname, hops, via) by name, paths by chain; of show a card (side, kind, other, text). chains: whether via is wanted."""
    q = parse(text)
    if q.filters and q.form in ("show", "path"):
        raise QueryError(f"{q.form} takes no filters")
    _check(q, all_paths, max_len)
    walks = q.form not in ("tagged", "owner", "unknown", "show") and not (q.form == "path" and all_paths)
    local = graph.local(small) if q.form not in ("tagged", "owner") else None
    for a in q.args if q.form not in ("tagged", "owner") else ():
        lookup(graph, a, local=local)
    if q.form == "show":
        return card(graph, q.args[0])
    if local is not None and walks:
        found = local_hits(local, q)
        late = []
        for f in q.filters:
            if f.what in ("module", "service"):
                inside = lookup(graph, f.value, f.what, local)
                found = [h for h in found if h[0] == inside or h[0].startswith(f"{inside}.")]
            elif f.what == "kind":
                found = [h for h in found if local.kinds.get(h[0]) == f.value]
            else:
                late.append(f)
        found.sort(key=(lambda h: (h[1], h[2])) if q.form == "path" else (lambda h: h[0].split(".")))
        out = in_memory(graph.spark, found)
        return filtered(graph, out, Query(q.form, q.args, q.star, q.scope, tuple(late))).orderBy(segments(F.col("qname"))) if late else out
    found = filtered(graph, _selected(graph, q, local) if q.form == "unknown" else hits(graph, q, all_paths, max_len, chains), q)
    return found.orderBy("hops", "via") if q.form == "path" else found.orderBy(segments(F.col("qname")))


def card(graph: IntentGraph, qname: str) -> DataFrame:
    """(side, kind, other, text) of one node: itself, its clauses, edges out and in by kind and far end, findings."""
    rank = F.create_map(*(x for i, k in enumerate(schema.EDGE_KINDS) for x in (F.lit(k), F.lit(i))))
    none = F.lit(None).cast("string")
    at = lambda df, c: df.filter(F.col(c) == qname)
    parts = [
        at(graph.nodes, "qname").select(F.lit(0).alias("o"), F.lit("node").alias("side"), "kind", F.col("file").alias("other"), F.col("origin").alias("text"), F.lit(0).alias("r")),
        at(graph.clauses, "qname").select(F.lit(1), F.lit("clause"), "clause", none, "value", "ord"),
        at(graph.edges, "src").select(F.lit(2), F.lit("out"), "kind", "dst", F.coalesce("status", "confidence"), rank[F.col("kind")]),
        at(graph.edges, "dst").select(F.lit(3), F.lit("in"), "kind", "src", F.coalesce("status", "confidence"), rank[F.col("kind")]),
    ]
    if graph.findings is not None:
        parts.append(at(graph.findings, "node").select(F.lit(4), F.lit("finding"), "code", none, "message", "line"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.orderBy("o", "r", "other", "text").select("side", "kind", "other", "text")
