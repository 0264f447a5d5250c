"""Lint rules: each takes the graph and gives findings; ``RULES`` has them by name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema, shared
from ..functions.names import has_token, nearest
from ..graph import IntentGraph, finding
from . import hierarchy as H


def _matrix(graph: IntentGraph) -> DataFrame:
    return F.broadcast(graph.spark.createDataFrame(schema.APPLICABILITY, "clause string, kind string, need string"))  # 130 rows


def _say(*parts) -> F.Column:
    return F.concat_ws("", *(F.lit(p) if p[:1] != "$" else F.col(p[1:]) for p in parts))


def applicability(graph: IntentGraph) -> DataFrame:
    """E0201 required clause missing, W0209 recommended one missing, E0203 one that may not stand there; annotated nodes only."""
    nodes = graph.nodes.filter("annotated").select("qname", "kind", "file", "line")
    given = graph.clauses.groupBy("qname", "clause").agg(F.min(F.struct("ord", "file", "line")).alias("at"))
    wanted = nodes.join(_matrix(graph), "kind").filter("need IN ('required', 'recommended')").join(given.select("qname", "clause"), ["qname", "clause"], "left_anti")
    missing = finding(wanted, F.when(F.col("need") == "required", "E0201").otherwise("W0209"), _say("$qname", " (", "$kind", ") lacks a ", "$clause", " clause"))
    wrong = nodes.drop("file", "line").join(given, "qname").join(_matrix(graph), ["kind", "clause"]).filter("need IN ('illegal', 'inherited')").select("*", "at.file", "at.line")
    return missing.unionByName(finding(wrong, "E0203", _say("$clause", " may not stand on ", "$qname", " (", "$kind", ", ", "$need", ")")))


def empty_steps(graph: IntentGraph) -> DataFrame:
    """E0204: a step that triggers, emits and handles nothing."""
    acts = graph.clauses.filter(F.col("clause").isin("triggers", "emits", "on")).select("qname")
    return finding(graph.of_kind("step").filter("annotated").join(acts, "qname", "left_anti"), "E0204", _say("step ", "$qname", " does nothing"))


def stray_routes(graph: IntentGraph) -> DataFrame:
    """E0205: a function's route outside a service."""
    routes = graph.clauses.filter("clause = 'route'").groupBy("qname").agg(F.min(F.struct("ord", "file", "line")).alias("at"))
    held = graph.of_kind("function").select("qname").join(H.containers(graph.nodes), "qname", "left").join(graph.nodes.select(F.col("qname").alias("container"), F.col("kind").alias("holder")), "container", "left")
    return finding(held.join(routes, "qname").filter("holder IS NULL OR holder <> 'service'").select("qname", "at.file", "at.line"), "E0205", _say("$qname", " has a route but lies in no service"))


def references(graph: IntentGraph) -> DataFrame:
    """Every legal reference with what it resolves to: (src, clause, target, target_kind, legal_target, kind, ord, file, line)."""
    table = [(c, kind, t) for c, (kind, targets) in schema.REFERENCES.items() for t in targets]
    edge = F.broadcast(graph.spark.createDataFrame([(c, k) for c, (k, _) in schema.REFERENCES.items()], "clause string, edge string"))
    targets = F.broadcast(graph.spark.createDataFrame([(c, t, True) for c, _, t in table], "clause string, target_kind string, legal_target boolean"))
    legal = F.broadcast(graph.spark.createDataFrame(sorted(schema.LEGAL), "clause string, kind string"))
    given = graph.clauses.join(edge, "clause").join(graph.nodes.select("qname", "kind", F.col("ord").alias("node_ord")), "qname").join(legal, ["clause", "kind"], "left_semi")
    known = graph.nodes.select(F.col("qname").alias("value"), F.col("kind").alias("target_kind"))
    out = given.drop("kind").join(known, "value", "left").join(targets, ["clause", "target_kind"], "left")
    return out.select(F.col("qname").alias("src"), "clause", F.col("value").alias("target"), "target_kind", F.coalesce("legal_target", F.lit(False)).alias("legal_target"), F.col("edge").alias("kind"), "node_ord", "ord", "file", "line")


def declared_edges(graph: IntentGraph) -> DataFrame:
    """Edges of the references that resolve; edge_id follows node, clause and place."""
    rank = F.create_map(*(x for i, c in enumerate(schema.REFERENCES) for x in (F.lit(c), F.lit(i))))
    found = references(graph).filter("legal_target").select("src", F.col("target").alias("dst"), "kind", F.lit("Declared").alias("layer"), "file", "line", F.struct("node_ord", rank[F.col("clause")], "ord", "src", "target").alias("place"))
    return found


def bad_references(graph: IntentGraph) -> DataFrame:
    """E0306 what doesn't exist, with the nearest name; E0307 what is of a wrong kind."""
    refs = references(graph).withColumnRenamed("src", "qname")
    lost = refs.filter("target_kind IS NULL")
    hint = nearest(lost, graph.nodes, "target", "qname")
    e0306 = finding(lost.join(hint, "target", "left"), "E0306", _say("$clause", " of ", "$qname", " names ", "$target", ", which doesn't exist; nearest: ", "$nearest"))
    return e0306.unionByName(finding(refs.filter("target_kind IS NOT NULL AND NOT legal_target"), "E0307", _say("$clause", " of ", "$qname", " may not point to ", "$target", " (", "$target_kind", ")")))


def redundant_triggers(graph: IntentGraph) -> DataFrame:
    """W0205: both ends of a trigger have the same nearest module."""
    m = H.nearest_modules(graph.nodes)
    refs = references(graph).filter("clause = 'triggers' AND legal_target").withColumnRenamed("src", "qname")
    same = refs.join(m, "qname").join(m.select(F.col("qname").alias("target"), F.col("module").alias("other")), "target").filter("module = other")
    return finding(same, "W0205", _say("$qname", " triggers ", "$target", " of its own module; such calls are derived"))


def claim_statuses(edges: DataFrame, derived: DataFrame, scope: DataFrame, identifiers: DataFrame, spans: DataFrame) -> DataFrame:
    """Declared ``edges`` with their status.

    scope: (file) that were analysed; identifiers: (qname, identifier) in the host language; spans: (qname, span_text) of
    the source. Outside the scope, and for what analysis can't see: Unverifiable. With a derived edge of the same
    ends and kind (a call for a trigger): Verified. Where the span is known and lacks the target's identifier:
    Contradicted. What isn't known never contradicts. Else Unverified.
    """
    matched = derived.select("src", "dst", F.when(F.col("kind") == "Calls", "Triggers").otherwise(F.col("kind")).alias("kind")).distinct().withColumn("_seen", F.lit(True))
    out = edges.join(scope.select("file").distinct().withColumn("_in", F.lit(True)), "file", "left").join(matched, ["src", "dst", "kind"], "left")
    out = out.join(identifiers.select(F.col("qname").alias("dst"), "identifier"), "dst", "left").join(spans.select(F.col("qname").alias("src"), "span_text"), "src", "left")
    seen = F.col("kind").isin("Affects", "Reads", "Triggers") & F.coalesce("_in", F.lit(False))
    status = F.when(~seen, "Unverifiable").when(F.col("_seen"), "Verified").when(~has_token(F.col("span_text"), F.col("identifier")), "Contradicted").otherwise("Unverified")
    return out.withColumn("status", status).drop("_in", "_seen", "identifier", "span_text")


def contradictions(graph: IntentGraph) -> DataFrame:
    """E0302 in strict modules, else W0302: claims that the source contradicts."""
    bad = graph.edges.filter("status = 'Contradicted'").withColumnRenamed("src", "qname").join(strict_nodes(graph), "qname", "left")
    return finding(bad, F.when(F.col("strict"), "E0302").otherwise("W0302"), _say("$qname", " claims ", "$kind", " ", "$dst", " but its source never names it"))


def undeclared_dependencies(graph: IntentGraph) -> DataFrame:
    """E0304: a declared use of what lies in another module that no depends_on of the user or its containers names."""
    uses = graph.edges_of(*schema.USES).filter("layer = 'Declared'")
    chain = H.owner_chains(graph.nodes)
    owned = uses.join(chain.select(F.col("qname").alias("dst"), "ancestor", "depth"), "dst")
    local = (F.col("src") == F.col("ancestor")) | F.startswith(F.col("src"), F.concat("ancestor", F.lit(".")))
    deps = graph.clauses.filter("clause = 'depends_on'").select(F.col("qname").alias("holder"), F.col("value").alias("ancestor"))
    effective = H.ancestry(uses.select(F.col("src").alias("qname")), graph.nodes, schema.KINDS, True).select(F.col("qname").alias("src"), F.col("ancestor").alias("holder")).join(deps, "holder").select("src", "ancestor").distinct().withColumn("_dep", F.lit(True))
    judged = owned.join(effective, ["src", "ancestor"], "left").groupBy("edge_id").agg(F.bool_or(local | F.coalesce("_dep", F.lit(False))).alias("fine"), F.max_by("ancestor", "depth").alias("owner"), F.first("src").alias("qname"), F.first("dst").alias("dst"), F.first("file").alias("file"), F.first("line").alias("line"))
    return finding(judged.filter("NOT fine"), "E0304", _say("$qname", " uses ", "$dst", " without depends_on: ", "$owner"))


def unused_dependencies(graph: IntentGraph) -> DataFrame:
    """W0206: a depends_on entry that no use in its holder needs."""
    deps = graph.clauses.filter("clause = 'depends_on'").join(graph.nodes.select(F.col("qname").alias("value")), "value", "left_semi")
    uses = graph.edges_of(*schema.USES).filter("layer = 'Declared'").select("src", "dst").distinct()
    holder = H.ancestry(uses.select(F.col("src").alias("qname")), graph.nodes, schema.KINDS, True).select(F.col("qname").alias("src"), F.col("ancestor").alias("holder"))
    needed = uses.join(holder, "src").join(H.owner_chains(graph.nodes).select(F.col("qname").alias("dst"), F.col("ancestor").alias("value")), "dst").select(F.col("holder").alias("qname"), "value").distinct()
    return finding(deps.join(needed, ["qname", "value"], "left_anti"), "W0206", _say("$qname", " depends on ", "$value", " but uses nothing of it"))


def hygiene(graph: IntentGraph) -> DataFrame:
    """W0210 state that nothing reads or affects, W0211 event emitted but not handled, W0212 handled but not emitted."""
    incoming = graph.edges_of("Affects", "Reads", "Emits", "Handles").groupBy(F.col("dst").alias("qname")).agg(F.bool_or(F.col("kind").isin("Affects", "Reads")).alias("used"), F.bool_or(F.col("kind") == "Emits").alias("emitted"), F.bool_or(F.col("kind") == "Handles").alias("handled"))
    no = F.lit(False)
    seen = graph.of_kind("state", "event").join(incoming, "qname", "left").select("qname", "kind", "file", "line", F.coalesce("used", no).alias("used"), F.coalesce("emitted", no).alias("emitted"), F.coalesce("handled", no).alias("handled"))
    state, event = F.col("kind") == "state", F.col("kind") == "event"
    code = F.when(state & ~F.col("used"), "W0210").when(event & F.col("emitted") & ~F.col("handled"), "W0211").when(event & F.col("handled") & ~F.col("emitted"), "W0212")
    return finding(seen.withColumn("code", code).filter("code IS NOT NULL"), F.col("code"), _say("$kind", " ", "$qname", " hangs loose"))


def unknowns(graph: IntentGraph) -> DataFrame:
    """W0213: one for each open question."""
    return finding(graph.clauses.filter("clause = 'unknown'"), "W0213", _say("$qname", " is open: ", "$value"))


def undeclared_effects(graph: IntentGraph) -> DataFrame:
    """W0303: a derived write by an annotated node that declares none to that state."""
    declared = graph.edges_of("Affects").filter("layer = 'Declared'").select("src", "dst").distinct()
    writes = graph.edges_of("Affects").filter("layer = 'Derived'").join(graph.nodes.filter("annotated").select(F.col("qname").alias("src")), "src", "left_semi")
    return finding(writes.join(declared, ["src", "dst"], "left_anti").withColumnRenamed("src", "qname"), "W0303", _say("$qname", " writes ", "$dst", " without saying so"))


def strict_nodes(graph: IntentGraph) -> DataFrame:
    """(qname, strict) for nodes whose nearest module is strict; modules in it are judged by themselves."""
    strict = graph.clauses.filter("clause = 'enforcement' AND value = 'strict'").select(F.col("qname").alias("module")).distinct()
    return H.nearest_modules(graph.nodes).join(strict, "module").select("qname", F.lit(True).alias("strict"))


def promote_strict(graph: IntentGraph, findings: DataFrame) -> DataFrame:
    """W02 and W03 findings of strict nodes are errors; their codes stay."""
    hit = F.col("strict") & F.col("code").rlike("^W0[23]")
    return findings.join(strict_nodes(graph).withColumnRenamed("qname", "node"), "node", "left").withColumn("severity", F.when(hit, "error").otherwise(F.col("severity"))).select(findings.columns)


#: codes that a policy may switch off
OVERRIDABLE = ["W0110", "W0205", "W0206", "W0207", "W0208", "W0209", "W0210", "W0211", "W0212", "W0213", "W0301", "W0302", "W0303"]


def apply_policy(findings: DataFrame, unknown: str = "warn", stale: str = "warn", effects: str = "warn", off: list[str] = ()) -> DataFrame:
    """Promotion by policy first, then suppression of what is switched off, promoted or not."""
    if wrong := set(off) - set(OVERRIDABLE):
        raise ValueError(f"can't be switched off: {sorted(wrong)}")
    errors = [c for c, level in (("W0213", unknown), ("W0301", stale)) if level == "error"]
    gone = [*off, *(["W0303"] if effects == "off" else [])]
    return findings.withColumn("severity", F.when(F.col("code").isin(errors), "error").otherwise(F.col("severity"))).filter(~F.col("code").isin(gone))


def owner_rule(paths: DataFrame, rules: DataFrame, column: str = "file") -> DataFrame:
    """``paths`` with the owners (array) of the last of ``rules`` (ord, regex, owners) that matches, null without one. The rules of one file are few: broadcast."""
    key = paths.select(column).distinct()
    hit = key.join(F.broadcast(rules), F.rlike(F.col(column), F.col("regex"))).groupBy(column).agg(F.max_by("owners", "ord").alias("owners"))
    return paths.join(hit, column, "left")


def foreign_owners(graph: IntentGraph, rules: DataFrame) -> DataFrame:
    """W0207: a declared owner that isn't among those of the ownership file; whole or after the last slash, in any case, with @ or without."""
    owned = graph.clauses.filter("clause = 'owner'").select("qname", "value", "file", "line")
    name = lambda x: F.lower(F.regexp_replace(x, "^@", ""))
    fits = F.exists("owners", lambda o: (name(o) == name(F.col("value"))) | (F.element_at(F.split(name(o), "/"), -1) == name(F.col("value"))))
    return finding(owner_rule(owned, rules).filter((F.size("owners") > 0) & ~fits), "W0207", _say("$qname", " says owner ", "$value", "; the ownership file differs"))


def first_glob(paths: DataFrame, globs: DataFrame, column: str = "file") -> DataFrame:
    """``paths`` with the module of the first of ``globs`` (ord, regex, module) that matches, and whether another one names a different module (E0103)."""
    key = paths.select(column).distinct()
    hit = key.join(F.broadcast(globs), F.rlike(F.col(column), F.col("regex"))).groupBy(column).agg(F.min_by("module", "ord").alias("module"), (F.count_distinct("module") > 1).alias("ambiguous"))
    return paths.join(hit, column, "left")


def newest_change(spans: DataFrame, blame: DataFrame) -> DataFrame:
    """(qname, time, hash): of the lines of each span (qname, file, line, end_line) the latest change; of equally late ones the first line's. Without a blamed line no row.

    Only blamed lines become rows. A span lies in at most two bins of 2 ** its level lines, and a line in one bin of each level
    of its file, so a line meets the spans of about its bin and not all of its file.
    """
    ends = spans.filter("line IS NOT NULL AND end_line IS NOT NULL").select("qname", "file", F.least("line", "end_line").cast("bigint").alias("_first"), F.greatest("line", "end_line").cast("bigint").alias("_last"))
    ends = ends.withColumn("_level", F.length(F.bin(F.col("_last") - F.col("_first"))))
    binned = ends.withColumn("_bin", F.explode(F.expr("sequence(shiftright(_first, _level), shiftright(_last, _level))")))
    lines = blame.withColumn("line", F.col("line").cast("bigint")).join(ends.select("file", "_level").distinct(), "file").withColumn("_bin", F.expr("shiftright(line, _level)"))
    # the lines are streamed, the spans of a bin are kept
    met = lines.join(binned, ["file", "_level", "_bin"]).filter(F.col("line").between(F.col("_first"), F.col("_last")))
    newest = met.groupBy("qname").agg(F.max_by(F.struct("time", "hash"), F.struct("time", -F.col("line"))).alias("n"))
    return newest.select("qname", "n.time", "n.hash")


def stale(blocks: DataFrame, subjects: DataFrame, blame: DataFrame) -> DataFrame:
    """W0301: the subject changed strictly later than its block."""
    s = newest_change(subjects, blame).select("qname", F.col("time").alias("subject_time"), "hash")
    late = newest_change(blocks, blame).select("qname", F.col("time").alias("block_time")).join(s, "qname").filter("subject_time > block_time")
    return finding(late.join(blocks.select("qname", "file", "line"), "qname"), "W0301", _say("$qname", " changed after its block, in ", "$hash"))


RULES = {f.__name__: f for f in (applicability, empty_steps, stray_routes, bad_references, redundant_triggers, contradictions, undeclared_dependencies, unused_dependencies, hygiene, unknowns, undeclared_effects)}


def lint(graph: IntentGraph, **policy) -> DataFrame:
    """All rules, strict promotion and policy, in the order of file, line, code and message."""
    found = reduce(DataFrame.unionByName, (rule(graph) for rule in RULES.values()))
    return apply_policy(promote_strict(graph, found), **policy).orderBy(F.split("file", "/"), "line", "code", "message")


def by_node(findings: DataFrame) -> DataFrame:
    return findings.filter("node IS NOT NULL").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("code", "line", "message"))).alias("findings"))


def numbered(*layers: DataFrame) -> DataFrame:
    """Edges with edge_id: layer by layer, in each by ``place``. One window over all edges would be one task; ids are offsets of sorted partitions."""
    spark, base, out = layers[0].sparkSession, 0, None
    for layer in layers:
        table = shared.written(layer.sort("place").withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "layer")
        sizes = {r["_part"]: r["count"] for r in table.groupBy("_part").count().collect()}
        offsets = {}
        for p in sorted(sizes):
            offsets[p], base = base, base + sizes[p]
        shift = F.broadcast(spark.createDataFrame(sorted(offsets.items()), "_part int, _offset bigint"))
        one = table.join(shift, "_part").withColumn("edge_id", F.col("_offset") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        one = one.drop("_part", "_at", "_offset", "place")
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
