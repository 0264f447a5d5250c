"""A project on disk as an intent graph: manifest, sources, declared layer, derived layer, claims, findings."""

from __future__ import annotations

from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema, shared
from .graph import IntentGraph, clauses_of, conform, edges_of, finding, nodes_of
from .operators import hierarchy as H
from .operators import lint as L
from .operators import resolution as R
from .operators import scan as S
from .sources import extract, files


def file_modules(sources: DataFrame, globs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(file, module, package): the glob's module, unless the file's first block is a scope of its own."""
    first = blocks.groupBy("file").agg(F.min_by(F.struct("kind", "qname"), "ord").alias("b"))
    named = L.first_glob(sources.select("file"), globs).join(first, "file", "left")
    module = F.when(F.col("b.kind").isin(schema.SCOPES), F.col("b.qname")).otherwise(F.col("module"))
    # files of one folder see each other's names
    package = F.when(F.endswith("file", F.lit(".go")) | F.endswith("file", F.lit(".java")), F.regexp_replace("file", "[^/]*$", ""))
    return named.select("file", module.alias("module"), package.alias("package"))


#: of each language: extensions, a folder's own file, what separates a path's parts, further roots
_PATHS = [([".py"], "__init__", ".", []), ([".ts", ".tsx", ".js", ".jsx"], "index", "/", []), ([".java"], "package-info", ".", ["src/main/java"]), ([".rs"], "mod", "::", ["src"])]


def import_files(imports: DataFrame, modules: DataFrame, roots: list[str]) -> DataFrame:
    """``imports`` with target_file, by the rules of each language; of languages without such rules there is none."""
    out = None
    for extensions, index, separator, more in _PATHS:
        own = imports.filter(F.exists(F.array(*map(F.lit, extensions)), lambda e: F.endswith("file", e)))
        if separator == "::":  # a path from the crate's root, the own folder or the one above
            path = F.regexp_replace(F.regexp_replace(F.regexp_replace("module", "^crate(::|$)", ""), "^self::", "./"), "^super::", "../")
            own = own.withColumn("module", F.when(F.col("module").rlike("^(self|super)::"), F.replace(path, F.lit("::"), F.lit("/"))).otherwise(path))
        found = R.import_targets(own, modules, extensions, index, [*roots, *(r for r in more if r not in roots)], separator)
        out = found if out is None else out.unionByName(found)
    return out


def derive(sources: DataFrame, modules: DataFrame, states: DataFrame, roots: list[str], cache: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Derived nodes and edges of the files that lie in a module; states: (file, module, identifier, state); cache: a folder of facts by text."""
    modules = modules.filter("module IS NOT NULL")
    own = sources.join(modules.select("file"), "file", "left_semi")
    facts = shared.written(files.with_cache(own, cache, extract.VERSION, extract.facts) if cache else extract.facts(own), "facts")
    fact = lambda kind: facts.filter(F.col("fact") == kind).drop("fact")
    imports = import_files(fact("import"), modules, roots)
    decls = fact("decl")
    known = R.unambiguous(decls, modules)
    calls = fact("call").select("file", "idx", "shape", "obj", "name", "class_decl", "enclosing", "line")
    called = R.call_edges(R.resolve_calls(calls, imports, decls, modules), decls, modules)
    functions = known.filter("kind = 'function'").select("file", F.col("idx").alias("enclosing"), F.col("qname").alias("src"))
    seen = fact("touch").select("file", F.col("name").alias("visible"), "write", "enclosing", "line", "idx").join(R.visible_states(states, modules, imports), ["file", "visible"]).join(functions, ["file", "enclosing"])
    return known.select("qname", "kind", "file", "line"), called.unionByName(R.touch_edges(seen.withColumnRenamed("state", "dst")))


def load(spark: SparkSession, root: str, marker: str = S.MARKER, check_stale: bool = False, cache: str | None = None) -> IntentGraph:
    """The graph of the project at ``root``, with the findings of scan and rules under the manifest's policy.

    check_stale: also what changed after its block, by ``git blame`` of the files with blocks; without a repository none is.
    """
    place = files.find_manifest(root)
    manifest = files.read_manifest(place.read_text(encoding="utf-8")) if place else {}
    globs = files.module_globs(spark, manifest)
    sources = shared.written(files.source_tree(spark, root), "sources")
    blocks, clauses, told = S.scan(sources, globs, marker)
    blocks = shared.written(blocks, "blocks")
    modules = shared.written(file_modules(sources, globs, blocks), "modules")
    states = blocks.filter("kind = 'state' AND identifier IS NOT NULL").drop("module").join(modules, "file").filter("module IS NOT NULL").select("file", "module", "identifier", F.col("qname").alias("state"))
    derived_nodes, derived_edges = derive(sources, modules, states, manifest.get("roots", [""]), cache)
    declared = blocks.withColumn("line", F.coalesce("subject_line", "line"))
    ambient = spark.createDataFrame([(m, "module") for m in dict.fromkeys(manifest.get("modules", {}).values())], "qname string, kind string")
    merged, rejected, duplicates = H.merge_nodes(*(conform(x, schema.NODES) for x in (declared, ambient, derived_nodes)))
    nodes = shared.written(nodes_of(merged.withColumn("annotated", F.coalesce("annotated", F.lit(False)))), "nodes")
    derived_edges = shared.written(H.drop_rejected(derived_edges, rejected), "derived")
    clauses = shared.written(clauses_of(clauses), "clauses")
    bare = IntentGraph(nodes, edges_of(derived_edges), clauses)
    subject = blocks.filter("subject_line IS NOT NULL").join(sources, "file").dropDuplicates(["qname"])
    spans = subject.select("qname", F.array_join(F.slice(F.split("text", r"\r?\n"), F.col("subject_line"), F.col("subject_end") - F.col("subject_line") + 1), "\n").alias("span_text"))
    bound = blocks.filter("identifier IS NOT NULL").dropDuplicates(["qname"]).select("qname", "identifier")
    scope = modules.filter(F.col("module").isNotNull() & F.exists(F.array(*map(F.lit, extract.EXTENSIONS)), lambda e: F.endswith("file", e))).select("file")
    claims = L.claim_statuses(L.declared_edges(bare), derived_edges, scope, H.host_identifiers(nodes, bound), spans)
    by_name = F.struct("src", "dst")
    shape = [x.withColumn("layer", F.lit("Derived")).withColumn("place", by_name) for x in (H.contains_edges(nodes), H.sequence_edges(nodes))]
    facts = derived_edges.withColumn("place", F.struct(F.split("file", "/").alias("f"), "line", "kind", "src", "dst"))
    graph = replace(bare, edges=shared.written(edges_of(L.numbered(claims, *shape, facts)), "edges"))
    policy = manifest.get("policy", {})
    off = list(manifest.get("lint", {}))
    levels = {"unknown": policy.get("unknown", "warn"), "stale": policy.get("stale", "warn"), "effects": policy.get("undeclared_effects", "warn")}
    found = L.lint(graph, **levels, off=off)
    if owners := files.find_ownership_file(root):
        found = found.unionByName(L.apply_policy(L.promote_strict(graph, L.foreign_owners(graph, files.ownership_rules(spark, owners))), **levels, off=off))
    taken = nodes.select("qname", F.concat_ws(":", "file", "line").alias("at"))
    again = duplicates.select("qname", "file", "line").unionByName(rejected.join(derived_nodes.select("qname", "file", "line").distinct(), "qname"))
    clash = finding(again.join(taken, "qname"), "E0305", F.concat(F.lit("the name "), "qname", F.lit(" is taken, at "), "at"))
    found = found.unionByName(L.apply_policy(clash, off=off))
    if check_stale:
        spans = blocks.filter("subject_line IS NOT NULL").dropDuplicates(["qname"])
        blamed = shared.written(files.blame(spans.select("file"), root), "blame")
        subjects = spans.select("qname", "file", F.col("subject_line").alias("line"), F.col("subject_end").alias("end_line"))
        late = L.stale(spans.select("qname", "file", "line", "end_line"), subjects, blamed)
        found = found.unionByName(L.apply_policy(L.promote_strict(graph, late), **levels, off=off))
    scanned = conform(told.withColumn("severity", F.when(F.substring("code", 1, 1) == "E", "error").otherwise("warning")), schema.FINDINGS)
    found = found.unionByName(L.apply_policy(scanned, off=off))
    return replace(graph.with_findings(shared.written(found, "findings")), blocks=blocks)


def propose_manifest(root: str) -> str:
    """A manifest for the folders that hold sources: one module each, in Pascal case."""
    base = Path(root)
    tops = sorted({p.relative_to(base).parts[0] for p in base.rglob("*") if p.suffix in files.EXTENSIONS and len(p.relative_to(base).parts) > 1 and not any(x.startswith(".") or x in files.SKIPPED for x in p.relative_to(base).parts)})
    name = lambda t: "".join(w.capitalize() for w in t.replace("-", "_").split("_"))
    return "\n".join([f'name = "{base.resolve().name}"', f"roots = [{', '.join(repr(t) for t in ['', *tops])}]".replace("'", '"'), "", "[modules]", *(f'"{t}/**" = "{name(t)}"' for t in tops), ""])
