"""Calls and touches of many files resolved against each other, from the tables of facts that extraction gives.

decls (file, idx, name, kind, line, parent); calls (file, idx, shape, obj, name, class_decl, enclosing, line);
imports (file, idx, form, alias, target_file, name): resolved by ``import_targets``; files (file, module, package).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import normal_path


def named_decls(decls: DataFrame, files: DataFrame) -> DataFrame:
    """Declarations with qname and how many have it; a name that several have is ambiguous and excludes all of them."""
    q = decls.drop("module").join(files.select("file", "module"), "file").withColumn("qname", F.concat_ws(".", "module", "name"))
    return q.withColumn("n", F.count("*").over(Window.partitionBy("qname")))


def unambiguous(decls: DataFrame, files: DataFrame) -> DataFrame:
    return named_decls(decls, files).filter("n = 1").drop("n")


def ambiguous_count(decls: DataFrame, files: DataFrame) -> DataFrame:
    return named_decls(decls, files).agg(F.count_if(F.col("n") > 1).alias("ambiguous_names"))


def last_imports(imports: DataFrame, form: str) -> DataFrame:
    """(file, alias, target_file, name): the last import of the form binds the alias."""
    return imports.filter(F.col("form") == form).groupBy("file", "alias").agg(F.max_by(F.struct("target_file", "name"), "idx").alias("i")).select("file", "alias", "i.target_file", "i.name")


def resolve_calls(calls: DataFrame, imports: DataFrame, decls: DataFrame, files: DataFrame) -> DataFrame:
    """Calls with the declaration each resolves to (target, confidence), null where none does.

    A bare call: the same file (Exact), the last named import (Resolved), the only declaration of that name in the
    package (Resolved). A call on an object: the last whole import of it. A method: its class in the file (Exact).
    """
    known = unambiguous(decls, files)
    top = known.select("file", "name", "qname", "kind", "idx", "parent")
    same = top.groupBy("file", "name").agg(F.min_by(F.struct("qname", "kind"), "idx").alias("same"))
    by_name = last_imports(imports, "Named").join(top.select(F.col("file").alias("target_file"), "name", "qname", "kind"), ["target_file", "name"]).select("file", F.col("alias").alias("name"), F.struct("qname", "kind").alias("named"))
    package = top.join(files.select("file", "package").filter("package IS NOT NULL"), "file").groupBy("package", "name").agg(F.count("*").alias("n"), F.collect_list(F.struct("file", "qname", "kind")).alias("all"))
    whole = last_imports(imports, "Whole").select("file", F.col("alias").alias("obj"), "target_file")
    attr = top.select(F.col("file").alias("target_file"), "name", F.struct("qname", "kind").alias("attr"))
    method = top.filter("parent IS NOT NULL").select("file", "name", F.col("parent").alias("class_decl"), F.struct("qname", "kind").alias("method")).dropDuplicates(["file", "name", "class_decl"])
    bare, on = F.col("shape") == "Bare", F.col("shape") == "Attr"
    out = calls.join(same, ["file", "name"], "left").join(by_name, ["file", "name"], "left").join(files.select("file", "package"), "file", "left").join(package, ["package", "name"], "left")
    out = out.join(whole, ["file", "obj"], "left").join(attr, ["target_file", "name"], "left").join(method, ["file", "name", "class_decl"], "left")
    others = F.filter("all", lambda x: x["file"] != F.col("file"))
    sibling = F.when(F.size(others) == 1, F.struct(others[0]["qname"].alias("qname"), others[0]["kind"].alias("kind")))
    target = F.when(bare, F.coalesce("same", "named", sibling)).when(on, F.col("attr")).when(F.col("shape") == "Method", F.col("method"))
    exact = (bare & F.col("same").isNotNull()) | (F.col("shape") == "Method")
    return out.withColumn("to", target).select(*calls.columns, F.col("to.qname").alias("target"), F.col("to.kind").alias("target_kind"), F.when(F.col("to").isNotNull(), F.when(exact, "Exact").otherwise("Resolved")).alias("confidence"))


def call_edges(resolved: DataFrame, decls: DataFrame, files: DataFrame) -> DataFrame:
    """Calls edges (src, dst, kind, layer, confidence, file, line): from functions to functions; what doesn't resolve is dropped, never guessed."""
    src = unambiguous(decls, files).filter("kind = 'function'").select("file", F.col("idx").alias("enclosing"), F.col("qname").alias("src"))
    good = resolved.filter("target_kind = 'function'").join(src, ["file", "enclosing"])
    return good.select("src", F.col("target").alias("dst"), F.lit("Calls").alias("kind"), F.lit("Derived").alias("layer"), "confidence", "file", "line")


def unresolved_count(resolved: DataFrame, decls: DataFrame, files: DataFrame) -> DataFrame:
    total, kept = resolved.agg(F.count("*").alias("calls")), call_edges(resolved, decls, files).agg(F.count("*").alias("edges"))
    return total.crossJoin(kept).select((F.col("calls") - F.col("edges")).alias("unresolved_calls"))


def visible_states(states: DataFrame, files: DataFrame, imports: DataFrame) -> DataFrame:
    """(file, visible, state): own-module states by identifier, imported ones by alias or alias.identifier; the last import wins over all else."""
    own = files.select("file", "module").join(states.drop("file"), "module").select("file", F.col("identifier").alias("visible"), F.col("state"), F.lit(-1).alias("rank"))
    home = states.select(F.col("file").alias("target_file"), "identifier", "state")
    named = imports.filter("form = 'Named'").join(home.withColumnRenamed("identifier", "name"), ["target_file", "name"]).select("file", F.col("alias").alias("visible"), "state", F.col("idx").alias("rank"))
    whole = imports.filter("form = 'Whole'").join(home, "target_file").select("file", F.concat_ws(".", "alias", "identifier").alias("visible"), "state", F.col("idx").alias("rank"))
    ranked = own.unionByName(named).unionByName(whole).withColumn("r", F.rank().over(Window.partitionBy("file", "visible").orderBy(F.desc("rank"))))
    return ranked.filter("r = 1").select("file", "visible", "state").distinct()


def touch_edges(touches: DataFrame) -> DataFrame:
    """Of (src, dst, write, file, line, idx) the first per function, state and write, as Affects or Reads edges."""
    first = touches.withColumn("r", F.row_number().over(Window.partitionBy("src", "dst", "write").orderBy(F.split("file", "/"), "line", "idx"))).filter("r = 1")
    return first.select("src", "dst", F.when(F.col("write"), "Affects").otherwise("Reads").alias("kind"), F.lit("Derived").alias("layer"), F.lit("Heuristic").alias("confidence"), "file", "line")


def import_targets(imports: DataFrame, files: DataFrame, extensions: list[str], index: str = "index", roots: list[str] = ("",), separator: str = ".") -> DataFrame:
    """``imports`` (file, idx, module, …) with target_file: the first candidate path that is a file.

    "./" and "../" are taken from the importer's directory; else the module's parts are taken under each root, then
    beside the importer. Each as it is, with an extension, and as a directory's index.
    """
    folder = F.regexp_replace("file", r"[^/]*$", "")
    module = F.col("module")
    dotted = F.replace(module, F.lit(separator), F.lit("/")) if separator != "/" else module
    bases = F.when(module.rlike(r"^\.{1,2}/"), F.array(F.concat(folder, module))).otherwise(F.array(*(F.concat(F.lit(f"{r}/" if r else ""), dotted) for r in roots), F.concat(folder, dotted)))
    suffixes = F.array(F.lit(""), *(F.lit(e) for e in extensions), *(F.lit(f"/{index}{e}") for e in extensions))
    paths = F.flatten(F.transform(bases, lambda b: F.transform(suffixes, lambda s: normal_path(F.concat(b, s)))))
    tried = imports.select("file", "idx", F.posexplode(paths).alias("at", "target_file")).join(files.select(F.col("file").alias("target_file")), "target_file")
    best = tried.groupBy("file", "idx").agg(F.min_by("target_file", "at").alias("target_file"))
    return imports.join(best, ["file", "idx"], "left")
