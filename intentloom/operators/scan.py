"""From source text to declared nodes: lines, comment runs, blocks, clauses, bindings, scopes."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..sources import braces
from . import clauses as C

#: the line that begins a block, and what begins a comment by extension
MARKER = "@intent"
COMMENTS = {".py": "#", ".ts": "//", ".js": "//", ".tsx": "//", ".jsx": "//", ".go": "//", ".java": "//", ".rs": "//", ".toml": "#", ".sql": "--"}
BLOCKS = "file string, block int, line int, end_line int, kind string, name string, identifier string, subject_line int, subject_end int"
_WORD = re.compile(r"[^\W\d][\w.]*")


def lines(sources: DataFrame) -> DataFrame:
    """(file, line, text) of (file, text); a line break at the end begins no line."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"\r?\n\z", "")
    return sources.select("file", F.posexplode(F.split(text, r"\r?\n", -1)).alias("at", "text")).select("file", (F.col("at") + 1).alias("line"), "text")


def comment_text(line: Column, token: Column) -> Column:
    """What a comment line says: without indent, token and at most one space; null: not a comment."""
    bare = F.ltrim(line)
    body = F.substr(bare, F.length(token) + 1)
    return F.when(F.startswith(bare, token), F.when(F.startswith(body, F.lit(" ")), F.substr(body, F.lit(2))).otherwise(body))


def marked_lines(sources: DataFrame, marker: str = MARKER) -> DataFrame:
    """(file, line, said, block, ignored): comment lines of blocks; ``block`` is the marker's line; ignored (W0110): a marker that follows a comment line outside a block."""
    token = F.coalesce(*(F.when(F.endswith("file", F.lit(e)), F.lit(t)) for e, t in COMMENTS.items()))
    order = Window.partitionBy("file").orderBy("line")
    said = lines(sources).withColumn("said", comment_text(F.col("text"), token)).drop("text")
    said = said.withColumn("new", F.col("said").isNull() | F.lag("said").over(order).isNull()).withColumn("run", F.sum(F.coalesce("new", F.lit(True)).cast("int")).over(order)).filter("said IS NOT NULL")
    within = Window.partitionBy("file", "run").orderBy("line")
    said = said.withColumn("marker", F.rtrim("said") == marker).withColumn("first", F.row_number().over(within) == 1).withColumn("ended", F.max((F.trim("said") == "").cast("int")).over(within) == 1)
    opened = F.max(F.when(F.col("first") & F.col("marker"), F.col("line"))).over(within)
    said = said.withColumn("block", F.when(~F.col("ended"), opened))
    return said.select("file", "line", "said", "block", (F.col("marker") & ~F.col("first") & F.col("block").isNull()).alias("ignored"))


def _fold(file: str, block: int, rows: list[tuple[int, str]]) -> tuple[tuple, list[tuple], list[tuple]]:
    """Block (kind, name, end), clauses and findings of one block's lines."""
    kind = name = None
    rest, wrong = [], []
    for line, text in C.logical_lines(rows):
        m = re.match(r"\s*(kind|name)\s*:(.*)$", text, re.S)
        if m and m[1] == "kind":
            value = m[2].strip()
            if kind is not None or value not in schema.KINDS:
                wrong.append(("E0106", line, f"{value} is no kind, or a second one"))
            else:
                kind = value
        elif m:
            value = m[2].strip()
            if name is not None or not _WORD.fullmatch(value):
                wrong.append(("E0107", line, f"{value} is no name, or a second one"))
            else:
                name = value
        else:
            rest.append((line, text))
    parsed, bad = C.parse(rest)
    return (kind, name, max([block, *(line for line, _ in rows)])), parsed, wrong + bad


def python_declarations(text: str) -> list[tuple[int, int, str, str]]:
    """(line, end_line, identifier, kind) of what a Python file declares; none if it doesn't parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            out.append((first, node.end_lineno, node.name, "type" if isinstance(node, ast.ClassDef) else "function"))
        elif isinstance(node, (ast.Assign, ast.AnnAssign)):
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            names = {x.id for t in targets for x in ast.walk(t) if isinstance(x, ast.Name)}
            out.append((node.lineno, node.end_lineno, names.pop() if len(names) == 1 else None, "state"))
    return sorted(out, key=lambda r: (r[0], -r[1]))


def declarations(text: str, file: str) -> list[tuple[int, int, str, str]]:
    extension = "." + file.rpartition(".")[2]
    return python_declarations(text) if extension == ".py" else braces.line_declarations(text, extension) if extension in braces.LANGUAGES else []


def bind(file: str, text: str, blocks: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """Blocks (block, kind, name, end) with their subjects (identifier, line, end); findings.

    A block's subject is what is declared on the first non-blank line after it. E0102: nothing is, and the block has no name;
    E0104: several things are; E0108: a module, service or workflow without name; E0109: a language without grammar, without name.
    """
    rows = text.splitlines()
    declared = declarations(text, file)
    known = file.endswith(".py") or "." + file.rpartition(".")[2] in braces.LANGUAGES
    out, wrong = [], []
    for block, kind, name, end in blocks:
        at = next((i + 1 for i in range(end, len(rows)) if rows[i].strip()), None)
        found = [d for d in declared if d[0] == at]
        if kind in schema.SCOPES:
            if name is None:
                wrong.append(("E0108", block, f"a {kind} needs a name"))
            else:
                out.append((block, end, kind, name, None, None, None))
        elif not known:
            if name is None:
                wrong.append(("E0109", block, "without grammar a block needs a name"))
            else:
                out.append((block, end, kind or "function", name, None, None, None))
        elif len(found) > 1 and name is None:
            wrong.append(("E0104", block, "several declarations follow"))
        elif found and (name or found[0][2]):
            first, last, identifier, what = found[0]
            out.append((block, end, kind or what, name or identifier, identifier, first, last))
        elif name is not None:
            out.append((block, end, kind or "function", name, None, None, None))
        else:
            wrong.append(("E0102", block, "nothing is declared after the block"))
    return out, wrong


_SCANNED = "row string, file string, block int, line int, end_line int, kind string, name string, identifier string, subject_line int, subject_end int, clause string, ord int, value string"


_SCHEMA = pa.schema([(n, {"string": pa.string(), "int": pa.int32()}[t]) for n, t in (c.split() for c in _SCANNED.split(", "))])


def _scan_file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for file, text, said in zip(*(batch.column(c).to_pylist() for c in ("file", "text", "said"))):
            groups: dict[int, list[tuple[int, str]]] = {}
            for r in said:
                groups.setdefault(r["block"], []).append((r["line"], r["said"]))
            folded = {b: _fold(file, b, sorted(x for x in rows if x[0] != b)) for b, rows in groups.items()}
            bound, wrong = bind(file, text, [(b, *folded[b][0]) for b in sorted(folded)])
            out += [("block", file, b, b, *x, None, None, None) for b, *x in bound]
            kept = {b for b, *_ in bound}
            out += [("finding", file, None, line, None, code, None, None, None, None, None, None, message) for code, line, message in [*wrong, *(w for f in folded.values() for w in f[2])]]
            out += [("clause", file, b, line, None, None, None, None, None, None, c, o, v) for b in kept for c, o, v, line in folded[b][1]]
        yield pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, r)) for r in out], schema=_SCHEMA)


def scan(sources: DataFrame, globs: DataFrame, marker: str = MARKER) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Declared nodes, clauses and findings of (file, text).

    Names lie in the file's module: that of the first glob that matches, unless the file's first block is a module, service or
    workflow, which then stands for it. A step lies in the nearest workflow before it (E0105 without one). Files
    without module give ``_orphan`` names (W0208).
    """
    from .. import shared
    from .lint import first_glob

    marked = shared.written(marked_lines(sources, marker), "marked")
    held = marked.filter("block IS NOT NULL").groupBy("file").agg(F.collect_list(F.struct("block", "line", "said")).alias("said"))
    rows = shared.written(sources.join(held, "file").select("file", "text", "said").mapInArrow(_scan_file, _SCANNED), "scanned")
    order = Window.partitionBy("file").orderBy("block")
    blocks = first_glob(rows.filter("row = 'block'").drop("row", "clause", "ord", "value"), globs)
    scoping = F.col("kind").isin(schema.SCOPES)
    own = F.first(F.struct(scoping.alias("is"), F.col("name"))).over(order)
    blocks = blocks.withColumn("own", own).withColumn("first", F.row_number().over(order) == 1)
    blocks = blocks.withColumn("workflow", F.last(F.when(F.col("kind") == "workflow", F.struct("block", "name", "first")), True).over(order))
    base = F.when(F.col("own.is"), F.col("own.name")).otherwise(F.coalesce("module", F.lit("_orphan")))
    flow = F.when(F.col("workflow.first"), F.col("workflow.name")).otherwise(F.concat_ws(".", base, "workflow.name"))
    qname = F.when(scoping & F.col("first"), F.col("name")).when((F.col("kind") == "step") & F.col("workflow").isNotNull(), F.concat_ws(".", flow, "name")).otherwise(F.concat_ws(".", base, "name"))
    blocks = blocks.withColumn("qname", qname)
    lost = (F.col("kind") == "step") & F.col("workflow").isNull()
    named = blocks.filter(~lost)
    ids = named.select("file", "block", "qname")
    nodes = named.select("qname", "kind", F.lit("Declared").alias("origin"), "file", "line", F.lit(True).alias("annotated"), F.col("block").cast("bigint").alias("ord"), "end_line", "identifier", "subject_line", "subject_end", "module")
    clauses = rows.filter("row = 'clause'").select("file", "block", "clause", "ord", "value", "line").join(ids, ["file", "block"]).select("qname", "clause", "ord", "value", "file", "line")
    issue = lambda df, code, line, message: df.select(F.lit(code).alias("code") if isinstance(code, str) else code.alias("code"), "file", F.col(line).alias("line") if isinstance(line, str) else line.alias("line"), message.alias("message"))
    found = issue(rows.filter("row = 'finding'"), F.col("kind"), "line", F.col("value"))
    found = found.unionByName(issue(marked.filter("ignored"), "W0110", "line", F.lit("a marker after a comment line begins no block")))
    found = found.unionByName(issue(blocks.filter(lost), "E0105", "line", F.lit("a step needs a workflow before it")))
    found = found.unionByName(issue(blocks.filter("ambiguous").select("file").distinct(), "E0103", F.lit(1), F.lit("globs name different modules")))
    found = found.unionByName(issue(blocks.filter(~lost & F.startswith("qname", F.lit("_orphan."))).select("file").distinct(), "W0208", F.lit(1), F.lit("the file lies in no module")))
    return nodes, clauses, found
