"""Facts of source files (Python here, languages with braces in ``braces``): declarations, calls, imports and touches of states, for ``operators.resolution``."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import braces

EXTENSIONS = [".py", *braces.LANGUAGES]

FACTS = "fact string, file string, idx int, name string, kind string, line int, end_line int, parent int, shape string, obj string, class_decl int, enclosing int, form string, alias string, module string, write boolean"
_TYPES = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
_SCHEMA = pa.schema([(n, _TYPES[t]) for n, t in (c.split() for c in FACTS.split(", "))])
#: changes whenever the same text gives other facts
VERSION = "3"
#: methods that change what they are called on
MUTATORS = {"append", "extend", "insert", "remove", "pop", "clear", "update", "add", "discard", "setdefault", "popitem", "sort"}


class _Reader(ast.NodeVisitor):
    def __init__(self, file: str):
        self.file, self.rows, self.decls = file, [], 0
        self.calls = self.imports = self.touches = 0
        #: enclosing declarations (idx, kind); None: a lambda
        self.stack: list[tuple[int, str] | None] = []
        self.made: list[dict[str, int]] = [{}]
        self.classes: dict[str, int] = {}

    def add(self, fact: str, idx: int, **values) -> None:
        self.rows.append({"fact": fact, "file": self.file, "idx": idx} | values)

    def enclosing(self) -> int | None:
        return self.stack[-1][0] if self.stack and self.stack[-1] and self.stack[-1][1] == "function" else None

    def _declare(self, node, kind: str) -> None:
        parent = next((s[0] for s in reversed(self.stack) if s), None)
        idx, self.decls = self.decls, self.decls + 1
        self.add("decl", idx, name=node.name, kind=kind, line=min([node.lineno, *(d.lineno for d in node.decorator_list)]), end_line=node.end_lineno, parent=parent)
        if kind == "type":
            self.classes[node.name] = idx
        # what runs where the declaration stands: decorators, defaults, annotations, bases
        outside = [*node.decorator_list]
        if kind == "type":
            outside += [*node.bases, *(k.value for k in node.keywords)]
        else:
            a = node.args
            every = [*a.posonlyargs, *a.args, *a.kwonlyargs, *(x for x in (a.vararg, a.kwarg) if x)]
            outside += [*a.defaults, *(x for x in a.kw_defaults if x), *(x.annotation for x in every if x.annotation), *([node.returns] if node.returns else [])]
        for x in outside:
            self.visit(x)
        self.stack.append((idx, kind))
        self.made.append({})
        for child in node.body:
            self.visit(child)
        self.stack.pop()
        self.made.pop()

    def visit_FunctionDef(self, node) -> None:
        self._declare(node, "function")

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node) -> None:
        self._declare(node, "type")

    def visit_Lambda(self, node) -> None:
        self.stack.append(None)
        self.generic_visit(node)
        self.stack.pop()

    def visit_Import(self, node) -> None:
        for a in node.names:
            self.add("import", self.imports, form="Whole", module=a.name, alias=a.asname or a.name, line=node.lineno)
            self.imports += 1

    def visit_ImportFrom(self, node) -> None:
        dots = "./" if node.level == 1 else "../" * (node.level - 1)
        module = dots + (node.module or "").replace(".", "/") if node.level else node.module
        for a in node.names:
            if a.name != "*":
                self.add("import", self.imports, form="Named", module=module, name=a.name, alias=a.asname or a.name, line=node.lineno)
                self.imports += 1

    def _construction(self, target, value) -> None:
        """Remember that a name holds an object of a class of this file."""
        if isinstance(target, ast.Name) and isinstance(value, ast.Call) and isinstance(value.func, ast.Name) and value.func.id in self.classes:
            self.made[-1][target.id] = self.classes[value.func.id]

    def visit_Assign(self, node) -> None:
        if len(node.targets) == 1:
            self._construction(node.targets[0], node.value)
        self.generic_visit(node)

    def visit_AnnAssign(self, node) -> None:
        self._construction(node.target, node.value)
        if node.value is not None:
            self.generic_visit(node)
        else:
            self.visit(node.annotation)

    def visit_AugAssign(self, node) -> None:
        self._touch(node.target, True)
        self.visit(node.value)

    @staticmethod
    def _path(node) -> str | None:
        if isinstance(node, ast.Name):
            return node.id
        if isinstance(node, ast.Attribute) and (base := _Reader._path(node.value)):
            return f"{base}.{node.attr}"
        return None

    def _touch(self, node, write: bool) -> None:
        root = node
        while isinstance(root, ast.Subscript):
            self.visit(root.slice)
            root = root.value
        if path := self._path(root):
            self.add("touch", self.touches, name=path, write=write, enclosing=self.enclosing(), line=node.lineno)
            self.touches += 1
        else:
            self.generic_visit(root)

    def visit_Call(self, node) -> None:
        f, values = node.func, {}
        if isinstance(f, ast.Name):
            values = {"shape": "Bare", "name": f.id}
        elif isinstance(f, ast.Attribute) and (obj := self._path(f.value)):
            made = self.made[-1].get(obj)
            values = {"shape": "Method", "name": f.attr, "obj": obj, "class_decl": made} if made is not None else {"shape": "Attr", "name": f.attr, "obj": obj}
            self._touch(f.value, f.attr in MUTATORS)
        else:
            values = {"shape": "Opaque"}
            self.visit(f)
        self.add("call", self.calls, enclosing=self.enclosing(), line=node.lineno, **values)
        self.calls += 1
        for x in [*node.args, *(k.value for k in node.keywords)]:
            self.visit(x)

    def visit_Name(self, node) -> None:
        self._touch(node, isinstance(node.ctx, (ast.Store, ast.Del)))

    def visit_Attribute(self, node) -> None:
        self._touch(node, isinstance(node.ctx, (ast.Store, ast.Del)))

    def visit_Subscript(self, node) -> None:
        self._touch(node, isinstance(node.ctx, (ast.Store, ast.Del)))


def python_facts(file: str, text: str) -> list[dict]:
    """Facts of one file; of one that doesn't parse a single row of fact "unparsed"."""
    reader = _Reader(file)
    try:
        for node in ast.parse(text).body:
            reader.visit(node)
    except (SyntaxError, ValueError, RecursionError):
        return [{"fact": "unparsed", "file": file, "idx": 0}]
    return reader.rows


def file_facts(file: str, text: str) -> list[dict]:
    if file.endswith(".py"):
        return python_facts(file, text)
    try:
        return braces.facts(file, text)
    except (RecursionError, IndexError):
        return [{"fact": "unparsed", "file": file, "idx": 0}]


def facts(sources: DataFrame) -> DataFrame:
    """All facts of (file, text) in the languages that are known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for f, t in zip(*(batch.column(c).to_pylist() for c in ("file", "text"))) for r in file_facts(f, t or "")]
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return sources.filter(F.exists(F.array(*map(F.lit, EXTENSIONS)), lambda e: F.endswith("file", e))).select("file", "text").mapInArrow(run, FACTS)
