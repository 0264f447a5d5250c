"""Declarations and facts of languages with braces (TypeScript and JavaScript, Go, Java, Rust), by a lexer that knows strings and comments."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

LANGUAGES = {".ts": "ts", ".tsx": "ts", ".js": "ts", ".jsx": "ts", ".go": "go", ".java": "java", ".rs": "rust"}
_NO_CALL = set("if for while switch catch return function func fn match await typeof new super throw else loop in of delete void synchronized select defer go range import use package mod".split())
_PATH = r"[A-Za-z_$][\w$]*(?:\s*(?:\.|::|\?\.)\s*[A-Za-z_$][\w$]*)*"
_CALL = re.compile(rf"({_PATH})\s*(?:::\s*<[^<>()]*>\s*)?!?\s*\(")
_WRITE = re.compile(rf"(?<![\w$.])({_PATH})\s*(?:\[[^\[\]]*\]\s*)*(?:[-+*/%&|^]|<<|>>|\*\*|\?\?|\|\||&&)?=(?![=>])")
_NAME = re.compile(rf"(?<![\w$.])({_PATH})")
#: methods that change what they are called on
_MUTATORS = set("push pop shift unshift splice sort reverse add delete clear set put remove insert extend append addAll removeAll putAll push_str push_back push_front pop_back pop_front retain truncate drain".split())
_MODS = r"(?:(?:public|private|protected|abstract|final|static|synchronized|default|native|sealed|strictfp)\s+)*"
_FORMS = {
    "ts": [
        ("function", r"(?:^|(?<=[\s;{}(]))(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s+(?P<n>[\w$]+)"), ("type", r"(?:^|(?<=[\s;{}]))(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:class|interface|enum)\s+(?P<n>[\w$]+)"),
        ("function", r"(?:^|(?<=[\s;{}]))(?:export\s+)?(?:const|let|var)\s+(?P<n>[\w$]+)\s*(?::[^=;]+)?=\s*(?:async\s*)?(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|[\w$]+)\s*(?::[^=;{]+)?=>"),
        ("state", r"(?:^|(?<=[\s;{}]))(?:export\s+)?(?:const|let|var)\s+(?P<n>[\w$]+)\s*(?=[:=;\n])"),
        ("method", r"(?<=[;{}\n])[ \t]*(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*\*?\s*(?P<n>[\w$#]+)\s*(?:<[^<>()]*>)?\s*\((?=[^;{}]*\)[^;{}()]*\{)"),
    ],
    "go": [("function", r"^func\s+(?:\([^)]*\)\s*)?(?P<n>\w+)"), ("type", r"^type\s+(?P<n>\w+)"), ("state", r"^(?:var|const)\s+(?P<n>\w+)")],
    "java": [("type", rf"(?:^|(?<=[\s;{{}}])){_MODS}(?:class|interface|enum|record)\s+(?P<n>\w+)"), ("method", rf"(?<=[;{{}}\n])[ \t]*(?:@\w+(?:\([^()]*\))?\s+)*{_MODS}(?:<[^<>()]*>\s*)?(?:[\w.]+(?:<[^(){{}};]*>)?(?:\[\])*\s+)?(?P<n>\w+)\s*\((?=[^;{{}}]*\)[^;{{}}()]*\{{)"), ("field", rf"(?<=[;{{}}\n])[ \t]*(?:@\w+\s+)*(?:(?:public|private|protected|final|static|volatile|transient)\s+)+[\w.]+(?:<[^(){{}};]*>)?(?:\[\])*\s+(?P<n>\w+)\s*(?=[=;])")],
    "rust": [("function", r"(?:^|(?<=[\s;{}]))(?:pub(?:\([^)]*\))?\s+)?(?:default\s+)?(?:async\s+|const\s+|unsafe\s+|extern\s+)*fn\s+(?P<n>\w+)"), ("type", r"(?:^|(?<=[\s;{}]))(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait|union)\s+(?P<n>\w+)"), ("state", r"(?:^|(?<=[\s;{}]))(?:pub(?:\([^)]*\))?\s+)?(?:static|const)\s+(?:mut\s+)?(?P<n>[A-Z_]\w*)\s*:")],
}
_FORMS = {k: [(kind, re.compile(p, re.M)) for kind, p in v] for k, v in _FORMS.items()}
_KIND = {"method": "function", "field": "state"}


def blanked(text: str, language: str) -> str:
    """The text with blanks in place of what stands in comments and strings; as long, with the same line breaks."""
    out, i, n = list(text), 0, len(text)
    #: depths of braces at which a template's inserted code ends
    inserted: list[int] = []
    depth = 0

    def blank(a: int, b: int) -> None:
        for k in range(a, b):
            if out[k] != "\n":
                out[k] = " "

    def template(at: int) -> int:
        """From within a template on, to its end or the next inserted code."""
        j = at
        while j < n and text[j] != "`" and not text.startswith("${", j):
            j += 2 if text[j] == "\\" else 1
        blank(at, min(j, n))
        if text.startswith("${", j):
            inserted.append(depth)
            blank(j, j + 2)
            return j + 2
        return j + 1

    while i < n:
        c = text[i]
        if text.startswith("//", i):
            j = text.find("\n", i)
            j = n if j < 0 else j
            blank(i, j)
            i = j
        elif text.startswith("/*", i):
            level, j = 1, i + 2
            while j < n and level:
                if text.startswith("*/", j):
                    level, j = level - 1, j + 2
                elif language == "rust" and text.startswith("/*", j):
                    level, j = level + 1, j + 2
                else:
                    j += 1
            blank(i, j)
            i = j
        elif language == "java" and text.startswith('"""', i):
            j = text.find('"""', i + 3)
            j = n if j < 0 else j
            blank(i + 3, j)
            i = j + 3
        elif language == "rust" and (m := re.compile(r'b?r(#*)"').match(text, i)) and not (i and (text[i - 1].isalnum() or text[i - 1] == "_")):
            j = text.find('"' + m[1], m.end())
            j = n if j < 0 else j
            blank(m.end(), j)
            i = j + 1 + len(m[1])
        elif c == "`" and language in ("ts", "go"):
            if language == "go":
                j = text.find("`", i + 1)
                j = n if j < 0 else j
                blank(i + 1, j)
                i = j + 1
            else:
                i = template(i + 1)
        elif c == "'" and language == "rust" and not re.compile(r"'(?:\\.[^']*|[^\\'])'").match(text, i):
            i += 1  # a lifetime
        elif c in "\"'":
            j = i + 1
            while j < n and text[j] != c and (text[j] != "\n" or language == "rust"):
                j += 2 if text[j] == "\\" else 1
            blank(i + 1, min(j, n))
            i = j + 1
        else:
            if c == "}" and inserted and depth == inserted[-1]:
                inserted.pop()
                blank(i, i + 1)
                i = template(i + 1)
            else:
                depth += (c == "{") - (c == "}")
                i += 1
    return "".join(out)


@dataclass
class Declaration:
    start: int
    end: int
    name: str
    kind: str
    #: where what it holds begins, and its name
    body: int
    at: int
    parent: int | None = None


def _extent(bare: str, at: int, kind: str, go: bool) -> tuple[int, int]:
    """Begin of the body and end of a declaration whose name ends at ``at``: the matching brace, or the end of the statement."""
    depth, body = 0, None
    for i in range(at, len(bare)):
        c = bare[i]
        if c in "([{":
            if c == "{" and depth == 0 and body is None:
                body = i
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth < 0:
                return body if body is not None else i, i
            if c == "}" and depth == 0 and body is not None and (kind != "state" or go):
                return body, i + 1
        elif depth == 0 and (c == ";" or c == "\n" and (kind == "state" or go) and not re.match(r"\s*[.?:=+*/&|,-]", bare[i:])) and (body is None or kind == "state"):
            if c == "\n" and bare[at:i].strip() == "" and not go:
                continue
            return body if body is not None else i, i
    return body if body is not None else len(bare), len(bare)


def declarations(text: str, language: str) -> tuple[str, list[Declaration]]:
    bare = blanked(text, language)
    found: dict[int, Declaration] = {}
    for kind, pattern in _FORMS[language]:
        for m in pattern.finditer(bare):
            name, at = m["n"], m.end("n")
            if name in _NO_CALL or m.start("n") in found:
                continue
            body, end = _extent(bare, at, _KIND.get(kind, kind), language == "go")
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            found[m.start("n")] = Declaration(start, end, name, _KIND.get(kind, kind), body, m.start("n"))
    out = sorted(found.values(), key=lambda d: (d.start, -d.end))
    stack: list[int] = []
    kept: list[Declaration] = []
    for d in out:
        while stack and kept[stack[-1]].end <= d.start:
            stack.pop()
        inside = stack[-1] if stack else None
        if inside is not None and kept[inside].kind == "function" and d.kind == "state":
            continue  # a local name
        if inside is not None and kept[inside].kind == "state":
            continue
        d.parent = inside
        kept.append(d)
        stack.append(len(kept) - 1)
    return bare, kept


def line_declarations(text: str, extension: str) -> list[tuple[int, int, str, str]]:
    """(line, end_line, identifier, kind)"""
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    line = lambda at: bisect_right(starts, at)
    _, found = declarations(text, LANGUAGES[extension])
    return [(line(d.start), line(max(d.start, d.end - 1)), d.name, d.kind) for d in found]


def _imports(text: str, bare: str, language: str) -> list[dict]:
    """form, module, name, alias, line of each import; strings are read from the text, places from where it isn't blank."""
    out = []

    def add(at: int, form: str, module: str, alias: str, name: str | None = None) -> None:
        out.append({"form": form, "module": module, "alias": alias, "name": name, "line": text.count("\n", 0, at) + 1})

    if language == "ts":
        for m in re.finditer(r"^\s*import\s+(?:type\s+)?([^'\";]*?)\s*(?:from\s*)?['\"]([^'\"\n]+)['\"]", text, re.M):
            if bare[m.start(1) : m.end(1)] != m[1]:
                continue
            if w := re.search(r"\*\s+as\s+([\w$]+)", m[1]):
                add(m.start(), "Whole", m[2], w[1])
            if b := re.search(r"\{([^}]*)\}", m[1]):
                for part in b[1].split(","):
                    words = part.replace("type ", "").split()
                    if words:
                        add(m.start(), "Named", m[2], words[-1], words[0])
            if d := re.match(r"([\w$]+)\s*(?:,|$)", m[1]):
                add(m.start(), "Named", m[2], d[1], "default")
    elif language == "go":
        for m in re.finditer(r'^\s*(?:import\s+)?(?:([\w.]+)\s+)?"([^"\n]+)"', text, re.M):
            head = bare[: m.start(2)]
            if re.search(r"\bimport\s*(?:\([^()]*)?$", re.sub(r'"\s*"', " ", head)) or text[m.start() : m.end()].lstrip().startswith("import"):
                add(m.start(2), "Whole", m[2], m[1] or m[2].rpartition("/")[2])
    elif language == "java":
        for m in re.finditer(r"^\s*import\s+(?:static\s+)?([\w.]+)\s*;", bare, re.M):
            add(m.start(1), "Whole", m[1], m[1].rpartition(".")[2])
    else:
        for m in re.finditer(r"\buse\s+([^;]+);", bare):
            for path, alias in _use_tree(m[1]):
                module, _, name = path.rpartition("::")
                add(m.start(), "Named", module or path, alias, name)
                add(m.start(), "Whole", path, alias)
    return out


def _use_tree(text: str, prefix: str = "") -> list[tuple[str, str]]:
    """(path, alias) of each leaf of a use declaration."""
    out, depth, last, parts = [], 0, 0, []
    for i, c in enumerate(text):
        depth += (c == "{") - (c == "}")
        if c == "," and depth == 0:
            parts.append(text[last:i])
            last = i + 1
    for part in [*parts, text[last:]]:
        part = part.strip()
        if m := re.fullmatch(r"(?:(.*?)::)?\s*\{(.*)\}", part, re.S):
            out += _use_tree(m[2], prefix + (m[1].strip() + "::" if m[1] else ""))
        elif part and not part.endswith("*"):
            path, _, alias = (x.strip() for x in part.partition(" as "))
            path = prefix.removesuffix("::") if path == "self" else prefix + path
            out.append((path, alias or path.rpartition("::")[2]))
    return out


def facts(file: str, text: str) -> list[dict]:
    """The facts of one file, in the form of ``extract.python_facts``."""
    language = LANGUAGES["." + file.rpartition(".")[2]]
    bare, found = declarations(text, language)
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    line = lambda at: bisect_right(starts, at)
    rows: list[dict] = []
    add = lambda fact, idx, **values: rows.append({"fact": fact, "file": file, "idx": idx} | values)
    for i, d in enumerate(found):
        add("decl", i, name=d.name, kind=d.kind, line=line(d.start), end_line=line(max(d.start, d.end - 1)), parent=d.parent)

    def enclosing(at: int) -> int | None:
        inside = [i for i, d in enumerate(found) if d.kind == "function" and d.body <= at < d.end]
        return inside[-1] if inside else None

    imports = _imports(text, bare, language)
    for i, x in enumerate(imports):
        add("import", i, **x)
    import_lines = {x["line"] for x in imports}
    named = {d.at for d in found}
    path = lambda p: re.sub(r"\s*(?:::|\?\.|\.)\s*", ".", p).removeprefix("this.").removeprefix("self.")
    n_calls = n_touches = 0
    called: set[int] = set()
    for m in _CALL.finditer(bare):
        full = path(m[1])
        obj, _, name = full.rpartition(".")
        if name in _NO_CALL or obj in _NO_CALL or line(m.start()) in import_lines:
            continue
        if m.start(1) in named:
            continue
        called.add(m.start(1))
        own = m[1].startswith(("this", "self"))
        add("call", n_calls, shape="Attr" if obj and not own else "Bare", name=name, obj=obj or None, enclosing=enclosing(m.start()), line=line(m.start()))
        n_calls += 1
        if obj:
            add("touch", n_touches, name=obj, write=name in _MUTATORS, enclosing=enclosing(m.start()), line=line(m.start()))
            n_touches += 1
    written = {m.start(1) for m in _WRITE.finditer(bare)}
    for m in _NAME.finditer(bare):
        if m.start() in called or m.start() in named or line(m.start()) in import_lines or (where := enclosing(m.start())) is None:
            continue
        name = path(m[1])
        if name not in _NO_CALL:
            add("touch", n_touches, name=name, write=m.start() in written, enclosing=where, line=line(m.start()))
            n_touches += 1
    return rows
