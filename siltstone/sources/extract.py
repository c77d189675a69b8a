"""Structural extraction of source files in three tiers and into graph tables.

Python is parsed with its own grammar. For the other languages no parser is at
hand, so declarations are recognised by line patterns and matching of brackets,
a documented subset: top-level and member declarations that begin on a line of
their own. In Go, comments and strings are blanked first; in the others,
strings that hold brackets or declarations can mislead it.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from siltstone.work import dealt

TIERS = "symbols string, definitions string, data string"


@dataclass
class Item:
    """A declaration: its kind, name, lines, header text and for types their members."""

    kind: str
    name: str
    first: int
    last: int
    text: str
    owner: str = ""
    params: list[str] = field(default_factory=list)
    returns: list[str] = field(default_factory=list)
    members: list[tuple[str, str]] = field(default_factory=list)


@dataclass
class Structure:
    """What a file declares."""

    package: str = ""
    imports: list[tuple[str, int]] = field(default_factory=list)
    items: list[Item] = field(default_factory=list)
    calls: list[tuple[str, str, int]] = field(default_factory=list)


def _span(lines: list[str], start: int) -> int:
    """Last line of the block that opens at or after line index ``start``."""
    depth, opened = 0, False
    for i in range(start, len(lines)):
        for c in lines[i]:
            if c == "{":
                depth, opened = depth + 1, True
            elif c == "}":
                depth -= 1
        if opened and depth <= 0:
            return i
        if not opened and lines[i].rstrip().endswith(";"):
            return i
    return start if not opened else len(lines) - 1


def _split(text: str) -> list[str]:
    """Comma-separated parts outside of brackets."""
    parts, depth, now = [], 0, ""
    for c in text:
        depth += (c in "([{<") - (c in ")]}>")
        if c == "," and depth == 0:
            parts.append(now)
            now = ""
        else:
            now += c
    return [p.strip() for p in [*parts, now] if p.strip()]


def _balanced(text: str, start: int) -> int:
    """Index after the bracket that closes the one at ``start``."""
    depth = 0
    for i in range(start, len(text)):
        depth += (text[i] == "(") - (text[i] == ")")
        if depth == 0:
            return i + 1
    return len(text)


def python_structure(text: str) -> Structure:
    """Classes, functions, methods, constants, imports and calls of a Python file; nothing if it doesn't parse."""
    out = Structure()
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return out
    lines = text.split("\n")

    def function(node: ast.FunctionDef | ast.AsyncFunctionDef, owner: str) -> None:
        arguments = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]
        params = [a.arg + (f": {ast.unparse(a.annotation)}" if a.annotation else "") for a in arguments]
        returns = [ast.unparse(node.returns)] if node.returns else []
        head = lines[node.lineno - 1 : node.body[0].lineno - 1] or [lines[node.lineno - 1]]
        out.items.append(Item("method" if owner else "function", node.name, node.lineno, node.end_lineno or node.lineno, "\n".join(head).rstrip(), owner, params, returns))
        name = f"{owner}.{node.name}" if owner else node.name
        for inner in ast.walk(node):
            if isinstance(inner, ast.Call):
                out.calls.append((name, ast.unparse(inner.func), inner.lineno))

    for node in tree.body:
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            module = "." * getattr(node, "level", 0) + (getattr(node, "module", None) or "")
            out.imports += [(module or alias.name, node.lineno) for alias in node.names]
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            function(node, "")
        elif isinstance(node, ast.ClassDef):
            members = [(t.id, "") for n in node.body if isinstance(n, ast.Assign) for t in n.targets if isinstance(t, ast.Name)]
            members += [(n.target.id, ast.unparse(n.annotation)) for n in node.body if isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name)]
            out.items.append(Item("class", node.name, node.lineno, node.end_lineno or node.lineno, lines[node.lineno - 1].rstrip(), "", [], [ast.unparse(b) for b in node.bases], members))
            for inner in node.body:
                if isinstance(inner, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    function(inner, node.name)
        elif isinstance(node, (ast.Assign, ast.AnnAssign)):
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            for target in targets:
                if isinstance(target, ast.Name):
                    kind = "constant" if target.id.isupper() else "variable"
                    out.items.append(Item(kind, target.id, node.lineno, node.end_lineno or node.lineno, "\n".join(lines[node.lineno - 1 : node.end_lineno])))
    return out


_GO_FUNC = re.compile(r"func\s+(?:\(\s*(?:\w+\s+)?(\*?)(\w+)(?:\[[^\]]*\])?\s*\)\s*)?(\w+)\s*(?:\[[^\]]*\])?\(")
_GO_TYPE = re.compile(r"(?:type\s+)?(\w+)\s+(struct|interface)\b|type\s+(\w+)\s*=?\s*([\w.\[\]*]+)")
_GO_VALUE = re.compile(r"(const|var)\s+(\w+)")
_GO_CALL = re.compile(r"\b((?:\w+\.)*\w+)\(")
# Words before a bracket that aren't calls.
_GO_WORDS = {"func", "if", "for", "switch", "select", "return", "go", "defer", "make", "new", "len", "cap", "append", "copy", "delete", "panic", "recover", "print", "println", "close", "string", "int", "int64", "float64", "byte", "error", "range"}


_GO_QUOTED = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|`[^`]*(?:`|\Z)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'""", re.S)


def go_code(text: str) -> str:
    """The text with comments, strings and runes blanked; line ends and columns stay."""
    return _GO_QUOTED.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def go_structure(text: str) -> Structure:
    """Types, functions, methods, values, imports and calls of a Go file.

    Declarations and brackets are looked for outside of comments and strings.
    """
    out, lines, code = Structure(), text.split("\n"), go_code(text).split("\n")
    i, group = 0, ""
    while i < len(lines):
        line = code[i]
        bare = line.strip()
        if match := re.match(r"package\s+(\w+)", line):
            out.package = match[1]
        elif re.match(r"import\s*\(", line):
            group = "import"
        elif re.match(r"import\s", line) and (match := re.match(r'import\s+(?:[\w.]+\s+)?"([^"]+)"', lines[i])):
            out.imports.append((match[1], i + 1))
        elif match := re.match(r"(const|var|type)\s*\($", line.rstrip()):
            group = match[1]
        elif bare == ")" and group:
            group = ""
        elif group == "import":
            if match := re.match(r'\s*(?:[\w.]+\s+)?"([^"]+)"', lines[i]):
                out.imports.append((match[1], i + 1))
        elif group in ("const", "var"):
            if match := re.match(r"(\w+)", bare):
                out.items.append(Item("constant" if group == "const" else "variable", match[1], i + 1, i + 1, lines[i].strip()))
        elif (line.startswith("type ") or group == "type") and (match := _GO_TYPE.match(bare)):
            name, kind = match[1] or match[3], match[2] or "alias"
            last = _span(code, i) if kind in ("struct", "interface") and "{" in line else i
            item = Item(kind, name, i + 1, last + 1, "\n".join(lines[i : last + 1]), "", [], [match[4]] if match[4] else [])
            for member in code[i + 1 : last]:
                member = member.strip()
                if found := re.match(r"(\w+)\s*(\(.*)", member):
                    item.members.append((found[1] + "()", found[2]))
                elif found := re.match(r"([\w, ]+?)\s+([^`]+)", member):
                    item.members += [(n.strip(), found[2].strip()) for n in found[1].split(",")]
                elif re.fullmatch(r"\*?[\w.]+", member):
                    item.members.append(("", member))
            out.items.append(item)
            i = last
        elif line.startswith("func ") and (match := _GO_FUNC.match(line)):
            last = _span(code, i)
            head = "\n".join(part.rstrip() for part in code[i : last + 1]).split("{\n")[0]
            opening = match.end() - 1
            closing = _balanced(head, opening)
            tail = head[closing:].strip().rstrip("{").strip()
            returns = _split(tail[1:-1]) if tail.startswith("(") and tail.endswith(")") else ([tail] if tail else [])
            owner = match[2] or ""
            out.items.append(Item("method" if owner else "function", match[3], i + 1, last + 1, head.split("\n")[0].rstrip("{ ").rstrip(), owner, _split(head[opening + 1 : closing - 1]), returns))
            name = f"{owner}.{match[3]}" if owner else match[3]
            for at in range(i + 1, last + 1):
                out.calls += [(name, c, at + 1) for c in _GO_CALL.findall(code[at]) if c not in _GO_WORDS]
            i = last
        elif match := _GO_VALUE.match(line):
            out.items.append(Item("constant" if match[1] == "const" else "variable", match[2], i + 1, i + 1, lines[i].strip()))
        i += 1
    return out


# Declaration patterns of languages with brackets or ends: (kind, pattern with the name in its last group).
_RULES: dict[str, list[tuple[str, str]]] = {
    "typescript": [
        ("import", r"import\b.*?from\s+['\"]([^'\"]+)"), ("class", r"(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"), ("interface", r"(?:export\s+)?interface\s+(\w+)"),
        ("enum", r"(?:export\s+)?(?:const\s+)?enum\s+(\w+)"), ("type", r"(?:export\s+)?type\s+(\w+)"), ("function", r"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\*?\s+(\w+)"), ("constant", r"(?:export\s+)?const\s+(\w+)"), ("variable", r"(?:export\s+)?(?:let|var)\s+(\w+)"),
    ],
    "rust": [
        ("import", r"use\s+([\w:{}, *]+)"), ("struct", r"(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)"), ("enum", r"(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)"), ("trait", r"(?:pub\s+)?trait\s+(\w+)"), ("impl", r"impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?(\w+)"),
        ("function", r"\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)"), ("constant", r"(?:pub\s+)?(?:const|static)\s+(?:mut\s+)?(\w+)"),
    ],
    "c": [
        ("import", r"#include\s+[<\"]([^>\"]+)"), ("constant", r"#define\s+(\w+)"), ("struct", r"(?:typedef\s+)?struct\s+(\w+)\s*\{?"), ("enum", r"(?:typedef\s+)?enum\s+(\w+)"), ("class", r"class\s+(\w+)"), ("namespace", r"namespace\s+(\w+)"),
        ("function", r"(?!return|else|typedef|using)[\w:<>*&\s]+?[\s*&](\w+)\s*\([^;]*$"),
    ],
    "java": [
        ("import", r"import\s+(?:static\s+)?([\w.*]+)"), ("class", r"(?:public\s+|private\s+|protected\s+|abstract\s+|final\s+|static\s+)*class\s+(\w+)"), ("interface", r"(?:public\s+|private\s+|protected\s+)*interface\s+(\w+)"), ("enum", r"(?:public\s+|private\s+|protected\s+)*enum\s+(\w+)"),
        ("constant", r"\s+(?:public\s+|private\s+|protected\s+)*static\s+final\s+[\w<>\[\]]+\s+(\w+)"), ("method", r"\s+(?:public\s+|private\s+|protected\s+|static\s+|final\s+|abstract\s+|synchronized\s+)+[\w<>\[\], ]*?(\w+)\s*\("),
    ],
    "php": [
        ("import", r"use\s+([\w\\]+)"), ("class", r"(?:abstract\s+|final\s+)*class\s+(\w+)"), ("interface", r"interface\s+(\w+)"), ("trait", r"trait\s+(\w+)"), ("constant", r"\s*(?:public\s+|private\s+)?const\s+(\w+)"), ("function", r"\s*(?:public\s+|private\s+|protected\s+|static\s+|abstract\s+)*function\s+(\w+)"),
    ],
    "ruby": [("import", r"require(?:_relative)?\s+['\"]([^'\"]+)"), ("class", r"\s*class\s+(\w+)"), ("module", r"\s*module\s+(\w+)"), ("method", r"\s*def\s+([\w.?!]+)"), ("constant", r"\s*([A-Z][A-Z0-9_]+)\s*=")],
}
_RULES["javascript"], _RULES["cpp"] = _RULES["typescript"], _RULES["c"]
_COMPILED = {language: [(kind, re.compile(p)) for kind, p in rules] for language, rules in _RULES.items()}


def pattern_structure(text: str, language: str) -> Structure:
    """Declarations by the line patterns of a language."""
    out, lines = Structure(), text.split("\n")
    for i, line in enumerate(lines):
        for kind, pattern in _COMPILED.get(language, []):
            match = pattern.match(line)
            if match:
                if kind == "import":
                    out.imports.append((match[1].strip(), i + 1))
                elif kind in ("constant", "variable", "type"):
                    out.items.append(Item(kind, match[1], i + 1, i + 1, line.strip()))
                else:
                    last = _ruby_end(lines, i) if language == "ruby" else _span(lines, i)
                    out.items.append(Item(kind, match[1], i + 1, last + 1, line.rstrip().rstrip("{").strip()))
                break
    return out


def _ruby_end(lines: list[str], start: int) -> int:
    indent = len(lines[start]) - len(lines[start].lstrip())
    return next((i for i in range(start + 1, len(lines)) if lines[i].strip() == "end" and len(lines[i]) - len(lines[i].lstrip()) <= indent), len(lines) - 1)


def structure(text: str, language: str) -> Structure:
    """The declarations of a file."""
    if language == "python":
        return python_structure(text)
    if language == "go":
        return go_structure(text)
    return pattern_structure(text, language)


def _range(item: Item) -> str:
    return f"(line {item.first})" if item.first == item.last else f"(lines {item.first}-{item.last})"


def tiers(found: Structure) -> tuple[str, str, str]:
    """Texts of symbols (names with lines), definitions (code) and data (constants, then variables)."""
    types = [x for x in found.items if x.kind not in ("function", "method", "constant", "variable")]
    functions = [x for x in found.items if x.kind in ("function", "method")]
    values = [x for kind in ("constant", "variable") for x in found.items if x.kind == kind]
    parts = [f"Package: {found.package}"] if found.package else []
    if found.imports:
        parts.append(f"Imports: {len(found.imports)} packages")
    if types:
        parts.append("Types:\n" + "\n".join(f"  - {x.name} ({x.kind}) {_range(x)}" for x in types))
    if functions:
        parts.append("Functions:\n" + "\n".join(f"  - {x.owner + '.' if x.owner else ''}{x.name}({', '.join(x.params)}) {_range(x)}" for x in functions))
    coded = ["\n\n".join(f"// {_range(x)}\n{x.text}" for x in some) for some in (types + functions, values)]
    return "\n\n".join(parts), *coded


def extract_tiers(files: DataFrame, path_col: str = "file_path", text_col: str = "content", language_col: str = "language") -> DataFrame:
    """Rows (path, language, TIERS), extracted in parallel with the files dealt over the tasks."""
    kind = files.schema[path_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, language, *tiers(structure(text or "", language))) for p, text, language in frame.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=[path_col, language_col, "symbols", "definitions", "data"])

    return dealt(files.select(path_col, text_col, language_col), path_col).mapInPandas(run, f"{path_col} {kind}, {language_col} string, {TIERS}")


GRAPH = "record string, id string, file_path string, module_path string, owner string, name string, kind string, target string, position int, first_line int, last_line int, n_params int, n_returns int, is_exported boolean"


def _graph_rows(path: str, language: str, text: str) -> list[tuple]:
    """Rows of GRAPH: types, fields, functions, parameters, imports, calls and uses of types."""
    found = structure(text, language)
    module = path.rpartition("/")[0]
    package = module or "main"
    test = path.endswith("_test.go")
    rows: list[tuple] = []

    def add(record: str, key: str, name: str, kind: str, **more) -> None:
        rows.append((record, key, path, module, more.get("owner"), name, kind, more.get("target"), more.get("position"), more.get("first"), more.get("last"), more.get("params"), more.get("returns"), name[:1].isascii() and name[:1].isupper()))

    for source, line in found.imports:
        add("import", f"{path}::{source}", source, "imports", target=source, first=line)
    numbers: dict[str, int] = {}
    for item in found.items:
        if item.kind in ("function", "method"):
            key = f"{path}::{item.owner + '.' if item.owner else ''}{item.name}"
            add("function", key, item.name, item.kind, owner=f"{package}::{item.owner}" if item.owner else None, first=item.first, last=item.last, params=len(item.params), returns=len(item.returns))
            for label, values in (("param", item.params), ("return", item.returns)):
                for position, value in enumerate(values):
                    name, _, kind = value.rpartition(" ") if language == "go" else value.partition(":")[::1]
                    add(label, f"{key}::{label}{position}", name.strip(" :"), label, owner=key, target=(kind or value).strip(), position=position)
                    base = re.sub(r"^[*.\[\]]+", "", (kind or value).strip())
                    if base[:1].isupper() or "." in base:
                        add("uses_type", f"{key}->{base}", item.name, "uses_type", owner=key, target=base if "." in base else f"{package}::{base}")
        elif item.kind not in ("constant", "variable") and not test:
            key = f"{package}::{item.name}"
            add("type", key, item.name, item.kind, first=item.first, last=item.last, params=len(item.members))
            for position, (name, kind) in enumerate(item.members):
                method = name.endswith("()")
                bare = name.removesuffix("()")
                end = _balanced(kind, 0) if method else 0
                tail = kind[end:].strip()
                returns = len(_split(tail[1:-1])) if tail.startswith("(") else int(bool(tail))
                add("method_field" if method else "field", f"{key}::{bare or f'embedded{position}'}", bare, kind, owner=key, target=kind, position=position, params=len(_split(kind[1 : end - 1])) if method else None, returns=returns if method else None)
    for caller, callee, line in found.calls:
        number = numbers[caller] = numbers.get(caller, -1) + 1
        add("call", f"{path}::{caller}::call{number}", callee, "calls", owner=f"{path}::{caller}", target=callee, position=number, first=line)
    return rows


def extract_graph(files: DataFrame, path_col: str = "file_path", text_col: str = "content", language_col: str = "language") -> DataFrame:
    """Rows of GRAPH for all files; files that don't parse give none."""
    names = [c.split()[0] for c in GRAPH.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [r for path, text, language in frame.itertuples(index=False) for r in _graph_rows(path, language, text or "")]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({c: "Int32" for c in ("position", "first_line", "last_line", "n_params", "n_returns")})

    return dealt(files.select(path_col, text_col, language_col), path_col).mapInPandas(run, GRAPH)
