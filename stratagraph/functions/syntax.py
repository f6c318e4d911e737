"""Definitions, imports, comments and touched symbols of source files.

Python is read by its own parser (a line scanner takes over where the text does not parse); JavaScript, TypeScript
and C by a scanner that knows strings, comments and brackets; the other languages by one that is told their
comments, strings and headers of definitions. Kinds of definitions carry the names that grammars give them; only
``KINDS`` make symbols, the others (methods of Java, items of Rust and the like) are listed in trees. Positions are
lines counted from 1.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from stratagraph.functions.patch import parse_patch, touches

SCRIPTS = {"javascript", "typescript", "tsx"}
C_LIKE = {"c", "cpp"}
#: Kinds that make symbols, and of these the ones with a history (fixed values).
KINDS = {"function_definition", "class_definition", "method_definition", "lexical_declaration", "variable_declaration", "function_declaration"}
FUNCTION_KINDS = {"function_definition", "method_definition", "function_declaration"}
_NOT_NAMES = {"if", "for", "while", "switch", "catch", "return", "sizeof", "else", "do", "function", "super", "constructor"}


@dataclass
class Definition:
    name: str
    kind: str
    start: int
    end: int
    text: str


@dataclass
class Parsed:
    definitions: list[Definition] = field(default_factory=list)
    imports: dict[str, str] = field(default_factory=dict)
    names: list[tuple[str, int]] = field(default_factory=list)  # identifiers with their line
    comments: list[tuple[str, str, int, int]] = field(default_factory=list)  # text, kind, first and last line

    def symbols(self) -> dict[str, str]:
        """Name to canonical name: imports, then definitions (the last of a name wins)."""
        table = dict(self.imports)
        for d in self.definitions:
            if d.kind not in KINDS:
                continue
            table[d.name.rsplit(".", 1)[-1]] = d.name
        return table


def _python(source: str) -> Parsed:
    out, lines = Parsed(), source.split("\n")
    try:
        for tok in tokenize.generate_tokens(io.StringIO(source).readline):
            if tok.type == tokenize.COMMENT:
                out.comments.append((tok.string, "inline", tok.start[0], tok.end[0]))
    except (tokenize.TokenError, SyntaxError, IndentationError):
        pass
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return _python_lines(lines, out)

    def walk(node: ast.AST, scope: str) -> None:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            name = f"{scope}.{node.name}" if scope else node.name
            kind = "class_definition" if isinstance(node, ast.ClassDef) else "function_definition"
            out.definitions.append(Definition(name, kind, node.lineno, node.end_lineno, "\n".join(lines[node.lineno - 1 : node.end_lineno])))
            out.names.append((node.name, node.lineno))
            scope = name
        if isinstance(node, (ast.Module, ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) and node.body and isinstance(node.body[0], ast.Expr) and isinstance(getattr(node.body[0], "value", None), ast.Constant) and isinstance(node.body[0].value.value, str):
            doc = node.body[0]
            out.comments.append((doc.value.value.strip(), "docstring", doc.lineno, doc.end_lineno))
        if isinstance(node, ast.Import):
            for a in node.names:
                out.imports[a.asname or a.name.split(".")[0]] = a.name
                out.names.append((a.asname or a.name.split(".")[0], node.lineno))
        elif isinstance(node, ast.ImportFrom):
            for a in node.names:
                out.imports[a.asname or a.name] = f"{'.' * node.level}{node.module or ''}.{a.name}" if node.module or node.level else a.name
                out.names.append((a.asname or a.name, a.lineno))
        elif isinstance(node, ast.Name):
            out.names.append((node.id, node.lineno))
        elif isinstance(node, ast.Attribute):
            out.names.append((node.attr, node.end_lineno))
        for child in ast.iter_child_nodes(node):
            walk(child, scope)

    try:
        walk(tree, "")
    except RecursionError:
        pass
    return out


def _python_lines(lines: list[str], out: Parsed) -> Parsed:
    """Definitions by indentation, for text that does not parse."""
    open_: list[tuple[int, str]] = []
    for i, line in enumerate(lines, 1):
        m = re.match(r"(\s*)(?:async\s+)?(def|class)\s+(\w+)", line)
        for name in re.findall(r"[^\W\d]\w*", line):
            out.names.append((name, i))
        if not m:
            continue
        depth = len(m[1].expandtabs())
        open_ = [o for o in open_ if o[0] < depth]
        name = ".".join([*(o[1] for o in open_), m[3]])
        end = next((j - 1 for j in range(i + 1, len(lines) + 1) if lines[j - 1].strip() and len(lines[j - 1]) - len(lines[j - 1].lstrip()) <= depth), len(lines))
        out.definitions.append(Definition(name, "class_definition" if m[2] == "class" else "function_definition", i, end, "\n".join(lines[i - 1 : end])))
        open_.append((depth, m[3]))
    return out


_TOKENS = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)


def _blanked(source: str, out: Parsed, tokens: re.Pattern = _TOKENS) -> str:
    """The source with strings and comments blanked, lines kept; comments are collected."""

    def blank(m: re.Match) -> str:
        text = m[0]
        if text.startswith(("//", "/*", "#", "--", "<!--", "=begin")):
            first = source.count("\n", 0, m.start()) + 1
            long = text.startswith(("/*", "--[[", "<!--", "=begin"))
            out.comments.append((text, "block" if long else "inline", first, first + text.count("\n")))
        return re.sub(r"[^\n]", " ", text)

    return tokens.sub(blank, source)


def _closing(code: str, at: int) -> int:
    """The position of the bracket that closes the one at ``at``; the end of the text if none does."""
    pairs, depth = {"{": "}", "(": ")", "[": "]"}, 0
    opening, closing = code[at], pairs[code[at]]
    for i in range(at, len(code)):
        depth += (code[i] == opening) - (code[i] == closing)
        if depth == 0:
            return i
    return len(code) - 1


_SLASHES, _HASH = r"//[^\n]*|/\*.*?\*/", r"(?:(?<=\s)|^)#[^\n]*"
_QUOTED, _CHARACTER = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", r"\"(?:\\.|[^\"\\])*\"|'(?:\\[^\n]{1,8}|[^'\\\n])'"
_LONG = r'"""(?:.|\n)*?"""'
#: Comments and strings of a language, what tells a comment, and how bodies end: by braces, by ``end``, by indentation or with the line.
LEXICON = {
    "java": (f"{_LONG}|{_SLASHES}|{_QUOTED}", "{"), "go": (f"`[^`]*`|{_SLASHES}|{_QUOTED}", "{"), "rust": (f"{_SLASHES}|{_CHARACTER}", "{"), "c_sharp": (f"@\"(?:[^\"]|\"\")*\"|{_SLASHES}|{_QUOTED}", "{"),
    "php": (f"{_SLASHES}|#(?!\\[)[^\n]*|{_QUOTED}", "{"), "swift": (f"{_LONG}|{_SLASHES}|{_CHARACTER}", "{"), "kotlin": (f"{_LONG}|{_SLASHES}|{_CHARACTER}", "{"), "scala": (f"{_LONG}|{_SLASHES}|{_CHARACTER}", "{"),
    "css": (f"/\\*.*?\\*/|{_QUOTED}", "{"), "ruby": (f"(?m:^=begin\\b.*?^=end\\b)|{_HASH}|{_QUOTED}", "end"), "lua": (rf"--\[\[.*?\]\]|--[^\n]*|{_QUOTED}", "end"), "bash": (f"{_HASH}|{_QUOTED}", "{"),
    "perl": (f"{_HASH}|{_QUOTED}", "{"), "r": (f"#[^\n]*|{_QUOTED}", "{"), "sql": (rf"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'", "line"), "yaml": (f"{_HASH}|{_QUOTED}", "line"), "html": (r"<!--.*?-->", "line"), "json": (r'"(?:\\.|[^"\\])*"', "line"),
}
_WORDS = r"(?m)^[ \t]*(?:(?:public|private|protected|internal|static|final|abstract|sealed|virtual|override|async|open|inline|export|extern|unsafe|partial|readonly|suspend|mutating|fileprivate|implicit|case|data|pub(?:\([a-z]+\))?|default|const|synchronized|native|new)\s+)*"
_TYPED = _WORDS + r"[\w.<>\[\],?]+(?:\s+|\s*\[\]\s*)([A-Za-z_]\w*)\s*\([^(){};]*\)\s*(?:throws\s+[\w., ]+|where\s[^{]+)?\{"
#: Headers of definitions per language with the kind a grammar gives them; the first group is the name.
HEADERS = {
    "java": [("class_declaration", _WORDS + r"(?:class|interface|enum|record)\s+(\w+)"), ("method_declaration", _TYPED)],
    "c_sharp": [("class_declaration", _WORDS + r"(?:class|interface|enum|record|struct|namespace)\s+([\w.]+)"), ("method_declaration", _TYPED)],
    "go": [("function_declaration", r"(?m)^func\s+(\w+)\s*[(\[]"), ("method_declaration", r"(?m)^func\s*\([^)]*\)\s*(\w+)\s*\("), ("type_declaration", r"(?m)^type\s+(\w+)\s+(?:struct|interface)\b")],
    "rust": [("impl_item", r"(?m)^[ \t]*impl\b(?:<[^>]*>)?\s*(?:[\w:<>, ]+\s+for\s+)?(\w+)"), ("mod_item", _WORDS + r"(?:mod|trait|struct|enum)\s+(\w+)"), ("function_item", _WORDS + r"fn\s+(\w+)")],
    "php": [("class_declaration", _WORDS + r"(?:class|interface|trait)\s+(\w+)"), ("function_definition", r"(?m)^[ \t]*function\s+&?(\w+)\s*\("), ("method_declaration", r"(?m)^[ \t]*(?:(?:public|private|protected|static|final|abstract)\s+)+function\s+&?(\w+)\s*\(")],
    "swift": [("class_declaration", _WORDS + r"(?:class|struct|enum|extension|actor|protocol)\s+(\w+)"), ("function_declaration", _WORDS + r"func\s+(\w+)")],
    "kotlin": [("class_declaration", _WORDS + r"(?:class|interface|object)\s+(\w+)"), ("function_declaration", _WORDS + r"fun\s+(?:<[^>]*>\s*)?(?:[\w.]+\.)?(\w+)\s*\(")],
    "scala": [("class_definition", _WORDS + r"class\s+(\w+)"), ("object_definition", _WORDS + r"(?:object|trait)\s+(\w+)"), ("function_definition", _WORDS + r"def\s+(\w+)")],
    "ruby": [("module", r"(?m)^[ \t]*module\s+([\w:]+)"), ("class", r"(?m)^[ \t]*class\s+([\w:]+)"), ("method", r"(?m)^[ \t]*def\s+(?:self\.)?([\w?!=]+)")],
    "lua": [("function_declaration", r"(?m)^[ \t]*(?:local\s+)?function\s+([\w.:]+)\s*\(")],
    "bash": [("function_definition", r"(?m)^[ \t]*(?:function\s+)?([\w-]+)\s*\(\s*\)\s*(?=\{)")],
    "perl": [("function_definition", r"(?m)^[ \t]*sub\s+(\w+)")], "r": [("function_assignment", r"(?m)^[ \t]*([\w.]+)\s*(?:<-|=)\s*function\s*\(")],
    "css": [("rule_set", r"(?m)^[ \t]*([.#\w][^{};@]*?)\s*(?=\{)")], "sql": [("create_statement", r"(?im)^[ \t]*create\s+(?:or\s+replace\s+)?(?:table|view|function|procedure)\s+(?:if\s+not\s+exists\s+)?([\w.]+)")],
}


def _end_of(code: str, start: int, at: int, ends: str) -> int:
    """Where the definition that begins at ``start`` with a header up to ``at`` ends."""
    line_end = lambda i: len(code) if (j := code.find("\n", i)) < 0 else j
    if ends == "{":
        stop = line_end(at)
        round_ = code.find("(", start, stop + 1)
        behind = _closing(code, round_) + 1 if round_ >= 0 and round_ >= at - 1 else at
        brace = re.compile(r"[^{};]*?\{").match(code, max(behind - (code[behind - 1 : behind] == "{"), start))
        return _closing(code, brace.end() - 1) + 1 if brace else line_end(behind)
    if ends == "end":
        indent = re.match(r"[ \t]*", code[code.rfind("\n", 0, start) + 1 :])[0]
        close = re.compile(rf"(?m)^{indent}end\b[^\n]*").search(code, line_end(at))
        return close.end() if close else line_end(at)
    return line_end(at)


def _headed(source: str, language: str) -> Parsed:
    """Definitions, names and comments of a language of ``LEXICON``."""
    out = Parsed()
    pattern, ends = LEXICON[language]
    code = _blanked(source, out, re.compile(pattern, re.S))
    line_of = lambda p: source.count("\n", 0, p) + 1
    spans = []
    for kind, header in HEADERS.get(language, ()):
        for m in re.finditer(header, code):
            if m[1] in _NOT_NAMES or re.match(r"\s*(?:return|else|new|throw)\b", m[0]):
                continue
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            spans.append((start, _end_of(code, start, m.end(), ends), m[1], kind))
    spans.sort(key=lambda s: (s[0], -s[1]))
    open_: list[tuple[int, str]] = []
    for start, end, name, kind in spans:
        open_ = [o for o in open_ if o[0] >= end]
        # as grammars have it, only the kinds that make symbols open a scope for others that do
        scope = next((o[1] for o in reversed(open_)), "")
        canonical = f"{scope}.{name}" if scope else name
        out.definitions.append(Definition(canonical, kind, line_of(start), line_of(max(start, end - 1)), source[start:end]))
        if kind in KINDS:
            open_.append((end, canonical))
    for i, line in enumerate(code.split("\n"), 1):
        out.names.extend((n, i) for n in re.findall(r"(?<![.\w])[A-Za-z_]\w*", line))
    return out


_JS_IMPORT = re.compile(r"import\s+(?:type\s+)?(?:(\w+)\s*,?\s*)?(?:\{([^}]*)\}|\*\s+as\s+(\w+))?\s*from\s*[\"']([^\"']+)[\"']")
_JS_DEFINITION = re.compile(r"(?P<function>\bfunction\s*\*?\s+(\w+)\s*[(<])|(?P<declared>\b(?:const|let|var)\s+(\w+)\b)|(?P<method>(?<=[{};\n])\s*(?:(?:public|private|protected|static|async|readonly|get|set)\s+)*(\w+)\s*(?:<[^>\n]*>)?\([^(){};]*\)\s*(?::[^{;=\n]+)?\{)")
_C_DEFINITION = re.compile(r"(?m)^[ \t]*(?:[A-Za-z_][\w:<>,*&\s]*?[\s*&])?([A-Za-z_][\w:~]*)\s*\(([^(){};]*)\)\s*(?:const\s*)?\{")


def _braces(source: str, language: str) -> Parsed:
    out = Parsed()
    code = _blanked(source, out)
    line_of = lambda p: source.count("\n", 0, p) + 1
    spans: list[tuple[int, int, str, str]] = []
    if language in SCRIPTS:
        for m in _JS_IMPORT.finditer(source):
            default, named, star, module = m.groups()
            for name in filter(None, (default, star)):
                out.imports[name] = f"{module}.{'default' if name == default else '*'}"
            for part in filter(None, (x.strip() for x in (named or "").split(","))):
                source_name, _, alias = part.removeprefix("type ").partition(" as ")
                out.imports[(alias or source_name).strip()] = f"{module}.{source_name.strip()}"
        for m in _JS_DEFINITION.finditer(code):
            kind = "function_declaration" if m["function"] else "lexical_declaration" if m["declared"] and not m["declared"].startswith("var") else "variable_declaration" if m["declared"] else "method_definition"
            name = m[2] or m[4] or m[6]
            if name in _NOT_NAMES and kind == "method_definition" and name != "constructor":
                continue
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            if m["declared"]:
                end = start
                while end < len(code) and code[end] not in ";\n":
                    end = _closing(code, end) + 1 if code[end] in "{([" else end + 1
            else:
                round_ = code.find("(", start)
                brace = code.find("{", _closing(code, round_)) if round_ >= 0 else -1
                end = _closing(code, brace) + 1 if brace >= 0 else m.end()
            spans.append((start, end, name, kind))
    elif language in C_LIKE:
        for m in _C_DEFINITION.finditer(code):
            if m[1] in _NOT_NAMES:
                continue
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            spans.append((start, _closing(code, m.end() - 1) + 1, m[1], "function_definition"))
    spans.sort(key=lambda s: (s[0], -s[1]))
    open_: list[tuple[int, str]] = []
    for start, end, name, kind in spans:
        open_ = [o for o in open_ if o[0] >= end]
        canonical = f"{open_[-1][1]}.{name}" if open_ else name
        out.definitions.append(Definition(canonical, kind, line_of(start), line_of(max(start, end - 1)), source[start:end]))
        open_.append((end, canonical))
    for i, line in enumerate(code.split("\n"), 1):
        out.names.extend((n, i) for n in re.findall(r"(?<!\.)\b[A-Za-z_$][\w$]*", line))
    for m in _JS_IMPORT.finditer(source) if language in SCRIPTS else ():
        first = line_of(m.start())
        out.names.extend((n, first) for n in out.imports if re.search(rf"\b{re.escape(n)}\b", m[0]))
    return out


def parse(source: str | None, language: str | None) -> Parsed:
    """Parse a file; unknown languages and null texts give an empty result."""
    if not source or not language:
        return Parsed()
    if language == "python":
        return _python(source)
    if language in SCRIPTS | C_LIKE:
        return _braces(source, language)
    return _headed(source, language) if language in LEXICON else Parsed()


def analyse(source: str | None, language: str | None, patch: str | None) -> dict:
    """What a change means: all definitions, symbols touched, functions touched with text, comments touched."""
    parsed, (lines, _) = parse(source, language), parse_patch(patch)
    table = parsed.symbols()
    used = {table[n] for n, line in parsed.names if n in table and touches(lines, line, line)}
    made = [d for d in parsed.definitions if d.kind in KINDS]
    hit = [d for d in made if touches(lines, d.start, d.end)]
    return {
        "definitions": sorted({d.name for d in made}), "touched": sorted(used | {d.name for d in hit}),
        "functions": [{"name": d.name, "text": d.text} for d in hit if d.kind in FUNCTION_KINDS],
        "comments": [{"text": t, "kind": k, "line": a} for t, k, a, b in parsed.comments if touches(lines, a, b)],
    }


ANALYSED = "commit_id string, seq bigint, path string, definitions array<string>, touched array<string>, functions array<struct<name string, text string>>, comments array<struct<text string, kind string, line int>>"


def analyse_changes(files: DataFrame) -> DataFrame:
    """``analyse`` of changes (commit_id, seq, path, language, content, patch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.list_(pa.struct([("name", pa.string()), ("text", pa.string())]))
        note = pa.list_(pa.struct([("text", pa.string()), ("kind", pa.string()), ("line", pa.int32())]))
        for b in batches:
            rows = [analyse(c, lang, p) for lang, c, p in zip(*[b.column(n).to_pylist() for n in ("language", "content", "patch")])]
            kinds = {"definitions": pa.list_(pa.string()), "touched": pa.list_(pa.string()), "functions": pair, "comments": note}
            yield pa.RecordBatch.from_arrays([b.column("commit_id"), b.column("seq"), b.column("path"), *[pa.array([r[k] for r in rows], t) for k, t in kinds.items()]], names=["commit_id", "seq", "path", *kinds])

    return files.select("commit_id", "seq", "path", "language", "content", "patch").mapInArrow(run, ANALYSED)


def tree(source: str | None, language: str | None, max_depth: int = 0) -> list[dict]:
    """The syntax tree in preorder: id, type, first and last position, depth, text of names and literals.

    Python nodes carry the parser's names in snake case, with ``function_definition``, ``class_definition`` and
    ``return_statement`` for the statements so called; the other languages list their definitions, comments and, inside
    them, the statements that their lines begin with a word for. Ids hash the position. ``max_depth`` 0 lists all.
    """
    import hashlib

    out: list[dict] = []
    known = {"FunctionDef": "function_definition", "AsyncFunctionDef": "function_definition", "ClassDef": "class_definition", "Return": "return_statement", "Name": "identifier", "Expr": "expression_statement", "Module": "module"}

    def add(kind: str, start: tuple, end: tuple, depth: int, text: str | None) -> None:
        if max_depth and depth > max_depth:
            return
        key = hashlib.sha256(f"{kind}:{start}:{end}:{len(out)}".encode()).hexdigest()[:12]
        out.append({"id": f"AST:{key}", "type": kind, "start_line": start[0], "start_column": start[1], "end_line": end[0], "end_column": end[1], "depth": depth, "text": text})

    if language == "python" and source:
        try:
            root = ast.parse(source)
        except (SyntaxError, ValueError, RecursionError):
            root = None
        stack = [(root, 0)] if root else []
        while stack:
            node, depth = stack.pop()
            kind = known.get(type(node).__name__) or re.sub(r"(?<=[a-z])(?=[A-Z])", "_", type(node).__name__).lower()
            if isinstance(node, ast.Constant):
                kind = "string" if isinstance(node.value, str) else "integer" if isinstance(node.value, int) else "constant"
            if hasattr(node, "lineno") or isinstance(node, ast.Module):
                leaf = isinstance(node, (ast.Name, ast.Constant, ast.arg))
                lines = source.split("\n")
                start = (getattr(node, "lineno", 1), getattr(node, "col_offset", 0))
                end = (getattr(node, "end_lineno", len(lines)), getattr(node, "end_col_offset", len(lines[-1])))
                add(kind, start, end, depth, ast.get_source_segment(source, node) if leaf else None)
            stack.extend((c, depth + 1) for c in reversed(list(ast.iter_child_nodes(node))))
    else:
        parsed = parse(source, language)
        rows = [(d.start, d.end, d.kind, d.name) for d in parsed.definitions] + [(a, b, "comment", t) for t, _, a, b in parsed.comments]
        words = {"return": "return_statement", "if": "if_statement", "for": "for_statement", "while": "while_statement", "switch": "switch_statement", "throw": "throw_statement", "import": "import_statement"}
        shut = {i for _, _, a, b in parsed.comments for i in range(a + 1, b + 1)}
        for i, line in enumerate((source or "").split("\n") if language else (), 1):
            m = re.match(r"\s*(\w+)\b", line)
            if m and m[1] in words and i not in shut:
                rows.append((i, i, words[m[1]], None))
        open_ = []
        for start, end, kind, text in sorted(rows, key=lambda r: (r[0], -r[1], r[2])):
            open_ = [e for e in open_ if e >= end and e >= start]
            add(kind, (start, 0), (end, 0), len(open_) + 1, text)
            if end > start:
                open_.append(end)
    return out


TREE = "file string, id string, type string, start_line int, start_column int, end_line int, end_column int, depth int, text string"


def trees(files: DataFrame, max_depth: int = 0) -> DataFrame:
    """``tree`` of files (file, language, content), one row per node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"id": pa.string(), "type": pa.string(), "start_line": pa.int32(), "start_column": pa.int32(), "end_line": pa.int32(), "end_column": pa.int32(), "depth": pa.int32(), "text": pa.string()}
        for b in batches:
            rows = [(f, r) for f, lang, c in zip(*[b.column(n).to_pylist() for n in ("file", "language", "content")]) for r in tree(c, lang, max_depth)]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in rows], pa.string()), *[pa.array([r[k] for _, r in rows], t) for k, t in kinds.items()]], names=["file", *kinds])

    return files.select("file", "language", "content").mapInArrow(run, TREE)
