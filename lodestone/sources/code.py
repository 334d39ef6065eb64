"""Functions, classes, imports and variables of source files, by an opaque parser for each file in Arrow batches.

Python is read with the standard library's syntax trees. JavaScript and TypeScript are read by a scanner that skips strings, comments
and templates and follows braces; it finds declarations, exported declarations, arrow functions bound by const or let, and methods.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "file string, kind string, name string, line int, end_line int, parameters string, calls array<string>, body string, parent_class string, is_exported boolean, ordinal int, text string"


def _row(kind: str, name: str, line: int, end: int = 0, parameters: str = "", calls: list[str] = (), body: str = "", parent: str | None = None, exported: bool = False, text: str = "") -> dict:
    return {"kind": kind, "name": name, "line": line, "end_line": end or line, "parameters": parameters, "calls": list(calls), "body": body, "parent_class": parent, "is_exported": exported, "text": text}


def parse_python(source: str) -> list[dict]:
    """Decorated methods and everything nested in methods' classes are left out, as are functions inside of methods; functions nested in functions are found."""
    tree, out = ast.parse(source), []
    function = (ast.FunctionDef, ast.AsyncFunctionDef)
    text = lambda n: ast.get_source_segment(source, n) or ""

    def calls(node: ast.AST) -> list[str]:
        met = [n for n in ast.walk(node) if isinstance(n, ast.Call)]
        return [text(n.func) for n in sorted(met, key=lambda n: (n.lineno, n.col_offset, -(n.end_lineno or 0), -(n.end_col_offset or 0)))]

    def add(node, parent: str | None) -> None:
        out.append(_row("function", node.name, node.lineno, node.end_lineno, f"({ast.unparse(node.args)})", [c for s in node.body for c in calls(s)], text(node), parent))

    def walk(body: list[ast.stmt]) -> None:
        for node in body:
            if isinstance(node, function):
                add(node, None)
                walk(node.body)
            elif isinstance(node, ast.ClassDef):
                methods = [m for m in node.body if isinstance(m, function) and not m.decorator_list]
                out.append(_row("class", node.name, node.lineno, node.end_lineno, text=",".join(m.name for m in methods)))
                for m in methods:
                    add(m, node.name)
            elif isinstance(node, (ast.Import, ast.ImportFrom)):
                out.append(_row("import", "", node.lineno, text=text(node)))
            elif isinstance(node, (ast.Assign, ast.AnnAssign)):
                for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
                    out.append(_row("variable", text(t), node.lineno))
            else:
                walk([s for f in ("body", "orelse", "finalbody") for s in getattr(node, f, []) if isinstance(s, ast.stmt)])

    walk(tree.body)
    return out


_QUIET = re.compile(r"//[^\n]*|/\*.*?\*/|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`", re.DOTALL)
_DECLARED = re.compile(r"(?P<export>export\s+(?:default\s+)?)?(?:async\s+)?function\s*\*?\s*(?P<f>[A-Za-z_$][\w$]*)\s*(?P<p>\([^)]*\))[^{;]*\{|(?P<export2>export\s+)?(?:const|let)\s+(?P<a>[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=>\s*\{?|(?P<export3>export\s+(?:default\s+)?)?class\s+(?P<c>[A-Za-z_$][\w$]*)[^{]*\{")
_METHOD = re.compile(r"(?:^|[;{}\n])\s*(?:static\s+|async\s+|get\s+|set\s+|public\s+|private\s+|protected\s+)*(?P<m>[A-Za-z_$#][\w$]*)\s*(?P<p>\([^)]*\))[^{;=]*\{")
_CALL = re.compile(r"([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)\s*\(")
_WORDS = {"if", "for", "while", "switch", "catch", "return", "function", "typeof", "await", "new", "super"}


def _end(text: str, at: int) -> int:
    """Place behind the brace that closes the one before `at`."""
    depth = 1
    for i in range(at, len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if not depth:
            return i + 1
    return len(text)


def parse_javascript(source: str) -> list[dict]:
    """Exported functions come twice, once as exported and once as not, as call graphs of this kind count them."""
    quiet = _QUIET.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)
    line = lambda i: source.count("\n", 0, i) + 1
    out = [_row("import", "", line(m.start()), text=source[m.start() : m.end()].strip()) for m in re.finditer(r"^\s*import\b[^\n]*", source, re.MULTILINE)]

    def calls(a: int, b: int) -> list[str]:
        return [c for c in _CALL.findall(quiet, a, b) if c not in _WORDS]

    for m in _DECLARED.finditer(quiet):
        start, braced = m.start(), quiet[m.end() - 1] == "{"
        end = _end(quiet, m.end()) if braced else (quiet.find("\n", m.end()) if "\n" in quiet[m.end() :] else len(quiet))
        if m["c"]:
            inner = [(x, m.end() + x.start("m")) for x in _METHOD.finditer(quiet[m.end() : end]) if x["m"] not in _WORDS and quiet.count("{", m.end(), m.end() + x.start("m")) == quiet.count("}", m.end(), m.end() + x.start("m"))]
            out.append(_row("class", m["c"], line(start), line(end - 1), text=",".join(x["m"] for x, _ in inner)))
            for x, at in inner:
                stop = _end(quiet, m.end() + x.end())
                out.append(_row("function", x["m"], line(at), line(stop - 1), x["p"], calls(m.end() + x.end(), stop), source[at:stop], m["c"]))
            continue
        exported = bool(m["export"] or m["export2"])
        row = _row("function", m["f"] or m["a"], line(start), line(max(start, end - 1)), m["p"] or "", calls(m.end(), end), source[start:end], None, exported)
        out.append(row)
        if exported:
            out.append({**row, "is_exported": False})
    return out


def parsed(files: DataFrame) -> DataFrame:
    """One row for each function, class, import and variable of files(path, content); a file that cannot be read gives one row of kind error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    got = parse_python(content or "") if path.endswith(".py") else parse_javascript(content or "")
                except (SyntaxError, ValueError, RecursionError) as e:
                    got = [_row("error", type(e).__name__, 0)]
                rows += [{"file": path, "ordinal": i, **r} for i, r in enumerate(got)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    code = files.where(F.regexp_like("path", F.lit(r"\.(?:py|js|jsx|ts|tsx)$"))).select("path", "content")
    return code.mapInPandas(run, SCHEMA)


def functions(items: DataFrame) -> DataFrame:
    """func_id (a hash of place and name, the same in every run) and the fields of functions."""
    f = items.where("kind = 'function'")
    return f.select(F.xxhash64("file", "ordinal").alias("func_id"), F.col("ordinal").cast("long").alias("ordinal"), F.col("name").alias("func_name"), "file", "line", "end_line", "parameters", "calls", "body", "parent_class", "is_exported")


def imports(items: DataFrame) -> DataFrame:
    return items.where("kind = 'import'").select("file", "text", "line")
