"""Syntax rows of Python files, and symbols and calls of C-like and Java files by a scanner with a scope stack."""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_NODE = pa.struct([("node_id", pa.string()), ("parent_id", pa.string()), ("kind", pa.string()), ("structural_path", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32())])


def _node_id(path: str, structural: str) -> str:
    return "anode:" + hashlib.sha256("\x1f".join((path, structural)).encode()).hexdigest()


def syntax_rows(path: str, source: bytes) -> list[dict]:
    """A row for each syntax node, parents first; a structural path names each step ``kind[index]`` below the parent."""
    tree = ast.parse(source)
    out, todo = [], [(tree, "Module[0]", None)]
    while todo:
        node, at, parent = todo.pop()
        me = _node_id(path, at)
        out.append({"node_id": me, "parent_id": parent, "kind": type(node).__name__, "structural_path": at, "start_line": getattr(node, "lineno", None), "end_line": getattr(node, "end_lineno", None)})
        children = list(ast.iter_child_nodes(node))
        todo.extend((c, f"{at}/{type(c).__name__}[{k}]", me) for k, c in reversed(list(enumerate(children))))
    return out


def python_syntax(files: DataFrame) -> DataFrame:
    """path, node_id, parent_id, kind, structural_path, start_line, end_line of the Python rows of a repository scan;
    files that don't parse have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rows = syntax_rows(path, content)
                except (SyntaxError, ValueError, RecursionError):
                    continue
                made = pa.array(rows, _NODE)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), *made.flatten()], ["path", *(f.name for f in _NODE)])

    schema = "path string, node_id string, parent_id string, kind string, structural_path string, start_line int, end_line int"
    return files.where("language = 'python'").select("path", "content").mapInArrow(run, schema)


_BLANK = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)
_STEP = re.compile(r"[{};]")
_CALL = re.compile(r"(->|\.)?\s*([A-Za-z_]\w*(?:::[A-Za-z_]\w*)*)\s*\(")
_TYPE = re.compile(r"\b(namespace|class|struct|interface|enum|union)\s+([A-Za-z_]\w*)(?![^{]*\()")
_FUNCTION = re.compile(r"([~A-Za-z_][\w:~]*)\s*(\((?:[^()]|\([^()]*\))*\))[^()=]*$", re.S)
_INCLUDE = re.compile(r"^\s*#\s*include\s*[<\"]([^>\"]+)[>\"]", re.M)
_IMPORT = re.compile(r"^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", re.M)
#: Words before a parenthesis that call nothing; fixed values.
_WORDS = frozenset("if for while switch return sizeof catch new delete throw else do case alignof decltype static_assert synchronized try assert super this".split())
_KINDS = {"namespace": "Namespace", "class": "Class", "struct": "Struct", "interface": "Interface", "enum": "Type", "union": "Type"}


def scan_braces(source: str, java: bool = False) -> tuple[list[dict], list[dict]]:
    """Symbols (kind, name, qualified_name, signature, start_line, end_line) and references (owner, type, raw_name,
    call_kind, start_line) of a source in a language with braces.

    Comments and strings are blanked. What stands before an opening brace decides whether a type, a function or a
    plain block begins. A call through a member or pointer is indirect unless the language is Java.
    """
    references = [{"owner": "", "type": "IMPORTS", "raw_name": m[1], "call_kind": None, "start_line": source.count("\n", 0, m.start(1)) + 1} for m in (_IMPORT if java else _INCLUDE).finditer(source)]
    text = _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)
    text = re.sub(r"^[ \t]*#(?:[^\n\\]|\\.)*", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.M | re.S)
    symbols: list[dict] = []
    stack: list[dict | None] = []
    start = 0
    line = lambda at: text.count("\n", 0, at) + 1

    def named() -> list[dict]:
        return [s for s in stack if s]

    def calls(a: int, b: int) -> None:
        owner = next((s for s in reversed(stack) if s and s["kind"] in ("Function", "Method")), None)
        if owner:
            for m in _CALL.finditer(text, a, b):
                if m[2] not in _WORDS:
                    references.append({"owner": owner["qualified_name"], "type": "CALLS", "raw_name": m[2].replace("::", "."), "call_kind": "indirect" if m[1] and not java else "direct", "start_line": line(m.start(2))})

    for m in _STEP.finditer(text):
        head = text[start : m.start()]
        if m[0] == "{":
            inside = any(s and s["kind"] in ("Function", "Method") for s in stack)
            kind = _TYPE.search(head)
            function = None if inside or kind else _FUNCTION.search(head.strip())
            symbol = None
            within = ".".join(s["name"] for s in named())
            if kind and not inside:
                symbol = {"kind": _KINDS[kind[1]], "name": kind[2], "signature": ""}
            elif function and function[1].split("::")[-1] not in _WORDS:
                name = function[1].replace("::", ".")
                method = "." in name or any(s["kind"] in ("Class", "Struct", "Interface") for s in named())
                symbol = {"kind": "Method" if method else "Function", "name": name.split(".")[-1], "signature": re.sub(r"\s+", " ", function[2])}
                within = ".".join(filter(None, [within, ".".join(name.split(".")[:-1])]))
            if symbol:
                at = start + len(head) - len(head.lstrip())
                symbol |= {"qualified_name": ".".join(filter(None, [within, symbol["name"]])), "start_line": line(at), "end_line": None}
                symbols.append(symbol)
            else:
                calls(start, m.start())
            stack.append(symbol)
        else:
            calls(start, m.start())
            if m[0] == "}" and stack:
                done = stack.pop()
                if done:
                    done["end_line"] = line(m.start())
        start = m.end()
    return symbols, references


_SYMBOL = pa.struct([("kind", pa.string()), ("name", pa.string()), ("qualified_name", pa.string()), ("signature", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32())])
_REFERENCE = pa.struct([("owner", pa.string()), ("type", pa.string()), ("raw_name", pa.string()), ("call_kind", pa.string()), ("start_line", pa.int32())])


def parse_braces(files: DataFrame) -> DataFrame:
    """path, symbols and references of the C, C++ and Java rows of a repository scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [scan_braces(c.decode("utf-8", "replace"), lang == "java") for c, lang in zip(batch.column("content").to_pylist(), batch.column("language").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([s for s, _ in both], pa.list_(_SYMBOL)), pa.array([r for _, r in both], pa.list_(_REFERENCE))], ["path", "symbols", "references"])

    schema = "path string, symbols array<struct<kind:string,name:string,qualified_name:string,signature:string,start_line:int,end_line:int>>, references array<struct<owner:string,type:string,raw_name:string,call_kind:string,start_line:int>>"
    return files.where("language in ('c', 'cpp', 'java')").select("path", "language", "content").mapInArrow(run, schema)
