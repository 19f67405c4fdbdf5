"""Control-flow graphs of Python functions, from their syntax trees."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Kinds of edges; fixed values.
EDGE_KINDS = ("next", "true", "false", "back", "break", "continue", "return")
_UNSUPPORTED = (ast.Try, ast.TryStar, ast.With, ast.AsyncWith, ast.AsyncFor, ast.Match, ast.Raise, ast.Yield, ast.YieldFrom, ast.Await)
_OPEN = list[tuple[int, str]]


class _Graph:
    """Nodes (kind, first and last line) and edges of one function; an open end is a node and the kind of the edge that leaves it."""

    def __init__(self, function: ast.FunctionDef):
        self.nodes: list[tuple[str, int, int]] = []
        self.edges: list[tuple[int, int, str]] = []
        self.loops: list[tuple[int, _OPEN]] = []
        entry = self.node("ENTRY", function.lineno, function.lineno)
        self.exit = self.node("EXIT", function.end_lineno, function.end_lineno)
        self.link(self.block(function.body, [(entry, "next")]), self.exit)

    def node(self, kind: str, first: int, last: int) -> int:
        self.nodes.append((kind, first, last))
        return len(self.nodes) - 1

    def link(self, ends: _OPEN, to: int) -> None:
        self.edges += [(a, to, kind) for a, kind in ends]

    def block(self, body: list[ast.stmt], ends: _OPEN) -> _OPEN:
        for statement in body:
            ends = self.statement(statement, ends)
        return ends

    def statement(self, s: ast.stmt, ends: _OPEN) -> _OPEN:
        branching = isinstance(s, (ast.If, ast.While, ast.For))
        at = self.node(type(s).__name__, s.lineno, (s.test if isinstance(s, (ast.If, ast.While)) else s.iter).end_lineno if branching else s.end_lineno)
        self.link(ends, at)
        if isinstance(s, ast.If):
            return self.block(s.body, [(at, "true")]) + (self.block(s.orelse, [(at, "false")]) if s.orelse else [(at, "false")])
        if isinstance(s, (ast.While, ast.For)):
            broken: _OPEN = []
            self.loops.append((at, broken))
            tail = self.block(s.body, [(at, "true")])
            self.loops.pop()
            self.edges += [(a, at, "back" if kind == "next" else kind) for a, kind in tail]
            return [(at, "false"), *broken]
        if isinstance(s, ast.Return):
            self.edges.append((at, self.exit, "return"))
            return []
        if isinstance(s, ast.Break):
            self.loops[-1][1].append((at, "break"))
            return []
        if isinstance(s, ast.Continue):
            self.edges.append((at, self.loops[-1][0], "continue"))
            return []
        return [(at, "next")]


def _unsupported(function: ast.AST) -> str | None:
    """The first construct of a function, outside functions in it, for which no graph is made."""
    stack = list(ast.iter_child_nodes(function))
    while stack:
        node = stack.pop()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda, ast.ClassDef)):
            continue
        if isinstance(node, _UNSUPPORTED):
            return type(node).__name__
        if isinstance(node, (ast.For, ast.While)) and node.orelse:
            return "loop_else"
        stack.extend(ast.iter_child_nodes(node))
    return "async" if isinstance(function, ast.AsyncFunctionDef) else None


def _functions(tree: ast.AST, scope: str = "") -> Iterator[tuple[str, ast.AST]]:
    for node in ast.iter_child_nodes(tree):
        name = f"{scope}.{node.name}" if scope and hasattr(node, "name") else getattr(node, "name", scope)
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            yield name, node
        yield from _functions(node, name if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) else scope)


_NODE = pa.struct([("node", pa.int32()), ("kind", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32())])
_EDGE = pa.struct([("src", pa.int32()), ("dst", pa.int32()), ("kind", pa.string())])


def control_flow(files: DataFrame) -> DataFrame:
    """path, owner (qualified name), start_line, unsupported, nodes and edges of each function in the Python rows of a repository scan.

    A node is a statement (a branch or loop stands for its condition), besides one ENTRY and one EXIT; edges are next,
    true, false, back, break, continue and return. A function with a construct that has no such graph (exceptions,
    context managers, matching, generators, coroutines, else of a loop) has no nodes, and ``unsupported`` names the
    construct. A file that does not parse has no functions. Nodes that nothing reaches are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    tree = ast.parse(content)
                except (SyntaxError, ValueError):
                    continue
                for owner, function in _functions(tree):
                    why = _unsupported(function)
                    graph = None if why else _Graph(function)
                    nodes = [dict(zip(("node", "kind", "start_line", "end_line"), (k, *n), strict=True)) for k, n in enumerate(graph.nodes)] if graph else []
                    edges = [dict(zip(("src", "dst", "kind"), e, strict=True)) for e in graph.edges] if graph else []
                    rows.append((path, owner, function.lineno, why, nodes, edges))
            types = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.list_(_NODE), pa.list_(_EDGE))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["path", "owner", "start_line", "unsupported", "nodes", "edges"])

    schema = "path string, owner string, start_line int, unsupported string, nodes array<struct<node:int,kind:string,start_line:int,end_line:int>>, edges array<struct<src:int,dst:int,kind:string>>"
    return files.where("language = 'python'").select("path", "content").mapInArrow(run, schema)
