"""Source files as rows, and facts of Python files."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that a scan leaves out; fixed values.
IGNORED = (
    ".git", ".hg", ".mypy_cache", ".factloom", ".pytest_cache", ".tox", ".venv", "__pycache__", "build", ".cache", "deps", "dist", "node_modules", "out", "target", "third_party",
    "third-party", "vendor", "venv",
)
#: Languages by file suffix; fixed values.
LANGUAGES = {
    ".py": "python", ".pyi": "python", ".h": "cpp", ".hh": "cpp", ".hpp": "cpp", ".hxx": "cpp", ".inc": "cpp", ".c": "c", ".cc": "cpp", ".cpp": "cpp", ".cxx": "cpp", ".c++": "cpp", ".java": "java",
}


def scan(spark: SparkSession, root: str) -> DataFrame:
    """path, language, sha256 and content of each source file below ``root``, paths relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = F.regexp_replace("path", r"^file:/+", "/")
    base = root.removeprefix("file://").rstrip("/") + "/"
    rows = files.select(F.replace(below, F.lit(base), F.lit("")).alias("path"), "content")
    parts = F.split("path", "/")
    rows = rows.where(~F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.isin(*IGNORED)))
    language = F.coalesce(*(F.when(F.col("path").endswith(s), F.lit(v)) for s, v in LANGUAGES.items()))
    return rows.select("path", language.alias("language"), F.sha2("content", 256).alias("sha256"), "content").where("language is not null")


class _Walk(ast.NodeVisitor):
    def __init__(self, module: str):
        self.scope, self.kinds = [module] if module else [], []
        self.symbols: list[tuple] = []
        self.references: list[tuple] = []
        self.aliases: dict[str, str] = {}

    def _symbol(self, node: ast.AST, kind: str, signature: str) -> None:
        self.symbols.append((kind, node.name, ".".join([*self.scope, node.name]), signature, node.lineno, node.end_lineno))
        self.scope.append(node.name)
        self.kinds.append(kind)
        self.generic_visit(node)
        self.scope.pop()
        self.kinds.pop()

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:  # noqa: N802
        kind = "Method" if self.kinds and self.kinds[-1] in ("Class", "Interface") else "Function"
        returns = f" -> {ast.unparse(node.returns)}" if node.returns else ""
        self._symbol(node, kind, f"({ast.unparse(node.args)}){returns}")

    visit_AsyncFunctionDef = visit_FunctionDef  # noqa: N815

    def visit_ClassDef(self, node: ast.ClassDef) -> None:  # noqa: N802
        bases = [ast.unparse(b) for b in node.bases]
        for b in bases:
            if b.split(".")[-1] not in ("object", "ABC", "Protocol"):
                self.references.append((".".join([*self.scope, node.name]), "IMPLEMENTS", b, None, node.lineno))
        self._symbol(node, "Interface" if any(b.split(".")[-1] in ("ABC", "Protocol") for b in bases) else "Class", "")

    def visit_Import(self, node: ast.Import) -> None:  # noqa: N802
        for a in node.names:
            self.aliases[a.asname or a.name.split(".")[0]] = a.name
            self.references.append((".".join(self.scope), "IMPORTS", a.name, a.name, node.lineno))

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:  # noqa: N802
        module = "." * node.level + (node.module or "")
        for a in node.names:
            self.aliases[a.asname or a.name] = f"{module}.{a.name}"
            self.references.append((".".join(self.scope), "IMPORTS", a.name, module, node.lineno))

    def visit_Call(self, node: ast.Call) -> None:  # noqa: N802
        if self.kinds:
            name = ast.unparse(node.func)
            root, _, rest = name.partition(".")
            if root in self.aliases:
                full = self.aliases[root] + ("." + rest if rest else "")
                module, _, short = full.rpartition(".")
                self.references.append((".".join(self.scope), "CALLS", short, module, node.lineno))
            elif isinstance(node.func, (ast.Name, ast.Attribute)):
                self.references.append((".".join(self.scope), "CALLS", name, None, node.lineno))
        self.generic_visit(node)


_SYMBOL = pa.struct([("kind", pa.string()), ("name", pa.string()), ("qualified_name", pa.string()), ("signature", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32())])
_REFERENCE = pa.struct([("owner", pa.string()), ("type", pa.string()), ("raw_name", pa.string()), ("target_module", pa.string()), ("start_line", pa.int32())])


def parse_python(files: DataFrame) -> DataFrame:
    """path, symbols, references and has_error of the Python rows of ``scan``. A file that doesn't parse has none and
    is marked; calls count inside symbols only, and a call through an import gets its module and real name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols, references, bad = [], [], []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                module = path.removesuffix(".py").removesuffix("/__init__").replace("/", ".")
                walk = _Walk(module)
                try:
                    walk.visit(ast.parse(content))
                except (SyntaxError, ValueError, RecursionError):
                    walk = _Walk(module)
                    bad.append(True)
                else:
                    bad.append(False)
                symbols.append([dict(zip((f.name for f in _SYMBOL), s, strict=True)) for s in walk.symbols])
                references.append([dict(zip((f.name for f in _REFERENCE), r, strict=True)) for r in walk.references])
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(symbols, pa.list_(_SYMBOL)), pa.array(references, pa.list_(_REFERENCE)), pa.array(bad)], ["path", "symbols", "references", "has_error"])

    schema = "path string, symbols array<struct<kind:string,name:string,qualified_name:string,signature:string,start_line:int,end_line:int>>, references array<struct<owner:string,type:string,raw_name:string,target_module:string,start_line:int>>, has_error boolean"
    return files.where("language = 'python'").select("path", "content").mapInArrow(run, schema)
