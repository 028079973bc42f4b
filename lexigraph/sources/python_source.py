"""Symbols of Python sources: a parser in each task, tables out. Other languages need grammars that aren't at hand; their files give
an error row, no failure."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SYMBOL = "struct<name:string,kind:string,type:string,line:int,end_line:int,column:int,parent:string,params:array<string>,returns:string,decorators:array<string>>"
_ANCHOR = "struct<symbol:string,kind:string,line:int,text:string>"
_IMPORT = "struct<module:string,name:string,local:string,line:int>"
PARSED = f"path string, symbols array<{_SYMBOL}>, anchors array<{_ANCHOR}>, imports array<{_IMPORT}>, error string"
ANCHORS = {ast.If: "if", ast.For: "for", ast.While: "while", ast.Try: "try", ast.With: "with", ast.Return: "return", ast.Raise: "raise", ast.Match: "match", ast.AsyncFor: "for", ast.AsyncWith: "with"}


def parse(source: str) -> tuple[list[dict], list[dict], list[dict]]:
    symbols: list[dict] = []
    anchors: list[dict] = []
    imports: list[dict] = []
    lines = source.split("\n")

    def visit(node: ast.AST, owner: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            inside = owner
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(child, ast.ClassDef)
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                params = [] if is_class else [a.arg for a in (*child.args.posonlyargs, *child.args.args, *([child.args.vararg] if child.args.vararg else []), *child.args.kwonlyargs, *([child.args.kwarg] if child.args.kwarg else []))]
                returns = None if is_class or child.returns is None else ast.unparse(child.returns)
                kind = "class" if is_class else "method" if isinstance(node, ast.ClassDef) else "function"
                symbols.append({"name": child.name, "kind": "def", "type": kind, "line": first, "end_line": child.end_lineno, "column": child.col_offset, "parent": owner, "params": params, "returns": returns, "decorators": [ast.unparse(d) for d in child.decorator_list]})
                inside = child.name
            elif isinstance(child, ast.Call):
                name = child.func.id if isinstance(child.func, ast.Name) else child.func.attr if isinstance(child.func, ast.Attribute) else None
                if name:
                    symbols.append({"name": name, "kind": "ref", "type": "call", "line": child.lineno, "end_line": child.end_lineno, "column": child.col_offset, "parent": owner, "params": [], "returns": None, "decorators": []})
            elif isinstance(child, ast.Import):
                imports.extend({"module": a.name, "name": None, "local": a.asname or a.name.split(".")[0], "line": child.lineno} for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                imports.extend({"module": "." * child.level + (child.module or ""), "name": a.name, "local": a.asname or a.name, "line": child.lineno} for a in child.names)
            if type(child) in ANCHORS and owner is not None:
                anchors.append({"symbol": owner, "kind": ANCHORS[type(child)], "line": child.lineno, "text": lines[child.lineno - 1].strip()[:80]})
            visit(child, inside)

    visit(ast.parse(source), None)
    seen, kept = set(), []
    for s in sorted(symbols, key=lambda s: s["line"]):
        if (key := (s["name"], s["kind"], s["line"])) not in seen:
            seen.add(key)
            kept.append(s)
    return kept, anchors, imports


def parsed(files: DataFrame) -> DataFrame:
    """(path, symbols, anchors, imports, error) of (path, text); `inline` makes tables of the arrays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, text in zip(batch["path"], batch["text"], strict=True):
                if not str(path).endswith((".py", ".pyi")):
                    out.append((path, [], [], [], "no parser for this language"))
                    continue
                try:
                    out.append((path, *parse(text or ""), None))
                except (SyntaxError, ValueError) as e:
                    out.append((path, [], [], [], f"line {getattr(e, 'lineno', None) or 1}: {e.args[0]}"))
            yield pd.DataFrame(out, columns=["path", "symbols", "anchors", "imports", "error"])

    return files.select("path", "text").mapInPandas(run, PARSED)


def symbol_table(parsed_files: DataFrame) -> DataFrame:
    """(file, name, kind, ...) with visibility by Python's custom."""
    rows = parsed_files.select(F.col("path").alias("file"), F.inline("symbols"))
    return rows.withColumn("visibility", F.when(F.col("name").startswith("_") & ~F.col("name").endswith("__"), "private").otherwise("public"))
