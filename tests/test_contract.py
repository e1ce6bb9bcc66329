from __future__ import annotations

import ast
from pathlib import Path

import __spark_entry__ as contract
import bench

TOP = Path(__file__).resolve().parents[1]


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() == 1 and {"view_x", "view_y", "view_z"} <= set(df.columns)


def test_every_sql_has_its_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(bench.OWN) <= set(contract.queries())


def test_nothing_else_imports_the_text_operators():
    for file in (TOP / "pointloom").rglob("*.py"):
        if "llm" in file.relative_to(TOP).parts:
            continue
        for node in ast.walk(ast.parse(file.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") or n == "corpus_pipeline" for n in names), file
