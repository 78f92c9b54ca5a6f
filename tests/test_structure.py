"""The library doesn't depend on its optional subpackage."""

import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_imports_the_optional_folder():
    for path in (ROOT / "segmenta").rglob("*.py"):
        if "llm" in path.relative_to(ROOT / "segmenta").parts:
            continue
        for node in ast.walk(ast.parse(path.read_text(encoding="utf-8"))):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(".llm" in n for n in names), path
