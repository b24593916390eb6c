"""The tabular part stands without the corpus part."""

import ast
from pathlib import Path

ROOT = Path(__file__).parents[1]


def test_nothing_outside_imports_the_corpus_part():
    for path in (ROOT / "wicker").rglob("*.py"):
        if "llm" not in path.parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n or "corpus_pipeline" in n for n in names), path


def test_entry_without_the_corpus_part(tmp_path):
    import shutil
    import subprocess
    import sys

    shutil.copytree(ROOT / "wicker", tmp_path / "wicker", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'cutoff_curve' in e.queries() and not any(q.startswith('op1_') for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
