import subprocess
import sys
from pathlib import Path

from corvane.plans import registry

ROOT = Path(__file__).resolve().parent.parent


def test_every_oracle_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    assert len(registry.QUERIES) > 120


def test_rest_of_the_package_does_not_import_llm():
    for p in (ROOT / "corvane").rglob("*.py"):
        if "llm" not in p.parts:
            assert "corvane.llm" not in p.read_text()


def test_entry_imports_without_the_optional_parts(tmp_path):
    import shutil

    shutil.copytree(ROOT / "corvane", tmp_path / "corvane", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'association_scores' in e.queries() and 'pipeline' not in e.queries(); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
