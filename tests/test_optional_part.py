"""The training-data operators may be missing, and must not be missed silently."""
import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; print(len(e.queries()), sum(q.startswith('op') for q in e.queries()), len(e.oracle_sql()))"


@pytest.fixture()
def copy(tmp_path):
    shutil.copytree(f"{REPO}/staywise", tmp_path / "staywise", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{REPO}/__spark_entry__.py", tmp_path)
    return tmp_path


def _counts(folder):
    done = subprocess.run([sys.executable, "-c", COUNT], cwd=folder, env={**os.environ, "PYTHONPATH": str(folder)}, capture_output=True, text=True)
    return done.returncode, done.stdout.split()


def test_the_rest_works_without_them(copy):
    code, (queries, operators, oracles) = _counts(copy)
    assert code == 0 and int(queries) > 170 and int(operators) == 0 and int(oracles) > 150
    (copy / "staywise" / "llm" / "__pycache__").mkdir(parents=True)  # what a deleted folder may leave
    assert _counts(copy)[0] == 0


def test_a_broken_operator_is_an_error(copy):
    (copy / "staywise" / "llm").mkdir()
    (copy / "staywise" / "llm" / "__init__.py").write_text("")
    (copy / "staywise" / "llm" / "catalog.py").write_text("import no_such_module\n")
    (copy / "corpus_pipeline.py").write_text("STAGES = []\n")
    assert _counts(copy)[0] != 0
