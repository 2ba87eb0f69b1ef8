"""The entry without its optional parts: the rest imports, registers its queries and is collected by pytest."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; print(sorted(e.queries())); print(sorted(e.oracle_sql())); print(len(e.LLM_QUERIES))"


def without(scratch, *names):
    """A copy of the repository without the files and folders named."""
    out = os.path.join(scratch, "copy")
    left_out = {os.path.join(ROOT, n) for n in names}
    shutil.copytree(ROOT, out, ignore=lambda d, found: [x for x in found if os.path.join(d, x) in left_out or x in (".git", "__pycache__")])
    return out


def run(copy, *args):
    return subprocess.run([sys.executable, *args], cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": copy},
                          timeout=300, check=True).stdout


@pytest.mark.parametrize("names", [("citeweave/llm", "tests/llm"), ("citeweave/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_the_rest_stands_alone(scratch, names):
    from citeweave.plans.catalog import QUERIES
    copy = without(scratch, *names)
    queries, oracles, own = run(copy, "-c", SHOW).splitlines()
    assert set(QUERIES) <= set(eval(queries)) and set(eval(oracles)) <= set(eval(queries))
    assert "pipeline" not in eval(queries)
    if "citeweave/llm" in names:
        assert own == "0" and "error" not in run(copy, "-m", "pytest", "tests", "-q", "--collect-only").lower().splitlines()[-1]
