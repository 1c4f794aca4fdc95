"""The entry module with and without the optional subpackage."""

import subprocess
import sys

from .conftest import ROOT


def said(code):
    run = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    return run.stdout.split()


def test_without_the_subpackage():
    block = "import sys; sys.modules['tidemark.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
    names = said(block + "import __spark_entry__ as e; print(*e.queries())")
    assert "plan_oneway" in names and "pipeline" not in names and not [n for n in names if n[:2] == "op" and n[2].isdigit()]


def test_sql_belongs_to_queries():
    assert said("import __spark_entry__ as e; print(len(set(e.oracle_sql()) - set(e.queries())))") == ["0"]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
