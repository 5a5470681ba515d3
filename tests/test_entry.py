"""The entry module, with and without the llm folders."""

import subprocess
import sys


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_llm():
    code = "import sys; sys.modules['shapeloom.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nassert not any(k.startswith('op') and '_' in k and k[2].isdigit() for k in e.queries()); assert 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])
