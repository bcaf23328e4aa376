import os
import subprocess
import sys

import pytest

import __spark_entry__
from tessella import catalog

DATA = "/root/testdata/sf0.001"


def test_contract():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(catalog.queries()) > 50
    assert len({q.name for q in catalog.ALL}) == len(catalog.ALL)


def test_imports_without_the_corpus_package(tmp_path):
    """The rest of the library stands without the corpus operators and the pipeline."""
    here = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    os.makedirs(tmp_path / "tessella")
    os.symlink(f"{here}/__spark_entry__.py", tmp_path / "__spark_entry__.py")
    for name in os.listdir(f"{here}/tessella"):
        if name != "llm":
            os.symlink(f"{here}/tessella/{name}", tmp_path / "tessella" / name)
    code = f"import sys; sys.path[:0] = [{str(tmp_path)!r}]; import __spark_entry__ as e; assert not any(n.startswith('op') for n in e.queries()); print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and int(out.stdout.split()[-1]) > 50, out.stderr[-500:]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't here")
def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0
