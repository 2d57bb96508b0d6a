"""The entry module works with and without the corpus subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(path):
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(*q)"
    return subprocess.run([sys.executable, "-c", code], cwd=path, env={**os.environ, "PYTHONPATH": str(path)}, capture_output=True, text=True, check=True).stdout.split()


def test_entry(tmp_path):
    ignore = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=ignore)
    alone = names(tmp_path / "repo")
    assert len(alone) > 100 and "pipeline" not in alone and not any(n.startswith("op") for n in alone)
    if os.path.exists(f"{ROOT}/laminar/llm/queries.py"):
        assert set(names(ROOT)) - set(alone) >= {"pipeline", "op2_sharding"}


def test_flagship(spark):
    import __spark_entry__

    if os.path.isdir("/root/testdata/sf0.001"):
        assert __spark_entry__.entry(spark).count() == 5
