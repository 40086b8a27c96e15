"""The rest of the repository stands alone without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("pipeline", [True, False])
def test_queries_without_the_optional_folders(tmp_path, pipeline):
    here = tmp_path / "copy"
    shutil.copytree(ROOT, here, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "spark-warehouse", *([] if pipeline else ["corpus_pipeline.py"])))
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(s), 'pipeline' in q, any(x.startswith('op1') for x in q), set(s) <= set(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=here, capture_output=True, text=True, timeout=300)
    n, m, *flags = out.stdout.split()
    assert int(n) > 100 and int(m) > 100 and flags == ["False", "False", "True"], out.stderr
