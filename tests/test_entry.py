"""The entry keeps its core queries whatever of the optional operators is missing."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("missing", ["wayfold.llm", "corpus_pipeline", "tiktoken", "public_tokenizers", "numpy"])
def test_core_queries_survive_a_missing_dependency(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; q = e.queries(); assert 'q_status_kpi' in q and 'op1_warc' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
