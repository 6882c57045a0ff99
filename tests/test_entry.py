"""The entry module with and without the corpus subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]
SHOW = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith(('op1_', 'pipeline')) for n in e.queries()))"


def _shown(folder):
    return subprocess.run([sys.executable, "-c", SHOW], cwd=folder, capture_output=True, text=True, check=True).stdout.split()


def test_entry_without_the_corpus_modules(tmp_path):
    bare = tmp_path / "bare"
    shutil.copytree(REPO, bare, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    n, oracles, corpus = _shown(bare)
    assert int(n) >= int(oracles) > 90 and corpus == "False"
    if (REPO / "plangauge" / "llm").is_dir():
        shutil.copy(REPO / "corpus_pipeline.py", bare)
        assert _shown(bare) == [n, oracles, corpus]
        assert _shown(REPO)[2] == "True"
