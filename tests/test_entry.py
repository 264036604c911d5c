"""The entry point with and without the optional text operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
LIST = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(*sorted(q))"


def listed(root: Path) -> set[str]:
    run = subprocess.run([sys.executable, "-c", LIST], cwd=root, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONDONTWRITEBYTECODE": "1"})
    assert run.returncode == 0, run.stderr
    return set(run.stdout.split())


def copy(to: Path) -> Path:
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, to / name)
    shutil.copytree(ROOT / "rasterlines", to / "rasterlines", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    return to


def test_queries_without_the_text_operators(tmp_path):
    root = copy(tmp_path)
    with_pipeline_file = listed(root)
    (root / "corpus_pipeline.py").unlink(missing_ok=True)
    assert listed(root) == with_pipeline_file
    assert "ctc_greedy_decode" in with_pipeline_file and not any(n.startswith("op") and n[2:3].isdigit() or n == "pipeline" for n in with_pipeline_file)
    assert with_pipeline_file <= listed(ROOT)
