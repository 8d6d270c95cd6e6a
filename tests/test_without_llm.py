"""The library without its optional part."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; print(len(e.queries()), sum(n.startswith('op') or n == 'pipeline' for n in e.queries()))"


def test_entry_imports_without_the_operators_whether_or_not_the_pipeline_is_there(tmp_path):
    for at, left in enumerate((("corpus_pipeline.py",), ())):
        copy = tmp_path / str(at)
        shutil.copytree(ROOT / "patronage", copy / "patronage", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        for name in ("__spark_entry__.py", *left):
            if (ROOT / name).exists():
                shutil.copy(ROOT / name, copy)
        run = subprocess.run([sys.executable, "-c", ASK], cwd=copy, capture_output=True, text=True, timeout=120)
        assert run.returncode == 0, run.stderr
        total, optional = map(int, run.stdout.split())
        assert total > 100 and optional == 0
