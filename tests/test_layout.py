"""The training-data operators can be removed: nothing else needs them."""

import os
import re
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_them(tmp_path):
    for name in ("lodestone", "__spark_entry__.py"):
        src = os.path.join(ROOT, name)
        if os.path.isdir(src):
            shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(src, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not [n for n in q if n.startswith('op') or n == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)


def test_nothing_else_imports_them():
    for top, _, names in os.walk(os.path.join(ROOT, "lodestone")):
        if os.sep + "llm" in top:
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(top, name), encoding="utf-8") as f:
                    assert not re.search(r"^\s*(?:from|import) lodestone\.llm", f.read(), re.M), name
