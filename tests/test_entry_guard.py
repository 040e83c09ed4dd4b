"""The entry works where the corpus subpackage and the pipeline are absent."""

from __future__ import annotations

import os
import re
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_subpackage():
    code = "import sys; sys.modules['meridia.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 60 and set(s) <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_the_subpackage():
    for folder, _, files in os.walk(os.path.join(ROOT, "meridia")):
        if os.path.relpath(folder, ROOT).split(os.sep)[1:2] == ["llm"]:
            continue
        for name in files:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    assert not re.search(r"meridia\.llm|from meridia import llm|corpus_pipeline", f.read()), name
