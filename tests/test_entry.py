"""The entry module stands without the llm folders and the pipeline."""

import os
import re
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import __spark_entry__ as e
names = set(e.queries())
assert len(names) > 240 and set(e.oracle_sql()) <= names
print(sorted(n for n in names if n.startswith("op") or n == "pipeline"))
"""


def listed(folder):
    got = subprocess.run([sys.executable, "-c", CODE], cwd=folder, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""}, check=True)
    return got.stdout.strip().splitlines()[-1]


def test_without_the_llm_folders(tmp_path):
    shutil.copytree(HERE, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    assert listed(tmp_path / "r") == "[]"


def test_nothing_else_imports_llm():
    for folder, _, files in os.walk(os.path.join(HERE, "treeloom")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f)) as text:
                        assert not re.search(r"\bllm\b", text.read()), f
