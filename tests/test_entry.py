"""The entry without its optional parts."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

BLOCK = """
import sys
class Blocked:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r} or name.startswith({name!r} + "."):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Blocked())
import __spark_entry__ as entry
names = set(entry.queries())
print(len(names), sum(n.startswith("op") and n[2].isdigit() for n in names), len(set(entry.oracle_sql()) - names), "pipeline" in names)
"""


def run(name: str) -> subprocess.CompletedProcess:
    root = Path(__file__).parent.parent
    return subprocess.run([sys.executable, "-c", BLOCK.format(name=name)], cwd=root, capture_output=True, text=True)


@pytest.mark.parametrize("name", ["custodia.llm", "public_tokenizers", "xxhash"])
def test_optional_parts_may_be_missing(name):
    count, operators, unnamed, pipeline = run(name).stdout.split()
    assert int(count) >= 105 and (int(operators), int(unnamed), pipeline) == (0, 0, "False")


def test_the_library_itself_may_not():
    failed = run("custodia.operators.pii")
    assert failed.returncode and "Error" in failed.stderr
