import importlib.util
import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

# Loads the entry with one module hidden, and prints the names of its queries.
HIDING = """
import importlib.abc, sys

class Hidden(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == {hidden!r} or name.startswith({hidden!r} + "."):
            raise ModuleNotFoundError(name)

sys.path.insert(0, {root!r})
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as entry
assert set(entry.oracle_sql()) <= set(entry.queries())
print(*sorted(entry.queries()), sep="\\n")
"""


def names(hidden):
    script = HIDING.format(hidden=hidden, root=ROOT)
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=120, cwd="/")
    assert done.returncode == 0, done.stderr
    return set(done.stdout.split())


def test_entry_without_the_training_data_operators():
    left = names("fleetframe.llm")
    assert "top_customers" in left and "pipeline" not in left
    assert not any(name.startswith("op") and "_" in name and name[2].isdigit() for name in left)


def test_entry_without_the_pipeline():
    if importlib.util.find_spec("fleetframe.llm") is None:
        pytest.skip("the training-data operators are not here")
    left = names("corpus_pipeline")
    assert "op3_byte_bpe" in left and "pipeline" not in left
