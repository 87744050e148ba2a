"""The library must work without the subpackage llm."""

import subprocess
import sys

from tests.conftest import ROOT

CODE = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("fluvial.llm") or name == "corpus_pipeline":
            raise ImportError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.queries() and e.oracle_sql() and not any(n.startswith("op") or n == "pipeline" for n in e.queries())
import fluvial.operators.network, fluvial.operators.skill, fluvial.sources.readers, fluvial.streaming.daily
"""


def test_entry_without_llm():
    subprocess.run([sys.executable, "-c", CODE], cwd=ROOT, check=True, env={"PYTHONPATH": ROOT, "PATH": "/usr/bin:/bin"})
