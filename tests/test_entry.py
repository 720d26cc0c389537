"""The entry works without the optional part, and without the packages that part needs."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = """
import sys
for name in sys.argv[1:]:
    sys.modules[name] = None
import __spark_entry__ as entry
from ringfold.plans import catalog
assert set(catalog.queries()) <= set(entry.queries())
print(len(entry.queries()), len(catalog.queries()))
"""


def _counts(*blocked):
    done = subprocess.run([sys.executable, "-c", COUNT, *blocked], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return tuple(map(int, done.stdout.split()))


def test_entry_without_an_optional_package():
    for blocked in ("zstandard", "ringfold.llm", "corpus_pipeline"):
        found, core = _counts(blocked)
        assert found == core > 50
