"""The guard of __spark_entry__.py passes over absent modules alone, not over broken ones."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as E


@pytest.mark.parametrize("gone", ["xxhash", "zstandard"])
def test_a_missing_dependency_is_an_error(gone):
    code = f"import sys; sys.modules[{gone!r}] = None; import __spark_entry__"
    done = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(E.__file__), capture_output=True, text=True)
    assert done.returncode != 0 and f"ModuleNotFoundError: import of {gone}" in done.stderr, done.stderr
