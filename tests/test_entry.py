"""The entry module without the training-data operators."""

import subprocess
import sys

import pytest

from conftest import ROOT

HIDE = "import sys; sys.modules[{!r}] = None; import __spark_entry__ as e; print(len(e.queries()), 'search_ranked' in e.oracle_sql())"


@pytest.mark.parametrize("missing", ["public_tokenizers", "corpus_pipeline", "talkgrain.llm"])
def test_queries_stay_when_an_import_fails(missing):
    from talkgrain.plans.queries import QUERIES

    got = subprocess.run([sys.executable, "-c", HIDE.format(missing)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert got.stdout.split() == [str(len(QUERIES)), "True"], got.stderr
