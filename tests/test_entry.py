import subprocess
import sys

import __spark_entry__ as entry
from tests.conftest import ROOT


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 50


def test_without_the_corpus_subpackage():
    code = "import sys; sys.modules['candela.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q); assert not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)


def test_flagship(spark):
    t = entry.entry(spark)
    assert {r["metric"] for r in t.collect()} == {"ndcg", "recall", "mrr"}
