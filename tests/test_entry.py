import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import rows

DATA = Path("/root/testdata/sf0.001")
SAMPLE = ["split2", "split3", "evaluate", "benchmark", "flow_aggregate", "ctx_unique_ports",
          "row_rejects", "time_reversal", "packet_decode", "new_connections", "review_counters",
          "latency_percentiles"]


def test_registry():
    own = {n for n in entry.queries() if not re.match(r"op\d+_|pipeline$", n)}
    queries, oracles = own, set(entry.oracle_sql()) & own
    assert set(oracles) <= set(queries) and len(queries) >= 95
    assert set(queries) - set(oracles) == {"train_logistic", "train_gbt", "train_leafwise", "train_iforest",
                                           "compare_models", "model_ranking", "retrain_feedback"}


def test_entry(spark):
    assert {r.severity for r in entry.entry(spark).collect()} == {"critical", "high", "medium"}


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        db.execute(f"create view {file.stem} as select * from '{file}'")
    cursor = db.execute(entry.oracle_sql()[name])
    want = rows([c[0] for c in cursor.description], cursor.fetchall())
    df = entry.queries()[name](spark, str(DATA))
    assert rows(df.columns, df.collect()) == want


def test_works_without_the_optional_operators():
    """With the training-data operators deleted the rest still registers; other missing modules still fail."""
    code = """
import sys

class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in GONE:
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)

sys.meta_path.insert(0, Gone())
import __spark_entry__ as entry
print(len(entry.queries()), sum(n.startswith("op") or n == "pipeline" for n in entry.queries()))
"""
    def run(gone):
        return subprocess.run([sys.executable, "-c", f"GONE = {gone!r}\n{code}"], capture_output=True, text=True,
                              cwd=Path(entry.__file__).parent)

    for gone in (["corpus_pipeline", "flowrisk.llm"], ["corpus_pipeline"]):
        count, optional = map(int, run(gone).stdout.split())
        assert count >= 95 and optional == 0
    assert run(["flowrisk.plans.q_flows"]).returncode != 0
