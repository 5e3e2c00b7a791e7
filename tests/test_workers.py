"""UDFs run on workers that have no copy of the package on their path."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from evalspark.session import local_session
spark = local_session(1, shuffle_partitions=1)
from evalspark.operators.lcs import rouge_l
from evalspark.operators.meteor import meteor
df = spark.createDataFrame([("p", "the cats were running", "the cat was run")], "pair_id string, candidate string, reference string")
print("RESULT", rouge_l(df).first().rouge_l > 0, meteor(df, stem=True).first().meteor > 0)
"""


def test_udfs_travel_by_value(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "RESULT True True" in run.stdout, run.stderr[-2000:]


def test_judge_failure_costs_one_row(spark):
    import pandas as pd

    from evalspark.operators.judge import judge

    def picky(b: pd.DataFrame) -> pd.DataFrame:
        if (b["unit_no"] == 2).any():
            raise ValueError("no")
        return b.assign(verdict=True, note=None)[["evaluation_id", "model", "criterion", "unit_no", "verdict", "note"]]

    rows = spark.createDataFrame([("e", "m", "c", i) for i in range(4)], "evaluation_id string, model string, criterion string, unit_no int")
    got = {r.unit_no: r.verdict for r in judge(rows.coalesce(1), picky).collect()}
    assert got == {0: True, 1: True, 2: None, 3: True}
