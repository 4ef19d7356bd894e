"""Queries where only the driver has the package."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[2]
DATA = "/root/testdata/sf0.001"
SCRIPT = f"""
import sys
sys.path.insert(0, {str(REPO)!r})
from loreweave.session import local_session
import __spark_entry__ as entry
spark = local_session("alone", "2", 2, sys.argv[1])
for name in ("op1_decontamination", "op2_deleted_interpolation", "op3_token_counts", "op4_toxicity", "op7_simhash_golay", "op10_quality_rules", "op11_passage_trees", "op12_conversation_repair", "op13_hard_negatives", "route_intents", "rename_exact"):
    print(name, entry.queries()[name](spark, {DATA!r}).count())
"""


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")
def test_package_on_the_driver_only(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    tokenizers = str(Path(__import__("public_tokenizers").__file__).parents[1])
    done = subprocess.run([sys.executable, "-c", f"import sys; sys.path.append({tokenizers!r})" + SCRIPT, str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert len(done.stdout.split("\n")) > 10
