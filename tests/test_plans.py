"""The plans that matter at scale keep their shape."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

DATA = Path("/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parent.parent


def plan(spark, name):
    return __spark_entry__.queries()[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name, exchanges", [("equalized_summary", 0), ("window_render_default", 0), ("histogram", 1), ("histogram_cdf", 2), ("job_latest", 1), ("distinct_until_changed", 1), ("progress_rate", 1)])
def test_exchanges(spark, name, exchanges):
    text = plan(spark, name)
    assert text.count("Exchange hashpartitioning") <= exchanges and "CartesianProduct" not in text


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_scans_are_pruned(spark):
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan(spark, "histogram")
    assert "text" not in plan(spark, "decode_counts").split("ReadSchema")[1]


def test_entry_without_the_corpus_package(tmp_path):
    """Everything else imports and is registered when the corpus package is deleted."""
    shutil.copytree(ROOT / "rayloom", tmp_path / "rayloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 70 and set(s) <= set(q) and not any(n.startswith('op') and n[2].isdigit() for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
