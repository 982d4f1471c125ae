import pytest
from helpers import same_as_sql

from wardspan.plans import catalogue

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf_dir, name):
    df = catalogue.queries()[name](spark, sf_dir)
    if name in SQL:
        same_as_sql(df, SQL[name], sf_dir)
    else:
        assert df.count() > 0


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(SQL)


def test_entry_imports_without_llm(tmp_path):
    """The entry works when the llm package and the pipeline are deleted."""
    import os
    import shutil
    import subprocess
    import sys

    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{top}/wardspan", tmp_path / "wardspan", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{top}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n == 'pipeline' or n.startswith('op1_') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_plans_prune_and_push_down(spark, sf_dir):
    """A projection reads its columns only, a filter on a key reaches the scan, and validation has no Python and no shuffle."""
    from wardspan.plans.catalogue import validated

    plan = catalogue.queries()["op_match"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "c_mktsegment" not in plan.split("ReadSchema")[1]
    plan = validated(spark, sf_dir, "Line").filter("l_orderkey = 5").select("_issues")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_orderkey,5)" in plan and "Exchange" not in plan and "Python" not in plan
