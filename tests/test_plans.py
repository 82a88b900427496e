"""Plan shape: pushdown, pruning, no row-at-a-time Python, broadcast only where bounded."""

from talentlake.plans import catalog

from .conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_merge_and_transform_stay_in_the_jvm(spark):
    p = plan(catalog.QUERIES["merge_stage"](spark, SF_SMALL))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p
    assert "WindowGroupLimit" in p
    t = plan(catalog.QUERIES["transform_stage"](spark, SF_SMALL))
    assert "BatchEvalPython" not in t and "ArrowEvalPython" not in t


def test_scan_prunes_columns(spark):
    df = catalog.QUERIES["hash_id"](spark, SF_SMALL)
    s = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    schemas = [line for line in s.splitlines() if line.startswith("ReadSchema: struct<o_orderkey")]
    assert schemas and all("o_orderpriority" not in line for line in schemas)


def test_source_count_entry(spark):
    import __spark_entry__ as E
    rows = E.entry(spark).collect()
    assert rows and all(r.n > 0 for r in rows)
    assert set(E.oracle_sql()) <= set(E.queries())


def test_top_k_is_merged_before_it_is_read_and_fill_is_broadcast(spark):
    p = plan(catalog.QUERIES["text_recommend"](spark, SF_SMALL))
    assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p and "MapInArrow" not in p
    t = plan(catalog.QUERIES["salary_impute"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in t and "SortMergeJoin" not in t


def test_merge_report_reads_the_columns_it_counts_by(spark):
    p = plan(catalog.QUERIES["merge_report"](spark, SF_SMALL))
    assert "description" not in p and "salaire_max" not in p


def test_reports_have_no_nested_loop_joins(spark):
    for name in ["stats_report", "mtd", "merge_report", "run_report", "contract_split", "mom_growth"]:
        p = plan(catalog.QUERIES[name](spark, SF_SMALL))
        assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p, name


def test_core_queries_work_without_the_packages_of_the_optional_ones():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = ("import sys; sys.modules['xxhash'] = None; import __spark_entry__ as E; "
            "assert 'source_count' in E.queries() and not any(n.startswith('op') and n[2].isdigit() for n in E.queries())")
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, env=os.environ | {"PYTHONPATH": root})
