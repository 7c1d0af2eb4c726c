"""Plan-shape checks: no cartesian products or nested-loop joins in any
registered batch query; scans prune columns; sources read via inventory."""

import os
import tempfile

import pytest

from conftest import SF_SMALL


def _batch_keys():
    from corpusflow.plans.registry import all_queries

    return sorted(k for k in all_queries() if not k.startswith("str_"))


@pytest.mark.parametrize("key", _batch_keys())
def test_no_cross_products(spark, key):
    from corpusflow.plans.registry import all_queries

    df = all_queries()[key].fn(spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_scan_prunes_columns(spark):
    from corpusflow.plans.registry import all_queries

    df = all_queries()["rpt_status_counts"].fn(spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # the status derivation needs doc_id only: text is never read
    assert "ReadSchema: struct<doc_id:bigint>" in plan


def test_file_inventory(spark):
    from corpusflow.operators.reports import repo_dirs
    from corpusflow.sources.inventory import read_file_inventory

    root = tempfile.mkdtemp(prefix="inv-", dir="/tmp")
    for owner, name, sizes in (("a", "x", [10, 20]), ("b", "y", [5])):
        d = os.path.join(root, owner, name, "src")
        os.makedirs(d)
        for n, size in enumerate(sizes):
            with open(os.path.join(d, f"f{n}.txt"), "wb") as f:
                f.write(b"x" * size)
    inv = read_file_inventory(spark, root)
    base_depth = len([p for p in root.split("/") if p])
    got = {r.repo_dir.split("/")[-2] + "/" + r.repo_dir.split("/")[-1]: r.size_bytes
           for r in repo_dirs(inv, base_depth).collect()}
    assert got == {"a/x": 30, "b/y": 5}
