"""Driver contract: entry(), queries(), oracle_sql()."""

import importlib.util
import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry_module():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_runs(spark):
    mod = _entry_module()
    df = mod.entry(spark)
    rows = df.collect()
    assert len(rows) == 6
    assert df.columns == ["status", "n"]
    assert sum(r.n for r in rows) == 200


def test_queries_and_oracles_align():
    mod = _entry_module()
    q, o = mod.queries(), mod.oracle_sql()
    assert len(q) >= 100
    assert set(o) <= set(q)
    for k in o:
        assert o[k].strip()


def test_a_missing_library_takes_only_its_operators_away():
    import os
    import subprocess
    import sys

    code = ("import sys, warnings; sys.modules['ahocorasick'] = None\n"
            "with warnings.catch_warnings(record=True) as w:\n"
            "    warnings.simplefilter('always')\n"
            "    import __spark_entry__ as e\n"
            "q = e.queries(); print(len(q), 'rpt_status_counts' in q, any(k.startswith('op') or k == 'pipeline' for k in q), len(w) > 0 or not e.LLM_QUERIES)")
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], cwd=here, capture_output=True, text=True, timeout=120)
    n, base, optional, told = out.stdout.split()
    assert int(n) > 130 and base == "True" and optional == "False" and told == "True", out.stderr
