"""Queries against their DuckDB SQL on the smallest tables, where these are there."""

import glob
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_library_needs_no_subpackage_for_training_data(tmp_path):
    """Copied without it, and without the pipeline, the entry module is imported and has its other queries."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(f"{root}/flowlens", f"{tmp_path}/flowlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(entry.__file__, tmp_path)
    code = "import __spark_entry__ as e, pkgutil, importlib, flowlens; [importlib.import_module(m.name) for m in pkgutil.walk_packages(flowlens.__path__, 'flowlens.') if not m.name.endswith('__main__')]; print(len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0 and int(done.stdout) > 45, done.stderr


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")
@pytest.mark.parametrize("name", ["packets_projection", "flow_tcp_state", "subnet_sweep", "smb_audit", "dns_tunnel", "beacon_whole_flow", "http_audit_one_per_flow", "ja4", "beacon_prefix", "flow_instances", "alert_dedup", "dns_telemetry", "evidence_offsets", "stix_objects"])
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = entry.queries()[name](spark, DIR)
    want = c.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(names).collect()))) == sorted(map(repr, want.fetchall()))
