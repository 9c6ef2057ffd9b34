"""bench.py contract: one JSON line with every registered query timed."""

import json
import os
import subprocess
import sys

import __spark_entry__ as E

from conftest import SF_SMALL

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_prints_one_json_line_with_all_queries():
    env = dict(os.environ, BENCH_SF_DIR=SF_SMALL, BENCH_CPUS="4", BENCH_TRIALS="1")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env, cwd=ROOT,
                         capture_output=True, text=True, timeout=900)
    assert out.returncode == 0, out.stderr[-2000:]
    lines = [ln for ln in out.stdout.splitlines() if ln.strip()]
    assert len(lines) == 1
    d = json.loads(lines[0])
    assert d["metric"] and d["unit"] == "sec" and d["sf"] == 0.001
    assert set(E.queries()) | {"build_events"} == set(d["queries"])
    assert all(v >= 0 for v in d["queries"].values())
    assert abs(d["value"] - sum(d["queries"].values())) < 0.01
