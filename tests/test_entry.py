"""The driver contract from outside the repository: load the entry file by
path from another directory, in a plain session, and run queries whose
Python workers must import the package."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import importlib.util
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false')
         .config('spark.ui.showConsoleProgress', 'false')
         .config('spark.driver.host', '127.0.0.1').config('spark.driver.bindAddress', '127.0.0.1').getOrCreate())
spec = importlib.util.spec_from_file_location('entry_under_test', {os.path.join(ROOT, '__spark_entry__.py')!r})
m = importlib.util.module_from_spec(spec)
spec.loader.exec_module(m)
print('entry', len(m.entry(spark).collect()))
print('ledger', m.queries()['ledger_final'](spark, '/root/testdata/sf0.001').count())
import re
print('oracles', sum(not re.match('op[0-9]+_|pipeline', k) for k in m.oracle_sql()))
"""


def test_entry_runs_from_another_directory():
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, "-c", SCRIPT], cwd="/", env=env, capture_output=True, text=True, timeout=600)
    lines = [x for x in r.stdout.splitlines() if x.split(" ")[0] in ("entry", "ledger", "oracles")]
    assert lines == ["entry 1000", "ledger 200", "oracles 94"], r.stderr[-2000:]
