"""Sessions send the package's code to their workers."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]

PROGRAM = """
import sys
sys.path.insert(0, {root!r})
from keelson.session import build_session, ship_package, scratch_path
from keelson.sources import listing as L
spark = build_session("elsewhere", "local-cluster[1,1,1024]", spark__ui__enabled="false", spark__checkpoint__dir={scratch!r},
                      spark__sql__shuffle__partitions="2")
ship_package(spark)
assert sum("keelson-code" in name for name in spark.sparkContext._python_includes) == 1
spark.range(3).coalesce(1).write.parquet({scratch!r} + "/t")
print("files", L.list_tree(spark, {scratch!r} + "/t").filter("path like '%/part-%'").count())
"""


def test_workers_started_elsewhere_have_the_package(tmp_path):
    """Workers of another process, in another folder, without the package on their path."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    program = PROGRAM.format(root=str(ROOT), scratch=str(tmp_path / "scratch"))
    done = subprocess.run([sys.executable, "-c", program], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "files 1" in done.stdout, done.stderr[-3000:]
