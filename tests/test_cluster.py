import subprocess
import sys

from strandline import cluster
from strandline.sources import tables


def test_the_archive_is_the_package(tmp_path):
    path = cluster.archive(str(tmp_path / "s.zip"))
    code = f"import sys; sys.path = [{path!r}, *[p for p in sys.path if 'repo' not in p]]; import strandline.operators.series as s; print(s.__file__)"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=str(tmp_path), env={"PATH": "/usr/bin:/bin"})
    assert path in done.stdout


def test_local_workers_find_it(spark, data):
    tables.table(spark, data, "events")
    cluster.ship(spark)
    assert spark.sparkContext._strandline_shipped
