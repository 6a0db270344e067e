"""The package on the workers, and where intermediate tables go."""

import os
import subprocess
import sys

import pytest

from fleetsight import session

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_package_reaches_workers_from_another_folder(tmp_path):
    code = (f"import sys; sys.path.insert(0, {ROOT!r})\n"
            "from fleetsight.session import local_session\nfrom fleetsight.plans import QUERIES\n"
            "spark = local_session('2', 'away', 2, '2g')\n"
            "print('ROWS', QUERIES['W14_track_replay'](spark, '/root/testdata/sf0.001').count())\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in out.stdout, out.stderr[-2000:]


class _Master:
    """A session that names no shared folder."""
    class sparkContext:
        master = "spark://somewhere:7077"

        @staticmethod
        def getConf():
            return {}

        @staticmethod
        def getCheckpointDir():
            return None

    class conf:
        @staticmethod
        def get(name, default):
            return default


def test_a_cluster_must_name_its_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch(_Master(), "x")


def test_written_tables_can_be_deleted(spark):
    frame = session.materialize(spark.range(3), "gone")
    path = session._WRITTEN[-1].removeprefix("file:")
    assert frame.count() == 3 and os.path.isdir(path)
    session.clear_scratch(spark)
    assert not os.path.exists(path)
