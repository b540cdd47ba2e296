"""The checkpoint folder comes from the session; a scratch one only when unset."""
import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SNIPPET = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from saiflow.session import ensure_checkpoint_dir, scratch_path
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
a, b = ensure_checkpoint_dir(s), ensure_checkpoint_dir(s)
assert a == b and scratch_path(s, "x") == a + "/x"
assert s.range(3).checkpoint().count() == 3
print("OK", a)
"""


def test_fallback_checkpoint_dir_when_unset():
    conf_dir = tempfile.mkdtemp(prefix="saiflow-noconf-")      # no spark-defaults.conf
    env = dict(os.environ, SPARK_CONF_DIR=conf_dir)
    out = subprocess.run([sys.executable, "-c", SNIPPET.format(root=ROOT)], env=env,
                         capture_output=True, text=True, timeout=300)
    assert "OK " in out.stdout, out.stderr[-2000:]


def test_configured_checkpoint_dir_is_used(spark):
    from saiflow.session import ensure_checkpoint_dir
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        assert ensure_checkpoint_dir(spark) == configured


def test_cluster_without_shared_folder_is_an_error():
    """Executors of a cluster do not share a local folder, so none is made up for them."""
    import pytest
    from saiflow.session import ensure_checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())
