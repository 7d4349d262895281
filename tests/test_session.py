import pytest

from basketry import session


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _Context:
    def __init__(self, master, conf=None):
        self.master = master
        self._dir = None
        self._conf = _Conf(conf or {})

    def getConf(self):
        return self._conf

    def getCheckpointDir(self):
        return self._dir

    def setCheckpointDir(self, path):
        self._dir = path


class _Session:
    def __init__(self, master, conf=None):
        self.conf = _Conf(conf or {})
        self.sparkContext = _Context(master, conf)


def test_cluster_without_checkpoint_dir_is_an_error():
    with pytest.raises(RuntimeError):
        session.checkpoint_dir(_Session("yarn"))


def test_configured_folder_is_used():
    s = _Session("yarn", {"spark.checkpoint.dir": "hdfs:///shared/ckpt"})
    assert session.checkpoint_dir(s) == "hdfs:///shared/ckpt"
    assert s.sparkContext.getCheckpointDir() == "hdfs:///shared/ckpt"


def test_local_mode_gets_a_private_folder():
    s = _Session("local[2]")
    path = session.checkpoint_dir(s)
    assert path and s.sparkContext.getCheckpointDir() == path


def test_configured_folder_wins_over_an_active_one():
    s = _Session("yarn", {"spark.checkpoint.dir": "hdfs:///shared/ckpt"})
    s.sparkContext.setCheckpointDir("hdfs:///elsewhere")
    assert session.checkpoint_dir(s) == "hdfs:///shared/ckpt"
    assert s.sparkContext.getCheckpointDir() == "hdfs:///shared/ckpt"


def test_materialized_tables_can_be_removed(spark):
    before = session._written.pop(spark.sparkContext.applicationId, [])
    df = session.materialize(spark.range(5))
    assert df.count() == 5 and session.clear_materialized(spark) == 1
    session._written[spark.sparkContext.applicationId] = before


def test_shuffles_that_nothing_needs_go_while_a_fit_runs(spark):
    import gc
    import os
    import time

    from basketry.session import collecting

    def files():
        dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager() \
            .diskBlockManager().localDirsString()
        return {os.path.join(d, f) for top in dirs for d, _, names in os.walk(top) for f in names
                if f.startswith("shuffle_")}

    before = files()
    spark.range(2000).repartition(3).groupBy("id").count().collect()
    made = files() - before
    assert made
    with collecting(spark, 0.3):
        for _ in range(100):
            gc.collect()
            if not made & files():
                break
            time.sleep(0.3)
    assert not made & files()
