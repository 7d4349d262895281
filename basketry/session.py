"""Session helpers.

The library never reconfigures a session it is handed, with one exception:
``checkpoint_dir`` sets a checkpoint folder only when the cluster left
``spark.checkpoint.dir`` unset (local runs and tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
from contextlib import contextmanager
from threading import Event, Thread

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "basketry") -> SparkSession:
    """A local session tuned for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster in ``spark.checkpoint.dir``.

    When the setting is absent in local mode (tests, the benchmark) a private
    folder is created and registered; on a cluster the configured shared folder
    is required and always used.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if configured:
        if not current or not current.startswith(configured.rstrip("/")):
            sc.setCheckpointDir(configured)
        return configured
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: on a cluster, checkpoints must go to the "
            "shared folder the cluster names there (a machine-local folder would not "
            "survive the loss of an executor).")
    path = tempfile.mkdtemp(prefix="basketry-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


#: Folders that ``materialize`` wrote, by application, and by the frame that reads one.
_written: dict[str, list[str]] = {}
_folder: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df, name: str = "table", clean: bool = False, settings: dict | None = None):
    """Write ``df`` once as Parquet in the checkpoint folder and return a frame
    reading it.

    Used where one aggregate feeds many downstream steps (report sections,
    fit/assign/profile passes): the aggregate is computed once, survives
    executor loss (it is a file in the shared folder, unlike a local
    checkpoint), later plans start from a plain scan, and Spark knows its real
    size when it chooses a join.

    ``clean`` has Spark remove the shuffle files of the write when it ends: in
    loops they would otherwise stay until the driver collects its garbage.
    ``settings`` hold for the write. All settings are put back afterwards.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/basketry-{name}-{uuid.uuid4().hex}"
    wanted = (settings or {}) | ({_CLEANUP: "true"} if clean else {})
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    _folder[out] = path
    return out


@contextmanager
def collecting(spark: SparkSession, seconds: float):
    """Has the driver's JVM collect its garbage every few seconds, from a thread. Spark removes the
    files of a shuffle when the driver finds that nothing refers to it, which by default it looks
    for every half hour; a loop inside one call of MLlib would fill the disk before."""
    over = Event()

    def run():
        while not over.wait(seconds):
            spark.sparkContext._jvm.System.gc()

    thread = Thread(target=run, daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()


def discard(*frames) -> None:
    """Remove tables that ``materialize`` wrote and returned as ``frames``; nothing that reads
    them may be used afterwards. Other frames are left alone."""
    for df in frames:
        path = _folder.pop(df, None)
        if path is not None:
            sc = df.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
            _written[sc.applicationId].remove(path)


def clear_materialized(spark: SparkSession) -> int:
    """Remove what ``materialize`` wrote in this application; frames that read
    those tables must not be used afterwards. Returns the number of folders."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    return len(paths)
