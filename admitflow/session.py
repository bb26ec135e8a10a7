"""Session construction and cluster-safe lineage cutting."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, app: str = "admitflow",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Return a session tuned for these jobs.

    On a cluster the master and most sizing come from spark-submit; the
    settings here are the ones every job relies on (UTC, AQE, no UI).
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    # The cluster's own setting holds unless the caller names a number.
    parts = shuffle_partitions or os.environ.get("ADMITFLOW_SHUFFLE_PARTITIONS")
    if parts:
        b = b.config("spark.sql.shuffle.partitions", str(parts))
    b = (b.config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true")
          # Keyed stream state (limiter buckets, holds, order guards) grows with
          # the number of keys; RocksDB keeps it off the JVM heap.
          .config("spark.sql.streaming.stateStore.providerClass",
                  "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"))
    if master and master.startswith("local"):
        # Local runs bind to loopback so block fetches never leave the host.
        b = (b.config("spark.driver.host", "127.0.0.1")
              .config("spark.driver.bindAddress", "127.0.0.1")
              .config("spark.driver.memory", os.environ.get("ADMITFLOW_DRIVER_MEMORY", "8g")))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; only when the
    session has none (local tests) create a private one."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            # A machine-local folder is not reachable from other executors.
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        configured = tempfile.mkdtemp(prefix="admitflow-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint directory.

    Used between rounds of iterative plans so a lost executor recomputes
    from the last round, not from the start (never ``localCheckpoint``).
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Rounds:
    """Tables of an iterative job, written below the shared checkpoint
    directory (so lost executors recompute one round) and removed when the
    next round has used them up."""

    def __init__(self, spark: SparkSession, name: str):
        import uuid
        self.spark = spark
        self.base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        w = df.write.mode("overwrite")
        (w.partitionBy(by) if by else w).parquet(f"{self.base}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def _path(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        p, fs = self._path(name)
        return fs.exists(p)

    def move(self, name: str, to: str) -> None:
        """Put a table (or a part of one) elsewhere among the tables; one
        that has no files is an empty folder there."""
        p, fs = self._path(name)
        target, _ = self._path(to)
        fs.mkdirs(target.getParent() if fs.exists(p) else target)
        if fs.exists(p) and not fs.rename(p, target):
            raise OSError(f"{p} could not be moved to {target}")

    def drop(self, name: str) -> None:
        p, fs = self._path(name)
        fs.delete(p, True)


HOT_KEY_ROWS_CONF = "spark.admitflow.hotKeyRows"
DEFAULT_HOT_KEY_ROWS = 1_000_000


def hot_key_rows(spark: SparkSession) -> int:
    """Rows above which one key (limiter key, product, trace) counts as hot
    and is split; set ``spark.admitflow.hotKeyRows`` to about the rows of
    one shuffle partition on the cluster."""
    return int(spark.conf.get(HOT_KEY_ROWS_CONF, str(DEFAULT_HOT_KEY_ROWS)))


def ship_by_value(fn) -> None:
    """Let a user's function travel to the workers with its code, as its
    module need not be importable there; this package's own is."""
    import sys

    from pyspark import cloudpickle
    module = sys.modules.get(getattr(fn, "__module__", None) or "")
    if module is not None and module.__name__.partition(".")[0] not in (__name__.partition(".")[0], "__main__"):
        cloudpickle.register_pickle_by_value(module)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``admitflow`` importable in the Python workers, wherever the
    driver was started: zip the package once and ``addPyFile`` it (the
    programmatic form of ``spark-submit --py-files``). Once per application."""
    try:
        sc = spark.sparkContext
        app = sc.applicationId
    except Exception:  # Spark Connect: no SparkContext on the client
        sc, app = None, f"connect-{id(spark)}"
    if app in _SHIPPED:
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="admitflow-pyfiles-"), "admitflow.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    if sc is not None:
        sc.addPyFile(out)
    else:
        spark.addArtifacts(out, pyfile=True)
    _SHIPPED.add(app)
