"""Session settings every job relies on."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

# Runtime settings that are safe to apply to a session somebody else built.
_RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # What a task sorts is many times its shuffled, compressed bytes: 604 MB for 34 MB of node rows
    # were measured. Small partitions bound a task's memory as the input grows.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    # Page jobs hash node rows by page_id once; joins on (page_id, node) may
    # then reuse that layout instead of shuffling again on the longer key.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows may be long texts: smaller batches bound a Python worker's memory.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    # Keyed state with timers needs this store; jobs without keyed state are not concerned.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

# Settings of a context, for sessions built here: checkpoints go when nothing refers to them.
_CONTEXT = {"spark.cleaner.referenceTracking.cleanCheckpoints": "true"}

_SHIPPED = "feedloom-workers.zip"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in _RUNTIME.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, which need not have it on their path."""
    sc = spark.sparkContext
    if any(str(f).endswith(_SHIPPED) for f in sc.listFiles):
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="feedloom-")) / _SHIPPED  # the driver serves it from here
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent).as_posix())
    sc.addPyFile(str(path))


def build_session(app: str = "feedloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_CONTEXT, **_RUNTIME, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, for checkpoints and staged tables.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset, as in unit tests, a
    folder on the default file system stands in for it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            # Unqualified, so the default file system resolves it: local in tests, shared on a cluster.
            path = f"/tmp/feedloom-checkpoints/{sc.applicationId}"
        sc.setCheckpointDir(path)


@contextmanager
def with_settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Runtime settings for the plans that are made meanwhile."""
    before = {key: spark.conf.get(key) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def materialize(df):
    """Cut the lineage with a reliable checkpoint, which survives lost executors.

    Inferring constraints over a long chain of windows takes the planner longer than the job
    itself and finds nothing there to push down, so it is off while this plan is made.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    with with_settings(spark, {"spark.sql.constraintPropagation.enabled": "false"}):
        return df.checkpoint()


def spread(scan):
    """Use all cores for row-heavy work over a small file scan.

    A small input has fewer splits than there are cores. A large one has more, and is left as
    it is: no shuffle is added. Only for plain scans, whose split count costs no execution.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
