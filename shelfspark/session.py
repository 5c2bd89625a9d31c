"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. On a cluster these come from the cluster
# defaults; ``build_session`` only fills the ones that are unset.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Broadcasts are decided per operator behind explicit size checks; this
    # threshold only governs what Catalyst may broadcast on its own.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


#: Bytes of a batch that a Python worker of a catalogue query gets, where the session names none. Spark's 64 MB (or
#: 10 000 rows) let a worker's memory follow the size of a task's input up to several such batches.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def small_batches(spark: SparkSession, wanted: bool = True) -> None:
    """Set the size of Arrow batches for what the session runs next, or (not ``wanted``) take it back. A value of the
    user's own is kept."""
    current = spark.conf.get(BATCH_SETTING, None)
    if wanted and current is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    elif not wanted and current == str(BATCH_BYTES):
        spark.conf.unset(BATCH_SETTING)


def build_session(master: str | None = None, app: str = "shelfspark",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster names it. Only a session on a ``local`` master, whose driver and tasks
    are one process, may go without: it gets ``fallback`` or a folder of its own."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir is unset: intermediate tables need a folder that driver and "
                             "executors share")
        configured = fallback or os.path.join(tempfile.gettempdir(), "shelfspark-checkpoints")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shared_scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder, for written tables."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Materialise ``df`` as a parquet table in the shared checkpoint folder and read
    it back: one job, lineage cut, and the data survives the loss of any executor
    (unlike cached or locally checkpointed blocks)."""
    path = shared_scratch(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in every executor's Python workers, as ``--py-files``
    would (once per SparkContext)."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    path = os.path.join(tempfile.mkdtemp(prefix="shelfspark-"), "shelfspark.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, names in os.walk(package):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(base, n)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
