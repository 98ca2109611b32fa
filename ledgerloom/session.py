"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "ledgerloom", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks. A cluster brings its own and this is not called."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir`` of the session. Only where that is unset and all runs in one
    process, as in tests, a temporary folder is set; a cluster without a shared folder raises ValueError."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.sparkContext.setCheckpointDir(folder)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """As store, but as a checkpoint: for tables that joins should not take for small, as a compressed one may be broadcast though it
    unpacks to many times its size. The session's cleaner deletes it where the cluster lets it. Runs a job now.

    A checkpoint keeps the size that its plan was estimated to have, a product over joins: with each round the number would have as many
    digits again, until it fills the driver's memory. The table returned has no estimate.
    """
    spark = df.sparkSession
    shared_dir(spark)
    kept = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().logical().rdd(), kept.schema(), False), spark)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of the session's executors, once per application."""
    sc = spark.sparkContext
    if _shipped.get("app") == sc.applicationId:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="ledgerloom-")) / "ledgerloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    _shipped["app"] = sc.applicationId


_shipped: dict[str, str] = {}


def store(df: DataFrame) -> DataFrame:
    """The rows of df written to the shared folder as a compressed columnar table, with a lineage that starts there: later reads take
    only the columns they need, and joins know its size. The table is deleted when the driver ends. Runs a job now."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/ledgerloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _stored:
        atexit.register(_forget, spark)
    _stored.append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a folder or file on whatever file system its path names; False if there is none."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(system.exists(target) and system.delete(target, True))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text to one file on whatever file system its path names, in place of any that is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """The text of one small file."""
    return spark.read.option("wholetext", True).text(path).collect()[0][0]


def _forget(spark: SparkSession) -> None:
    try:
        for path in _stored:
            delete(spark, path)
    except Exception:  # the session is gone; whoever owns the folder empties it
        pass


_stored: list[str] = []
