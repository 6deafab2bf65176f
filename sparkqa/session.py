"""Session helpers: table loading, a shared scratch folder, and a local session for tests/bench."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table; Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Shared folder for written tables and checkpoints: the session's ``spark.checkpoint.dir``
    (a shared file system on a real cluster), else the context's checkpoint folder. Neither
    set is an error: a machine-local folder is not seen by executors, so none is guessed."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a shared folder (written tables and checkpoints go there)")
    return base.rstrip("/")


_SCOPES: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, never reused path under the shared folder (inside the open ``scratch`` scope, if any)."""
    return f"{_SCOPES[-1] if _SCOPES else shared_dir(spark) + '/sparkqa'}/{label}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables written inside the block are removed when it ends. Results must be
    written or collected before that: a DataFrame that reads them cannot be used afterwards."""
    path = scratch_path(spark, "scope")
    _SCOPES.append(path)
    try:
        yield path
    finally:
        _SCOPES.pop()
        p, fs = _fs(spark, path)
        fs.delete(p, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as a Parquet table under the shared folder and read it back.

    Cuts the lineage like a reliable checkpoint and survives lost executors, but runs the
    plan once (checkpointing an unpersisted frame runs it twice: the eager count, then the
    file write), and later reads prune columns and push filters into the scan. Tables live
    under ``<spark.checkpoint.dir>/sparkqa/`` for the job's lifetime."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_session(cores: int | str = "*", app: str = "sparkqa") -> SparkSession:
    """Local session with the settings the library is tuned for (AQE, UTC, no UI)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config(SPREAD, str(os.cpu_count() if cores == "*" else cores))
        .config("spark.sql.shuffle.partitions", os.environ.get("SPARKQA_SHUFFLE_PARTITIONS", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARKQA_DRIVER_MEMORY", "16g"))
    )
    if os.environ.get("SPARKQA_CHECKPOINT_DIR"):
        builder = builder.config("spark.checkpoint.dir", os.environ["SPARKQA_CHECKPOINT_DIR"])
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        # one process on one machine: a temporary folder is shared by all of it
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sparkqa-"))
    return spark


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system, so shared stores work too."""
    p, fs = _fs(spark, path)
    return bool(fs.exists(p))


def finish_folder(spark: SparkSession, written: str, path: str) -> str:
    """Gives a folder that is complete its final name. Of jobs that build the same path at once the first one wins; the
    others' folders go, and all of them read the same one."""
    src, fs = _fs(spark, written)
    dst, _ = _fs(spark, path)
    fs.mkdirs(dst.getParent())
    if fs.exists(dst) or not fs.rename(src, dst):
        fs.delete(src, True)
    # a rename onto a folder that came into being meanwhile lands inside it
    fs.delete(_fs(spark, f"{path}/{src.getName()}")[0], True)
    return path


def fingerprint(spark: SparkSession, path: str) -> str:
    """Digest of the files under ``path`` (names, lengths, times): another digest means other data."""
    p, fs = _fs(spark, path)
    files, found = fs.listFiles(p, True), []
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:32]


def list_names(spark: SparkSession, path: str) -> list[str]:
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return []
    return [s.getPath().getName() for s in fs.listStatus(p)]


SPREAD = "spark.sparkqa.spread"


def spread(df: DataFrame) -> DataFrame:
    """Deals a frame to as many tasks as the session's ``spark.sparkqa.spread`` says; without that setting
    (as on a cluster, where inputs have many splits) it is ``df`` itself. ``local_session`` sets it, as
    the small test files have one row group, and so one task, each."""
    tasks = int(df.sparkSession.conf.get(SPREAD, "0"))
    return df.repartition(tasks) if tasks else df
