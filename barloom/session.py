"""Session helpers: a local builder for tests and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", app: str = "barloom", memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    n = 8 if cores == "*" else int(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` of the session, else the checkpoint folder set on
    its context. A session on one machine (a test) may have neither and gets a
    temporary folder, which goes when the process ends; a cluster may not.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="barloom-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: The folder of each running application below the shared one.
_own: dict[tuple[str, str], str] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A path for a fresh folder below the shared one.

    All paths of an application lie in one folder, which Spark's file system
    deletes when the driver's JVM ends.
    """
    key = (spark.sparkContext.applicationId, shared_root(spark))
    if key not in _own:
        own = spark._jvm.org.apache.hadoop.fs.Path(f"{key[1]}/barloom-{uuid.uuid4().hex}")
        fs = own.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(own)
        fs.deleteOnExit(own)
        _own[key] = own.toString()
    return f"{_own[key]}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str = "kept", by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` to the shared folder now and read it back, in one folder for each value of ``by``.

    For a table that several branches of a plan use: it is computed once, the
    plan stays short, and a lost executor re-reads files instead of redoing the
    work before them. The copy goes when the driver ends.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
