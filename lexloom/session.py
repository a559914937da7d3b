"""What every operator needs from its session: shipped code and shared scratch space."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_LOCK = threading.Lock()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application."""
    sc = spark.sparkContext
    with _LOCK:
        if sc.applicationId in _SHIPPED:
            return
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="lexloom-")) / "lexloom-code.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(Path("lexloom") / p.relative_to(root)))
        sc.addPyFile(str(archive))
        _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where that is unset and the master is local (tests)."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), f"lexloom-{os.getuid()}")


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, path) of a path of any kind."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()), p


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts lineage in a way that survives lost executors, and an expensive stage that several
    branches need runs once. The folder is deleted when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexloom-{uuid.uuid4().hex}"
    fs, p = file_system(spark, path)
    fs.deleteOnExit(p)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for exactly this DataFrame; nothing may read it any more."""
    path = getattr(df, "_lexloom_path", None)
    if path:
        fs, p = file_system(df.sparkSession, path)
        fs.delete(p, True)


def spread(df: DataFrame, small_bytes: int = 64 << 20) -> DataFrame:
    """Rows of a small table over all cores.

    A file of a few MB is one task, however much work each of its rows makes. Tables whose files
    take more than ``small_bytes`` have tasks enough and are left as they are, without a shuffle.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= small_bytes else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
