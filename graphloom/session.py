"""Session helpers shared by all operators."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

DROP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("graphloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder named by spark.checkpoint.dir.

    Only where that setting is absent (tests, laptops) a temporary folder is used.
    """
    shared_folder(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        return df.checkpoint(eager=True)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is materialised meanwhile leaves no shuffle files behind; else they stay until the driver happens to collect its garbage, and rounds add up on disk."""
    before = spark.conf.get(DROP, None)
    spark.conf.set(DROP, "true")
    try:
        yield
    finally:
        spark.conf.unset(DROP) if before is None else spark.conf.set(DROP, before)


def stored(df: DataFrame, path: str | None = None, mode: str = "errorifexists") -> tuple[DataFrame, str]:
    """(the rows of df as Parquet in the shared folder, the path): like cut_lineage, but smaller, and removed when the caller says so."""
    spark = df.sparkSession
    path = path or f"{shared_folder(spark)}/rows-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.mode(mode).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def shared_folder(spark: SparkSession) -> str:
    """The folder that all nodes share: spark.checkpoint.dir, or in its absence the context's checkpoint folder.

    A session in one process may fall back to a temporary folder; on a cluster executors couldn't read it, so that raises.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named is None:
        if sc.getCheckpointDir() is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-checkpoint-"))
        named = sc.getCheckpointDir()
    return named


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library wrote, wherever it is."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Renames a folder that this library wrote, if it is there."""
    old, new = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (path, to))
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(old):
        fs.mkdirs(new.getParent())
        if not fs.rename(old, new):
            raise OSError(f"{path} wasn't renamed to {to}")


def there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
