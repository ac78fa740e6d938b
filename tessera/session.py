"""Session helpers: one place for the defaults tests and the bench use, and for the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    """A local session with the defaults the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tessera")
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


#: Rows and bytes of an Arrow batch: texts can be long, so batches stay short and a worker's memory bounded.
BATCH_ROWS, BATCH_BYTES = 2048, 2 << 20


def workers_import(spark: SparkSession) -> None:
    """Let local Python workers import this package, and give them short batches; on a cluster the package is installed or sent with --py-files."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); one of its own only where that is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all machines share")
        base = f"/tmp/checkpoints/tessera-{os.getpid()}"
        spark.sparkContext.setCheckpointDir(base)
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base.rstrip("/")


_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex[:12]}"
    made = _MADE.get()
    if made is not None:
        made.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path that scratch() gave."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Delete what is written below the shared folder meanwhile; for work whose result is written elsewhere at its end."""
    token = _MADE.set([])
    try:
        yield
    finally:
        made = _MADE.get()
        _MADE.reset(token)
        for path in made:
            remove(spark, path)


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write the rows as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that materialize() wrote and nothing reads any more."""
    spark = df.sparkSession
    base = shared_dir(spark).split(":", 1)[-1].lstrip("/")
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        if base in folder and "/tessera/" in folder:
            remove(spark, folder)


def forget(spark: SparkSession) -> None:
    """Delete all intermediate tables of this library in the shared folder; only when no result is read any more."""
    remove(spark, f"{shared_dir(spark)}/tessera")
