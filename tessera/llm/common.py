"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.session import workers_import

#: Rows of an Arrow batch: texts can be long, so batches stay short and a worker's memory bounded.
BATCH_ROWS, BATCH_BYTES = 2048, 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """What every operator with Python workers needs: short Arrow batches and importable modules."""
    workers_import(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so columns with clashing names cannot reach an operator's own."""
    return df.select(*(df[n] for n in names))


def texts(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null is empty."""
    import pyarrow as pa

    return [b if b is not None else b"" for b in column.cast(pa.large_binary()).to_pylist()]


def release() -> None:
    """Give memory that a finished task no longer needs back to the machine; Python workers live on for later tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim:
        trim(0)


def released(run):
    """A function over Arrow batches that releases memory at its end."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return whole
