"""What the operators share: tables, the shared scratch folder, and slices of Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from granary.sources.landing import shared_dir

_WRITTEN: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads one table of a data folder through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


scratch_dir = shared_dir


def written(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet to the shared folder and reads it again."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def purge(spark: SparkSession) -> int:
    """Deletes every table that written() made in this application; call it once nothing reads them any more."""
    jvm, n = spark.sparkContext._jvm, 0
    for name in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        path = jvm.org.apache.hadoop.fs.Path(name)
        n += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return n


def slices(batches: Iterator[pa.RecordBatch], text: str, max_rows: int = 512, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the texts of one slice hold about max_bytes at most (a longer single text stands alone)."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < batch.num_rows:
            end, held = at, 0
            while end < batch.num_rows and end - at < max_rows and (held == 0 or held + size[end] <= max_bytes):
                held += int(size[end])
                end += 1
            yield batch.slice(at, end - at)
            at = end
