"""Intermediate tables in the folder that driver and executors share, and the layout of Parquet files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.errors import EngineError


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without one gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise EngineError("state", "set spark.checkpoint.dir to a shared folder")
    own = "file://" + tempfile.mkdtemp(prefix="tessera-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def staged(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back; the files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def row_group_rows(spark: SparkSession, files: list[str]) -> int:
    """The rows of a row group in Parquet files (the last of each file may be smaller); 0 if there is no one size."""
    jvm = spark.sparkContext._jvm
    parquet, conf = jvm.org.apache.parquet.hadoop, spark.sparkContext._jsc.hadoopConfiguration()
    sizes, last = set(), 0
    for file in files:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
        reader = parquet.ParquetFileReader.open(parquet.util.HadoopInputFile.fromPath(path, conf))
        try:
            rows = [block.getRowCount() for block in reader.getFooter().getBlocks()]
        finally:
            reader.close()
        sizes.update(rows[:-1])
        last = max(last, *rows[-1:], 0)
    return sizes.pop() if len(sizes) == 1 and last <= min(sizes) else 0
