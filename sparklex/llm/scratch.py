"""Tables written on the way, in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset, as in tests, a temporary folder that is set as such."""
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def fewer(df: DataFrame) -> DataFrame:
    """df in four tasks a core, or an eighth of a shuffle's partitions, if that is more: for rows of a few numbers each.

    A task takes its partitions one after another, so that its memory is that of one of them.
    """
    spark = df.sparkSession
    return df.coalesce(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))


def by_file(files: DataFrame) -> DataFrame:
    """A manifest (a row a file) dealt so that its files are read side by side; files are few, so some tasks stay empty."""
    return files.repartition(max(1, 3 * files.count()), "file")


def written(df: DataFrame, name: str, narrow: bool = False, group: int = 1 << 27) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: it cuts the lineage and outlives executors. narrow: in fewer() tasks.

    group: bytes of a row group, as compressed, which one task reads; a file of one group leaves the tasks of its other splits without rows.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df = fewer(df) if narrow else df
    df.write.option("compression", "zstd").option("parquet.block.size", group).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes a written() table that no later step reads."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
