"""Reading tables, and cutting lineage where a result is used more than once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables of fewer bytes than this, in fewer parts than there are cores, are spread over all cores.
SMALL = 256 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over all cores, if it is a small table: of at most SMALL bytes as stored, in fewer parts than there are cores.

    Larger tables are left as they are, whatever the cluster: nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    stored = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    small = int(str(stored)) <= SMALL and df.rdd.getNumPartitions() < cores
    return df.repartition(cores, key) if small else df


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared checkpoint folder.

    The folder is the one named in ``spark.checkpoint.dir``, which all executors share, so the rows
    outlive any executor. Only a session that runs on one machine may lack that setting; it gets a temporary one.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)
