"""Cutting the lineage of jobs that go in rounds."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def set_folder(spark: SparkSession) -> None:
    """Use the checkpoint folder that the session names; on one machine, a temporary one that ends with the process if it names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if named is None:
            named = tempfile.mkdtemp(prefix="tracejobs-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read from the checkpoint folder from here on."""
    set_folder(df.sparkSession)
    return df.checkpoint()


def cut_all(*tables: DataFrame) -> list[DataFrame]:
    """The tables, as cut has them, but computed by one job, so that a shuffle that they share is made once."""
    columns = lambda of, df: [F.struct(*df.columns).alias(f"of_{i}") if i == of else F.lit(None).cast(t.schema).alias(f"of_{i}") for i, t in enumerate(tables)]
    both = cut(reduce(DataFrame.unionByName, [df.select(F.lit(i).alias("table"), *columns(i, df)) for i, df in enumerate(tables)]))
    return [both.where(F.col("table") == i).select(f"of_{i}.*") for i in range(len(tables))]
