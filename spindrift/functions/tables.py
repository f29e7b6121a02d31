"""Tables that an operation writes for itself: they cut the lineage and are computed once."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a local one in local mode, else one in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and spark.sparkContext.master.startswith("local"):
        found = "file://" + os.path.join(tempfile.gettempdir(), "spindrift-captures")
    return (found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/spindrift-tables").rstrip("/")


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, with a short plan for all that follows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
