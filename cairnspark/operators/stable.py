"""Materialisation points.

Floating-point sums depend on the order in which shuffled rows arrive, so a frame that is read by two branches of one plan (say, ranked and
joined back to its ranks) must be evaluated once. ``stable`` writes it to the cluster's shared folder and reads it back, which also
lets a job survive lost executors.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="cairnspark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stable(df: DataFrame) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
