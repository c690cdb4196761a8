"""Reports and working tables in folders that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def working_folder(spark: SparkSession) -> str:
    """A new path under the session's shared checkpoint folder. Only a local session may have none: it gets a temporary one; on a cluster that is an error."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base or tempfile.mkdtemp(prefix='spark-work-')}/{uuid.uuid4().hex}"


def write_report(report: DataFrame, folder: str, run_id: str) -> DataFrame:
    """Write the report as JSON under its run id and as ``latest``; return what ``latest`` holds."""
    report.write.mode("overwrite").json(f"{folder}/run_id={run_id}")
    report.sparkSession.read.schema(report.schema).json(f"{folder}/run_id={run_id}").write.mode("overwrite").json(f"{folder}/latest")
    return report.sparkSession.read.schema(report.schema).json(f"{folder}/latest")
