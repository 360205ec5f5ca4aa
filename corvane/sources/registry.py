"""The workspace registry as a JSON file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import WORKSPACES

_FILE = "workspaces array<struct<id:string,path:string,alias:string,tags:array<string>>>, defaultId string"


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a registry file; none if it is missing or can't be read."""
    empty = spark.createDataFrame([], WORKSPACES)
    try:
        raw = spark.read.schema(_FILE).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
        rows = raw.select("defaultId", F.explode("workspaces").alias("w")).select("w.id", "w.path", "w.alias", "w.tags", F.coalesce(F.col("w.id") == F.col("defaultId"), F.lit(False)).alias("is_default"))
        rows.limit(1).collect()
    except Exception:  # noqa: BLE001  what can't be read is no registry
        return empty
    return rows


def write_registry(registry: DataFrame, path: str) -> None:
    """The whole file anew, as one object."""
    one = registry.agg(
        F.sort_array(F.collect_list(F.struct("id", "path", "alias", "tags"))).alias("workspaces"), F.max(F.when(F.col("is_default"), F.col("id"))).alias("defaultId")
    )
    one.coalesce(1).write.mode("overwrite").json(path)
