"""An extension: a stream of the rows that each commit adds, by Structured Streaming over the generations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..model import GROUP, Connection


def read_generations(spark: SparkSession, conn: Connection | dict | str) -> DataFrame:
    """key, ts, value, gen, gid of every generation as it is written; a consumer keeps the greatest ts of a key."""
    return spark.readStream.schema(GROUP).option("basePath", f"{Connection.of(conn).path}/groups").option("ignoreMissingFiles", "false").parquet(f"{Connection.of(conn).path}/groups")
