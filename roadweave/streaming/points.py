"""Points snapped to a static network as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from roadweave.operators.points import match_points


def snap_stream(points: DataFrame, edges: DataFrame, max_distance: float, path: str, checkpoint: str) -> StreamingQuery:
    """Matches each micro-batch like a table of its own; rows carry batch_id, and a batch that is run again replaces its rows."""

    def write(batch: DataFrame, number: int) -> None:
        out = match_points(batch, edges, max_distance).withColumn("batch_id", F.lit(number))
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return points.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
