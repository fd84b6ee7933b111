"""Edges matched to connected routes as they arrive (Mode 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from roadweave.operators.routes import RouteParameters, match_routes
from roadweave.plans.scratch import Scratch


def route_stream(edges: DataFrame, network: DataFrame, path: str, checkpoint: str, parameters: RouteParameters | None = None, **more) -> StreamingQuery:
    """Routes of each micro-batch of edges (id, pts) through a static network, under path/long and path/summary.

    A source's route depends on the network near it alone, so batches together give what one run over all would. The network
    is written once, at the start. Rows carry batch_id; a batch that is run again replaces its own folder, so each source is
    there exactly once as long as it arrives once.
    """
    q = parameters or RouteParameters(**more)
    fixed = Scratch(network.sparkSession, "network").table(network, "edges")

    def write(batch: DataFrame, number: int) -> None:
        arrived = Scratch(batch.sparkSession, "arrived").table(batch.select("id", "pts"), "edges")  # read more than once
        long, summary = match_routes(arrived, fixed, q)
        for name, rows in (("long", long), ("summary", summary)):
            rows.withColumn("batch_id", F.lit(number)).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")

    return edges.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
