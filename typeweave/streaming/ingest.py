"""Micro-batches of relational rows added to a graph, and a standing MATCH over each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from typeweave.api import Graph


def match_stream(stream: DataFrame, graph_of: Callable[[DataFrame], Graph], pattern: str, variables: tuple[str, ...], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs MATCH pattern on the graph that graph_of makes of each micro-batch, into sink.

    checkpoint is a folder in shared storage; a batch that is run again gives sink its number again.
    """

    def run(batch: DataFrame, number: int) -> None:
        sink(graph_of(batch).query().match(pattern).to_df(*variables), number)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run).start()
