"""Watch mode: a tick stream whose batches run the incremental pass.

Session logs grow in place, which Spark's file stream would not notice, so every tick compares manifests. A pass that
is repeated after a failure changes nothing, as documents have stable ids and states are written last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def changes(result: dict[str, dict[str, int]]) -> dict[str, int]:
    """What a pass indexed: turns, chunks and commits."""
    get = lambda source, key: (result.get(source) or {}).get(key, 0)
    return {"turns": get("agent", "turns"), "chunks": get("code", "chunks"), "commits": get("commits", "commits")}


def watch(spark: SparkSession, one_pass: Callable[[], dict[str, dict[str, int]]], checkpoint: str, seconds: int = 15, report: Callable[[dict[str, int]], None] = print) -> StreamingQuery:
    """Runs ``one_pass`` every ``seconds`` until the query is stopped and reports passes that changed something."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def run(_batch: DataFrame, _number: int) -> None:
        n = changes(one_pass())
        if any(n.values()):
            report(n)

    return ticks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
