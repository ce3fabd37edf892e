"""Streams: pages scored as they arrive, and requests spaced per host with state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def score_arrivals(arriving: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Scores each batch of new pages and adds its cells to path. A batch that is repeated after a failure replaces what it wrote before, by its number."""

    def batch(pages: DataFrame, number: int) -> None:
        spark = pages.sparkSession
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        score(pages).withColumn("batch", F.lit(number)).write.mode("overwrite").partitionBy("batch").parquet(path)

    return arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def space_requests(requests: DataFrame, min_delay: float, most: float = 30.0) -> DataFrame:
    """A stream of requests (host, request_id, at in seconds, crawl_delay) with go_at: when each may go out, at least the host's delay after the one before it.

    The state per host is the time its last request went out.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for df in frames:
            df = df.sort_values(["at", "request_id"])
            out = []
            for r in df.itertuples():
                gap = max(min_delay, min(r.crawl_delay if r.crawl_delay == r.crawl_delay and r.crawl_delay is not None else 0.0, most))
                last = r.at if last is None else max(r.at, last + gap)
                out.append((key[0], r.request_id, r.at, last))
            yield pd.DataFrame(out, columns=["host", "request_id", "at", "go_at"])
        if last is not None:
            state.update((last,))

    return requests.groupBy("host").applyInPandasWithState(run, "host string, request_id long, at double, go_at double", "last double", "append", GroupStateTimeout.NoTimeout)


def event_windows(events: DataFrame, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts of activity per type and tumbling window, with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n")).select("window.start", "event_type", "n")
