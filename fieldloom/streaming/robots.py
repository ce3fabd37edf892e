"""Decisions by robots.txt with an expiry: what a host has answered counts for an hour of event time, then it is asked again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..sources.fetch import KEEP, Robots

DECISIONS = "request_id long, host string, url string, at double, read_at double, fresh boolean, allowed boolean, robots string, crawl_delay double"


def decide(rows: pd.DataFrame, kept: tuple | None, keep: float, agent: str) -> tuple[pd.DataFrame, tuple | None]:
    """The decisions on a host's requests in order of time, and the answer (at, status, text) that is kept then."""
    out, rules = [], Robots(kept[1], kept[2]) if kept else None
    for r in rows.sort_values(["at", "request_id"]).itertuples(index=False):
        fresh = kept is None or r.at - kept[0] >= keep
        if fresh:
            kept = (float(r.at), None if pd.isna(r.robots_status) else int(r.robots_status), None if pd.isna(r.robots_text) else r.robots_text)
            rules = Robots(kept[1], kept[2])
        out.append((r.request_id, r.host, r.url, r.at, kept[0], fresh, *rules.decide(r.url, agent)))
    return pd.DataFrame(out, columns=[x.split(" ")[0] for x in DECISIONS.split(", ")]), kept


class Keeper(StatefulProcessor):
    """State per host: when robots.txt was read and what it said. A timer takes it away when it expires, so that hosts nobody asks for leave nothing behind."""

    def __init__(self, keep: float, agent: str):
        self.keep, self.agent = keep, agent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.answer = handle.getValueState("answer", "at double, status int, text string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = tuple(self.answer.get()) if self.answer.exists() else None
        before = kept and kept[0]
        decided, kept = decide(pd.concat(list(rows)), kept, self.keep, self.agent)
        if kept[0] != before:
            if before is not None:
                self.handle.deleteTimer(int((before + self.keep) * 1000))
            self.answer.update(kept)
            self.handle.registerTimer(int((kept[0] + self.keep) * 1000))
        yield decided

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.answer.clear()
        return iter(())

    def close(self) -> None:
        pass


def robots_stream(requests: DataFrame, keep: float = KEEP, agent: str = "fieldloom", late: str = "1 minute") -> DataFrame:
    """A stream of requests (request_id, host, url, at in seconds, robots_status, robots_text: what the site would answer at that time) with its decisions (DECISIONS).

    Requests of a host are taken in order of time within a batch; the watermark drives the timers. Needs the RocksDB state store.
    """
    timed = requests.withColumn("ts", F.timestamp_seconds("at")).withWatermark("ts", late)
    return timed.groupBy("host").transformWithStateInPandas(Keeper(keep, agent), StructType.fromDDL(DECISIONS), "Append", "EventTime")


def robots_decisions(requests: DataFrame, keep: float = KEEP, agent: str = "fieldloom") -> DataFrame:
    """The same decisions for a table: each host's requests are one stream in order of time, read in pieces."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host, kept = None, None
        for frame in frames:
            for h, rows in frame.groupby("host", sort=False, dropna=False):
                decided, kept = decide(rows, kept if h == host else None, keep, agent)
                host = h
                yield decided

    columns = ["request_id", "host", "url", "at", "robots_status", "robots_text"]
    return requests.select(*columns).repartition("host").sortWithinPartitions("host", "at", "request_id").mapInPandas(run, DECISIONS)
