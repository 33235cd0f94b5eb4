"""Arrears indicators kept up from a stream of events, late ones included.

Every indicator is a ratio of counts over consecutive events of an entity: steps between two states, rows in arrears, and spells that
begin. An event that arrives between two others takes one step away and adds two, so each micro-batch puts out signed changes of the counts, and
their sum over all batches is at any time what a batch query over all events gives. An entity's state holds
its events since the watermark, in order, and the last one before.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState

from ..operators.markov import kpi_shares

COUNTS = ("from_current", "from_arrears", "migrated", "cured", "defaulted", "in_arrears", "spells", "too_late")


def step(before: int | None, after: int | None) -> dict[str, int]:
    """What an event of state ``after`` behind one of state ``before`` (None: the first of its entity) adds to the counts."""
    if after is None:
        return {}
    out = {"in_arrears": int(after == 1), "spells": int(after == 1 and before != 1)}
    if before is not None:
        out |= {"from_current": int(before == 0), "from_arrears": int(before == 1), "migrated": int((before, after) == (0, 1)), "cured": int((before, after) == (1, 0)), "defaulted": int(before < 2 and after == 2)}
    return out


class Entity:
    """An entity's events (time, tie, state) in order. ``base`` says whether the first is the last one before the watermark, behind which nothing can be put in any more."""

    def __init__(self, events: list[tuple[int, int, int]], base: bool):
        self.events, self.base = events, base

    def add(self, event: tuple[int, int, int], totals: dict[str, int]) -> None:
        at = bisect_right(self.events, event)
        if at == 0 and self.base:
            totals["too_late"] += 1
            return
        before = self.events[at - 1][2] if at else None
        after = self.events[at][2] if at < len(self.events) else None
        for sign, changes in ((1, step(before, event[2])), (1, step(event[2], after)), (-1, step(before, after))):
            for name, n in changes.items():
                totals[name] += sign * n
        self.events.insert(at, event)

    def forget(self, watermark: int) -> None:
        """Keep the events from the watermark on, and the last one before."""
        old = bisect_right(self.events, (watermark, -(2**63), -1))
        if old > 1 or old and self.base:
            self.events, self.base = self.events[old - 1 :], True


def changes(stream: DataFrame, entity: str, time: str, tie: str, state: Column, delay: str = "1 day") -> DataFrame:
    """A stream of (what, n): signed changes of the counts named in ``COUNTS``. Events later than ``delay`` behind the newest may come too late, which is counted. state: 0 current, 1 arrears, 2 default."""
    rows = stream.select(F.col(entity).alias("entity"), F.col(time).cast("timestamp").alias("time"), F.unix_micros(F.col(time).cast("timestamp")).alias("micros"), F.col(tie).cast("bigint").alias("tie"), state.cast("int").alias("state"))
    rows = rows.where("entity IS NOT NULL AND time IS NOT NULL AND state IS NOT NULL").withWatermark("time", delay)

    def update(key: tuple, parts: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        times, ties, states, base = kept.get if kept.exists else ([], [], [], False)
        own = Entity(list(zip(times, ties, states)), base)
        totals = dict.fromkeys(COUNTS, 0)
        for part in parts:
            for event in zip(part["micros"].tolist(), part["tie"].fillna(0).astype("int64").tolist(), part["state"].tolist()):
                own.add(event, totals)
        own.forget(kept.getCurrentWatermarkMs() * 1000)
        columns = [list(c) for c in zip(*own.events)] or [[], [], []]
        kept.update((*columns, own.base))
        found = [(name, n) for name, n in totals.items() if n]
        yield pd.DataFrame({"what": [w for w, _ in found], "n": [n for _, n in found]})

    return rows.groupBy("entity").applyInPandasWithState(update, "what string, n bigint", "times array<bigint>, ties array<bigint>, states array<int>, base boolean", "append", "NoTimeout")


def keep_changes(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer of a stream of changes; each micro-batch is summed into a folder of its own, which a batch that is sent again replaces."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.groupBy("what").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")


def kept_kpis(spark: SparkSession, path: str) -> DataFrame:
    """The row of ``arrears_kpis``, and too_late, from all changes that were kept."""
    rows = spark.read.schema("what string, n bigint, batch bigint").parquet(path)
    counts = rows.agg(*(F.coalesce(F.sum(F.when(F.col("what") == c, F.col("n"))), F.lit(0)).cast("bigint").alias(c) for c in COUNTS))
    return kpi_shares(counts).crossJoin(counts.select("too_late"))
