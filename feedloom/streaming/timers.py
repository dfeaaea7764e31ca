"""STR-06 on a clock: a source turns stale an hour after its last fetch, also while nothing arrives.

Every source has a timer in Spark's keyed state. A finished fetch sets it anew; when it fires,
the source enters the plan, the active one to be fetched now and the others deferred. The stream
runs a batch on every trigger, with input or without, and state and timers come back from the
checkpoint. What happened while it was down fires in the first batch.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from feedloom import schema as S
from feedloom.streaming.tables import BUCKETS, VersionedTable, run

HOUR_MS = 3_600_000
PLAN = "source_id STRING, last_fetched_at TIMESTAMP, stale BOOLEAN, priority STRING"
_CHANGE = "source_id string, last_ms long, stale boolean"


def _clock(after_ms: int) -> StatefulProcessor:
    """One source's last fetch and the timer that follows it.

    The class is local, so that it travels whole: the process that Spark starts beside the
    driver to set up the state has only PySpark on its path.
    """

    class Clock(StatefulProcessor):
        """One source's last fetch and the timer that follows it."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.last = handle.getValueState("last", "ms long")

        def _known(self) -> int | None:
            return self.last.get()[0] if self.last.exists() else None

        def _set(self, ms: int) -> None:
            self.last.update((ms,))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(ms + after_ms)

        def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N803
            self._set(int(initialState["ms"].max()))

        def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N803
            import pandas as pd

            ms = max(int(part["ms"].max()) for part in rows)
            known = self._known()
            if known is None or ms > known:  # a late fetch changes nothing
                self._set(ms)
                yield pd.DataFrame({"source_id": [key[0]], "last_ms": [ms], "stale": [False]})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N803
            import pandas as pd

            yield pd.DataFrame({"source_id": [key[0]], "last_ms": [self._known()], "stale": [True]})

        def close(self) -> None:
            pass

    return Clock()


def _newest(batches) -> Iterator:
    """Of each batch of rows the newest fetch of a source: a hot source sends one row a batch."""
    for pdf in batches:
        yield pdf.groupby("source_id", as_index=False)["ms"].max()


class StaleClock:
    """The plan of stale sources, kept by timers.

    ``source`` gives the sources known at the first start: id and last_fetched_at, null if it
    was never fetched, which is stale at once. The hidden source is never planned.
    """

    def __init__(self, root: str, source: DataFrame, active: str | None, after_ms: int = HOUR_MS, buckets: int = BUCKETS) -> None:
        self.root, self.active, self.after_ms = root, active, after_ms
        self.known = source.filter(F.col("id") != S.SAVED_PAGES_ID).groupBy(F.col("id").alias("source_id")).agg(
            F.coalesce(F.unix_millis(F.max("last_fetched_at")), F.lit(0)).alias("ms"))
        self.plan = VersionedTable(f"{root}/plan", PLAN, "source_id", buckets)

    def changes(self, fetches: DataFrame) -> DataFrame:
        """Stream of sources that turn stale or fresh. ``fetches`` has source_id and ts, one row a finished fetch."""
        rows = fetches.filter(F.col("source_id").isNotNull() & F.col("ts").isNotNull() & (F.col("source_id") != S.SAVED_PAGES_ID)).select(
            "source_id", F.unix_millis("ts").alias("ms"))
        newest = rows.mapInPandas(_newest, "source_id string, ms long")
        return newest.groupBy("source_id").transformWithStateInPandas(
            _clock(self.after_ms), _CHANGE, "Update", "ProcessingTime", initialState=self.known.groupBy("source_id"))

    def step(self, batch: DataFrame, batch_id: int) -> None:
        """Of a batch's changes of a source the last counts; its row in the plan is replaced."""
        last = batch.groupBy("source_id").agg(F.max(F.struct("last_ms", "stale")).alias("c")).select(
            "source_id", F.when(F.col("c.last_ms") > 0, F.timestamp_millis("c.last_ms")).alias("last_fetched_at"), F.col("c.stale").alias("stale"))
        first = F.lit(True) if self.active is None else F.col("source_id") == self.active
        rows = last.withColumn("priority", F.when(F.col("stale"), F.when(first, "now").otherwise("deferred")))
        self.plan.update(rows, batch_id, lambda current, new: current.join(new.select("source_id"), "source_id", "left_anti").select(
            *current.columns).unionByName(new.select(*current.columns)))

    def start(self, fetches: DataFrame, every: str = "1 minute"):
        """Run on a clock. Timers fire in the batch that follows their time."""
        return run(self.changes(fetches), self.step, f"{self.root}/checkpoint", every, "update")

    def settle(self, fetches: DataFrame) -> None:
        """Run until input is used up and the timers that are due by then have fired.

        A stream with timers has a batch at every trigger, so it has no end of its own: it is
        stopped after a batch without input, which fired what was due. The first batch does not
        count: it may be one that was planned before a stop, at the time of its plan.
        """
        query = self.start(fetches, "0 seconds")
        while query.isActive:
            ran = [p for p in query.recentProgress if "addBatch" in p.durationMs]
            if any(p.numInputRows == 0 for p in ran[1:]):
                break
            time.sleep(0.1)
        query.stop()
        if query.exception() is not None:
            raise query.exception()

    def due(self, spark) -> DataFrame:
        """The sources to fetch: id and priority."""
        return self.plan.read(spark).filter("stale").select(F.col("source_id").alias("id"), "priority", "last_fetched_at")
