"""Progress as a stream whose state ends: a process that is closed is forgotten ``kept`` after its CLOSE, by event time.

Processes meet in ``groups`` by a hash, as a call of Python for each process costs far more than its messages; the state is a map
of each group with one value for each process, of which a micro-batch reads and writes those that it touches. One timer in event time
for each group, at the first end of a state in it, removes what has ended. Messages of a group within one micro-batch are sorted in
memory, so bound what a micro-batch reads (``maxFilesPerTrigger``). A checkpoint is of one number of groups.

Defined cases: as ``operators.progress.fold``; across micro-batches messages count in the order of those; a process whose state is
gone begins anew if it sends again; one that never closes keeps its state, or, with ``idle``, until no message came for that
long. The session's state store must be ``ROCKS``.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pointloom.streaming.progress import is_complete

STATE = "progress string, connected boolean, closed boolean, until long"
OUT = "pid long, progress string, connected boolean, closed boolean, incomplete boolean"
#: Groups that processes meet in: many for each task, few enough to hold many processes each.
GROUPS = 1024


class Progress(StatefulProcessor):
    def __init__(self, kept: timedelta, idle: timedelta | None, ready: str, close: str) -> None:
        self.kept, self.idle = int(kept.total_seconds() * 1000), int(idle.total_seconds() * 1000) if idle else None
        self.ready, self.close_word = ready, close

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state, self.timer = handle, handle.getMapState("progress", "pid long", STATE), handle.getValueState("timer", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        said = pd.concat(list(rows)).sort_values(["named", "pid", "seq"], kind="stable")
        known, ends, out = self.state.exists(), [], []
        for (named, pid), own in groupby(zip(*(said[c].tolist() for c in ("named", "pid", "seq", "data")), strict=True), key=itemgetter(0, 1)):
            pid = pid if named else None
            before = self.state.getValue((pid,)) if known else None
            progress, connected, closed, until = before or (None, False, False, None)
            last = None  # no message counts once it is closed
            for _, _, seq, data in own:
                if closed:
                    break
                last = int(seq) // 1000
                if data == self.ready:
                    connected = True
                elif data == self.close_word:
                    closed = True
                else:
                    progress = data
            if last is not None and (closed or self.idle is not None):
                until = last + (self.kept if closed else self.idle)
            if (now := (progress, connected, closed, until)) != before:
                self.state.updateValue((pid,), now)
            if until is not None:
                ends.append(until)
            out.append((pid, progress, connected, closed, closed and not is_complete(progress)))
        if ends:
            self._wake(min(ends))
        pids, *others = zip(*out, strict=True)
        yield pd.DataFrame({"pid": pd.array(pids, "Int64"), **dict(zip(("progress", "connected", "closed", "incomplete"), others, strict=True))})

    def _wake(self, at: int) -> None:
        """One timer, at ``at`` or where it was, if that is before."""
        held = self.timer.get() if self.timer.exists() else None
        if held is not None:
            if held[0] <= at:
                return
            self.handle.deleteTimer(held[0])
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, ended, left = timerValues.getCurrentWatermarkInMs(), [], None
        for (pid,), (_, _, _, until) in self.state.iterator():
            if until is not None and until < now:
                ended.append(pid)
            elif until is not None:
                left = until if left is None else min(left, until)
        for pid in ended:
            self.state.removeKey((pid,))
        self.timer.clear()
        if left is not None:
            self._wake(left)
        return iter(())

    def close(self) -> None:
        pass


def follow(messages: DataFrame, kept: timedelta, delay: str = "0 seconds", idle: timedelta | None = None, ready: str = "READY", close: str = "CLOSE", groups: int = GROUPS) -> DataFrame:
    """Streaming (pid, ts, seq in microseconds, data) to the state of each process that a micro-batch touched."""
    marked = messages.withWatermark("ts", delay)
    # a null pid would make the others of its Arrow batch floating-point numbers
    pid = F.coalesce("pid", F.lit(0).cast("long")).alias("pid")
    dealt = marked.select(F.pmod(F.xxhash64("pid"), F.lit(groups)).cast("int").alias("part"), F.col("pid").isNotNull().alias("named"), pid, "ts", "seq", "data")
    return dealt.groupBy("part").transformWithStateInPandas(Progress(kept, idle, ready, close), outputStructType=OUT, outputMode="update", timeMode="EventTime")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def open_processes(spark, checkpoint: str) -> DataFrame:  # noqa: ANN001
    """pid and state of every process that a stopped stream's checkpoint still holds."""
    read = spark.read.format("statestore").option("stateVarName", "progress").load(checkpoint)
    return read.select(F.col("user_map_key.pid").alias("pid"), "user_map_value.*")
