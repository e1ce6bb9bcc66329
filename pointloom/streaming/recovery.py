"""Streams that say that they lost their source, and go on from their checkpoint."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import StreamingQueryException
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


@dataclass
class Connection:
    """What is known of a stream: whether it runs, whether its last end was an error, all errors, and how many micro-batches were told of."""

    connected: bool = False
    failed: bool = False
    errors: list[str] = field(default_factory=list)
    batches: int = 0


class Connections(StreamingQueryListener):
    """The state of each stream by its id, which a restart from the checkpoint keeps."""

    def __init__(self) -> None:
        self.held: dict[str, Connection] = {}
        self._lock = threading.Lock()

    def of(self, query_id: object) -> Connection:
        with self._lock:
            return self.held.setdefault(str(query_id), Connection())

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        own = self.of(event.id)
        own.connected, own.failed = True, False

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        self.of(event.progress.id).batches += 1

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        own = self.of(event.id)
        own.connected, own.failed = False, event.exception is not None
        if event.exception is not None:
            own.errors.append(str(event.exception))


def keep_running(spark: SparkSession, start: Callable[[], StreamingQuery], tries: int = 5, wait: float = 1.0, longest: float = 60.0) -> Connection:
    """Starts a stream and waits for its end; one that breaks is started again, from its checkpoint, up to ``tries`` times in
    all, after waits that double up to ``longest`` seconds. Returns what became of it; the last error is raised if no try ended well.

    ``start`` must give the same checkpoint each time, so that the stream goes on where it broke.
    """
    listener = Connections()
    spark.streams.addListener(listener)
    try:
        for turn in range(tries):
            query = start()
            try:
                query.awaitTermination()
                break
            except StreamingQueryException:
                if turn == tries - 1:
                    raise
                time.sleep(min(longest, wait * 2**turn))
        own, until = listener.of(query.id), time.monotonic() + 30
        while own.connected and time.monotonic() < until:  # events come a little later than the end
            time.sleep(0.05)
        return own
    finally:
        spark.streams.removeListener(listener)
