"""Progress messages as a stream: one state for each process, closed for good by CLOSE."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pointloom.operators.progress import CLOSE, READY

STATE = "progress string, connected boolean, closed boolean"
OUT = "pid long, progress string, connected boolean, closed boolean, incomplete boolean"


def is_complete(progress: str | None) -> bool:
    try:
        return float(progress) == 100
    except (TypeError, ValueError):
        return False


def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Messages in order of seq within a micro-batch; across micro-batches as they arrive."""
    progress, connected, closed = state.get if state.exists else (None, False, False)
    for _, said in sorted((m for b in batches for m in zip(b["seq"], b["data"], strict=True)), key=lambda m: m[0]):
        if closed:
            break
        if said == READY:
            connected = True
        elif said == CLOSE:
            closed = True
        else:
            progress = said
    state.update((progress, connected, closed))
    yield pd.DataFrame({"pid": [key[0]], "progress": [progress], "connected": [connected], "closed": [closed], "incomplete": [closed and not is_complete(progress)]})


def follow(messages: DataFrame) -> DataFrame:
    """Streaming (pid, seq, data) to the state of each process that a micro-batch touched; output mode update."""
    return messages.groupBy("pid").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
