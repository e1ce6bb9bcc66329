"""Requests of which only the latest counts: a new one ends the jobs of the one before."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


class LatestOnly:
    def __init__(self, spark: SparkSession) -> None:
        self._context, self._numbers, self._now = spark.sparkContext, itertools.count(), ""

    @contextmanager
    def request(self) -> Iterator[str]:
        """Jobs started inside belong to this request; the previous request's jobs are cancelled."""
        self.cancel()
        self._now = tag = f"latest-{id(self)}-{next(self._numbers)}"
        self._context.addJobTag(tag)
        try:
            yield tag
        finally:
            self._context.removeJobTag(tag)

    def cancel(self) -> None:
        if self._now:
            self._context.cancelJobsWithTag(self._now)
