"""Event-stream text as a stream: frames of ``id:``, ``event:`` and ``data:`` lines that a blank line ends, in files that grow.

An offset is a byte of each file, always behind a whole frame: what follows the last blank line waits for its rest, so a
restart between two halves of a frame neither loses nor repeats it. Long ranges are read by tasks of ``split`` bytes; each takes the
frames that begin in its part.

    spark.dataSource.register(EventText)
    spark.readStream.format("event_text").load(folder)          # file, at, id, event, data

Defined cases: several data lines of a frame are joined by line feeds; a frame without data, and a comment (``:``), gives no row; lines end
with LF or CRLF; a null id or event was not said; bytes that are no UTF-8 are replaced; hidden files (``_``, ``.``) are passed
over; an offset names each file, so a folder should hold a bounded number of files.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SPLIT, WINDOW = 64 << 20, 1 << 16
_BLANK = re.compile(rb"\r?\n\r?\n")


def _stored(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


def last_frame(file, size: int) -> int:  # noqa: ANN001
    """Where the last whole frame of a file's first ``size`` bytes ends; 0 without one. Reads back from the end."""
    end, held = size, b""
    while end > 0:
        start = max(0, end - WINDOW)
        file.seek(start)
        held = file.read(end - start) + held[:3]
        found = list(_BLANK.finditer(held))
        if found:
            return start + found[-1].end()
        end = start
    return 0


def frame(raw: bytes) -> tuple[str | None, str | None, str] | None:
    """id, event and data of a frame; None if it has no data."""
    own: dict[str, list[str]] = {}
    for line in raw.decode("utf-8", "replace").split("\n"):
        name, _, value = line.removesuffix("\r").partition(":")
        if name in ("id", "event", "data"):
            own.setdefault(name, []).append(value.removeprefix(" "))
    if "data" not in own:
        return None
    return own.get("id", [None])[-1], own.get("event", [None])[-1], "\n".join(own["data"])


class Bytes(InputPartition):
    def __init__(self, file: str, start: int, end: int, first: bool, until: int) -> None:
        self.file, self.start, self.end, self.first, self.until = file, start, end, first, until


class EventTextReader(DataSourceStreamReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path.rstrip("/"), split

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        store, base = _stored(self.path)
        out = {}
        if store.get_file_info(base).type == fs.FileType.NotFound:
            return out
        for x in store.get_file_info(fs.FileSelector(base, recursive=True)):
            own = x.path[len(base) :].lstrip("/")
            if x.type == fs.FileType.File and not any(part.startswith(("_", ".")) for part in own.split("/")):
                with store.open_input_file(x.path) as f:
                    end = last_frame(f, x.size)
                if end:
                    out[own] = end
        return out

    def partitions(self, start: dict, end: dict) -> list[Bytes]:
        ranges = ((name, int(start.get(name, 0)), int(until)) for name, until in sorted(end.items()))
        return [Bytes(name, at, min(at + self.split, until), at == begin, until) for name, begin, until in ranges for at in range(begin, until, self.split)]

    def read(self, partition: Bytes) -> Iterator[tuple]:
        store, base = _stored(self.path)
        with store.open_input_file(f"{base}/{partition.file}") as f:
            # a part that is not the first begins behind the first blank line that ends in it
            at = partition.start if partition.first else max(0, partition.start - 4)
            f.seek(at)
            held, begun = b"", partition.first
            while at < partition.end or held:
                more = f.read(min(WINDOW, partition.until - at - len(held)))
                held += more
                place = 0
                for m in _BLANK.finditer(held):
                    if begun and at + place >= partition.end:
                        return
                    if begun:
                        said = frame(held[place : m.start()])
                        if said:
                            yield partition.file, at + place, *said
                    if begun or at + m.end() >= partition.start:
                        begun = True
                    place = m.end()
                keep = place if begun else max(place, len(held) - 3)
                at, held = at + keep, held[keep:]
                if not more:
                    return

    def commit(self, end: dict) -> None:
        pass


class EventText(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_text"

    def schema(self) -> str:
        return "file string, at long, id string, event string, data string"

    def streamReader(self, schema) -> EventTextReader:  # noqa: ANN001, N802
        return EventTextReader(self.options["path"], int(self.options.get("split", SPLIT)))
