"""A SentencePiece model file as plain values: pieces, kinds and normaliser settings."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

MARK = "▁"
#: Piece kinds and model kinds of the file format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        x = data[at]
        at, value, shift = at + 1, value | (x & 127) << shift, shift + 7
        if x < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protobuf message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


@dataclass(frozen=True)
class PieceModel:
    raw: bytes
    pieces: list[tuple[str, float, int]]
    kind: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    trim_spaces: bool

    @classmethod
    def from_file(cls, path: str) -> PieceModel:
        with open(path, "rb") as f:
            return cls.parse(f.read())

    @classmethod
    def parse(cls, raw: bytes) -> PieceModel:
        pieces, trainer, normaliser = [], {}, {}
        for number, value in _fields(raw):
            if number == 1:
                p = dict(_fields(value))
                pieces.append((p.get(1, b"").decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        return cls(raw, pieces, trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), normaliser.get(2, b""), bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1)))

    def splits_at_marks(self) -> bool:
        """No piece has a space marker behind another character, so words can be encoded apart."""
        return not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in self.pieces if kind in (NORMAL, USER))


def pretokens(text: str | None, model: PieceModel) -> list[str]:
    """Runs of space markers with the word behind, each without its first marker.

    Only for models without a character map: the text is otherwise taken as it is.
    """
    if not text:
        return []
    if model.trim_spaces:
        text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return []
    parts = text.split(" ")
    if "" not in parts and MARK not in text:
        return parts
    marked = MARK + text.replace(" ", MARK)
    return [p[1:] for p in re.findall(f"{MARK}+[^{MARK}]*", marked)]
