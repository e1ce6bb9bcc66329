"""Fill-in-the-middle: texts cut at two seeded unit boundaries and put in another order.

A unit is a longest run of A-Z and a-z, or any other character. The index has each distinct text once,
with the list of its boundaries in Elias-Fano form: of each number the low bits as they are, the high bits in
unary, so a boundary takes two bits and the low ones, and the k-th is read without the others. Texts meet by
their SHA-256, and count as one text only if their contents are equal. Each Arrow batch first joins the
ids of equal texts, so a text leaves it once, with at most a batch of ids; after one shuffle its list is made
once and every document's cut selected from it. A text that may be hot is dealt over up to ``PLACES`` tasks, and its list made in each.

Output: plain, the text; psm, ``<P>`` prefix ``<S>`` suffix ``<M>`` middle; spm, ``<S>`` suffix ``<P>`` prefix ``<M>`` middle.

Defined cases: a null text counts as the empty text; an empty text and one that holds a mark stay plain; null
ids have the seed of the word ``null``; texts of any length are taken whole; repeated rows each have their row; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import short_batches

#: Marks of the output, shares of a hundred that are rearranged, and of those that begin with the suffix.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
REARRANGED, SUFFIX_FIRST = 90, 20
#: Tasks that the rows of one hot text are dealt over, at most; characters in an Arrow batch of outputs, about.
PLACES, OUT_CHARS = 256, 8 << 20
NAMES = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
MADE = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def boundaries(text: str) -> np.ndarray:
    """0, then where each unit of the text ends, in characters."""
    own = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    small = own | 32
    letter = (small >= ord("a")) & (small <= ord("z")) & (own < 128)
    cuts = np.ones(len(own) + 1, bool)
    cuts[1:-1] = ~(letter[1:] & letter[:-1])
    return np.flatnonzero(cuts)


def packed(numbers: np.ndarray) -> tuple[int, bytes, bytes]:
    """An ascending list in Elias-Fano form: low bits of each, those bits in a row, and the unary high bits."""
    n, most = len(numbers), int(numbers[-1]) if len(numbers) else 0
    width = max(0, (most // max(n, 1)).bit_length() - 1) if n else 0
    low = (numbers[:, None] >> np.arange(width) & 1).astype(np.uint8).reshape(-1)
    high = np.zeros((most >> width) + n + 1, np.uint8)
    high[(numbers >> width) + np.arange(n)] = 1
    return width, np.packbits(low, bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes()


def select(k: int, width: int, low: bytes, high: bytes) -> int:
    """The k-th number (from 0) of a list in Elias-Fano form."""
    rest, ones = k, np.bitwise_count(np.frombuffer(high, np.uint8))
    before = np.cumsum(ones)
    byte = int(np.searchsorted(before, k, "right"))
    rest = k - (int(before[byte - 1]) if byte else 0)
    at = byte * 8 + int(np.flatnonzero(np.unpackbits(np.frombuffer(high, np.uint8, 1, byte), bitorder="little"))[rest])
    first = k * width
    held = int.from_bytes(low[first // 8 : (first + width + 7) // 8], "little") >> first % 8
    return (at - k << width) | (held & (1 << width) - 1)


def gathered(docs: DataFrame) -> DataFrame:
    """key (SHA-256), place, text and docs (ids) of each distinct text of each Arrow batch of ``docs`` (doc_id, text).

    A text that has one in ``PLACES`` rows of a batch, and at least four, may be hot; it goes to a place drawn for the batch.
    """
    short_batches(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own: dict[str, list] = {}
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own.setdefault(text or "", []).append(doc_id)
            draw = zlib.crc32(str(next(iter(own.values()), None)).encode()) % PLACES
            keys = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in own]
            places = [draw if len(ids) >= 4 and len(ids) * PLACES >= b.num_rows else 0 for ids in own.values()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(places, pa.int32()), pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.list_(pa.int64()))], ["key", "place", "text", "docs"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(of, "key binary, place int, text string, docs array<long>").repartition("key", "place").sortWithinPartitions("key")


class Lists:
    """The boundary lists of the texts of one key after the other, each made once."""

    def __init__(self) -> None:
        self.key, self.held = b"", {}

    def of(self, key: bytes, text: str) -> tuple[bool, tuple[int, int, bytes, bytes]]:
        """Whether this text (by its content) is new, and its number of units with its list."""
        if key != self.key:
            self.key, self.held = key, {}
        new = text not in self.held
        if new:
            own = boundaries(text)
            self.held[text] = (len(own) - 1, *packed(own))
        return new, self.held[text]


def index(docs: DataFrame) -> DataFrame:
    """text, n, width, low, high of each distinct text; of one that is dealt over several places, once for each."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists()
        for b in batches:
            rows = []
            for key, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                new, own = lists.of(key, text)
                if new:
                    rows.append((text, *own))
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)], ["text", "n", "width", "low", "high"])

    return gathered(docs).mapInArrow(of, "text string, n long, width int, low binary, high binary")


def seeds(doc_id: int | None) -> list[int]:
    """Four numbers below 2**32 from an id."""
    digest = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[at : at + 8], 16) for at in range(0, 32, 8)]


def rearranged(doc_id: int | None, text: str, n: int, width: int, low: bytes, high: bytes) -> tuple:
    """doc_id, n, form, prefix_chars, middle_chars, output."""
    h1, h2, h3, h4 = seeds(doc_id)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= REARRANGED:
        return doc_id, n, "plain", None, None, text
    a, z = (select(k, width, low, high) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    head, middle, tail = text[:a], text[a:z], text[z:]
    form = "spm" if h4 % 100 < SUFFIX_FIRST else "psm"
    order = (SUFFIX, tail, PREFIX, head, MIDDLE, middle) if form == "spm" else (PREFIX, head, SUFFIX, tail, MIDDLE, middle)
    return doc_id, n, form, a, z - a, "".join(order)


def transform(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists()
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for b in batches:
            rows, held = [], 0
            for key, text, ids in zip(b.column(0).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                own = text.as_py()
                _, found = lists.of(key, own)
                for doc_id in ids:
                    rows.append(rearranged(doc_id, own, *found))
                    held += len(own)
                    if held >= OUT_CHARS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], NAMES)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], NAMES)

    return gathered(docs).mapInArrow(of, MADE)


def restored(output: Column, form: Column) -> Column:
    """The text from its output and form; the first of each mark counts, as texts with marks stay plain."""
    between = lambda a, b: F.substring_index(F.substring(output, F.lit(len(a) + 1), F.length(output)), b, 1)
    middle = F.substring_index(output, MIDDLE, -1)
    inner = lambda mark: F.substring_index(F.substring_index(output, MIDDLE, 1), mark, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, inner(SUFFIX))
    spm = F.concat(inner(PREFIX), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(made: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
