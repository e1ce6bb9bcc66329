"""Token counts of a unigram vocabulary by forward scores over a trie of pre-tokens.

Pre-tokens are runs of space markers with the word behind them. The distinct pre-tokens
of a batch are walked in sorted order as the paths of a trie: a stack holds the best
score and its number of tokens for every prefix on the current path, so a shared prefix
is scored once, and the count at a terminal is stored for the pre-token. Documents then
add up the counts of their pre-tokens. Nothing is shuffled, and any lost task is redone
from its own rows.

Scores: those of the model if it is a unigram model. The public model here has byte-pair
pieces, whose scores are merge ranks and no log-probabilities; these become a Zipf-Mandelbrot
law over the rank. A character outside the vocabulary costs as many tokens as it has UTF-8
bytes. Among paths of equal score the one with fewer tokens counts.

Defined cases: null and empty texts have 0 tokens; a text of any length is handled whole, one
pre-token at a time; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches
from .piecemodel import BYTE, MARK, NORMAL, UNIGRAM, UNUSED, USER, PieceModel, pretokens

#: Pre-tokens whose counts a worker keeps between batches, and the longest that it keeps.
MAX_KEPT, MAX_KEPT_LEN = 300_000, 48


class Forward:
    """Best segmentation under unigram scores, shared over common prefixes."""

    def __init__(self, model: PieceModel) -> None:
        ranked = [p for p, _, kind in model.pieces if kind in (NORMAL, USER)]
        if model.kind == UNIGRAM:
            self.score = {p: s for p, s, kind in model.pieces if kind in (NORMAL, USER, UNUSED)}
        else:
            total = math.log(sum(1 / (r + 2.7) for r in range(len(ranked))))
            self.score = {p: -math.log(r + 2.7) - total for r, p in enumerate(ranked)}
        self.longest = max(map(len, self.score), default=1)
        # score of every end of a piece, None where it is no piece itself: a longer start is in vain where an end is missing
        self.ends: dict[str, float | None] = {p[k:]: None for p in self.score for k in range(1, len(p))} | self.score
        self.unknown = min(self.score.values(), default=0.0) - 10.0
        self.bytes = any(kind == BYTE for *_, kind in model.pieces)

    def counts(self, words: list[str]) -> dict[str, int]:
        """Tokens of each of the distinct ``words``."""
        ends, out = self.ends, {}
        best, path = [(0.0, 0)], ""  # (score, -tokens) of each prefix of path
        for word in sorted(words):
            shared, most = 0, min(len(path), len(word))
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del best[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                top = None
                for start in range(end - 1, -1, -1):
                    piece = word[start:end]
                    if piece not in ends:
                        break
                    s = ends[piece]
                    if s is not None:
                        x = best[start]
                        y = (x[0] + s, x[1] - 1)
                        if top is None or y > top:
                            top = y
                if ends.get(word[end - 1]) is None:
                    x = best[end - 1]
                    y = (x[0] + self.unknown, x[1] - (len(word[end - 1].encode("utf-8", "surrogatepass")) if self.bytes else 1))
                    if top is None or y > top:
                        top = y
                best.append(top)
            out[word], path = -best[-1][1], word
        return out


def token_counts(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens of every row. ``model_file`` is read on the driver and sent with the tasks (under 2 MB)."""
    short_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(PieceModel.from_file(model_file))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forward, kept = Forward(model.value), {}
        for b in batches:
            if len(kept) > MAX_KEPT:
                kept.clear()
            splits = [Counter(pretokens(t, model.value)) for t in b.column(1).to_pylist()]
            new = {w for c in splits for w in c if w not in kept}
            own = {marked[1:]: n for marked, n in forward.counts([MARK + w for w in new]).items()}
            total = [sum(n * (own[w] if w in own else kept[w]) for w, n in c.items()) for c in splits]
            kept.update((w, n) for w, n in own.items() if len(w) <= MAX_KEPT_LEN)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, "doc_id long, n_tokens long")
