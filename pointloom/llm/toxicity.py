"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words also count by their beginnings, as insults inflect and compound.

Labelled rows are featurised in parallel; a sample of at most ``MAX_TRAIN`` of them, by hash
of the id, is learnt in one task in a fixed order with a learning rate per coordinate. L1
keeps few weights; those that are not zero, of at most 2**BITS, come back to the driver and
are broadcast as one array. Scoring is a pass over whole texts without a shuffle.

Defined cases: a null or wordless text has no features and is scored by the bias alone;
texts of any length are scored whole; labels that are null or not 0 or 1 are left out, of
several labels of an id the largest counts, and of several rows of an id one is learnt; null ids are never learnt from and are not held
out; without a weight (as without labels) every score is 0.5 less an epsilon, so nothing is rejected; an empty
table gives an empty result; equal texts have equal scores.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, short_batches, spread, whole_rows

#: Hashed features; rows learnt from at most; held-out share is one in FOLDS.
BITS, MAX_TRAIN, FOLDS = 18, 16_000, 5
#: FTRL's rate, smoothing, L1 and L2, and passes over the sample.
ALPHA, BETA, L1, L2, PASSES = 1.0, 1.0, 8.0, 0.1, 4
BEGINNINGS = (5, 7)
_SIZE = 1 << BITS
_SPLIT = re.compile(r"[^\w']+")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _hashed(words: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


def features(text: str | None) -> np.ndarray:
    """Distinct hashed features: words, pairs, pairs with a gap of one, and beginnings of words.

    A beginning counts again as a feature of its own where it stands twice and three times,
    so inflected and compound forms of a word add up.
    """
    words = [w for w in _SPLIT.split((text or "").lower()) if w]
    h = _hashed(words)
    one, a, b, c, d = _ODD
    grams = [h * one, h[:-1] * a + h[1:] * b, h[:-2] * c + h[2:] * d]
    for k in BEGINNINGS:
        x, n = np.unique(_hashed([w[:k] for w in words if len(w) > k]), return_counts=True)
        x = x * d + np.uint64(k)
        grams += [x, *(x[n >= j] * a + np.uint64(j) for j in (2, 3))]
    return np.unique((np.concatenate(grams) * one >> np.uint64(64 - BITS)).astype(np.int32))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def learn(rows: list[tuple[np.ndarray, int]], passes: int = PASSES) -> np.ndarray:
    """Weights (the last is the bias) after ``passes`` over (distinct indices, label)."""
    z, n = np.zeros(_SIZE + 1), np.zeros(_SIZE + 1)
    rows = [(np.append(x, _SIZE), y) for x, y in rows]
    for _ in range(passes):
        for x, y in rows:
            zx, nx = z[x], n[x]
            w = np.where(np.abs(zx) <= L1, 0.0, -(zx - np.sign(zx) * L1) / ((BETA + np.sqrt(nx)) / ALPHA + L2))
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            z[x] = zx + g - (np.sqrt(nx + g * g) - np.sqrt(nx)) / ALPHA * w
            n[x] = nx + g * g
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_train: int = MAX_TRAIN) -> Broadcast:
    """The weights, broadcast, learnt from labelled rows of ``docs`` that are not held out."""
    spark = docs.sparkSession
    short_batches(spark)
    known = labels.where(F.col(label).isin(0, 1) & ~held_out() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(label).cast("int").alias("y"))
    known = cut(known)
    share = min(1.0, max_train / max(1, known.count()))
    sample = known.where(spread(F.col("id"), "toxicity") < int(share * 1_000_000))

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "y": b["y"], "x": [features(t) for t in b["text"]]})

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(x, int(y)) for b in batches for x, y in zip(b["x"], b["y"], strict=True)]
        w = learn(rows)
        at = np.flatnonzero(w)
        yield pd.DataFrame({"at": at.astype("int32"), "w": w[at]})

    # at most max_train (id, label) pairs on the broadcast side, so the texts stay where they are
    side = F.broadcast(sample)
    own = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(side, "id").select("id", "y", "text")
    # of the rows of an id one, as a hash of its text chooses, so that at most max_train rows go to the one task
    each = own.mapInPandas(featurise, "id long, y int, x array<int>").groupBy("id").agg(F.min_by(F.struct("y", "x"), F.struct(F.xxhash64("x"), F.size("x"))).alias("r"))
    rows = each.select("id", "r.y", "r.x")
    weights = rows.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id", F.size("x"), F.hash("x")).mapInPandas(fit, "at int, w double").toPandas()
    dense = np.zeros(_SIZE + 1, np.float32)
    dense[weights["at"]] = weights["w"]
    if not dense.any():
        dense[-1] = -1e-6
    return spark.sparkContext.broadcast(dense)


def score_text(text: str | None, weights: np.ndarray) -> float:
    x = features(text)
    return float(1 / (1 + np.exp(-np.clip(weights[x].sum(dtype=np.float64) + weights[-1], -35, 35))))


def score(docs: DataFrame, weights: Broadcast) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    short_batches(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [score_text(t.as_py(), weights.value) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.float64()), pa.array([int(s >= 0.5) for s in found], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return narrow.mapInArrow(of, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, weights: Broadcast) -> DataFrame:
    """The rows of ``docs``, with its columns, that are not predicted toxic."""
    short_batches(docs.sparkSession)
    names, place = docs.columns, docs.columns.index("text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = b.column(0)
            clean = pa.array([score_text(t.as_py(), weights.value) < 0.5 for t in row.field(place)], pa.bool_())
            yield pa.RecordBatch.from_arrays(row.filter(clean).flatten(), names)

    return whole_rows(docs).mapInArrow(of, docs.schema)
