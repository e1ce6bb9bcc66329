"""SentencePiece encoding and decoding on the tokenizers library.

The model file is parsed, and its normaliser, space marker, pieces with scores and byte
fallback are rebuilt as a ``tokenizers.Tokenizer``: a unigram model from the scores, or, for
byte-pair models such as the public one, a BPE model whose merges are ordered by the score
of the piece they make. Where no piece has a space marker inside and no character map is
set, a text's pre-tokens are encoded apart: the distinct new ones of a batch go through
``encode_batch`` on several threads, and are kept for later batches. Those of byte-pair models
go there as texts of many words, whose ids are told apart by the pieces that begin with the marker. Other models
encode whole texts. Ids are decoded by whole texts, through ``decode_batch``.

All ids and decoded texts are those of the rebuilt tokenizer. The sentencepiece library only
verifies: a pre-token (or text) to which it gives other ids marks its documents, ``parity`` false.

Defined cases: null and empty texts have no ids and decode to the empty text; texts that hold
the space marker itself decode it as a space; texts of any length are handled whole; an empty
table gives an empty result.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers

from .common import pieces, short_batches
from .piecemodel import MARK, NORMAL, UNIGRAM, UNKNOWN, USER, PieceModel, pretokens

#: Words in each of the two generations that are kept, and their length; a full one becomes the old one, whose words come back when used.
MAX_KEPT, MAX_KEPT_LEN = 100_000, 48
THREADS = 2
#: Texts whose ids are decoded at once, and new words (or texts) that are encoded at once: what both libraries say of them is held until it is packed.
DECODED, LEARNT = 50, 2000
#: New words that are encoded as one text.
PACKED = 100


def rebuild(model: PieceModel) -> Tokenizer:
    """The model as a tokenizer of the tokenizers library, for whole texts."""
    unknown = next((i for i, (*_, kind) in enumerate(model.pieces) if kind == UNKNOWN), None)
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=unknown, byte_fallback=model.byte_fallback)
    else:
        ids = {p: i for i, (p, *_) in enumerate(model.pieces)}
        score = {p: s for p, s, kind in model.pieces if kind in (NORMAL, USER)}
        joins = [(-s, ids[p[:k]], p[:k], p[k:]) for p, s in score.items() for k in range(1, len(p)) if p[:k] in score and p[k:] in score]
        core = models.BPE(ids, [(a, b) for *_, a, b in sorted(joins)], unk_token=model.pieces[unknown][0] if unknown is not None else None, fuse_unk=True, byte_fallback=model.byte_fallback)
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.trim_spaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    steps += [normalizers.Prepend(MARK)] if model.dummy_prefix else []
    out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    strip = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    # the marker is replaced piece by piece, as bytes that spell it stay as they are; of the first only one space is stripped
    out.decoder = decoders.Sequence([decoders.Metaspace(MARK, prepend_scheme="never", split=False), decoders.ByteFallback(), decoders.Fuse(), *strip])
    return out


def _packed(ids: list[list[int]]) -> bytes:
    return np.fromiter(chain.from_iterable(ids), np.int32).tobytes()


class Codec:
    def __init__(self, model: PieceModel) -> None:
        os.environ.update(TOKENIZERS_PARALLELISM="true", RAYON_NUM_THREADS=str(THREADS))
        self.model, self.whole = model, rebuild(model)
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=model.raw)
        self.apart = model.splits_at_marks() and not model.charsmap and model.dummy_prefix
        self.begins = np.array([p.startswith(MARK) for p, *_ in model.pieces])
        # merges never cross a marker, so words of one text have the ids that they have alone; sums of scores may be rounded otherwise
        self.packs = self.apart and model.kind != UNIGRAM and any(p == MARK for p, *_ in model.pieces)
        # ids of a pre-token as the bytes of 32-bit numbers, so that a text's ids are one join
        self.kept: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.differ: set[str] = set()
        if self.apart:
            # the space marker alone, as behind a text's last space, is what "a " has more than "a"
            whole, short = (self._ids([t])[0] for t in ("a ", "a"))
            self.kept[""] = _packed([whole[len(short) :]])
            if whole != self.reference.encode("a "):
                self.differ.add("")

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, words: list[str], lengths: list[int], raw: bytes) -> None:
        at = 0
        for w, n in zip(words, lengths, strict=True):
            self.kept[w] = raw[at : at + 4 * n]
            at += 4 * n

    def _learn(self, words: list[str], texts: list[str]) -> None:
        """Keep the ids of new words, each given to the tokenizer as its text, and those to which the other library gives other ids."""
        got = self._ids(texts)
        said = self.reference.encode(texts, num_threads=THREADS) if texts else []
        if got != said:
            self.differ.update(w for w, a, b in zip(words, got, said, strict=True) if a != b)
        self._keep(words, [len(ids) for ids in got], _packed(got))

    def _learn_words(self, words: list[str]) -> None:
        """The same for new words, of which those without markers go together as texts of many words."""
        alone = [w for w in words if MARK in w or not self.packs]
        others = [w for w in words if MARK not in w] if self.packs else []
        packs = [others[at : at + PACKED] for at in range(0, len(others), PACKED)]
        texts = [" ".join(own) for own in packs]
        said = self.reference.encode(texts, num_threads=THREADS) if texts else []
        for own, ids, ids_said in zip(packs, self._ids(texts), said, strict=True):
            flat = np.array(ids, np.int32)
            starts = np.flatnonzero(self.begins[flat])
            if ids == ids_said and len(starts) == len(own):
                self._keep(own, np.diff(starts, append=len(flat)).tolist(), flat.tobytes())
            else:
                alone += own
        self._learn(alone, [w.replace(MARK, " ") for w in alone])

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bool]]:
        """Of each text its ids (the bytes of 32-bit numbers), and whether the two libraries agree on it."""
        kept, differ = self.kept, self.differ
        words = [pretokens(t, self.model) for t in texts] if self.apart else [[t] if t else [] for t in texts]
        used = set(chain.from_iterable(words))
        missing = used.difference(kept)
        again = missing & self.old.keys()
        kept.update((w, self.old[w]) for w in again)
        new = list(missing - again)
        for at in range(0, len(new), LEARNT):
            part = new[at : at + LEARNT]
            self._learn_words(part) if self.apart else self._learn(part, part)
        out = [(b"".join(map(kept.__getitem__, own)), not differ or differ.isdisjoint(own)) for own in words]
        for w in new:
            if len(w) > MAX_KEPT_LEN:
                del kept[w]
                differ.discard(w)
        if len(kept) > MAX_KEPT:
            self.old, self.kept = kept, {w: kept[w] for w in [""] if self.apart}
            self.differ = differ & kept.keys()
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.whole.decode_batch(ids, skip_special_tokens=False)


_codecs: list[Codec] = []


def codec_of(model: PieceModel) -> Codec:
    """The model's codec, which a Python worker keeps with the ids of the words it knows for its later tasks."""
    if not _codecs or _codecs[0].model.raw != model.raw:
        _codecs[:] = [Codec(model)]
    return _codecs[0]


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, ids (array of int), parity, decoded_same (decoding the ids gives the text back) of every row."""
    short_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(PieceModel.from_file(model_file))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model.value)
        for b in pieces(batches, 1):
            texts = b.column(1).to_pylist()
            found = codec.encode(texts)
            ends = np.cumsum([0] + [len(ids) // 4 for ids, _ in found], dtype=np.int32)
            values = np.frombuffer(b"".join(ids for ids, _ in found), np.int32)
            same = []
            for at in range(0, len(texts), DECODED):
                back = codec.decode([np.frombuffer(ids, np.int32).tolist() for ids, _ in found[at : at + DECODED]])
                same += [a == (t or "").replace(MARK, " ") for a, t in zip(back, texts[at:], strict=False)]
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array([ok for _, ok in found], pa.bool_()), pa.array(same, pa.bool_())], ["doc_id", "ids", "parity", "decoded_same"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, "doc_id long, ids array<int>, parity boolean, decoded_same boolean")


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """doc_id, text of every row of ``encoded`` (doc_id, ids)."""
    model = encoded.sparkSession.sparkContext.broadcast(PieceModel.from_file(model_file))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codec.decode([x or [] for x in b.column(1).to_pylist()]), pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(of, "doc_id long, text string")
