"""Rows without an id, and texts of 25,000 words, through every operator on documents, against brute force."""

from __future__ import annotations

import random
from collections import Counter

import pytest
import sentencepiece
from pointloom.llm import mixing, nearcopies, pii, quality, secretscan, sentencepieces, simhash, sketch, tokencount, toxicity
from pointloom.llm.piecemodel import BYTE, MARK, PieceModel
from pointloom.llm.queries import PIECE_MODEL

from .test_corpus_ops import brute_fingerprint, brute_hashes, words_of

_own = random.Random(8)
LONG = " ".join(_own.choice(["the", "und", "ation", "stupid", "é", "w"]) + str(_own.randrange(4000)) * (_own.random() < 0.7) for _ in range(25_000)) + " token=abcdef12 a@b.cd"
#: doc_id, text
ROWS = [(None, LONG), (None, "no id here"), (None, None), (1, ""), (2, LONG), (2, LONG), (3, "one two three four five six")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(d, t, "web", len(t or "")) for d, t in ROWS], "doc_id long, text string, source string, n_chars long")


def same(rows: list, of) -> None:  # noqa: ANN001
    """Rows (doc_id, value) are those of ROWS with what ``of`` says of each text."""
    assert Counter((r[0], r[1]) for r in rows) == Counter((d, of(t)) for d, t in ROWS)


def test_token_counts(odd):
    model = PieceModel.from_file(PIECE_MODEL)
    forward, has_bytes = tokencount.Forward(model), any(kind == BYTE for *_, kind in model.pieces)

    def plain(word: str) -> int:
        s, best = MARK + word, [(0.0, 0)]
        for end in range(1, len(s) + 1):
            ways = [(best[i][0] + forward.score[s[i:end]], best[i][1] - 1) for i in range(end) if s[i:end] in forward.score]
            if s[end - 1] not in forward.score:
                ways.append((best[-1][0] + forward.unknown, best[-1][1] - (len(s[end - 1].encode()) if has_bytes else 1)))
            best.append(max(ways))
        return -best[-1][1]

    same(tokencount.token_counts(odd, PIECE_MODEL).collect(), lambda t: sum(n * plain(w) for w, n in Counter(t.split(" ")).items()) if t else 0)


def test_mixture(odd):
    rows = mixing.shares(odd).select("id", "size").collect()
    same(rows, lambda t: len(words_of(t)))
    assert mixing.mix(odd).schema == odd.schema


def test_fingerprints_of_simhash(odd):
    same(simhash.near_duplicates(odd).select("doc_id", simhash.as_hex("fp")).collect(), lambda t: f"{brute_fingerprint(t):016x}")


def test_near_copies(odd):
    found = nearcopies.near_copies(odd).collect()
    assert len(found) == len(ROWS) and len({bytes(r.root) for r in found}) == 4
    kept = nearcopies.keep_one(odd).collect()
    assert sorted((r.doc_id is None, r.doc_id, len(r.text or "")) for r in kept if r.doc_id is not None) == [(False, 1, 0), (False, 2, len(LONG)), (False, 3, 27)]
    assert [r.text for r in kept if r.doc_id is None] == ["no id here"]


def test_secrets(odd):
    found, _ = secretscan.findings(odd)
    same([(r.doc_id, secretscan.listed([tuple(x) for x in r.findings])) for r in found.collect()], lambda t: secretscan.listed(secretscan.scan(t or "")))
    masked = secretscan.redact(odd)
    assert masked.schema == odd.schema and Counter(r.doc_id for r in masked.collect()) == Counter(d for d, _ in ROWS)
    assert not any("abcdef12" in (r.text or "") for r in masked.collect())


def test_toxicity(spark, odd):
    weights = toxicity.train(odd, spark.createDataFrame([(1, 0), (2, 1), (3, 0), (None, 1)], "doc_id long, toxic int"))
    same([(r.doc_id, r.score) for r in toxicity.score(odd, weights).collect()], lambda t: toxicity.score_text(t, weights.value))
    assert all(r.held_out is False for r in toxicity.score(odd, weights).where("doc_id is null").collect())


def test_private_data(odd):
    found = pii.spans(odd, pii.train(odd)).collect()
    same([(r.doc_id, tuple((x.kind, x.start, x.end) for x in r.found if x.base)) for r in found], lambda t: tuple(pii.base_spans(t or "")))
    assert any(x.kind == "email" for r in found for x in r.found)


def test_pieces(odd):
    reference = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    rows = sentencepieces.encode(odd, PIECE_MODEL).collect()
    same([(r.doc_id, tuple(r.ids)) for r in rows], lambda t: tuple(reference.encode(t or "")))
    assert all(r.parity and r.decoded_same for r in rows)


def test_quality(odd):
    def repeated(t: str | None) -> tuple:
        words = words_of(t)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = Counter(windows)
        return len(words), len({i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)})

    same([(r.doc_id, (r.n_words, r.n_repeat_words)) for r in quality.ledger(odd).collect()], repeated)


def test_sketches(odd):
    def written(t: str | None) -> str:
        return f"{2**46:x}:" + ",".join(f"{h:x}" for h in brute_hashes(t or "") if h < 2**46)

    rows = sketch.fingerprints(odd, run=2).collect()
    same([(r.doc_id, r.fingerprint) for r in rows], written)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
