"""Operators on single documents against brute force: secrets, personal data, quality rules, tokens."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct

import pyarrow as pa
import pytest
import sentencepiece
from pointloom.llm import quality, queries, secretscan, sentencepieces, tokencount
from pointloom.llm.common import pieces
from pointloom.llm.piecemodel import BYTE, MARK, PieceModel
from pointloom.llm.queries import PIECE_MODEL
from pyspark.sql import functions as F

from tests.compare import assert_same


def digest(spans: list[tuple]) -> str:
    return hashlib.sha256(",".join(":".join(map(str, s)) for s in spans).encode()).hexdigest()


def brute_secrets(text: str | None) -> tuple[int, int, int, str]:
    text, found = text or "", []
    assign = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for order, (kind, pattern, group, least) in enumerate((("assign", assign, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))):
        found += [(m.start(), order, kind, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    spans = [(k, s, e) for s, _, k, e in sorted(found)]
    return *(sum(s[0] == k for s in spans) for k in ("assign", "access", "hex")), digest(spans)


def brute_quality(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)} if len(windows) < 600 else {i + k for i, w in enumerate(windows) if w in _again(windows) for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(twice), n < 50 or 100 * len(twice) > 50 * n


def _again(windows: list) -> set:
    ordered = sorted(windows)
    return {a for a, b in zip(ordered, ordered[1:], strict=False) if a == b}


def keyed(rows, *names) -> dict:
    return {(r["doc_id"], *(r[n] for n in names)) for r in rows}


def wanted(docs, of) -> set:
    return {(r.doc_id, *of(r.text)) for r in docs.select("doc_id", "text").collect()}


def test_secrets(docs, no_docs):
    found, _ = secretscan.findings(docs)
    rows = secretscan.digests(found).collect()
    assert len(rows) == docs.count()
    assert keyed(rows, "n_assign", "n_access", "n_hex", "base_sha256") == wanted(docs, brute_secrets)
    assert any("pem:" in r.spans and "vendor:" in r.spans for r in rows)
    assert secretscan.digests(secretscan.findings(no_docs)[0]).count() == 0


def test_secret_ledger_scans_new_blobs_only(spark, docs):
    first, ledger = secretscan.findings(docs)
    assert secretscan.scan_new(docs, ledger).count() == 0
    assert secretscan.scan_new(docs, ledger, "3").count() == docs.select("text").fillna("").distinct().count()
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(77777, "secret=abcdef99")], "doc_id long, text string"))
    assert secretscan.scan_new(more, ledger).count() == 1
    again, grown = secretscan.findings(more, ledger)
    assert again.where("doc_id = 77777").first().findings[0].kind == "assign" and grown.count() == ledger.count() + 1
    assert again.count() == first.count() + 1


def test_redaction_keeps_rows_and_columns(docs, no_docs):
    out = secretscan.redact(docs)
    assert out.schema == docs.schema and out.count() == docs.count()
    rows = {r.doc_id: r for r in out.collect()}
    for r in docs.collect():
        spans = secretscan.scan(r.text or "")
        got = rows[r.doc_id]
        if not spans:
            assert got == r
        else:
            assert got.n_chars == len(got.text) and all(r.text[s:e] not in got.text for _, s, e in spans)
    assert secretscan.redact(no_docs).count() == 0


def test_redaction_masks_blobs_of_an_earlier_run(spark, docs):
    _, ledger = secretscan.findings(docs)
    kept = ledger.union(ledger.withColumn("rule_version", F.lit("old")))
    again, whole = (sorted(map(str, secretscan.redact(docs, own).collect())) for own in (kept, None))
    assert again == whole


def test_long_runs_take_linear_time():
    assert secretscan.scan("token " * 50_000 + "eyJ" * 100_000) == []


def test_quality(docs, no_docs):
    own = quality.ledger(docs)
    rows = quality.apply_policy(own).collect()
    assert len(rows) == docs.count()
    assert keyed(rows, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == wanted(docs, brute_quality)
    assert all(not r.kept for r in rows if r.base_failed) and any(r.kept for r in rows)
    assert quality.ledger(no_docs).count() == 0 == quality.ablations(quality.ledger(no_docs)).count()


@pytest.mark.parametrize("name", ["op5_secret_scan", "op9_quality_rules"])
def test_query_equals_sql(spark, sf_dir, name):
    assert_same(queries.queries()[name](spark, sf_dir), sf_dir, queries.oracle_sql()[name])


def test_secrets_equal_sql_on_odd_texts(spark, docs, tmp_path):
    tokens = ["eyJ" + "a" * 9 + "." + "b" * 9 + "." + "c" * 9, "x.eyJ" + "a_-" * 4 + "." + "b" * 9 + "." + "c" * 9 + " eyJ" + "q" * 8 + "." + "r" * 8 + "." + "s" * 8, "-eyJ" + "a" * 9 + "." + "b" * 9 + "." + "c" * 9, "ſecret=abcdefg Token=\"a1b2c3d4\"", "token=abcdef;secret='zyxwvu'", "xoxb-1234567890ab é ghp_" + "a1B2" * 10]
    rows = docs.select("doc_id", "text").where("doc_id is not null").dropDuplicates(["doc_id"]).union(spark.createDataFrame([(60_000 + i, t) for i, t in enumerate(tokens)], "doc_id long, text string"))
    rows.coalesce(1).toPandas().to_parquet(tmp_path / "documents.parquet")
    assert_same(queries.queries()["op5_secret_scan"](spark, str(tmp_path)), str(tmp_path), queries.oracle_sql()["op5_secret_scan"])


def test_policies_and_ablations_read_the_ledger(docs):
    own = quality.ledger(docs)
    rows = own.collect()
    full = quality.mask(quality.POLICIES["v2"])
    for r in quality.ablations(own).collect():
        bit = quality.mask([r.rule])
        assert r.fails == sum(bool(x.failed & bit) for x in rows)
        assert r.fails_alone == sum((x.failed & full) == bit for x in rows)
        assert r.kept_without == sum((x.failed & full & ~bit) == 0 for x in rows)
    v1 = {r.doc_id for r in quality.apply_policy(own, "v1").where("kept").collect()}
    assert {r.doc_id for r in quality.apply_policy(own).where("kept").collect()} <= v1


def test_sentencepiece_parity_and_round_trip(docs, no_docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    encoded = sentencepieces.encode(docs, PIECE_MODEL)
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = encoded.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert list(r.ids) == sp.encode(text[r.doc_id]) and r.parity and r.decoded_same
    back = {r.doc_id: r.text for r in sentencepieces.decode(encoded, PIECE_MODEL).collect()}
    assert back == {k: v.replace(MARK, " ") for k, v in text.items()}
    assert sentencepieces.encode(no_docs, PIECE_MODEL).count() == 0


def test_ids_and_texts_are_the_tokenizers(spark):
    """With a tokenizer that knows one id only, every id and every decoded text follows it, and no text is at parity."""
    from tokenizers import Tokenizer, models

    codec = sentencepieces.Codec(PieceModel.from_file(PIECE_MODEL))
    codec.whole, codec.kept, codec.differ = Tokenizer(models.WordLevel({"u": 0}, unk_token="u")), {"": b""}, set()
    found = codec.encode(["some words here", "more"])
    assert all(set(memoryview(ids).cast("i")) == {0} and not parity for ids, parity in found)
    assert codec.decode([[0, 0]]) == ["u u"]


def test_words_of_one_text_have_the_ids_they_have_alone(monkeypatch):
    """Packs of seven words, few words kept, markers and unknown characters among them; and one that the other library reads otherwise."""
    monkeypatch.setattr(sentencepieces, "PACKED", 7)
    monkeypatch.setattr(sentencepieces, "MAX_KEPT", 50)
    own = random.Random(3)
    words = ["".join(own.choice("abcdeéß漢🎉\n.,") for _ in range(own.randint(1, 9))) for _ in range(400)] + ["a" + MARK + "b", MARK, "", "x" * 60]
    texts = [" ".join(own.choices(words, k=60)) for _ in range(40)] + [" ".join(words)]
    codec = sentencepieces.Codec(PieceModel.from_file(PIECE_MODEL))
    assert codec.packs
    for at in range(0, len(texts), 5):
        part = texts[at : at + 5]
        assert [list(memoryview(ids).cast("i")) for ids, _ in codec.encode(part)] == [codec._ids([t])[0] for t in part]
        assert all(parity for _, parity in codec.encode(part))
        assert "" in codec.kept and "x" * 60 not in codec.kept

    class Other:
        def encode(self, texts: list[str], num_threads: int) -> list[list[int]]:
            return [[0] if "odd" in t else e for t, e in zip(texts, codec._ids(texts), strict=True)]

    codec.reference = Other()
    assert [parity for _, parity in codec.encode(["here an odd thing", "here a thing", "odder", "more"])] == [False, True, False, True]


def message(*fields: tuple[int, int | float | bytes]) -> bytes:
    """A protobuf message from numbers and values."""

    def varint(n: int) -> bytes:
        return bytes([n & 127 | 128]) + varint(n >> 7) if n > 127 else bytes([n])

    out = b""
    for number, value in fields:
        if isinstance(value, bytes):
            out += varint(number << 3 | 2) + varint(len(value)) + value
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            out += varint(number << 3) + varint(value)
    return out


#: model kind, name of the normaliser's rules, marker before a text, extra spaces removed, byte fallback
MODELS = {"nmt": (1, "nmt_nfkc", 1, 1, 0), "plain": (1, "", 1, 0, 0), "bytes": (1, "nfkc_cf", 1, 1, 1), "no prefix": (1, "", 0, 1, 0), "pairs": (2, "nfkc", 1, 1, 0), "plain pairs": (2, "", 1, 0, 0), "pairs and bytes": (2, "", 1, 1, 1)}


@pytest.fixture(scope="module", params=MODELS.values(), ids=MODELS)
def small_model(request, tmp_path_factory) -> str:
    """A model file put together by hand: every setting that is rebuilt, with a few scored pieces."""
    kind, rules, prefix, trim, fallback = request.param
    parts = "th the un und di die le les in ing ed ged nged inged ther ation ti tion er ent rent ere erent ac ach ache".split()
    chars = sorted(set("".join(parts)) | set("äéßzq1 ").difference(" "))
    words = [MARK + w for w in ("the", "und", "th", "un", "t", "u")]
    pieces = [(1, "<unk>", 0.0, 2), (1, "<s>", 0.0, 3), (1, "</s>", 0.0, 3)]
    pieces += [(1, f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if fallback else []
    score = (lambda i: -float(i)) if kind == 2 else (lambda i: -2.0 - math.log(i + 1.5))
    pieces += [(1, p, score(i), 1) for i, p in enumerate([*parts, *words, MARK, *chars])]
    proto = b"".join(message((1, message((1, p.encode()), (2, s), (3, k)))) for _, p, s, k in pieces)
    charsmap = b""
    if rules:
        charsmap = PieceModel.parse(sentencepiece.SentencePieceNormalizer(rule_name=rules).serialized_model_proto()).charsmap
        assert charsmap
    trainer = message((3, kind), *([(35, 1)] if fallback else []), (40, 0), (41, 1), (42, 2))
    normaliser = message((1, (rules or "identity").encode()), (2, charsmap), (3, prefix), (4, trim), (5, 1))
    path = tmp_path_factory.mktemp("model") / "small.model"
    path.write_bytes(proto + message((2, trainer)) + message((3, normaliser)))
    return str(path)


def test_other_models_are_rebuilt(small_model):
    """Unigram models with a character map, trimming, byte fallback or no prefix, and a byte-pair one: all at parity."""
    model = PieceModel.from_file(small_model)
    codec, other = sentencepieces.Codec(model), sentencepiece.SentencePieceProcessor(model_file=small_model)
    texts = ["the und ation", "  the   und ", "ﬁne ① ＡＢＣ the", "zzz qq", "日本 the", "a\tb\nc", "", "therätherß", "x" * 300, "the\u00a0und", " ", "the "] + [t for t in texts_of_length(20_000)]
    for text, (ids, parity) in zip(texts, codec.encode(texts), strict=True):
        assert list(memoryview(ids).cast("i")) == other.encode(text) and parity, text
        if not any(other.is_unknown(i) for i in other.encode(text)):
            assert codec.decode([other.encode(text)]) == [other.decode(other.encode(text))], text


def texts_of_length(words: int) -> list[str]:
    own = random.Random(9)
    return [" ".join(own.choice(["the", "und", "ation", "zq", "é"]) for _ in range(words))]


def test_token_counts_equal_plain_dynamic_programming(docs, no_docs):
    model = PieceModel.from_file(PIECE_MODEL)
    forward = tokencount.Forward(model)
    has_bytes = any(kind == BYTE for *_, kind in model.pieces)

    def plain(text: str | None) -> int:
        if not text:
            return 0
        s = MARK + text.replace(" ", MARK)
        best = [(0.0, 0)]
        for end in range(1, len(s) + 1):
            ways = [(best[i][0] + forward.score[s[i:end]], best[i][1] - 1) for i in range(max(0, end - forward.longest), end) if s[i:end] in forward.score]
            if s[end - 1] not in forward.score:
                ways.append((best[-1][0] + forward.unknown, best[-1][1] - (len(s[end - 1].encode()) if has_bytes else 1)))
            best.append(max(ways))
        return -best[-1][1]

    rows = tokencount.token_counts(docs, PIECE_MODEL).collect()
    assert len(rows) == docs.count()
    text = {r.doc_id: r.text for r in docs.where("length(text) < 3000 or text is null").collect()}
    for r in rows:
        if r.doc_id in text:
            # sums over whole texts round differently, so a tie may fall either way
            assert abs(r.n_tokens - plain(text[r.doc_id])) <= 1
    assert tokencount.token_counts(no_docs, PIECE_MODEL).count() == 0


@pytest.mark.parametrize("words", [["a", "ab", "abc", "b"], ["", "zz"], ["ab"] * 2])
def test_shared_prefixes_change_nothing(words):
    forward = tokencount.Forward(PieceModel.from_file(PIECE_MODEL))
    assert forward.counts(words) == {w: forward.counts([w])[w] for w in words}


def test_pieces_hold_whole_rows_and_at_most_so_many_bytes():
    texts = [None, "", "x" * 30, "ab", None, "é" * 5, "cd", "y" * 9, "z"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts, pa.string())], ["doc_id", "text"])
    found = list(pieces([batch, batch.slice(0, 0)], 1, most=12))
    assert [r for b in found for r in b.to_pylist()] == batch.to_pylist()
    assert all(b.num_rows == 1 or sum(len((t or "").encode()) for t in b.column(1).to_pylist()) <= 12 for b in found)
    assert [b.num_rows for b in found] == [2, 1, 3, 3]
