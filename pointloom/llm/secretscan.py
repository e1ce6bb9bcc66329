"""Secret scans over an incremental ledger of blobs.

Every version of every path is addressed by the SHA-256 of its text. Only pairs of blob
and rule version that the ledger does not hold yet are scanned, each blob once however
many paths and versions share it, and findings are joined back to all of them. Texts move
once, keyed by blob and row, so a group of copies is spread over tasks; the choice of the row
that stands for a blob, and the join back, move digests only.

Rules: the base kinds ``assign``, ``access`` and ``hex``; the method adds ``pem`` (private key
headers), ``jwt`` and ``vendor`` (tokens with a vendor's prefix).

Defined cases: a null text is the empty blob; equal rows share a blob; null ids are paths like
any other; texts are scanned whole; an empty table gives an empty result and ledger; only the
columns named are used.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, short_batches, spread

RULE_VERSION = "2"
PARTS = 8
#: Patterns, least length of the tested group, in the order of kinds.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),  # the same runs as [0-9a-f]+ of at least 24
}
ADDED = {
    "pem": (r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 0),
    "jwt": (r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    "vendor": (r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,})", 0, 0),
}
KINDS = [*BASE, *ADDED]
_RULES = [(kind, re.compile(p, re.ASCII), group, least) for kind, (p, group, least) in (BASE | ADDED).items()]
FINDINGS = "array<struct<kind:string,start:int,end:int>>"


def scan(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end (code points) of all findings, by start, then kind."""
    found = []
    for order, (kind, pattern, group, least) in enumerate(_RULES):
        for m in pattern.finditer(text):
            if len(m[group]) >= least:
                found.append((m.start(), order, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def blobs(versions: DataFrame) -> DataFrame:
    """doc_id, blob of every row."""
    return versions.select(F.col("doc_id").cast("long").alias("doc_id"), blob_of().alias("blob"))


def blob_of():
    return F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)


def scan_new(versions: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> DataFrame:
    """The ledger's new rows: blob, rule_version, findings, for each blob of ``versions`` (doc_id, text)
    of which ``ledger`` has no row of this rule version."""
    short_batches(versions.sparkSession)
    of_blob = blobs(versions).groupBy("blob").agg(F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("row"))
    if ledger is not None:
        of_blob = of_blob.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t.as_py() or "")] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], ["blob", "findings"])

    texts = versions.select(blob_of().alias("blob"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("row"), "text")
    chosen = texts.join(of_blob.hint("shuffle_hash"), ["blob", "row"], "left_semi").select("blob", "text")
    scanned = chosen.mapInArrow(of, f"blob string, findings {FINDINGS}")
    return scanned.groupBy("blob").agg(F.first("findings").alias("findings")).select("blob", F.lit(rule_version).alias("rule_version"), "findings")


def findings(versions: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(doc_id, blob, findings of every row of ``versions``; the ledger with its new rows).

    Nothing is scanned before one of them is read. Who keeps the ledger writes it and takes the rows by
    ``joined`` from what was written, so that no blob is scanned twice.
    """
    grown = scan_new(versions, ledger, rule_version)
    if ledger is not None:
        grown = ledger.select("blob", "rule_version", "findings").unionByName(grown)
    return joined(versions, grown, rule_version), grown


def joined(versions: DataFrame, ledger: DataFrame, rule_version: str = RULE_VERSION) -> DataFrame:
    """doc_id, blob, findings of every row of ``versions`` by a ledger that has all its blobs."""
    found = (F.col("rule_version") == rule_version) & (F.size("findings") > 0)
    # the few blobs with findings go to PARTS places each, so that rows which share a blob are spread over tasks
    now = ledger.where(found).select("blob", "findings", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)).cast("array<long>")).alias("part"))
    rows = blobs(versions).withColumn("part", spread(F.coalesce("doc_id", F.lit(0)), "copies", PARTS))
    return rows.join(now, ["blob", "part"], "left").select("doc_id", "blob", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans from findings of every row."""
    text = lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))
    base = F.filter("findings", lambda x: x.kind.isin(*BASE))
    number = lambda k: F.size(F.filter("findings", lambda x: x.kind == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(number, BASE), F.sha2(F.array_join(F.transform(base, text), ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform("findings", text), ",").alias("spans"))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span, overlapping ones as one, replaced by a mark."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """``docs``, with its columns, with the secrets in ``text`` masked and ``n_chars`` counted anew."""
    grown = scan_new(docs, ledger)
    if ledger is not None:
        grown = ledger.where(F.col("rule_version") == RULE_VERSION).select("blob", "rule_version", "findings").unionByName(grown)
    grown = cut(grown.where(F.size("findings") > 0))
    named = [F.col(f"`{c}`") for c in docs.columns]
    # as in ``joined``: findings go to PARTS places, so that the rows of one blob are spread over tasks
    side = grown.select("blob", "findings", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)).cast("array<long>")).alias("part"))
    part = spread(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "copies", PARTS)
    joined = docs.select(F.struct(*named).alias("row"), blob_of().alias("blob"), part.alias("part")).join(side, ["blob", "part"], "left")
    place = docs.columns.index("text")
    counted = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, found = b.column(0), b.column(1)
            own = row.flatten()
            texts = [
                redacted(t.as_py() or "", [(x["kind"], x["start"], x["end"]) for x in f.as_py()]) if f.is_valid and len(f) else t.as_py()
                for t, f in zip(own[place], found, strict=True)
            ]
            own[place] = pa.array(texts, own[place].type)
            if counted is not None:
                changed = [len(t) if f.is_valid and len(f) else n.as_py() for t, n, f in zip(texts, own[counted], found, strict=True)]
                own[counted] = pa.array(changed, own[counted].type)
            yield pa.RecordBatch.from_arrays(own, names)

    names = docs.columns
    return joined.select("row", "findings").mapInArrow(of, docs.schema)


def scan_digest(text: str | None) -> tuple[int, int, int, str, str]:
    """The digest columns of one text, for comparison on small fixtures."""
    spans = scan(text or "")
    base = [x for x in spans if x[0] in BASE]
    return *(sum(x[0] == k for x in base) for k in BASE), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)
