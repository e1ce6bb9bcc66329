"""Personal data: patterns for the base kinds, and a skip-chain conditional random field that adds spans.

The field's nodes are values: the base spans of a document, whole, and what stands elsewhere for the value of one of
them: neighbouring numbers that together have all its digits, or all but a telephone's country code; the same four
octets; the same address in another spelling of ``@``, or its whole local part before another domain if that has the form of a name. A part of
a value, or a number that only ends alike, is no node. All other tokens are O (no personal data) by definition and need no
messages. Neighbouring nodes share chain potentials. Occurrences of a value share skip potentials however far
apart they are, from each to the value's first base span and to the occurrence before, so their number stays linear.
Base spans hold their label; loopy sum-product message passing until the messages settle carries it to the nodes that no pattern
finds. Of those, the ones that the field labels with ``CERTAIN`` probability become added spans. Messages run in pieces of at most ``NODES`` nodes in
the order of the text, so memory is bounded; what an earlier piece of a text decided holds in the next.

The weights are learnt here by pseudo-likelihood from base spans and the other tokens. As
what the patterns test would else explain every label, each base span is echoed while learning: by a
mention of it that no pattern sees, with the same label, its features hidden and a skip edge as its only
tie, by a stranger, hidden and without ties, and by a part of its own value without ties, which are O. So the skip weights are
learnt from what other occurrences say. A token that a pattern finds only where it stands alone, and one that stands for a base span's
value, teaches nothing. Learning is one task over whole documents, sampled by hash: of at most about ``MAX_TRAIN`` documents (repeated rows once)
so many that they have about ``MAX_TOKENS`` tokens; the weights are a table of under 200 kB, which is broadcast. Base spans never
depend on the field.

Defined cases: a null text counts as the empty text, without spans; null ids are kept; texts of
any length are scanned whole; equal texts have equal spans; an empty table gives an empty
result, and without a document to learn from no span is added; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, short_batches, spread

#: The base kinds, in order, and the limits of each.
KINDS = ["email", "ip", "card", "phone"]
LABELS = ["O", *KINDS]
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++")
# only from where a run of digits begins: what fails there fails from its other digits too
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")  # nothing follows, so giving back is never needed
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

MAX_TRAIN, MAX_TOKENS = 20_000, 60_000
CERTAIN, SWEEPS, SETTLED, BUCKETS, NODES = 0.9, 200, 1e-9, 4096, 20_000
#: Digits of a number that can stand for a value, at least and at most.
LEAST_DIGITS, MOST_DIGITS = 7, 19
#: Features of a node, whatever the token.
FEATURES = 11
#: Kinds of skip edges, each with a weight of its own.
EQUAL, SIMILAR = 0, 1
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*[0-9@]\S*")
_NUMBER = re.compile(r"[0-9(][0-9()./_-]*+")
_GAP = re.compile(r"[\x20().+/-]{1,3}")
_AT = re.compile(r"@|\(at\)|\[at\]|_at_", re.I)
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*+")
_NAME = re.compile(r"[a-z]+(?:[._-][a-z0-9]+)+")
_EDGE_LEFT, _EDGE_RIGHT = "\"'([{<|#*$%&", ".,;:!?\"')]}>|#*$%&"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def is_octet(digits: str) -> bool:
    """Whether ASCII digits, of any length, are a number of at most 255."""
    own = digits.lstrip("0")
    return len(own) < 3 or (len(own) == 3 and own <= "255")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern, found from each @ backwards instead of from every character on."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            yield m.span()
            free = m.end()
        at = text.find("@", max(free, at + 1))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end of the base kinds, by kind, then start."""
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(is_octet, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def tokens(text: str) -> list[tuple[int, int]]:
    """Start and end of the tokens with a digit or @, without marks around them."""
    out = []
    for m in _TOKEN.finditer(text):
        raw = m[0]
        start = m.start() + len(raw) - len(raw.lstrip(_EDGE_LEFT))
        end = m.end() - (len(raw) - len(raw.rstrip(_EDGE_RIGHT)))
        if start < end:
            out.append((start, end))
    return out


def digits_of(core: str) -> str:
    return "".join(c for c in core if c.isdecimal())


def node_features(core: str, before: str, after: str, hidden: bool = False) -> list[int]:
    """Hashed features of a token between two words; those that show what the patterns test can be hidden."""
    named = [f"before {before[-8:].lower()}", f"after {after[:8].lower()}", "bias"]
    if hidden:
        named += [f"hidden {k}" for k in range(8)]
    else:
        digits = digits_of(core)
        shape = re.sub(r"(.)\1+", r"\1+", re.sub(r"[0-9]", "9", re.sub(r"[^\W\d_]", "a", core)))[:40]
        octets = core.split(".")
        named += [
            f"shape {shape}", f"digits {min(len(digits), 20)}", f"length {min(len(core), 24) // 3}", f"first {shape[:1]}", f"at {'@' in core}", f"dots {min(len(octets) - 1, 4)}",
            f"long {13 <= len(digits) <= 19 and luhn(digits)}", f"octets {len(octets) == 4 and all(x.isascii() and x.isdigit() and is_octet(x) for x in octets)}",
        ]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in named]


def octets_of(core: str) -> tuple[str, ...] | None:
    """The four numbers of up to three digits that a value consists of, if it does."""
    parts = re.findall("[0-9]+", core)
    return tuple(x.lstrip("0") or "0" for x in parts) if len(parts) == 4 and all(len(x) <= 3 for x in parts) else None


def keys_of(kind: str, core: str) -> list[tuple[int, str, object]]:
    """What stands for a base span's value: kind of the edge, sort of the key, key."""
    if kind == "email":
        local, _, domain = core.lower().rpartition("@")
        return [(EQUAL, "address", f"{local}@{domain}")] + [(SIMILAR, "local", local)] * bool(_NAME.fullmatch(local))
    if kind == "ip":
        own = octets_of(core)
        return [(EQUAL, "octets", own)] if own else []
    digits = digits_of(core)
    out = [(EQUAL, "digits", digits)]
    if kind == "phone":
        # one digit after +1 and +7, else two or three, are a country's code
        out += [(SIMILAR, "digits", digits[n:]) for n in ((1,) if digits[0] in "17" else (2, 3)) if len(digits) - n >= LEAST_DIGITS]
    return out


def _numbers(text: str, known: dict) -> Iterator[tuple[int, int, list]]:
    """Start, end and known keys of numbers, and of neighbouring numbers together: from each on the most that stand for a value."""
    found: list[tuple[int, int, str]] = []  # numbers side by side, from one on that may begin a value

    def matched(ended: bool) -> Iterator[tuple[int, int, list]]:
        """Values that begin in ``found``, as long as what may follow can't change them; those numbers are taken out."""
        i = 0
        while i < len(found) and (ended or len(found) - i > MOST_DIGITS):
            digits, best = "", None
            for j in range(i, len(found)):
                digits += found[j][2]
                if len(digits) > MOST_DIGITS + 1:
                    break
                keys = [("digits", d) for d in (digits, digits[1:] if digits[:1] == "0" else "") if len(d) >= LEAST_DIGITS and ("digits", d) in known]
                own = octets_of(text[found[i][0] : found[j][1]]) if j == i else None
                if own and ("octets", own) in known:
                    keys.append(("octets", own))
                if keys:
                    best = (j, keys)
            if best:
                start, end = found[i][0], found[best[0]][1]
                if start and text[start - 1] == "(" and ")" in text[start:end]:
                    start -= 1
                yield start, end, best[1]
                i = best[0] + 1
            else:
                i += 1
        del found[:i]

    for m in _NUMBER.finditer(text):
        core = m[0].strip("()./_-")
        if not core:
            continue
        start = m.start() + m[0].index(core)
        end = start + len(core)
        whole = not (start and (text[start - 1].isalnum() or text[start - 1] in "@_")) and not (end < len(text) and (text[end].isalnum() or text[end] in "@_"))
        if found and not (whole and start - found[-1][1] <= 3 and _GAP.fullmatch(text, found[-1][1], start)):
            yield from matched(True)
        if whole:
            found.append((start, end, digits_of(core)))
            if len(found) > 8 * MOST_DIGITS:
                yield from matched(False)
    yield from matched(True)


def _addresses(text: str, known: dict) -> Iterator[tuple[int, int, list]]:
    """Start, end and known keys of addresses in any spelling of ``@``."""
    free = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, m.end())
        if start == m.start() or not domain:
            continue
        local, end = text[start : m.start()].lower(), domain.end()
        keys = [("address", f"{local}@{domain[0].lower()}")]
        if any(c.isalpha() for c in domain[0]):
            keys.append(("local", local))
        keys = [k for k in keys if k in known]
        if keys:
            yield start, end, keys
            free = end


Node = tuple[int, int, int, list]


def nodes(text: str, spans: list[tuple[str, int, int]]) -> list[Node]:
    """Start, end, label and keys of a text's base spans, those within others aside, and of the other places that stand for their values, in order."""
    held: list[Node] = []
    known: dict = {}
    for start, end, kind in sorted((s, e, k) for k, s, e in spans):
        if held and start < held[-1][1]:
            continue
        keys = []
        for edge, sort, key in keys_of(kind, text[start:end]):
            known.setdefault((sort, key), edge)
            keys.append((sort, key))
        held.append((start, end, LABELS.index(kind), keys))
    if not held:
        return []
    free, sorts = [], {sort for sort, _ in known}
    if sorts & {"digits", "octets"}:
        free += list(_numbers(text, known))
    if sorts & {"address", "local"}:
        free += list(_addresses(text, known))
    out, at = [], 0
    taken = sorted((s, e) for _, s, e in spans)
    for start, end, keys in sorted(free, key=lambda x: x[:2]):
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if (at == len(taken) or taken[at][0] >= end) and (not out or start >= out[-1][1]):
            out.append((start, end, 0, keys))
    return sorted(held + out, key=lambda x: x[:2])


def edges(text: str, found: list[Node]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """Chain edges between neighbours, and skip edges (with their kinds) from each node to its value's first base span and last occurrence."""
    chain = [(i, i + 1) for i in range(len(found) - 1) if 0 < found[i + 1][0] - found[i][1] <= 3 and " " in text[found[i][1] : found[i + 1][0]]]
    chained, skip, first, last = set(chain), {}, {}, {}
    for i, (_, _, label, keys) in enumerate(found):
        if label:
            for turn, key in enumerate(keys):
                first.setdefault(key, []).append((i, EQUAL if turn == 0 else SIMILAR, label))
    # of each label the first base span of a value
    first = {key: list({label: (i, kind) for i, kind, label in reversed(own)}.values()) for key, own in first.items()}
    for i, (_, _, _, keys) in enumerate(found):
        for turn, key in enumerate(keys):
            other = [(j, max(kind, EQUAL if turn == 0 else SIMILAR)) for j, kind in first.get(key, ())] + ([last[key]] if key in last else [])
            for j, kind in other:
                edge = (min(i, j), max(i, j))
                if i != j and edge not in chained:
                    skip.setdefault(edge, kind)
        for turn, key in enumerate(keys):
            last[key] = (i, EQUAL if turn == 0 else SIMILAR)
    return chain, [(*edge, kind) for edge, kind in sorted(skip.items())]


def features_at(text: str, start: int, end: int, hidden: bool = False) -> list[int]:
    """Features of a place; of a mention that no pattern sees its form is hidden, as that of the echoes is, and its neighbours count."""
    before, after = text[max(0, start - 24) : start].split()[-1:], text[end : end + 24].split()[:1]
    return node_features(text[start:end], "".join(before), "".join(after), hidden)


def lessons(text: str, spans: list[tuple[str, int, int]]) -> tuple[list, list, list, list]:
    """Features, labels, chain and skip edges that are learnt from a text: base spans and tokens that stand for none of
    their values, and for each base span an echo, a stranger and a part of its value."""
    own = nodes(text, spans)
    taken, at, every = sorted([(s, e) for _, s, e in spans] + [(s, e) for s, e, *_ in own]), 0, []
    for s, e in tokens(text):
        while at < len(taken) and taken[at][1] <= s:
            at += 1
        if (at == len(taken) or taken[at][0] >= e) and not base_spans(text[s:e]):
            every.append((s, e, 0, []))
    kept = sorted([n for n in own if n[2]] + every, key=lambda n: n[:2])
    chain, skip = edges(text, kept)
    x, y = [features_at(text, s, e) for s, e, *_ in kept], [n[2] for n in kept]
    n, said = len(y), [i for i in range(len(y)) if y[i]]
    hidden = [node_features("", "", "", True)] * len(said)
    parts = [node_features(re.findall("[0-9]+|[A-Za-z]+", text[kept[i][0] : kept[i][1]])[-1], "", "") for i in said]
    skip += [(i, n + j, (EQUAL, SIMILAR)[j % 2]) for j, i in enumerate(said)]
    return x + hidden + hidden + parts, y + [y[i] for i in said] + [0] * (2 * len(said)), chain, skip


def learn(x: np.ndarray, y: np.ndarray, chain: np.ndarray, skip: np.ndarray, rounds: int = 150) -> dict:
    """Weights by gradient steps on the pseudo-likelihood: node (BUCKETS x labels), chain (labels x labels), skip (one for each kind)."""
    k, n = len(LABELS), len(y)
    unary, trans, same = np.zeros((BUCKETS, k)), np.zeros((k, k)), np.zeros(2)
    su, st, ss = np.full((BUCKETS, 1), 1e-6), 1e-6, np.full(2, 1e-6)
    gold = np.eye(k)[y]
    ones = np.zeros((2, n, k))  # labels of skip neighbours, by kind of the edge
    for a, b in ((skip[:, 0], skip[:, 1]), (skip[:, 1], skip[:, 0])):
        np.add.at(ones, (skip[:, 2], a), gold[b])
    for _ in range(rounds if n else 0):
        logit = unary[x].sum(1) + np.tensordot(same, ones, 1)
        np.add.at(logit, chain[:, 1], trans[y[chain[:, 0]]])
        np.add.at(logit, chain[:, 0], trans[:, y[chain[:, 1]]].T)
        p = np.exp(logit - logit.max(1, keepdims=True))
        d = (gold - p / p.sum(1, keepdims=True)) / n
        gu, gt = np.zeros_like(unary), np.zeros_like(trans)
        for j in range(x.shape[1]):
            np.add.at(gu, x[:, j], d)
        np.add.at(gt, y[chain[:, 0]], d[chain[:, 1]])
        np.add.at(gt.T, y[chain[:, 1]], d[chain[:, 0]])
        gu, gt, gs = gu - 1e-6 * unary, gt - 1e-6 * trans, (d * ones).sum((1, 2)) - 1e-6 * same
        su, st, ss = su + (gu**2).sum(1, keepdims=True), st + (gt**2).sum(), ss + gs**2
        unary, trans, same = unary + 0.5 * gu / np.sqrt(su), trans + 0.5 * gt / np.sqrt(st), np.maximum(0.0, same + 0.5 * gs / np.sqrt(ss))
    return {"unary": unary.astype(np.float32), "chain": trans, "skip": same, "learnt": n}


def marginals(x: np.ndarray, chain: np.ndarray, skip: np.ndarray, w: dict, held: np.ndarray | None = None, sweeps: int = SWEEPS) -> np.ndarray:
    """Label probabilities of every node by loopy belief propagation, all edges in step until the messages settle.

    ``held`` gives nodes that hold a label other than O; exact where the edges have no loop.
    """
    k = len(LABELS)
    unary = w["unary"][x].sum(1).astype(np.float64)
    if held is not None:
        at = np.flatnonzero(held)
        unary[at] = -1e3
        unary[at, held[at]] = 0.0
    both = np.concatenate([chain[:, :2], skip[:, :2]]).astype(int).reshape(-1, 2)
    if len(both):
        # one table for each kind of edge and direction: chain, chain backwards, skip edges
        tables = np.stack([w["chain"], w["chain"].T, *(weight * np.eye(k) for weight in np.asarray(w["skip"]))])
        kinds = 2 + skip[:, 2].astype(int)
        kind = np.concatenate([np.zeros(len(chain), int), kinds, np.ones(len(chain), int), kinds])
        src, dst = np.concatenate([both[:, 0], both[:, 1]]), np.concatenate([both[:, 1], both[:, 0]])
        back = np.roll(np.arange(len(src)), -len(both))
        message = np.zeros((len(src), k))
        for _ in range(sweeps):
            belief = unary.copy()
            np.add.at(belief, dst, message)
            out = (belief[src] - message[back])[:, :, None] + tables[kind]
            top = out.max(1)
            fresh = np.log(np.exp(out - top[:, None]).sum(1)) + top
            fresh = 0.5 * message + 0.5 * (fresh - fresh.max(1, keepdims=True))
            moved, message = np.abs(fresh - message).max(), fresh
            if moved < SETTLED:
                break
        np.add.at(unary, dst, message)
    p = np.exp(unary - unary.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _joined(graphs: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels, chain and skip edges of many graphs as one."""
    starts = np.cumsum([0] + [len(g[1]) for g in graphs])
    flat = lambda at, width, shift: np.concatenate([np.zeros((0, width), np.int32), *(np.asarray(g[at], np.int32).reshape(-1, width) + shift(s) for g, s in zip(graphs, starts, strict=False))])
    none = lambda s: 0
    return flat(0, FEATURES, none), flat(1, 1, none)[:, 0], flat(2, 2, lambda s: s), flat(3, 3, lambda s: np.array([s, s, 0]))


def _pieces(text: str, found: list[Node], most: int) -> Iterator[tuple[int, int, list, list]]:
    """A text's nodes in pieces: first node, one past the last, and the edges that end in the piece."""
    chain, skip = edges(text, found)
    chain.sort(key=lambda e: e[1])
    skip.sort(key=lambda e: e[1])
    c = k = 0
    for at in range(0, len(found), most):
        end = min(at + most, len(found))
        c0, k0 = c, k
        while c < len(chain) and chain[c][1] < end:
            c += 1
        while k < len(skip) and skip[k][1] < end:
            k += 1
        yield at, end, chain[c0:c], skip[k0:k]


def _decided(text: str, found: list[Node], w: dict, most: int = NODES) -> list[int]:
    """The label of each node: its own, or what the field is certain of, else O. An edge from an earlier piece, or to a base
    span behind the piece, comes from a copy of its node that holds what is decided; one to a node that is O is left out."""
    label = [n[2] for n in found]
    for at, end, chain, skip in _pieces(text, found, most):
        later = [e for e in edges_to_later(found, at, end)] if len(found) > most else []
        copies: dict[int, int] = {}

        def place(i: int) -> int | None:
            if at <= i < end:  # noqa: B023
                return i - at  # noqa: B023
            return copies.setdefault(i, end - at + len(copies)) if label[i] else None  # noqa: B023

        own_chain = [(a, b) for a, b in ((place(a), place(b)) for a, b in chain) if a is not None and b is not None]
        own_skip = [(a, b, kind) for a, b, kind in ((place(a), place(b), kind) for a, b, kind in [*skip, *later]) if a is not None and b is not None]
        rows = [features_at(text, s, e, not y) for s, e, y, _ in found[at:end]] + [[0] * FEATURES] * len(copies)
        held = np.array(label[at:end] + [label[i] for i in copies])
        p = marginals(np.array(rows), np.array(own_chain, int).reshape(-1, 2), np.array(own_skip, int).reshape(-1, 3), w, held)
        for i, row in zip(range(at, end), p, strict=False):
            y = int(row[1:].argmax()) + 1
            if not label[i] and row[y] >= CERTAIN:
                label[i] = y
    return label


def edges_to_later(found: list[Node], at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """Skip edges from nodes of a piece without a base span before its end to their value's first one behind it."""
    first: dict = {}
    for i, (_, _, label, keys) in enumerate(found):
        if label:
            for turn, key in enumerate(keys):
                first.setdefault(key, (i, EQUAL if turn == 0 else SIMILAR))
    for i in range(at, end):
        for key in found[i][3]:
            if not found[i][2] and key in first and first[key][0] >= end:
                yield i, first[key][0], first[key][1]


def find(texts: list[str | None], w: dict, most: int = NODES) -> list[list[tuple[str, int, int]]]:
    """All spans of each text, by kind, then start; base spans as they are, and the field's further ones."""
    out = []
    for text in (t or "" for t in texts):
        spans = base_spans(text)
        found = nodes(text, spans) if spans and w["learnt"] else []
        added = []
        if any(not n[2] for n in found):
            added = [(LABELS[y], n[0], n[1]) for n, y in zip(found, _decided(text, found, w, most), strict=True) if y and not n[2]]
        out.append(sorted(spans + added, key=lambda s: (KINDS.index(s[0]), s[1])) if added else spans)
    return out


def train(docs: DataFrame, max_train: int = MAX_TRAIN) -> Broadcast:
    """The field's weights, broadcast, learnt from at most about ``max_train`` documents and ``MAX_TOKENS`` tokens, in whole documents."""
    spark = docs.sparkSession
    short_batches(spark)
    parts = ["x", "y", "chain", "skip"]
    n = docs.count()
    rows = docs.select(F.xxhash64(F.lit("pii"), F.col("doc_id").cast("long"), "text").alias("row"), "text")
    sample = rows.where(spread(F.col("row"), "pii") < int(1_000_000 * min(1.0, max_train / max(n, 1))))

    def graphs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = [lessons(t or "", base_spans(t or "")) for t in b["text"]]
            flat = [[np.asarray(part, np.int32).reshape(-1) for part in g] for g in own]
            yield pd.DataFrame({"row": b["row"], "tokens": [len(g[1]) for g in own], **{name: [f[i] for f in flat] for i, name in enumerate(parts)}})

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = learn(*_joined([tuple(r) for b in batches for r in b[parts].itertuples(index=False)]))
        used = np.flatnonzero(np.abs(w["unary"]).sum(1))
        rows = [("unary", int(i), w["unary"][i].astype(float).tolist()) for i in used]
        rows += [("chain", i, w["chain"][i].tolist()) for i in range(len(LABELS))] + [("skip", w["learnt"], w["skip"].tolist())]
        yield pd.DataFrame(rows, columns=["part", "at", "w"])

    made = sample.mapInPandas(graphs, "row long, tokens long, " + ", ".join(f"{name} array<int>" for name in parts)).where("tokens > 0")
    once = cut(made.groupBy("row").agg(*(F.first(c).alias(c) for c in ("tokens", *parts))))
    total = once.agg(F.sum("tokens")).first()[0] or 0
    whole = once.where(spread(F.col("row"), "tokens") < int(1_000_000 * min(1.0, MAX_TOKENS / max(total, 1))))
    found = whole.repartition(1).sortWithinPartitions("row").mapInPandas(fit, "part string, at long, w array<double>").toPandas()
    w = {"unary": np.zeros((BUCKETS, len(LABELS)), np.float32), "chain": np.zeros((len(LABELS), len(LABELS))), "skip": np.zeros(2), "learnt": 0}
    for part, at, values in found.itertuples(index=False):
        if part == "skip":
            w["skip"], w["learnt"] = np.array(values, float), int(at)
        else:
            w[part][at] = values
    return spark.sparkContext.broadcast(w)


def spans(docs: DataFrame, weights: Broadcast) -> DataFrame:
    """doc_id, found (array of kind, start, end by kind, then start) and n_base (how many of each base kind) of every row."""
    short_batches(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            rows = []
            for t, found in zip(texts, find(texts, weights.value), strict=True):
                own = set(base_spans(t)) if found else set()
                rows.append([{"kind": k, "start": s, "end": e, "base": (k, s, e) in own} for k, s, e in found])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], ["doc_id", "found"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, "doc_id long, found array<struct<kind:string,start:int,end:int,base:boolean>>")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    text = lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))
    base = F.filter("found", lambda x: x.base)
    number = lambda k: F.size(F.filter("found", lambda x: x.base & (x.kind == k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(number, KINDS), F.sha2(F.array_join(F.transform(base, text), ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform("found", text), ",").alias("spans"))


def base_digest(text: str | None) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base_spans(text or "")).encode()).hexdigest()
