"""Secret scans through a trigram index.

Each rule's regular expression yields a Boolean query over trigrams that every match must contain.
A slice of documents is indexed by the trigrams the queries ask for, the postings are intersected
and united as the query says, and the expression itself runs only on the candidates. Rules
without mandatory trigrams scan every document. The index of a slice lives as long as
the slice, so memory doesn't grow with the table and nothing is shuffled.

Letters are folded in the index, never in the verification, so queries serve both cases.

Defined cases: null text counts as empty; a document without secrets has counts of 0 and the digest of the
empty string; repeated rows are reported each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import pairwise
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import map_batches, with_text, worker_cache

#: Strings that an expression's finite part may stand for before it is cut.
STRINGS = 64

Trigrams = tuple  # ("and" | "or", parts), or bytes of length 3; ("and", ()) holds for all documents
EVERY: Trigrams = ("and", ())


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, and the length its ``group`` must have; ``base`` rules are those of the contract."""

    kind: str
    pattern: bytes
    group: int = 0
    least: int = 0
    base: bool = False


#: The contract's three rules, in its order.
BASE = (
    Rule("assign", rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", rb"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", rb"[0-9a-f]+", 0, 24, True),
)
RULES = (
    *BASE,
    Rule("forge", rb"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", rb"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", rb"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", rb"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"),
    Rule("login", rb"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:[^\s/@]{1,64}@"),
)


def _all_of(strings: set[bytes]) -> Trigrams:
    """The query of one of ``strings``: every trigram of it."""
    if any(len(s) < 3 for s in strings):
        return EVERY
    return ("or", tuple(("and", tuple(sorted({s[i : i + 3] for i in range(len(s) - 2)}))) for s in sorted(strings)))


def _finite(seq) -> set[bytes] | None:
    """The strings an expression stands for, letters folded, or None if they are too many."""
    out = {b""}
    for op, arg in seq:
        match op:
            case parser.LITERAL:
                more = {bytes([arg]).lower()}
            case parser.IN if all(x[0] is parser.LITERAL for x in arg):
                more = {bytes([x[1]]).lower() for x in arg}
            case parser.SUBPATTERN:
                more = _finite(arg[-1])
            case parser.BRANCH:
                parts = [_finite(x) for x in arg[1]]
                more = None if None in parts else set().union(*parts)
            case parser.MAX_REPEAT if arg[1] == 1:
                more = _finite(arg[2])
                more = more if more is None or arg[0] else more | {b""}
            case _:
                more = None
        if more is None or len(out) * len(more) > STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def _derive(seq) -> Trigrams:
    """A query that every document with a match fulfils: finite stretches give trigrams, the rest is taken apart."""
    terms, held = [], {b""}
    for item in seq:
        more = _finite([item])
        if more is not None and len(held) * len(more) <= STRINGS:
            held = {a + b for a in held for b in more}
            continue
        terms.append(_all_of(held))
        held = {b""} if more is None else more
        op, arg = item
        if op is parser.SUBPATTERN:
            terms.append(_derive(arg[-1]))
        elif op is parser.BRANCH:
            terms.append(("or", tuple(map(_derive, arg[1]))))
        elif op is parser.MAX_REPEAT and arg[0]:
            terms.append(_derive(arg[2]))
    terms.append(_all_of(held))
    return _plain(("and", tuple(terms)))


def _plain(query: Trigrams) -> Trigrams:
    if isinstance(query, bytes):
        return query
    kind, parts = query[0], [_plain(x) for x in query[1]]
    if kind == "or" and EVERY in parts:
        return EVERY
    parts = [x for x in dict.fromkeys(parts) if x != EVERY]
    return parts[0] if len(parts) == 1 else (kind, tuple(parts))


def trigram_query(pattern: bytes) -> Trigrams:
    """The Boolean trigram query of an expression over bytes; ``EVERY`` if no trigram is mandatory."""
    return _derive(parser.parse(pattern))


def _grams(query: Trigrams) -> set[bytes]:
    return {query} if isinstance(query, bytes) else set().union(*map(_grams, query[1]))


class Index:
    """Postings of a slice for the wanted trigrams: a Boolean vector over its documents for each."""

    def __init__(self, texts: list[bytes], wanted: set[bytes]) -> None:
        self.n = len(texts)
        self.postings = {g: np.zeros(self.n, bool) for g in wanted}
        joined = np.frombuffer(b"\0\0".join(texts).lower(), np.uint8)
        if len(joined) < 3 or not wanted:
            return
        starts = np.concatenate([[0], np.cumsum([len(t) + 2 for t in texts])])
        codes = joined[:-2].astype(np.uint32)
        codes <<= 8
        codes |= joined[1:-1]
        codes <<= 8
        codes |= joined[2:]
        table = _table(frozenset(wanted))
        hits = np.flatnonzero(table[codes])
        docs = np.searchsorted(starts, hits, "right") - 1
        found = codes[hits]
        for gram, posting in self.postings.items():
            posting[docs[found == int.from_bytes(gram, "big")]] = True

    def candidates(self, query: Trigrams) -> np.ndarray:
        if isinstance(query, bytes):
            return self.postings[query]
        out = np.full(self.n, query[0] == "and")
        for part in query[1]:
            if query[0] == "and":
                out = out & self.candidates(part)
            else:
                out = out | self.candidates(part)
        return out


def _table(wanted: frozenset) -> np.ndarray:
    """Which of all trigrams are wanted."""

    def make() -> np.ndarray:
        table = np.zeros(1 << 24, bool)
        table[[int.from_bytes(g, "big") for g in wanted]] = True
        return table

    return worker_cache(("trigrams", wanted), make)


def _positions(text: bytes, offsets: list[int]) -> dict[int, int]:
    """Code-point positions of byte offsets, each stretch of the text decoded once."""
    if text.isascii():
        return {x: x for x in offsets}
    out, at = {0: 0}, 0
    for a, b in pairwise(sorted({0, *offsets})):
        at += len(text[a:b].decode("utf-8", "replace"))
        out[b] = at
    return out


def spans(text: bytes, rules: list[tuple[int, Rule, re.Pattern]]) -> list[tuple[int, int, int]]:
    """start, order of the rule, end in code points of every match that holds, in that order."""
    found = []
    for order, rule, pattern in rules:
        for m in pattern.finditer(text):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                found.append((m.start(), order, m.end()))
    at = _positions(text, [x for a, _, b in found for x in (a, b)])
    return sorted((at[a], order, at[b]) for a, order, b in found)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, kinds, starts and ends of every document's secrets, in order of start and rule."""

    def run(batch: pa.RecordBatch) -> dict:
        # Equivalent to [0-9a-f]+ with a length of 24 or more, without a match for each short run.
        ready = [(i, r, re.compile(rb"[0-9a-f]{%d,}" % r.least if r.pattern == rb"[0-9a-f]+" else r.pattern)) for i, r in enumerate(rules)]
        queries = [trigram_query(r.pattern) for r in rules]
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        index = Index(texts, set().union(*map(_grams, queries)))
        due: list[list] = [[] for _ in texts]
        for rule, query in zip(ready, queries, strict=True):
            for i in np.flatnonzero(index.candidates(query)):
                due[i].append(rule)
        found = [spans(text, own) if own else [] for text, own in zip(texts, due, strict=True)]
        return {"doc_id": batch.column("doc_id"), "kinds": [[rules[k].kind for _, k, _ in x] for x in found], "starts": [[a for a, _, _ in x] for x in found], "ends": [[b for _, _, b in x] for x in found]}

    return map_batches(with_text(docs, "doc_id"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, kinds array<string>, starts array<long>, ends array<long>")
