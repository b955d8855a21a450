"""Boolean formulas over words and date ranges, compiled to one Boolean column.

The lexer and the shunting-yard run on the driver; what comes out is an expression that Spark evaluates in one
scan, so a negation needs no table of all documents and no operator a shuffle. All operators associate to the
left, ``NOT`` too, which fixes how formulas with repeated or misplaced operators are read.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.stemmer import stem
from quarry.operators.dates import created_in, day_of, valid_in

#: How tightly the operators bind.
BINDS = {"NOT": 3, "AND": 2, "OR": 1}
_TOKEN = re.compile(r"\s*(?:(?P<word>[A-Za-z][A-Za-z0-9]*)|(?P<paren>[()]))")
_RANGE = re.compile(r"\s*(date_range|created_in)\s*(?=\()", re.I)


@dataclass(frozen=True)
class Token:
    """WORD with its text, RANGE with its kind and days, or an operator or parenthesis."""

    kind: str
    text: str = ""
    days: tuple[int, int] = (0, 0)


def _range(formula: str, at: int, kind: str) -> tuple[Token, int]:
    """The arguments end at the first comma and the first closing parenthesis after it."""
    comma = formula.find(",", at)
    close = formula.find(")", comma + 1)
    if comma < 0 or close < 0:
        raise ValueError(f"expected (date, date) after {kind}")
    days = day_of(formula[at + 1 : comma].strip()), day_of(formula[comma + 1 : close].strip())
    return Token("RANGE", kind.lower(), days), close + 1


def tokenize(formula: str, dates: bool = False) -> list[Token]:
    """Tokens of a formula; words are in lower case, operators are told in either case."""
    out, at = [], 0
    while formula[at:].strip():
        if dates and (found := _RANGE.match(formula, at)):
            token, at = _range(formula, found.end(), found[1])
            out.append(token)
            continue
        found = _TOKEN.match(formula, at)
        if not found:
            raise ValueError(f"unexpected character: {formula[at:].strip()[0]!r}")
        at = found.end()
        word = found["word"]
        if word is None:
            out.append(Token(found["paren"]))
        elif word.upper() in BINDS:
            out.append(Token(word.upper()))
        else:
            out.append(Token("WORD", word.lower()))
    return out


def to_rpn(tokens: list[Token]) -> list[Token]:
    """Reverse Polish order by the shunting-yard."""
    out: list[Token] = []
    waiting: list[Token] = []
    for token in tokens:
        if token.kind in ("WORD", "RANGE"):
            out.append(token)
        elif token.kind == "(":
            waiting.append(token)
        elif token.kind == ")":
            while waiting and waiting[-1].kind != "(":
                out.append(waiting.pop())
            if not waiting:
                raise ValueError("mismatched parentheses")
            waiting.pop()
        else:
            while waiting and waiting[-1].kind != "(" and BINDS[waiting[-1].kind] >= BINDS[token.kind]:
                out.append(waiting.pop())
            waiting.append(token)
    while waiting:
        if waiting[-1].kind == "(":
            raise ValueError("mismatched parentheses")
        out.append(waiting.pop())
    return out


def evaluate(rpn: list[Token], leaf: Callable[[Token], Column]) -> Column:
    """A column from the reverse Polish order."""
    held: list[Column] = []
    for token in rpn:
        if token.kind not in BINDS:
            held.append(leaf(token))
            continue
        need = 1 if token.kind == "NOT" else 2
        if len(held) < need:
            raise ValueError(f"{token.kind} lacks an operand")
        if token.kind == "NOT":
            held.append(~held.pop())
        else:
            b, a = held.pop(), held.pop()
            held.append(a & b if token.kind == "AND" else a | b)
    if len(held) != 1:
        raise ValueError("empty expression" if not held else "operands without an operator")
    return held[0]


def compile_text(formula: str, terms: str = "terms") -> Column:
    """A formula of words over an array of stems; a blank one holds for no document."""
    if not formula.strip():
        return F.lit(False)
    tokens = tokenize(formula)
    if tokens[-1].kind in BINDS:
        raise ValueError("the expression ends with an operator")
    return evaluate(to_rpn(tokens), lambda t: F.array_contains(terms, stem(t.text)))


def compile_dated(formula: str, terms: str = "terms", begin: str = "begin_date", end: str = "end_date") -> Column:
    """A formula of words and of DATE_RANGE and CREATED_IN; an empty one holds for no document, and a final NOT applies to what stands before it."""
    if not formula.strip():
        return F.lit(False)

    def leaf(token: Token) -> Column:
        if token.kind == "WORD":
            return F.array_contains(terms, stem(token.text))
        return (valid_in if token.text == "date_range" else created_in)(*token.days, begin, end)

    rpn = to_rpn(tokenize(formula, dates=True))
    return evaluate(rpn, leaf) if rpn else F.lit(False)
