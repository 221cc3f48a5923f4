"""Boolean trigram queries derived from regular expressions.

An expression is parsed and worked off bottom up. Of every part four things are kept: all the strings that it can match,
while they are few; strings of which every match begins with one; strings of which every match ends with one; and a
query that the text of every match satisfies. Where parts meet, the ends of one are joined to the beginnings of the
next, so trigrams over a seam count too. A query is True (no trigram is mandatory), a trigram, or ("and" | "or",
queries). What the parser doesn't know says nothing, which only makes a query weaker.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from re import _constants as C
from re import _parser

#: Strings that are kept of a part, characters of a class that count as its alternatives, and repeats that are unrolled.
MOST_STRINGS = 24
MOST_CHARACTERS = 8
MOST_REPEATS = 4

Query = bool | str | tuple


def all_of(queries: Iterable[Query]) -> Query:
    parts: set = set()
    for q in queries:
        if isinstance(q, tuple) and q[0] == "and":
            parts |= q[1]
        elif q is not True:
            parts.add(q)
    if not parts:
        return True
    return next(iter(parts)) if len(parts) == 1 else ("and", frozenset(parts))


def _terms(q: Query) -> frozenset:
    return q[1] if isinstance(q, tuple) and q[0] == "and" else frozenset([q])


def any_of(queries: Iterable[Query]) -> Query:
    parts: set = set()
    for q in queries:
        if q is True:
            return True
        parts |= q[1] if isinstance(q, tuple) and q[0] == "or" else {q}
    # what asks for more than another alternative adds nothing
    parts = {q for q in parts if not any(_terms(p) < _terms(q) for p in parts)}
    return next(iter(parts)) if len(parts) == 1 else ("or", frozenset(parts))


def of_strings(strings: frozenset[str]) -> Query:
    """What holds for a text that contains one of the strings."""
    if any(len(s) < 3 for s in strings):
        return True
    return any_of(all_of(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


@dataclass(frozen=True)
class Part:
    begins: frozenset[str]
    ends: frozenset[str]
    query: Query = True
    whole: bool = False  # begins and ends are all the strings that the part can match

    def told(self) -> Query:
        return all_of([self.query, of_strings(self.begins), of_strings(self.ends)])

    def loose(self) -> Part:
        """The same without the claim to be whole, with short and few ends."""
        begins, ends = _few(self.begins, lambda s: s[:2]), _few(self.ends, lambda s: s[-2:])
        return Part(begins, ends, self.told())


def _few(strings: frozenset[str], shorten) -> frozenset[str]:
    if len(strings) > MOST_STRINGS:
        strings = frozenset(map(shorten, strings))
    return strings if len(strings) <= MOST_STRINGS else frozenset([""])


def _exactly(*strings: str) -> Part:
    return Part(frozenset(strings), frozenset(strings), True, True)


NOTHING = _exactly("")
ANYTHING = Part(frozenset([""]), frozenset([""]))


def _joined(a: frozenset[str], b: frozenset[str]) -> frozenset[str]:
    return frozenset(x + y for x in a for y in b)


def then(a: Part, b: Part) -> Part:
    if a.whole and b.whole and len(a.begins) * len(b.begins) <= MOST_STRINGS:
        return Part(c := _joined(a.begins, b.begins), c, all_of([a.query, b.query]), True)
    x, y = a.loose(), b.loose()
    begins = _joined(a.begins, y.begins) if a.whole else x.begins
    ends = _joined(x.ends, b.ends) if b.whole else y.ends
    seam = of_strings(_joined(x.ends, y.begins)) if len(x.ends) * len(y.begins) <= MOST_STRINGS**2 else True
    # long ends are told before they are shortened
    return Part(begins, ends, all_of([x.query, y.query, seam])).loose()


def either(a: Part, b: Part) -> Part:
    if a.whole and b.whole and len(a.begins | b.begins) <= MOST_STRINGS:
        return Part(c := a.begins | b.begins, c, any_of([a.query, b.query]), True)
    x, y = a.loose(), b.loose()
    return Part(x.begins | y.begins, x.ends | y.ends, any_of([x.query, y.query])).loose()


def _sequence(items, fold: bool) -> Part:
    out = NOTHING
    for op, value in items:
        out = then(out, _part(op, value, fold))
    return out


def _class(items, fold: bool) -> Part:
    found: set[str] = set()
    for op, value in items:
        if op is C.LITERAL:
            found.add(chr(value))
        elif op is C.RANGE and value[1] - value[0] < MOST_CHARACTERS:
            found |= {chr(c) for c in range(value[0], value[1] + 1)}
        else:
            return ANYTHING
    if fold:
        found = {c.lower() for c in found}
    return _exactly(*found) if len(found) <= MOST_CHARACTERS else ANYTHING


def _part(op, value, fold: bool) -> Part:
    if op is C.LITERAL:
        return _exactly(chr(value).lower() if fold else chr(value))
    if op is C.IN:
        return _class(value, fold)
    if op is C.BRANCH:
        out = None
        for x in value[1]:
            one = _sequence(x, fold)
            out = one if out is None else either(out, one)
        return out
    if op is C.SUBPATTERN:
        return _sequence(value[3], fold)
    if op is C.ATOMIC_GROUP:
        return _sequence(value, fold)
    if op in (C.AT, C.ASSERT, C.ASSERT_NOT):
        return NOTHING  # no character of its own
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        least, most, inner = value
        one = _sequence(inner, fold)
        if least == 0:
            return either(one, NOTHING) if most == 1 else (NOTHING if most == 0 else ANYTHING)
        out = one
        for _ in range(min(least, MOST_REPEATS) - 1):
            out = then(out, one)
        return out if least == most <= MOST_REPEATS else out.loose()
    return ANYTHING


def _folds(items) -> bool:
    """Whether a group somewhere in a parsed expression takes letters in either case."""
    for op, value in items:
        if op is C.SUBPATTERN and value[1] & re.IGNORECASE:
            return True
        inner = [value[3]] if op is C.SUBPATTERN else [value[2]] if op in (
            C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT
        ) else []
        inner += value[1] if op is C.BRANCH else [value] if op is C.ATOMIC_GROUP else []
        if any(map(_folds, inner)):
            return True
    return False


def derive(pattern: str) -> tuple[Query, bool]:
    """(query, fold): what the text of every match satisfies; with fold the query is about the lower-cased text.

    An expression that takes letters in either case anywhere is lower-cased as a whole, which asks for no more. One
    that this parser can't read (the rules' own engine knows more) has no mandatory trigram.
    """
    try:
        parsed = _parser.parse(pattern)
    except re.error:
        return True, False
    fold = bool(parsed.state.flags & re.IGNORECASE) or _folds(parsed)
    return _sequence(parsed, fold).told(), fold


def trigrams(q: Query) -> set[str]:
    if q is True:
        return set()
    return {q} if isinstance(q, str) else set().union(*map(trigrams, q[1]))


def holds(q: Query, text: str) -> bool:
    """Whether a text satisfies a query."""
    if q is True or isinstance(q, str):
        return q is True or q in text
    return (all if q[0] == "and" else any)(holds(x, text) for x in q[1])
