"""Boolean trigram queries of regular expressions.

A query is a list of clauses, each a set of trigrams: a text that matches the expression
has all trigrams of one clause at least, in lower case. An expression without mandatory
trigrams has no query.
"""

from __future__ import annotations

from re import _constants as codes
from re import _parser as parser

# Alternatives that are told apart, and members up to which a character class is spelt out.
MOST_WAYS = 32
MOST_MEMBERS = 6

# A way to match is a list of literal runs; None stands for anything between them.
Way = tuple[str | None, ...]
ANY: list[Way] = [(None,)]
EMPTY: list[Way] = [()]


def _join(a: Way, b: Way) -> Way:
    if a and b and a[-1] is not None and b[0] is not None:
        return (*a[:-1], a[-1] + b[0], *b[1:])
    return (*a, *b)


def _sequence(parts: list[list[Way]]) -> list[Way]:
    ways = EMPTY
    for part in parts:
        # What would make too many ways counts as anything.
        if len(ways) * len(part) > MOST_WAYS:
            part = ANY
        ways = [_join(a, b) for a in ways for b in part]
    return ways


def _class(members) -> list[Way]:
    chars: set[str] = set()
    for kind, value in members:
        if kind is codes.LITERAL:
            chars.add(chr(value).lower())
        elif kind is codes.RANGE and value[1] - value[0] < MOST_MEMBERS:
            chars.update(chr(c).lower() for c in range(value[0], value[1] + 1))
        else:
            return ANY
    return [(c,) for c in sorted(chars)] if len(chars) <= MOST_MEMBERS else ANY


def _ways(tree) -> list[Way]:
    parts = []
    for kind, value in tree:
        if kind is codes.LITERAL:
            parts.append([(chr(value).lower(),)])
        elif kind is codes.IN:
            parts.append(_class(value))
        elif kind is codes.SUBPATTERN:
            parts.append(_ways(value[-1]))
        elif kind is codes.BRANCH:
            some = [w for branch in value[1] for w in _ways(branch)]
            parts.append(some if len(some) <= MOST_WAYS else ANY)
        elif kind in (codes.MAX_REPEAT, codes.MIN_REPEAT, codes.POSSESSIVE_REPEAT):
            low, high, inner = value
            once = _ways(inner)
            parts += [once] * min(low, 3)
            if (low, high) == (0, 1):
                parts.append(EMPTY + once)
            elif high != low or low > 3:
                parts.append(ANY)
        elif kind is codes.AT:
            pass
        else:
            parts.append(ANY)
    return _sequence(parts)


def query(regex: str) -> list[frozenset[str]] | None:
    """The clauses of an expression, or None if it must be run on every text."""
    clauses = {
        frozenset(run[i : i + 3] for run in way if run is not None for i in range(len(run) - 2))
        for way in _ways(parser.parse(regex))
    }
    if not clauses or frozenset() in clauses:
        return None
    # A clause that asks for more than another one adds nothing.
    least = [c for c in clauses if not any(other < c for other in clauses)]
    return sorted(least, key=sorted)
