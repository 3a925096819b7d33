"""Boolean trigram queries of regular expressions.

A query is a set of alternatives, each a set of trigrams: a text can match only if it holds all trigrams of one
alternative. The alternative without trigrams stands for "any text". Letters are folded to lower case throughout, so
queries are asked of folded texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

ANY = frozenset([frozenset()])
#: Most strings or alternatives that are kept apart; beyond it a query is loosened, never made stricter.
MOST = 64


def grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def either(*queries: frozenset) -> frozenset:
    """Alternatives of all queries; those that hold another one are implied by it and go."""
    sets = frozenset().union(*queries)
    return frozenset(s for s in sets if not any(o < s for o in sets))


def both(left: frozenset, right: frozenset) -> frozenset:
    if len(left) * len(right) > MOST:
        return min(left, right, key=len)
    return either(frozenset(a | b for a in left for b in right))


@dataclass(frozen=True)
class Facts:
    """What is known of all matches: the matches themselves if few, how they begin and end, and what they hold."""

    exact: frozenset[str] | None
    first: frozenset[str]
    last: frozenset[str]
    needs: frozenset = ANY

    def query(self) -> frozenset:
        return self.needs if self.exact is None else both(self.needs, either(*(frozenset([grams(s)]) for s in self.exact)))


EMPTY = frozenset([""])
UNKNOWN = Facts(None, EMPTY, EMPTY)


def words(*texts: str) -> Facts:
    return Facts(frozenset(texts), frozenset(texts), frozenset(texts))


def ends(texts, cut) -> frozenset[str]:
    """Beginnings or ends, cut to two letters where there are too many; nothing is known if there still are."""
    texts = frozenset(texts)
    if len(texts) > MOST:
        texts = frozenset(map(cut, texts))
    return texts if len(texts) <= MOST else EMPTY


def then(a: Facts, b: Facts) -> Facts:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST:
        pairs = [x + y for x in a.exact for y in b.exact]
        return Facts(frozenset(pairs), frozenset(pairs), frozenset(pairs), both(a.needs, b.needs))
    first = a.first if a.exact is None else {x + y for x in a.exact for y in b.first}
    last = b.last if b.exact is None else {x + y for x in a.last for y in b.exact}
    seam = ANY
    if len(a.last) * len(b.first) <= MOST:
        seam = either(*(frozenset([grams(x + y)]) for x in a.last for y in b.first))
    needs = both(both(a.query(), b.query()), seam)
    return Facts(None, ends(first, lambda s: s[:2]), ends(last, lambda s: s[-2:]), needs)


def alternative(options: list[Facts]) -> Facts:
    exact = None
    if all(o.exact is not None for o in options):
        exact = frozenset().union(*(o.exact for o in options))
    needs = either(*(o.query() for o in options))
    first = ends(frozenset().union(*(o.first for o in options)), lambda s: s[:2])
    last = ends(frozenset().union(*(o.last for o in options)), lambda s: s[-2:])
    return Facts(exact, first, last, needs) if exact is not None and len(exact) <= MOST else Facts(None, first, last, needs)


def letters(items) -> Facts:
    """A character class: its members, if they are listed and few."""
    members = set()
    for kind, value in items:
        if str(kind) == "LITERAL":
            members.add(value)
        elif str(kind) == "RANGE" and value[1] - value[0] <= MOST:
            members.update(range(value[0], value[1] + 1))
        else:
            return UNKNOWN
    found = {chr(m).lower() for m in members}
    return words(*found) if len(found) <= MOST // 4 else UNKNOWN


def repeated(item: Facts, least: int, most: int) -> Facts:
    if least == 0:
        return alternative([words(""), item]) if most == 1 else UNKNOWN
    once = reduce(then, [item] * min(least, 3))
    if least == most and least <= 3:
        return once
    return Facts(None, once.first, once.last, once.query())


def facts(tree) -> Facts:
    """Facts of a parsed expression. What is not understood counts as unknown."""
    found = words("")
    for kind, value in tree:
        name = str(kind)
        if name == "LITERAL":
            part = words(chr(value).lower())
        elif name == "IN":
            part = letters(value)
        elif name == "BRANCH":
            part = alternative([facts(option) for option in value[1]])
        elif name == "SUBPATTERN":
            part = facts(value[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            part = repeated(facts(value[2]), int(value[0]), int(value[1]))
        elif name in ("AT", "ASSERT", "ASSERT_NOT"):
            part = words("")
        else:
            part = UNKNOWN
        found = then(found, part)
    return found


def trigram_query(pattern: str) -> frozenset:
    """The query of a pattern, which may use what regular expressions of Python and the JVM have in common."""
    from re import _parser

    return facts(_parser.parse(pattern)).query()
