"""Boolean trigram queries that a text must satisfy before a regular expression can match in it."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as op
from re import _parser

#: Sets of possible strings are followed up to this size.
MOST = 32


@dataclass(frozen=True)
class Query:
    """All of ``terms``, and of each group of ``choices`` one. Without both it requires nothing."""

    terms: frozenset[str] = frozenset()
    choices: tuple[tuple[Query, ...], ...] = ()

    @property
    def empty(self) -> bool:
        return not self.terms and not self.choices

    def trigrams(self) -> set[str]:
        return set(self.terms).union(*(q.trigrams() for group in self.choices for q in group))


def both(a: Query, b: Query) -> Query:
    return Query(a.terms | b.terms, (*a.choices, *(c for c in b.choices if c not in a.choices)))


def any_of(queries: list[Query]) -> Query:
    """One of the queries. If one of them requires nothing, the choice doesn't either."""
    if any(q.empty for q in queries):
        return Query()
    common = frozenset.intersection(*(q.terms for q in queries))
    rest = list(dict.fromkeys(Query(q.terms - common, q.choices) for q in queries))
    # What requires all that another choice does, and more, adds nothing to the choice.
    rest = [q for q in rest if not any(p is not q and not p.choices and p.terms <= q.terms for p in rest)]
    return Query(common, () if any(q.empty for q in rest) else (tuple(rest),))


def of_strings(strings: set[str]) -> Query:
    """What holds for a text that contains one of the strings."""
    return any_of([Query(frozenset(s[i : i + 3] for i in range(len(s) - 2))) for s in sorted(strings)])


Known = tuple[set[str] | None, Query]  # the strings a part can be, if followed, and else what it requires


def _joined(a: set[str] | None, b: set[str] | None) -> set[str] | None:
    if a is None or b is None or len(a) * len(b) > MOST:
        return None
    return {x + y for x, y in product(a, b)}


def _sequence(parts) -> Known:
    run: set[str] = {""}
    required, whole = Query(), True
    for part in parts:
        strings, query = _part(*part)
        longer = _joined(run, strings)
        if longer is None:  # the run of followed strings ends here, perhaps another begins
            required, whole = both(both(required, of_strings(run)), query), False
            longer = strings or {""}
        run = longer
    return (run, Query()) if whole else (None, both(required, of_strings(run)))


def _part(kind, value) -> Known:
    if kind is op.LITERAL:
        return {chr(value).lower()}, Query()
    if kind is op.AT:
        return {""}, Query()
    if kind is op.IN and all(k is op.LITERAL for k, _ in value):
        letters = {chr(v).lower() for _, v in value}
        return (letters if len(letters) <= MOST else None), Query()
    if kind is op.SUBPATTERN:
        return _sequence(value[3])
    if kind is op.BRANCH:
        known = [_sequence(branch) for branch in value[1]]
        strings = set().union(*(s for s, _ in known if s is not None))
        if all(s is not None for s, _ in known) and len(strings) <= MOST:
            return strings, Query()
        return None, any_of([q if s is None else of_strings(s) for s, q in known])
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        least, most, inner = value
        strings, query = _sequence(inner)
        if strings is not None and (least, most) == (0, 1):
            return strings | {""}, Query()
        if least:
            return None, query if strings is None else of_strings(strings)
    return None, Query()


def trigram_query(pattern: str) -> Query:
    """What the lower-case form of any text with a match must contain, by trigrams of lower case."""
    strings, query = _sequence(_parser.parse(pattern))
    return query if strings is None else of_strings(strings)
