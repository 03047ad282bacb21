"""Many regular expressions over one text: an automaton of the literals that each needs picks the few that are run.

A rule's literals are read from its parsed expression: every match holds at least one of them.  All rules' literals lie in
one Aho-Corasick automaton, so a text is read once however many rules there are, and a text without any literal costs no
regular expression at all.  Rules without a literal always run.
"""

from __future__ import annotations

import re
from functools import cache
from re import _constants as K
from re import _parser as parser
from typing import NamedTuple

import ahocorasick

#: `.` and `$` know only \n as a line end, \w, \s and \b are ASCII, upper and lower case are one.
FLAGS = re.IGNORECASE | re.ASCII
#: Character classes of up to so many characters give their characters as literals.
CLASS = 8


def folded(text: str) -> str:
    """ASCII letters in lower case, others as they are: what the patterns' flags hold for one."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    """Of two requirements that both hold, the one that fewer texts meet: its shortest literal is longer, or it has fewer."""
    if not a or not b:
        return a or b
    worth = lambda s: (min(map(len, s)), -len(s))
    return a if worth(a) >= worth(b) else b


def _needs(nodes: parser.SubPattern) -> frozenset[str] | None:
    best, run = None, ""
    for kind, value in nodes:
        if kind is K.LITERAL:
            run += chr(value)
            continue
        if kind is K.SUBPATTERN and len(value[3]) and all(k is K.LITERAL for k, _ in value[3]) and not (value[1] or value[2]):
            run += "".join(chr(v) for _, v in value[3])
            continue
        if run:
            best, run = _better(best, frozenset([folded(run)])), ""
        found = None
        if kind is K.SUBPATTERN:
            found = _needs(value[3])
        elif kind is K.BRANCH:
            each = [_needs(branch) for branch in value[1]]
            found = frozenset().union(*each) if all(each) else None
        elif kind in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT) and value[0] > 0:
            found = _needs(value[2])
        elif kind is K.IN and len(value) <= CLASS and all(k is K.LITERAL for k, _ in value):
            found = frozenset(folded(chr(v)) for _, v in value)
        elif kind is K.ATOMIC_GROUP:
            found = _needs(value)
        best = _better(best, found)
    return _better(best, frozenset([folded(run)]) if run else None)


def needed_literals(pattern: str) -> frozenset[str] | None:
    """Lower-case literals of which every match of the pattern holds one, whatever its case; None if there are no such."""
    return _needs(parser.parse(pattern, FLAGS))


class Hit(NamedTuple):
    rule: int
    start: int
    end: int


class Matcher:
    """Searches texts for all of its patterns."""

    def __init__(self, patterns: tuple[str, ...]):
        self.compiled = [re.compile(p, FLAGS) for p in patterns]
        self.always, holders = [], {}
        for i, p in enumerate(patterns):
            literals = needed_literals(p)
            if literals is None:
                self.always.append(i)
            for x in literals or ():
                holders.setdefault(x, []).append(i)
        self.literals = ahocorasick.Automaton()
        for x, rules in holders.items():
            self.literals.add_word(x, tuple(rules))
        if holders:
            self.literals.make_automaton()
        self.gated = bool(holders)

    def candidates(self, text: str) -> list[int]:
        """Rules that may match the text, in their order."""
        if not self.gated:
            return self.always
        found = {rules for _, rules in self.literals.iter(folded(text))}
        return sorted({i for rules in found for i in rules}.union(self.always)) if found else self.always

    def search(self, rule: int, text: str) -> Hit | None:
        m = self.compiled[rule].search(text)
        return Hit(rule, m.start(), m.end()) if m else None

    def first(self, text: str) -> int | None:
        return next((i for i in self.candidates(text) if self.compiled[i].search(text)), None)

    def all(self, text: str) -> list[int]:
        return [i for i in self.candidates(text) if self.compiled[i].search(text)]


@cache
def matcher(patterns: tuple[str, ...]) -> Matcher:
    """One per worker and set of patterns."""
    return Matcher(patterns)
