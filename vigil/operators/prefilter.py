"""Which of many rules can hold on an event: found in one pass over each field, whatever the number of rules.

Most rules can hold only where some text is found in some field (``contains``, ``startswith`` and ``endswith`` all imply
it). Such needles are read off a rule by running its condition over ``Needs`` instead of columns. All needles of a field
become one pattern, a prefix tree with longest words first, which a lookahead matches at every place of the field's value.
The longest needle at a place implies those that it begins with, so nothing is missed. A rule without needles is always a
candidate. Candidates are only guesses: the rule's own predicate decides.
"""

from __future__ import annotations

import json
import logging
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil.operators.rules import Compiler, Rule

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Needs:
    """One of ``any_of``, (field, text) pairs, must be found for a predicate to hold; None: nothing is known of it."""

    any_of: frozenset | None

    def weight(self) -> tuple:
        """The greater, the more seldom found: never, then long texts, then few of them."""
        if self.any_of is None:
            return -1, 0
        return min((len(text) for _, text in self.any_of), default=1 << 30), -len(self.any_of)

    def __and__(self, other: Needs) -> Needs:
        return max(self, other, key=Needs.weight)

    def __or__(self, other: Needs) -> Needs:
        return UNKNOWN if self.any_of is None or other.any_of is None else Needs(self.any_of | other.any_of)

    def __invert__(self) -> Needs:
        return UNKNOWN


UNKNOWN, NEVER = Needs(None), Needs(frozenset())


class NeedsReader(Compiler):
    """Reads a rule as its compiler does, with ``Needs`` in place of predicates."""

    def selection(self, sel: dict) -> Needs:
        found = UNKNOWN
        for spec, expected in sel.items():
            name, _, modifier = str(spec).partition("|")
            texts = [str(v).lower() for v in (expected if isinstance(expected, list) else [expected])]
            if modifier.split("|")[0] != "re" and all(texts):
                found &= Needs(frozenset((name, t) for t in texts))
        return found

    def never(self) -> Needs:
        return NEVER

    def at_least(self, blocks: list[Needs], need: int) -> Needs:
        if need <= 0:
            return UNKNOWN
        if need > len(blocks):
            return NEVER
        return reduce(Needs.__and__ if need == len(blocks) else Needs.__or__, blocks)


def needs_of(rule: Rule) -> Needs:
    """What a rule without threshold needs; unknown where it cannot be read."""
    try:
        return NeedsReader().condition(rule.condition, rule.detection)
    except Exception:  # noqa: BLE001 - the rule's own predicate decides what becomes of it
        log.debug("needs of rule %r cannot be read", rule.title, exc_info=True)
        return UNKNOWN


def longest_word_pattern(words: set[str]) -> str:
    """Pattern of the longest of ``words`` that begins at a place."""
    def escaped(c: str) -> str:
        return c if c.isascii() and c.isalnum() else f"\\x{{{ord(c):X}}}"

    def below(group: list[str], at: int) -> str:
        """``group``: sorted words with the same first ``at`` characters."""
        first, last = group[0], group[-1]
        same = at
        while same < min(len(first), len(last)) and first[same] == last[same]:
            same += 1
        head = "".join(map(escaped, first[at:same]))
        by_next = defaultdict(list)
        for w in group:
            if len(w) > same:
                by_next[w[same]].append(w)
        if not by_next:
            return head
        return f"{head}(?:{'|'.join(below(g, same) for g in by_next.values())}){'?' if len(first) == same else ''}"

    return below(sorted(words), 0)


def candidates(needs: dict[int, Needs], value_of: dict[str, str]) -> Column:
    """Array of the ordinals of the rules that can hold; ``value_of`` names the column of each field's lower-cased value."""
    by_field: dict[str, dict[str, list]] = defaultdict(lambda: defaultdict(list))
    always = [o for o, n in needs.items() if n.any_of is None]
    for o, n in needs.items():
        for name, text in n.any_of or ():
            by_field[name][text].append(o)
    parts = [F.from_json(F.lit(json.dumps(always)), "array<int>")]
    for name, rules_of in by_field.items():
        implied = {w: sorted({o for end in range(1, len(w) + 1) for o in rules_of.get(w[:end], ())}) for w in rules_of}
        table = F.from_json(F.lit(json.dumps(implied)), "map<string,array<int>>")
        found = F.regexp_extract_all(F.coalesce(F.col(value_of[name]), F.lit("")), F.lit(f"(?=({longest_word_pattern(set(rules_of))}))"), F.lit(1))
        parts.append(F.flatten(F.transform(F.array_distinct(found), lambda w: F.element_at(table, w))))
    return F.array_distinct(F.concat(*parts))
