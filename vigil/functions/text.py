"""String column builders shared by the sources, normaliser and rules.

Everything here returns a ``Column`` made of built-in Spark functions, so it
stays inside whole-stage code generation (no Python per row).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil.schema import SEVERITY_ALIASES

# Java regex flags that give Python-``re`` behaviour on ``str`` patterns:
# U = Unicode \w \d \s \b, u = Unicode case folding, d = only "\n" ends a line
# for "." and "$" (Java would also stop at \r, \u0085, \u2028, \u2029).
PY_FLAGS = "(?U)(?d)"
PY_FLAGS_NOCASE = "(?iuU)(?d)"

# Python's str.strip() also removes the four separator controls \x1c-\x1f,
# which are not Unicode White_Space and so are outside Java's (?U)\s.
_WS = r"[\s\x{1c}-\x{1f}]"
_STRIP = r"(?U)^" + _WS + r"+|" + _WS + r"+$"


def ustrip(c: Column) -> Column:
    """Strip Unicode whitespace at both ends (Python ``str.strip``); text that begins and ends with visible ASCII is not searched."""
    tight = F.substring(c, 1, 1).between("!", "~") & F.substring(c, -1, 1).between("!", "~")
    return F.when(tight, c).otherwise(F.regexp_replace(c, _STRIP, ""))


def py_regex(pattern: str, ignore_case: bool = False) -> str:
    """Java form of a Python ``re`` pattern as used on text lines."""
    p = re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern)
    p = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", p)
    return (PY_FLAGS_NOCASE if ignore_case else PY_FLAGS) + p


def regex_split(c: Column, pattern: str, n: int, anchored: bool = False) -> Column:
    """All groups of the first match of ``pattern`` from ONE regex evaluation,
    as an array ["", g1, ..., gn] (``regexp_extract`` would run the regex once
    per group). Materialise it as a column, then read it with ``group_at``.

    The match is rewritten to "\\n g1 \\n g2 ..." by ``regexp_replace`` and
    split; ``^.*?(?:p).*$`` finds the same leftmost match as a search. Callers
    guarantee that ``c`` holds no newline (true for log lines, which are split
    on newlines, and their parts), so an unmatched value splits to one element.
    """
    body = pattern if anchored else "^.*?(?:" + pattern + ").*$"
    repl = "".join("\n$" + str(i) for i in range(1, n + 1))
    return F.split(F.regexp_replace(c, py_regex(body), repl), "\n")


def group_at(arr: Column, i: int) -> Column:
    """Group ``i`` of a ``regex_split`` array; NULL if no match or empty."""
    return F.when(F.size(arr) > 1, F.nullif(F.get(arr, i), F.lit("")))


def contains_any(lowered: Column, words) -> Column:
    """OR of substring tests on an already lower-cased column."""
    return reduce(lambda a, b: a | b, [lowered.contains(w) for w in words], F.lit(False))


def parse_severity(c: Column) -> Column:
    """Severity text -> one of low/medium/high/critical; unknown or empty -> low."""
    table = F.create_map(*[x for kv in SEVERITY_ALIASES.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.coalesce(F.try_element_at(table, F.lower(c)), F.lit("low"))


def map_present(m: Column, key: str) -> Column:
    """True when ``key`` is in the map, also when its value is NULL."""
    return F.coalesce(F.map_contains_key(m, F.lit(key)), F.lit(False))


def compact_map(*pairs) -> Column:
    """Map of (name, Column) pairs, dropping entries whose value is NULL."""
    flat = []
    for k, v in pairs:
        flat += [F.lit(k), v]
    return F.map_filter(F.create_map(*flat), lambda k, v: v.isNotNull())
