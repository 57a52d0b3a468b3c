"""Token predicates over text columns.

A text is analysed into lower-case runs of letters and digits.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def analyse(text: str) -> list[str]:
    """Tokens of a literal."""
    return [t for t in re.split(r"[^\w]|_", text.lower()) if t]


def tokens(text: Column) -> Column:
    """Tokens of a column; null for null."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def match(text: Column, query: str, operator: str = "or", minimum: int | None = None) -> Column:
    """Whether a text has any (``or``), all (``and``) or ``minimum`` query tokens."""
    wanted = list(dict.fromkeys(analyse(query)))
    if not wanted:
        return F.lit(False)
    array = F.array(*[F.lit(t) for t in wanted])
    if minimum is None and operator == "or":
        return F.arrays_overlap(tokens(text), array)
    need = len(wanted) if minimum is None else minimum
    return F.size(F.array_intersect(tokens(text), array)) >= need


def _joined(text: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))


def match_phrase(text: Column, query: str) -> Column:
    """Whether the query tokens stand next to each other, in order."""
    wanted = analyse(query)
    return _joined(text).contains(" " + " ".join(wanted) + " ") if wanted else F.lit(False)


def match_phrase_prefix(text: Column, query: str) -> Column:
    """As a phrase, the last token a prefix."""
    wanted = analyse(query)
    return _joined(text).contains(" " + " ".join(wanted)) if wanted else F.lit(False)


def match_bool_prefix(text: Column, query: str) -> Column:
    """Any query token, the last one as a prefix."""
    wanted = analyse(query)
    if not wanted:
        return F.lit(False)
    last = F.exists(tokens(text), lambda t: t.startswith(wanted[-1]))
    return last | match(text, " ".join(wanted[:-1])) if wanted[:-1] else last


def edits_allowed(value: str, fuzziness: str = "AUTO") -> int:
    if fuzziness.upper() == "AUTO":
        return 0 if len(value) < 3 else 1 if len(value) < 6 else 2
    return int(fuzziness)


def fuzzy(text: Column, value: str, fuzziness: str = "AUTO") -> Column:
    """Whether a token is within the allowed edit distance."""
    k = edits_allowed(value, fuzziness)

    def near(t: Column) -> Column:
        return (F.abs(F.length(t) - len(value)) <= k) & (F.levenshtein(t, F.lit(value.lower()), k) >= 0)

    return F.exists(tokens(text), near)


def wildcard(value: Column, pattern: str) -> Column:
    """``*`` any run, ``?`` any character, over the whole value; a backslash makes
    the character after it an ordinary one."""
    out, at = "", 0
    while at < len(pattern):
        c = pattern[at]
        if c in "*?":
            out += "%" if c == "*" else "_"
        else:
            if c == "\\" and at + 1 < len(pattern):
                at += 1
                c = pattern[at]
            out += "\\" + c if c in "%_\\" else c
        at += 1
    return value.like(out)


def regexp(value: Column, pattern: str) -> Column:
    """A regular expression over the whole value."""
    return value.rlike(rf"\A(?:{pattern})\z")
