"""Turning fixed phrases and regular expressions into Spark columns.

Word classes are spelled out as Unicode letters, digits and underscore, so
Arabic counts as text and the result does not depend on how a given JVM reads
``\\w`` and ``\\b``.  Patterns are always literals: each compiles once per task.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
NOT_BEFORE = rf"(?<!{WORD})"
NOT_AFTER = rf"(?!{WORD})"
EDGE = rf"(?:{NOT_BEFORE}(?={WORD})|(?<={WORD}){NOT_AFTER})"
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_IN_CLASS = {"w": r"\p{L}\p{N}_", "s": r"\s\xa0", "d": r"\p{Nd}"}
_OUTSIDE = {"w": WORD, "W": NOT_WORD, "s": SPACE, "d": r"\p{Nd}", "b": EDGE}


def _begins_with_word(pattern: str) -> str | None:
    """What a pattern surely begins with, if that is a digit (its class) or some letter or digit (empty); None if it may be anything else.

    Groups that it begins with are looked into: all their alternatives must begin so, and none of them may be optional.
    """
    def atom(at: int) -> str | None:
        width = 2 if pattern.startswith(r"\d", at) else 1
        optional = pattern[at + width:at + width + 1] in ("?", "*") or pattern.startswith("{0", at + width)
        if optional or not (width == 2 or pattern[at:at + 1].isalnum()):
            return None
        return r"\p{Nd}" if width == 2 else ""

    at = len(re.match(r"(?:\((?:\?:)?)*", pattern)[0])
    found, depth = [atom(at)], pattern[:at].count("(")
    lowest, in_class = depth, False
    while lowest and at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 1
        elif in_class or c == "[":
            in_class = c != "]"
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if depth < lowest:
                lowest = depth
                if pattern[at + 1:at + 2] in ("?", "*") or pattern.startswith("{0", at + 1):
                    return None
        elif c == "|" and depth == lowest:
            found.append(atom(at + 1))
        at += 1
    return None if None in found else found[0] if len(set(found)) == 1 else ""


def unicode_regex(pattern: str, ignore_case: bool = True) -> str:
    """Spell out ``\\w \\W \\d \\s \\b`` as Unicode classes for Java.

    A word edge before what surely is a word character, or after it, looks at its other side only.
    """
    out, in_class, i = ["(?iu)" if ignore_case else ""], False, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            if nxt == "b" and not in_class:
                first = _begins_with_word(pattern[i + 2:])
                ends = re.search(r"(?:\\d|(?<!\\)[A-Za-z0-9])(?:\{[1-9][0-9,]*\}|\+)?$", pattern[:i])
                out.append(f"(?={first}){NOT_BEFORE}" if first else NOT_BEFORE if first == "" else NOT_AFTER if ends else EDGE)
                i += 2
                continue
            table = _IN_CLASS if in_class else _OUTSIDE
            out.append(table.get(nxt, ch + nxt))
            i += 2
            continue
        if ch == "[":
            in_class = True
        elif ch == "]":
            in_class = False
        out.append(ch)
        i += 1
    return "".join(out)


def phrase_regex(phrases: Iterable[str], whole_words: bool = True) -> str:
    """One alternation for a phrase list; blanks stand for any white space."""
    body = "|".join(f"(?:{p.replace(' ', chr(92) + 's+')})" for p in phrases)
    body = unicode_regex(body, ignore_case=False)
    return f"(?iu){NOT_BEFORE}(?:{body}){NOT_AFTER}" if whole_words else f"(?iu)(?:{body})"


def _branches(phrases: list[str]) -> str:
    """An alternation in which phrases share their beginnings, so that a position of a text is tried once per first character."""
    by_first: dict[str, list[str]] = {}
    for p in phrases:
        by_first.setdefault(p[:1], []).append(p[1:])
    ends = by_first.pop("", None)
    arms = [(r"\s+" if c == " " else c) + _branches(rest) for c, rest in by_first.items()]
    if not arms:
        return ""
    body = arms[0] if len(arms) == 1 and ends is None else f"(?:{'|'.join(arms)})"
    return body if ends is None else f"{body}?"


def has_phrase(col: Column, phrases: Iterable[str], whole_words: bool = True) -> Column:
    """Whether one of the phrases occurs; unlike in :func:`phrase_regex` it does not matter which."""
    phrases = list(phrases)
    plain = [p for p in phrases if re.fullmatch(r"[\w ,'&-]+", p)]
    rest = [p.replace(" ", r"\s+") for p in phrases if p not in plain]
    body = unicode_regex("|".join([*([_branches(sorted(plain))] if plain else []), *(f"(?:{p})" for p in rest)]), ignore_case=False)
    return col.rlike(f"(?iu){NOT_BEFORE}(?:{body}){NOT_AFTER}" if whole_words else f"(?iu)(?:{body})")


def matches(col: Column, pattern: str, ignore_case: bool = True) -> Column:
    return col.rlike(unicode_regex(pattern, ignore_case))


def extract(col: Column, pattern: str, group: int = 0, ignore_case: bool = True) -> Column:
    """First match (or group) of a pattern, NULL when it does not occur or is empty."""
    return F.nullif(grab(col, pattern, group, ignore_case), F.lit(""))


def grab(col: Column, pattern: str, group: int = 0, ignore_case: bool = True) -> Column:
    """First match (or group) of a pattern, empty when it does not occur."""
    return F.regexp_extract(col, unicode_regex(pattern, ignore_case), group)


def let(col: Column, body) -> Column:
    """Evaluate ``col`` once and use the value several times in ``body``."""
    return F.element_at(F.transform(F.array(col), body), 1)


def replace(col: Column, pattern: str, by: str, ignore_case: bool = True) -> Column:
    return F.regexp_replace(col, unicode_regex(pattern, ignore_case), by)


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_any(col: Column, words: Iterable[str]) -> Column:
    return any_of(col.contains(w) for w in words)


def first_label(col: Column, groups, default) -> Column:
    """Label of the first group one of whose words occurs in ``col`` (ordered CASE)."""
    out = None
    for label, words in groups:
        hit = contains_any(col, words)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


# every character Python and Unicode count as white space
WHITE = (" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
         + "\u2028\u2029\u202f\u205f\u3000")


def strip(col: Column) -> Column:
    """Trim any white space, not only blanks."""
    return F.btrim(col, F.lit(WHITE))


def squeeze(col: Column) -> Column:
    return strip(F.regexp_replace(col, f"{SPACE}+", " "))


def blank_to_null(col: Column) -> Column:
    return F.when(col != "", col)


def text(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def lines(col: Column) -> Column:
    """Non-empty trimmed lines of a text."""
    return F.filter(F.transform(F.split(text(col), "\n"), strip), lambda x: x != "")


def first_where(arr: Column, predicate, value=lambda x: x) -> Column:
    """First ``value`` of a list of texts that a predicate holds for; nothing is asked of those behind it."""
    def tried(x: Column) -> Column:
        return let(value(x), lambda v: F.when(predicate(v), v))

    return F.aggregate(arr, F.lit(None).cast("string"), lambda found, x: F.coalesce(found, tried(x)))


def missing_text(col: Column) -> Column:
    """NULL for an empty text."""
    return blank_to_null(col)
