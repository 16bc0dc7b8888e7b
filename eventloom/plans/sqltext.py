"""Helpers that write the same question as plain SQL, for checks against another engine."""

from __future__ import annotations

import re
from collections.abc import Iterable

from .. import lexicon as lx
from . import adapters as A


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def with_views(body: str) -> str:
    """Prefix the event views a query mentions."""
    ctes = [f"{n} AS ({getattr(A, n.upper())})" for n in ("ev", "cap", "raw", "postings", "ann")
            if re.search(rf"\b{n}\b", body)]
    return f"WITH {', '.join(ctes)} {body}" if ctes else body


def re2(phrases: Iterable[str], whole_words: bool = True) -> str:
    body = "|".join(f"(?:{p})" for p in phrases).replace(" ", r"\s+").replace(r"\w", r"[\p{L}\p{N}_]")
    edge = r"[^\p{L}\p{N}_]"
    return q(f"(?:^|{edge})(?:{body})(?:$|{edge})" if whole_words else f"(?:{body})")


def has(col: str, phrases, whole_words: bool = True) -> str:
    return f"regexp_matches({col}, {re2(phrases, whole_words)})"


def contains_any(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(w)})" for w in words) + ")"


def first_label(col: str, groups, default: str) -> str:
    arms = " ".join(f"WHEN {contains_any(col, words)} THEN {q(label)}" for label, words in groups)
    return f"CASE {arms} ELSE {default} END"


def ts(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S')"


def week(col: str) -> str:
    """%W by SQL arithmetic: Monday weeks, week 0 before the first Monday."""
    return (f"strftime({col}, '%Y') || '-W' || lpad(CAST((extract(doy FROM {col}) - 1 + 7 "
            f"- (extract(isodow FROM {col}) - 1)) // 7 AS VARCHAR), 2, '0')")


def partner(col: str) -> str:
    arms = []
    for name, words, fragments in lx.PARTNER_ORGS:
        cond = has(col, words) + (f" OR {has(col, fragments, False)}" if fragments else "")
        arms.append(f"WHEN {cond} THEN {q(name)}")
    return f"CASE {' '.join(arms)} END"


def tier(title: str, full: str, org: str) -> str:
    """The scoring cascade as one CASE over lower-case title and text."""
    def graded(phrases, name):
        arms = []
        for p in phrases:
            arms += [f"WHEN {has(title, (p,))} THEN '{name}_title'", f"WHEN {has(full, (p,))} THEN '{name}_text'"]
        return " ".join(arms)
    t, f = (lambda ph: has(title, ph)), (lambda ph: has(full, ph))
    return f"""CASE
      WHEN {f(lx.MEDICAL)} AND {f(lx.STUDENT_HEALTH)} THEN 'health_student' WHEN {f(lx.MEDICAL)} THEN 'medical'
      WHEN {f(lx.INDUSTRIAL)} THEN 'industrial'
      WHEN {t(lx.LEISURE)} OR ({f(lx.LEISURE)} AND NOT {t(lx.SUMMIT + lx.CAREER)}) THEN 'leisure'
      WHEN {t(lx.SUMMIT)} THEN 'summit_title' WHEN {t(lx.CAREER)} THEN 'career_title'
      WHEN {f(lx.HACKATHON)} THEN 'hackathon' WHEN {f(lx.SUMMIT)} THEN 'summit_text' WHEN {f(lx.CAREER)} THEN 'career_text'
      WHEN {org} IS NOT NULL AND {contains_any(full, lx.MAJOR_WORDS)} THEN 'partner_major'
      WHEN {org} IS NOT NULL THEN 'partner'
      WHEN {t(lx.UNIVERSITY)} AND {t(lx.CONFERENCE)} THEN 'university_conference'
      WHEN {t(lx.UNIVERSITY)} OR ({t(lx.CONFERENCE)} AND {f(lx.UNIVERSITY)}) THEN 'campus'
      WHEN {f(lx.STUDENT_ORG)} THEN 'student_org'
      {graded(lx.WORKSHOP + lx.TRAINING, 'workshop')} {graded(lx.TECH, 'tech')} {graded(lx.CULTURE, 'culture')}
      ELSE 'general' END"""
