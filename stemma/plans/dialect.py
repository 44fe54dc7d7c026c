"""Small builders for the SQL side of text features."""

from __future__ import annotations


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def match(c: str, p: str, multiline: bool = False) -> str:
    return f"regexp_matches({c}, {q(('(?m)' if multiline else '') + p)})"


def any_match(c: str, ps: list[str], multiline: bool = False) -> str:
    return "(" + " OR ".join(match(c, p, multiline) for p in ps) + ")"


def any_word(c: str, ws: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, {q(w)})" for w in ws) + ")"


def count_words(c: str, ws: list[str]) -> str:
    return "(" + " + ".join(f"contains({c}, {q(w)})::INT" for w in ws) + ")"


def count_true(parts: list[str]) -> str:
    return "(" + " + ".join(f"({p})::INT" for p in parts) + ")"


def count_matches(c: str, ps: list[str], multiline: bool = False) -> str:
    return "(" + " + ".join(f"len(regexp_extract_all({c}, {q(('(?m)' if multiline else '') + p)}))" for p in ps) + ")"


def words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '\\s+'), lambda x: x <> '')"


def lines(c: str, breaks: str) -> str:
    parts = f"regexp_split_to_array({c}, {q(breaks)})"
    return f"(CASE WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END)"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def case_sum(pairs: list[tuple[str, str]]) -> str:
    return " + ".join(f"CASE WHEN {c} THEN {v} ELSE 0.0::DOUBLE END" for c, v in pairs)
