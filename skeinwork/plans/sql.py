"""Pieces of DuckDB SQL that several checks share."""

from __future__ import annotations

from skeinwork.functions.text import DROPPED, IDEOGRAPHS, PUNCTUATION, SENTENCE_RULES, WHITESPACE


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, {quote(f'^{WHITESPACE}+|{WHITESPACE}+$')}, '', 'g')"


def sentences(expr: str) -> str:
    """List of sentences of a text expression."""
    out = f"(' ' || {expr} || '  ')"
    for kind, what, replacement in SENTENCE_RULES:
        call = "replace" if kind == "literal" else "regexp_replace"
        flags = "" if kind == "literal" else ", 'g'"
        out = f"{call}({out}, {quote(what)}, {quote(replacement)}{flags})"
    pieces = f"string_split(regexp_replace({out}, {quote(WHITESPACE + '+')}, ' ', 'g'), '<stop>')"
    return f"list_transform(({pieces})[:-2], lambda s: trim(s))"


def words(expr: str) -> str:
    """List of normalised, pre-tokenised words."""
    out = f"regexp_replace({expr}, {quote(DROPPED)}, '', 'g')"
    out = f"regexp_replace({out}, {quote(WHITESPACE)}, ' ', 'g')"
    out = f"regexp_replace({out}, {quote('(' + IDEOGRAPHS + ')')}, ' \\1 ', 'g')"
    out = f"lower(strip_accents({out}))"
    out = f"regexp_replace({out}, {quote('(' + PUNCTUATION + ')')}, ' \\1 ', 'g')"
    return f"list_filter(string_split({out}, ' '), lambda w: w <> '')"


def draw(parts: str, slot: str) -> str:
    """Eight hexadecimal digits of a SHA-256 digest over ``:``-joined parts."""
    return f"substr(sha256(concat_ws(':', {parts})), ({slot}) * 8 + 1, 8)"


def position_draw(seed: str, key: str, position: str) -> str:
    """Draw of a zero-based position: eight positions share a digest."""
    return draw(f"{quote(seed)}, {key}, ({position}) // 8", f"({position}) % 8")


def shuffle_rank(seed: str, key: str) -> str:
    return f"row_number() over (order by md5(concat_ws(':', {quote(seed)}, {key})), {key}) - 1"
