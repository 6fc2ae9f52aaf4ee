"""Text expressions: strip, sentence split, normalise, pre-tokenise, path names."""

from __future__ import annotations

import string
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.arrays import let

# The characters Python's str.strip and \s treat as white space.
WHITESPACE = (
    r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
# The same set in the form Java's matcher tests fastest.
SPACE = r"(?U:[\s\x{1c}-\x{1f}])"

# Markers, word lists and the order of the sentence-splitting rules.
# ("regex" | "literal", what, replacement); \1.. are group references.
KEEP, BREAK = "<prd>", "<stop>"
TITLES = r"(Mr|St|Mrs|Ms|Dr)[.]"
SUFFIXES = r"(Inc|Ltd|Jr|Sr|Co)"
STARTERS = (
    r"(Mr|Mrs|Ms|Dr|He\s|She\s|It\s|They\s|Their\s|Our\s|We\s|But\s|However\s|That\s|This\s|Wherever)"
).replace(r"\s", WHITESPACE)
ACRONYMS = r"([A-Z][.][A-Z][.](?:[A-Z][.])?)"
WEBSITES = r"[.](com|net|org|io|gov)"
SENTENCE_RULES = [
    ("literal", "\n", " "),
    ("regex", r"([0-9])[.]([0-9])", r"\1<prd>\2"),
    ("regex", r"([0-9])[.] ([0-9])", r"\1<prd>\2"),
    ("regex", TITLES, r"\1<prd>"),
    ("regex", WEBSITES, r"<prd>\1"),
    ("literal", "Ph.D.", "Ph<prd>D<prd>"),
    ("literal", "e.g.", "e<prd>g<prd>"),
    ("literal", "e. g.", "e<prd>g<prd>"),
    ("literal", "i.e.", "i<prd>e<prd>"),
    ("literal", "i. e.", "i<prd>e<prd>"),
    ("literal", "et. al.", "et<prd>al<prd>"),
    ("literal", "Fig. ", "Fig.<prd>"),
    ("regex", WHITESPACE + r"([A-Za-z])[.] ", r" \1<prd> "),
    ("regex", ACRONYMS + " " + STARTERS, r"\1<stop> \2"),
    ("regex", r"([A-Za-z])[.]([A-Za-z])[.]([A-Za-z])[.]", r"\1<prd>\2<prd>\3<prd>"),
    ("regex", r"([A-Za-z])[.]([A-Za-z])[.]", r"\1<prd>\2<prd>"),
    ("regex", " " + SUFFIXES + "[.] " + STARTERS, r" \1<stop> \2"),
    ("regex", " " + SUFFIXES + "[.]", r" \1<prd>"),
    ("regex", r" ([A-Za-z])[.]", r" \1<prd>"),
    ("literal", ".”", "”."),
    ("literal", '."', '".'),
    ("literal", '!"', '"!'),
    ("literal", '?"', '"?'),
    ("literal", ".", ".<stop>"),
    ("literal", "?", "?<stop>"),
    ("literal", "!", "!<stop>"),
    ("literal", "<prd>", "."),
]
FIGURE_RULE = ("literal", "Fig. ", "Fig.<prd>")
FIGURE_FIXED = ("literal", "Fig. ", "Fig<prd> ")

# Code point ranges that count as ideographs and get spaces around them.
IDEOGRAPHS = (
    r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{20000}-\x{2a6df}\x{2a700}-\x{2b73f}"
    r"\x{2b740}-\x{2b81f}\x{2b820}-\x{2ceaf}\x{f900}-\x{faff}\x{2f800}-\x{2fa1f}]"
)
# Characters dropped by text cleaning, and the punctuation that stands alone.
DROPPED = r"[\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{7f}-\x{9f}\x{fffd}\p{Cf}\p{Co}]"
PUNCTUATION = r"[!-/:-@\[-`{-~\p{P}]"
# A run of anything but spaces and punctuation.
WORD = r"[^ !-/:-@\[-`{-~\p{P}]+"


def _replace(text: Column, pattern: str, replacement: str) -> Column:
    """``regexp_replace`` with ``\\1`` group references and the fast white-space form."""
    groups = replacement.replace("$", r"\$").replace("\\1", "$1").replace("\\2", "$2").replace("\\3", "$3")
    return F.regexp_replace(text, pattern.replace(WHITESPACE, SPACE), groups)


def strip(text: Column) -> Column:
    """Trim all Unicode white space, as Python's ``str.strip`` does."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def sentences(text: Column, compat: bool = True) -> Column:
    """Split into sentences; text after the last terminator is dropped.

    ``compat=False`` keeps ``Fig. 2`` in one piece.
    """
    out = F.concat(F.lit(" "), text, F.lit("  "))
    for rule in SENTENCE_RULES:
        kind, what, replacement = FIGURE_FIXED if rule == FIGURE_RULE and not compat else rule
        if kind == "literal":
            out = F.replace(out, F.lit(what), F.lit(replacement))
        else:
            out = _replace(out, what, replacement)
    pieces = F.split(F.regexp_replace(out, f"{SPACE}+", " "), BREAK)
    return let(pieces, lambda p: F.transform(F.slice(p, 1, F.size(p) - 1), lambda s: F.trim(s)))


def sentence_rows(df: DataFrame, keys: list[str], text: str = "text", compat: bool = True) -> DataFrame:
    """One row per sentence: keys, ``sent_idx``, ``sentence``. The outer explode keeps the optimizer
    from splitting the text again for a size filter."""
    exploded = F.posexplode_outer(sentences(F.col(text), compat)).alias("sent_idx", "sentence")
    return df.select(*keys, exploded).filter(F.col("sent_idx").isNotNull())


# Last code point of the range that one character table normalises alone.
LATIN_END = 0x2FF


@lru_cache(maxsize=None)
def character_table(last: int, accents: bool = True) -> tuple[str, str]:
    """(from, to) for ``translate`` up to code point ``last``, built from Unicode data.

    A letter whose canonical decomposition is one base character plus combining marks becomes that
    base. Up to ``LATIN_END`` the table also turns white space into spaces and, standing at the
    end of ``from`` without a partner, drops control characters.
    """
    source, target, dropped = [], [], []
    for point in range(last + 1):
        char = chr(point)
        if 0xAC00 <= point <= 0xD7A3 or 0xD800 <= point <= 0xDFFF:
            continue
        plain = char
        if unicodedata.decomposition(char):
            plain = "".join(c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn")
        if last == LATIN_END and char != " " and (char in "\t\n\r" or unicodedata.category(char) == "Zs"):
            source.append(char)
            target.append(" ")
        elif last == LATIN_END and unicodedata.category(char) in ("Cc", "Cf"):
            dropped.append(char)
        elif accents and plain != char and len(plain) == 1:
            source.append(char)
            target.append(plain)
    return "".join(source + dropped), "".join(target)


def _hangul_parts(text: Column) -> Column:
    """Canonical decomposition of Hangul syllables, by the Unicode arithmetic rule."""

    def part(code: Column) -> Column:
        return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")

    def one(char: Column) -> Column:
        code = F.conv(F.hex(F.encode(char, "UTF-16BE")), 16, 10).cast("int")
        index = code - F.lit(0xAC00)
        tail = index % 28
        parts = F.concat(
            part(F.lit(0x1100) + F.floor(index / 588)),
            part(F.lit(0x1161) + F.floor((index % 588) / 28)),
            F.when(tail > 0, part(F.lit(0x11A7) + tail)).otherwise(F.lit("")),
        )
        return F.when((index >= 0) & (index < 11172), parts).otherwise(char)

    spelled = F.array_join(F.transform(F.split(text, ""), one), "")
    return F.when(text.rlike(r"[\x{ac00}-\x{d7a3}]"), spelled).otherwise(text)


def strip_accents(text: Column) -> Column:
    """Replace accented letters by their base letter and drop combining marks."""
    source, target = character_table(sys.maxunicode)
    return F.regexp_replace(F.translate(text, source, target), r"\p{Mn}+", "")


def beyond_latin(text: Column) -> Column:
    """Whether a text has characters after the Latin blocks."""
    return text.rlike(rf"[^\x{{0}}-\x{{{LATIN_END:x}}}]")


def normalise(text: Column, accents: bool = True, lowercase: bool = True, ideographs: bool = True) -> Column:
    """Clean control characters, space out ideographs, strip accents, lower the case.

    Texts within the Latin blocks need one pass over a character table; only others go through the
    full rules. Each step uses the one before once, so no text is worked through twice.
    """
    full = _hangul_parts(text) if accents else text
    full = F.regexp_replace(F.regexp_replace(full, DROPPED, ""), SPACE, " ")
    if ideographs:
        full = F.regexp_replace(full, f"({IDEOGRAPHS})", " $1 ")
    if accents:
        full = strip_accents(full)
    source, target = character_table(LATIN_END, accents)
    out = F.when(beyond_latin(text), full).otherwise(F.translate(text, source, target))
    return F.lower(out) if lowercase else out


def pre_tokens(text: Column) -> Column:
    """Words of normalised text: spaces separate, every punctuation mark stands alone."""
    return F.regexp_extract_all(text, F.lit(f"{PUNCTUATION}|{WORD}"), F.lit(0))


def words(text: Column) -> Column:
    """Normalise, then pre-tokenise."""
    return pre_tokens(normalise(text))


def spaced(text: Column) -> Column:
    """Text whose words ``token_words`` finds: one within the Latin blocks as it is, another as its words."""
    return F.when(beyond_latin(text), F.array_join(words(text), " ")).otherwise(text)


@lru_cache(maxsize=None)
def latin_words() -> dict[int, str]:
    """``words`` of the Latin blocks as a table for ``str.translate``: what each character becomes, punctuation between spaces."""
    source, target = character_table(LATIN_END)
    plain = dict(zip(source, target)) | dict.fromkeys(source[len(target) :], "")
    table = {}
    for point in range(LATIN_END + 1):
        char = plain.get(chr(point), chr(point)).lower()
        mark = char in string.punctuation or unicodedata.category(char).startswith("P") if char else False
        table[point] = f" {char} " if mark else char
    return table


def token_words(token: str) -> list[str]:
    """``words`` of a part between spaces of a ``spaced`` text."""
    return token.translate(latin_words()).split()


def characters(text: Column) -> Column:
    """Array of code points, in linear time."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def model_name(path: Column) -> Column:
    """Folder name of a model path up to its first dot; a trailing slash does not matter."""
    parts = F.split(F.regexp_replace(path, "/+$", ""), "/")
    return F.split_part(F.element_at(parts, -1), F.lit("."), F.lit(1))


def file_stem(path: Column) -> Column:
    """File name up to its first dot. Spark gives paths and names URL-encoded, a plus sign as itself."""
    name = F.url_decode(F.replace(F.element_at(F.split(path, "/"), -1), F.lit("+"), F.lit("%2B")))
    return F.split_part(name, F.lit("."), F.lit(1))
