"""Text cleaning as columns.

Python and Java regexes disagree on what is a blank or a word character; ``(?U)``
switches Java to Unicode and the four separators U+001C..U+001F are added.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns, replacement tokens and limits that results depend on.
TAG = r"<[^>]+>"
ENTITY = r"&\w+;"
URL = r"http\S+|www\.\S+"
EMAIL = r"\S+@\S+"
BLANKS = r"\s+"
NOT_PLAIN_TEXT = r"[^a-zA-Z0-9\s\.\,\!\?\;\:\-\'\"]"
NOT_ALPHANUMERIC = r"[^a-zA-Z0-9\s]"
URL_TOKEN, EMAIL_TOKEN = "[URL]", "[EMAIL]"
MIN_WORDS = 3
MAX_WORDS = 512

MODES = ("replace", "remove", "keep")
_BLANK = r"[\s\x1c-\x1f]"
_SOLID = r"[^\s\x1c-\x1f]"


def _unicode(pattern: str) -> str:
    """The pattern with Unicode classes; blanks as Python sees them."""
    return "(?U)" + pattern.replace(r"\s", _BLANK).replace(r"\S", _SOLID)


# Characters that NFKC leaves as they are, whatever stands around them: no marks, no second half of a composition, no
# compatibility forms.  Not all of them, but those of common scripts, punctuation and symbols.
STABLE = (
    (0x00, 0x9F), (0xA1, 0xA7), (0xA9, 0xA9), (0xAB, 0xAE), (0xB0, 0xB1), (0xB6, 0xB7), (0xBB, 0xBB), (0xBF, 0x131),
    (0x134, 0x13E), (0x141, 0x148), (0x14A, 0x17E), (0x180, 0x1C3), (0x388, 0x38A), (0x38E, 0x3A1), (0x3A3, 0x3CF),
    (0x400, 0x482), (0x48A, 0x52F), (0x1E00, 0x1E99), (0x2010, 0x2010), (0x2012, 0x2016), (0x2018, 0x2023),
    (0x2030, 0x2032), (0x2039, 0x203A), (0x20AC, 0x20AC), (0x2190, 0x21FF), (0x2500, 0x27BF), (0x3001, 0x3029),
    (0x3041, 0x3096), (0x30A1, 0x30FA), (0x30FC, 0x30FE), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0x1F300, 0x1F64F),
)
# Most characters are ASCII and pass at the first look.
_UNSTABLE = r"(?![\x00-\x7F])[^" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in STABLE) + "]"
_SLICE = 256


@F.arrow_udf(T.StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    parts = [pa.array([], pa.string())]
    # A few texts at a time: a batch is never whole in Python strings.
    for at in range(0, len(texts), _SLICE):
        some = texts.slice(at, _SLICE).to_pylist()
        parts.append(pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in some], pa.string()))
    return pa.concat_arrays(parts)


def normalize(text: Column) -> Column:
    """NFKC form.

    A text of ``STABLE`` characters alone is its own normal form, so only other
    texts cross to Python; the others are sent as nulls and keep their value.
    """
    foreign = F.when(text.rlike(_UNSTABLE), text)
    return F.coalesce(_nfkc(foreign), text)


def strip_markup(text: Column) -> Column:
    """Remove tags and named entities, leaving nothing in their place."""
    untagged = F.regexp_replace(text, r"<[^>]++>", "")
    return F.regexp_replace(untagged, _unicode(ENTITY), "")


def _swap(text: Column, pattern: str, token: str, mode: str) -> Column:
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    if mode == "keep":
        return text
    return F.regexp_replace(text, pattern, token if mode == "replace" else "")


def mark_urls(text: Column, mode: str = "replace") -> Column:
    return _swap(text, _unicode(URL), URL_TOKEN, mode)


def mark_emails(text: Column, mode: str = "replace") -> Column:
    """A match always starts where a run of solid characters starts.

    Saying so keeps a long run without an ``@`` linear instead of quadratic.
    """
    return _swap(text, _unicode(r"(?<!\S)" + EMAIL), EMAIL_TOKEN, mode)


def collapse_blanks(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _unicode(BLANKS), " "))


def keep_plain(text: Column, punctuation: bool = True) -> Column:
    """Only ASCII letters, digits and blanks, with or without common punctuation."""
    pattern = NOT_PLAIN_TEXT if punctuation else NOT_ALPHANUMERIC
    return F.regexp_replace(text, "(?U)" + pattern.replace(r"\s", r"\s\x1c-\x1f"), "")


# The steps below name their input once: Catalyst copies a repeated expression,
# and the whole regex chain behind it would run again for every copy.


def word_count(collapsed: Column) -> Column:
    """Words of a blank-collapsed text; an empty text has none."""
    return F.size(F.array_remove(F.split(collapsed, " "), ""))


def raw_word_count(text: Column) -> Column:
    return word_count(collapse_blanks(F.coalesce(text, F.lit(""))))


def require_words(collapsed: Column, least: int = MIN_WORDS) -> Column:
    """Empty when there are fewer than ``least`` words."""
    if least < 2:
        return collapsed
    return F.regexp_replace(collapsed, r"\A[^ ]*(?: [^ ]+){0,%d}\z" % (least - 2), "")


def present(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def clean(text: Column, least: int = MIN_WORDS, urls: str = "replace", emails: str = "replace") -> Column:
    """All steps in order: null, normal form, markup, links, blanks, length."""
    normal = normalize(present(text))
    linked = mark_emails(mark_urls(strip_markup(normal), urls), emails)
    return require_words(collapse_blanks(linked), least)


def clean_joint(text: Column, least: int = MIN_WORDS, replace_urls: bool = True, replace_emails: bool = True) -> Column:
    """Two flags that act as one: either replaces both kinds, neither removes both."""
    mode = "replace" if replace_urls or replace_emails else "remove"
    return clean(text, least, mode, mode)


def drop_invisible(text: Column) -> Column:
    """Remove format characters (zero-width, direction marks, soft hyphen)."""
    return F.regexp_replace(text, r"\p{Cf}", "")


def corrupt_count(text: Column) -> Column:
    """Replacement characters and control characters other than blanks."""
    return F.regexp_count(text, F.lit("[�\\x00-\\x08\\x0e-\\x1b\\x7f]"))


def is_corrupt(text: Column) -> Column:
    return corrupt_count(text) > 0


def is_long(collapsed: Column, most: int = MAX_WORDS) -> Column:
    return word_count(collapsed) > most


def first_words(collapsed: Column, most: int = MAX_WORDS) -> Column:
    """Opt-in cut of an over-long text to its first words."""
    return F.array_join(F.slice(F.split(collapsed, " "), 1, most), " ")


def special_share(text: Column) -> Column:
    """Share of characters that are neither letters, digits nor blanks; 0 for an empty text."""
    special = F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\p{M}\p{Z}\x09-\x0d]"))
    return F.when(F.length(text) > 0, special / F.length(text)).otherwise(0.0)
