"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from formwright.functions.arrays import let, running_total
from formwright.vocabulary import PREVIEW_LENGTH, WHITESPACE

# `\b` follows Unicode letters on some Java releases and ASCII on others; spelled out it is the same
# everywhere: a place between a letter, digit or underscore and something else.
_WORD = r"[\p{L}\p{N}_]"
_BOUNDARY = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def java_pattern(pattern: str, first: str = "", ignore_case: bool = False) -> str:
    """The pattern with Unicode word boundaries, and Unicode case folding if asked for.

    A leading boundary is tried at every character of the text. `first`, the class of characters
    that a match can start with, is looked at before it and turns most places down at once.
    """
    body = pattern
    if first and body.startswith(r"\b"):
        body = f"(?={first})(?<!{_WORD})" + body[2:]
    if body.endswith(r"}\b"):
        body = body[:-2] + f"(?!{_WORD})"
    return ("(?iu)" if ignore_case else "") + body.replace(r"\b", _BOUNDARY)


def strip(value: Column) -> Column:
    """Remove all leading and trailing Unicode white space (`trim` removes blanks only)."""
    return F.btrim(value, F.lit(WHITESPACE))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D+", "")


def preview(value: Column, length: int = PREVIEW_LENGTH) -> Column:
    """The text itself, or its first characters and `...` if it is longer."""
    return F.when(
        F.length(value) > length, F.concat(F.substring(value, 1, length), F.lit("..."))
    ).otherwise(value)


def word_tokens(value: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(value), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


MARK = "\u0001"


def unmarked(text: Column) -> Column:
    """The text with the character that marks matches replaced by another control character."""
    return F.when(text.contains(MARK), F.translate(text, MARK, "\u0002")).otherwise(text)


def pieces(text: Column, pattern: str) -> Column:
    """The text cut at its matches: gap, match, gap, match, ..., gap.

    `text` is `unmarked`, and the pattern matches no control characters. Marking the matches and
    cutting at the marks takes one run of the pattern.
    """
    return F.split(marked(text, pattern), MARK, -1)


def marked(text: Column, pattern: str) -> Column:
    """The `unmarked` text with a mark before and after each match."""
    return F.regexp_replace(text, pattern, f"{MARK}$0{MARK}")


def piece_starts(cut: Column) -> Column:
    """Where each piece starts, in code points."""
    return running_total(F.transform(cut, F.length))
