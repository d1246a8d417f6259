"""Reading of fields that were cut out of a text: which characters they hold, how long they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = "0123456789"
HEX = DIGITS + "abcdefABCDEF"


def made_of(text: Column, characters: str) -> Column:
    """Whether a text is not empty and has only these characters; false for null."""
    return F.coalesce((text != "") & (F.translate(text, characters, "") == ""), F.lit(False))


def digits(text: Column, least: int = 1, most: int = 18) -> Column:
    """Whether a text is ``least`` to ``most`` decimal digits."""
    return made_of(text, DIGITS) & F.length(text).between(least, most)


def words(text: Column) -> Column:
    """The words of a line, without regard to how much white space is between them."""
    return F.filter(F.split(F.translate(text, "\t\r\n\f\x0b", "     "), " "), lambda w: w != "")


def first_word(text: Column) -> Column:
    """The first of a line's words; empty if it has none."""
    return F.substring_index(F.ltrim(F.translate(text, "\t\r\n\f\x0b", "     ")), " ", 1)


def after(text: Column, mark: str) -> Column:
    """What stands behind the first ``mark``; empty if there is none."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substring(text, at + len(mark), F.length(text))).otherwise("")


def before(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, 1)
