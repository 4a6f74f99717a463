"""Texts read as times."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeframe.functions.words import DATE_FORMATS

# What each letter run of a date format may stand for.
_SHAPES = {
    "yyyy": r"\d{4}", "MMMM": "[A-Za-z]{3,9}", "MMM": "[A-Za-z]{3}", "MM": r"\d{2}", "dd": r"\d{2}", "d": r"\d{1,2}", "HH": r"\d{2}", "mm": r"\d{2}", "ss": r"\d{2}",
}


def shape_of(fmt: str) -> str:
    """A pattern that every text of a date format matches."""
    out = ""
    for quoted, run, other in _pieces(fmt):
        out += re.escape(quoted) if quoted else _SHAPES[run] if run else re.escape(other)
    return f"^{out}$"


def _pieces(fmt: str) -> list[tuple[str, str, str]]:
    """(quoted text, letter run, other character) of a format, one of them filled each time."""
    return [
        (m.group(1) or "", m.group(2) or "", m.group(4) or "") for m in re.finditer(r"'([^']*)'|(([A-Za-z])\3*)|(.)", fmt)
    ]


def parsed_time(text: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """The first format that fits. A format is tried only on texts of its shape, as a failed parse is dear."""
    text = F.trim(text)
    return F.coalesce(*[F.when(text.rlike(shape_of(f)), F.try_to_timestamp(text, F.lit(f))) for f in formats])
