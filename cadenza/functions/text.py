"""Text predicates and clean-up that the dialogue tables need, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"\s​‌‍⁠﻿­"  # white space and invisible characters
_QUOTE = "\"'“”‘’„«»`"


def strip(x: Column) -> Column:
    """Without outer white space of any script (tabs, line ends and U+00A0 included). NULL stays NULL."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def norm(x: Column) -> Column:
    return F.lower(strip(x))


def is_silence(x: Column) -> Column:
    """`Silent` in any letter case, with or without outer white space, quotes or one final full stop, and
    `<|silent|>`. NULL for NULL."""
    around = f"[{_SPACE}{_QUOTE}]*"
    return x.rlike(rf"(?iU)^{around}silent{around}[.。]?{around}$|^[{_SPACE}]*<\|silent\|>[{_SPACE}]*$")


def is_blank(x: Column) -> Column:
    """Nothing but white space or invisible characters. NULL for NULL."""
    return x.rlike(rf"(?U)^[{_SPACE}]*$")
