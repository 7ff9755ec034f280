"""The four tests by which stages tell a silent turn from a talking one. They differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that the two judged stages take for silence, after strip and lower case.
PLACEHOLDERS_STREAM = (
    "", "silent", "<no_information>", "<silent>", "<|silent|>", "silent.",
    "alright, i'll send you a reminder then.",
    "got it, i'll let you know at that moment.",
    "got it, i'll let you know.",
    "understood, i will remind you when the time comes.",
    "收到，我会留意的。",
    "没问题，到时候提醒你。",
    "好的，到时候我会提醒你。",
    "没问题，到时候我会告诉你。",
    "no problem, i'll remind you then.",
    "okay, i will alert you when it happens.",
    "i will make sure to remind you at that time.",
    "好的，那到时候我会提醒你。",
    "好的，到时候我会发提醒给你。",
    "sure, i will let you know at that time.",
    "noted, expect a reminder from me then.",
    "ok, i will remind you then.",
    "certainly, i will provide the reminder then.",
    "ok", "okay", "sure", "yes", "收到", "好的", "明白了", "got it, i will notify you at that moment.",
)
PLACEHOLDERS_MATCHED = tuple(x for x in PLACEHOLDERS_STREAM if x not in ("<|silent|>", "silent."))

_OUTER = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def strip(x: Column) -> Column:
    """Without outer white space of any kind; NULL stays NULL."""
    return F.regexp_replace(x, _OUTER, "")


def aligned_text(x: Column) -> Column:
    """Alignment's text: empty for `silent` and `<|silent|>` after strip and lower case, else the raw text."""
    return F.when(F.lower(strip(x)).isin("silent", "<|silent|>"), F.lit("")).otherwise(x)


def is_silent_aligned(x: Column) -> Column:
    """Silent for alignment: only the two words, or the empty text. White space alone talks."""
    return aligned_text(x) == ""


def is_placeholder(x: Column, placeholders: tuple[str, ...] = PLACEHOLDERS_STREAM) -> Column:
    """Silent for judging: NULL, or one of the placeholders after strip and lower case."""
    return F.coalesce(F.lower(strip(x)).isin(*placeholders), F.lit(True))


def is_silent_reply(x: Column) -> Column:
    """Silent for replay history: NULL, or `silent` without quotes, end marks and outer white space."""
    quoted = F.regexp_replace(F.regexp_replace(strip(x), r'^"+|"+$', ""), r"^'+|'+$", "")
    bare = strip(F.regexp_replace(strip(quoted), r"[.!。！ ]+$", ""))
    return F.coalesce(F.lower(bare) == "silent", F.lit(True))
