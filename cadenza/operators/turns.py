"""Turns and frames of nested conversations. A session is one row; nothing here shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.once import computed
from cadenza.functions.silence import aligned_text, is_placeholder

__all__ = ["aligned_frames", "computed", "first_instruction", "last_assistant", "question", "stream_frames", "turns"]


def turns(df: DataFrame, *keys: str) -> DataFrame:
    """One row per turn: keys, pos (from 0) and the fields of the turn, `from` as role. NULL conversations give none."""
    e = df.select(*keys, F.posexplode("conversations").alias("pos", "turn"))
    names = [f.name for f in e.schema["turn"].dataType.fields]
    return e.select(*keys, "pos", *[F.col(f"turn.`{n}`").alias("role" if n == "from" else n) for n in names])


def question(conv: str = "conversations") -> Column:
    """Value of the first user turn, of any kind; NULL if there is none."""
    return F.expr(f"try_element_at(filter({conv}, c -> c.from = 'user'), 1).value")


def first_instruction(conv: str = "conversations") -> Column:
    """Value of the first user turn that is not a video placeholder."""
    return F.expr(f"try_element_at(filter({conv}, c -> c.from = 'user' and c.value is distinct from '<video>'), 1).value")


def last_assistant(conv: str = "conversations") -> Column:
    """The last assistant turn, or NULL."""
    return F.expr(f"try_element_at(filter({conv}, c -> c.from = 'assistant'), -1)")


def stream_frames(placeholders: tuple[str, ...]) -> Column:
    """Frames of the judged stages: ARRAY<STRUCT<i, ts, gt, pred, gt_silent, pred_silent>>, i from 0 among assistant turns."""
    kept = F.filter("conversations", lambda c: c["from"] == "assistant")
    return F.transform(kept, lambda c, i: F.struct(
        i.alias("i"), c["timestamp"].alias("ts"), c["value"].alias("gt"), F.coalesce(c["pred"], F.lit("")).alias("pred"),
        is_placeholder(c["value"], placeholders).alias("gt_silent"), is_placeholder(c["pred"], placeholders).alias("pred_silent")))


def aligned_frames() -> Column:
    """Frames of the alignment stage in order of time: ARRAY<STRUCT<ts, ord, gen, ref>>; turns without pred or time are left out.

    Silent texts are empty. `ord` counts the assistant turns of the row, from 0, and breaks ties of time.
    """
    kept = F.filter("conversations", lambda c: c["from"] == "assistant")
    shaped = F.transform(kept, lambda c, i: F.struct(
        c["timestamp"].alias("ts"), i.alias("ord"), aligned_text(c["pred"]).alias("gen"),
        F.coalesce(aligned_text(c["value"]), F.lit("")).alias("ref")))
    return F.array_sort(F.filter(shaped, lambda f: f["gen"].isNotNull() & f["ts"].isNotNull()))
