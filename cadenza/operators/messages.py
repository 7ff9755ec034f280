"""From turns to the messages of a model request."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PART = "struct<kind: string, text: string>"
MESSAGE = f"struct<role: string, parts: array<{PART}>>"


def system_prompt(conv: str) -> Column:
    """The last system turn, or empty."""
    return F.expr(f"coalesce(try_element_at(filter({conv}, c -> c.from = 'system'), -1).value, '')")


def parts(conv: str, videos: str, last: int) -> Column:
    """Turns other than system as ARRAY<STRUCT<role, parts>>, video turns with their clip.

    Video turn n goes with the n-th of `videos`; of the clips that have a turn, only the last `last` stay; surplus video
    turns are left out.
    """
    skip = f"greatest(0, least(size(filter({conv}, c -> c.from = 'user' and c.value = '<video>')), size({videos})) - {last})"
    numbered = f"""aggregate({conv}, named_struct('n', 0, 'out', cast(array() as array<struct<role: string, kind: string, text: string>>)), (acc, c) ->
        if(c.from = 'user' and c.value = '<video>',
           named_struct('n', acc.n + 1, 'out', if(acc.n < size({videos}) and acc.n >= {skip}, array_append(acc.out, named_struct('role', 'user', 'kind', 'video', 'text', {videos}[acc.n])), acc.out)),
           named_struct('n', acc.n, 'out', if(c.from in ('user', 'assistant'), array_append(acc.out, named_struct('role', c.from, 'kind', 'text', 'text', c.value)), acc.out))),
        acc -> acc.out)"""
    return F.expr(f"transform({numbered}, x -> named_struct('role', x.role, 'parts', array(named_struct('kind', x.kind, 'text', x.text))))")


def merged(messages: str) -> Column:
    """Adjacent user messages become one, their parts in order; assistant messages stay apart."""
    return F.expr(f"""aggregate({messages}, cast(array() as array<{MESSAGE}>), (acc, m) ->
        if(size(acc) > 0 and m.role = 'user' and acc[size(acc) - 1].role = 'user',
           concat(slice(acc, 1, size(acc) - 1), array(named_struct('role', 'user', 'parts', concat(acc[size(acc) - 1].parts, m.parts)))),
           array_append(acc, m)))""")


def instruction(window: int) -> str:
    """A system prompt for a model that watches the last `window` seconds."""
    return (f"You watch a live video of somebody at work and see its last {window} seconds. Say the next step when it is due, confirm what is "
            "right and correct what is wrong, briefly. At all other times answer with the one word Silent.")


def judge_prompt(question: Column, response: Column, answer: Column) -> Column:
    """The text that asks a judge for a score; inputs are joined, never substituted, so they may hold any text."""
    return F.concat(
        F.lit("Rate from 0 to 5 how well the given answer does what the right answer does. Reply as JSON with the keys explanation and score.\nQuestion: "),
        F.coalesce(question, F.lit("")), F.lit("\nGiven answer: "), F.coalesce(response, F.lit("")), F.lit("\nRight answer: "), F.coalesce(answer, F.lit("")), F.lit("\n"))
