"""The final report of a model: one row of numbers, rendered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summary(events: DataFrame, model: str) -> dict:
    """Name, rows, final score and a `percent%(mean)` text per category, as one dict (a handful of rows are collected)."""
    from cadenza.operators.metrics import distribution, final_score

    total = final_score(events).first()
    out = {"model_name": model, "#samples": total["n_events"], "final_score": total["final_score"]}
    for r in distribution(events).orderBy("category").collect():
        out[f"{r['category']}(all)"] = f"{round(r['percent'], 1)}%({round(r['mean_score'], 1)})"
    return out


def wide(distribution: DataFrame) -> DataFrame:
    """The long distribution as one row with a text column per category and subset."""
    cell = F.concat((F.rint(F.col("percent") * 10) / 10).cast("string"), F.lit("%("), (F.rint(F.col("mean_score") * 10) / 10).cast("string"), F.lit(")"))
    names = [f"{c}({s})" for s in ("all",) for c in ("CorrectSilent", "NoResponse", "FalseAlarm", "PartlyCorrect")]
    d = distribution.withColumn("name", F.concat("category", F.lit("("), "subset", F.lit(")"))).withColumn("cell", cell)
    return d.groupBy().pivot("name", names).agg(F.first("cell"))


def render(model: str, macro: dict | None, stream: dict | None, matched: dict | None, when: str = "") -> str:
    """The report's text: temporal alignment, then response behaviour. What is missing reads N/A."""
    num = lambda v, d: f"{v:.{d}f}" if isinstance(v, int | float) else "N/A"
    macro, stream, matched = macro or {}, stream or {}, matched or {}
    lines = [f"Results of {model}" + (f", {when}" if when else ""), "", "Temporal alignment"]
    for name in ("precision", "recall", "f1"):
        lines.append(f"  soft {name}: {num(macro.get(f'avg_soft_{name}'), 4)}")
    lines += [f"  score of matched pairs (0-100): {num(matched.get('final_score'), 1)}", "", "Response behaviour, percent (mean score)"]
    for name in ("CorrectSilent", "NoResponse", "FalseAlarm", "PartlyCorrect"):
        lines.append(f"  {name}: {stream.get(f'{name}(all)', 'N/A')}")
    lines.append(f"  score of the stream (0-100): {num(stream.get('final_score'), 1)}")
    return "\n".join(lines) + "\n"
