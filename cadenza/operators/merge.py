"""Merging a session's samples, and choosing files and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.paths import interval_pair, stem
from cadenza.operators.turns import first_instruction


def merged_turns(samples: DataFrame, key: str, order: str, said: str = "pred") -> DataFrame:
    """Each sample's last assistant turn that has a `said`, placed in its session: key, start, end (of its last clip),
    sample order, timestamp (the endpoint where the turn has none), text, sample_type, and the session's question.

    (start, end, order) sorts a session; samples without clips come first. The question is the first instruction of the
    session's first sample by `order`; later ones are lost. Turns stay rows, so a long session is no single row.
    """
    t = samples.withColumn("turn", F.expr(f"try_element_at(filter(conversations, c -> c.from = 'assistant' and c.{said} is not null), -1)")).where("turn is not null")
    pair = interval_pair(F.coalesce(F.try_element_at("videos", F.lit(-1)), F.lit("")))
    asked = samples.groupBy(F.col(key).alias("_k")).agg(F.min_by(first_instruction(), F.col(order)).alias("question"))
    return (t.select(key, pair.alias("p"), F.col(order), F.coalesce("turn.timestamp", "endpoint_timestamp").cast("double").alias("timestamp"),
                     F.col(f"turn.{said}").alias("text"), F.col("turn.value").alias("value"), "sample_type")
            .join(asked, F.col(key) == F.col("_k"), "left")
            .select(key, F.col("p.start").alias("start"), F.col("p.end").alias("end"), order, "timestamp", "text", *(["value"] if said != "value" else []), "sample_type", "question"))


def in_subset(df: DataFrame, subset: DataFrame, key: str, by: str = "line") -> DataFrame:
    """Rows whose key is in the list (column `line`, trimmed, blanks dropped).

    `by` says what of a line is compared: `line` the whole relative path, `file` its last part with extension, `name` that
    without extension. Keys are taken as they are, so a caller passes a file name where it asks for one.
    """
    line = F.trim("line")
    part = {"line": line, "file": F.substring_index(line, "/", -1), "name": stem(line)}[by]
    lines = subset.where(F.length(line) > 0).select(part.alias(key)).distinct()
    return df.join(lines, key, "left_semi")


def domains(df: DataFrame, subset: DataFrame, file: str, name: str = "domain") -> DataFrame:
    """Adds the domain of a row: the first part of the list's line that ends in the row's file name; `unknown` where that line has
    no folder, NULL where there is no line. Of several lines the last in order of text counts."""
    line = F.trim("line")
    known = (subset.where(F.length(line) > 0).select(F.substring_index(line, "/", -1).alias(file), F.struct(line.alias("l"), F.when(F.instr(line, "/") > 0, F.split(line, "/")[0]).otherwise("unknown").alias("d")).alias("x"))
             .groupBy(file).agg(F.max("x")["d"].alias(name)))
    return df.join(known, file, "left")


def conversations(merged: DataFrame, key: str, order: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """The turns of `merged_turns` as one conversation per key: the question (if there is one), then the assistant turns in order of
    (start, end, order), with value, timestamp, pred and sample_type. A session is bounded by its video's length."""
    turn = F.struct(F.lit("assistant").alias("from"), F.col("value"), "timestamp", F.col("text").alias("pred"), "sample_type")
    per = merged.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", order, turn.alias("turn")))).alias("t"), F.first("question", True).alias("question"), *[F.first(c, True).alias(c) for c in carry])
    ask = F.struct(F.lit("user").alias("from"), F.col("question").alias("value"), F.lit(None).cast("double").alias("timestamp"), F.lit(None).cast("string").alias("pred"), F.lit(None).cast("int").alias("sample_type"))
    said = F.transform("t", lambda x: x["turn"])
    return per.select(key, *carry, F.when(F.col("question").isNull(), said).otherwise(F.concat(F.array(ask), said)).alias("conversations"))


def not_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key no finished output has."""
    return df.join(done.select(key), key, "left_anti")


def first_containing(left: DataFrame, key: str, right: DataFrame, name: str, order: str, value: str) -> DataFrame:
    """left with `value` of the first right row (by `order`) whose name is in the key or has the key in it; NULL if none.

    Names and keys that are equal are found by an equi-join. Containment of different texts has no equi-key: each text
    is cut into its substrings of the lengths that occur on the other side, and those are joined. An empty or NULL name is
    in every key: its first row is a single candidate for all. Of one name the last row's value stands at the first place.
    """
    names = right.select(F.coalesce(name, F.lit("")).alias("n"), F.col(order).alias("o"), F.col(value).alias("v")).groupBy("n").agg(
        F.min("o").alias("o"), F.max_by("v", "o").alias("v"))
    keys = left.select(F.col(key).alias("k")).where("k is not null").distinct()
    # substrings of a by the other side's lengths; the set of lengths is small and bounded by the longest text
    cuts = lambda text, lens: F.expr(f"array_distinct(flatten(transform(filter({lens}, l -> l > 0 and l <= length({text})), l -> transform(sequence(1, length({text}) - l + 1), s -> substring({text}, s, l)))))")
    n_len = names.agg(F.array_sort(F.collect_set(F.length("n"))).alias("lens"))
    k_len = keys.agg(F.array_sort(F.collect_set(F.length("k"))).alias("lens"))
    k_lens, n_lens = k_len.scalar(), n_len.scalar()
    a = keys.withColumn("lens", n_lens).select("k", F.explode(cuts("k", "lens")).alias("n")).join(names, "n").select("k", "o", "v")
    b = names.withColumn("lens", k_lens).select("o", "v", F.explode(cuts("n", "lens")).alias("k")).join(keys, "k").select("k", "o", "v")
    hit = a.unionByName(b).groupBy("k").agg(F.min(F.struct("o", "v")).alias("h"))
    anywhere = names.where("n = ''").select(F.struct("o", "v").alias("e"))
    out = left.join(hit, left[key] == hit["k"], "left").drop("k").withColumn("e", anywhere.scalar())
    best = F.when(F.col(key).isNotNull(), F.least("h", "e"))
    return out.withColumn(value, best["v"]).drop("h", "e")
