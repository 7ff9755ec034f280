"""Writing results. Every write goes through Spark's commit protocol, so a path has all of a result or none."""

from __future__ import annotations

import logging
import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

log = logging.getLogger("cadenza")


def write_json_by_key(df: DataFrame, path: str, key: str, mode: str = "overwrite", spread: str | None = None) -> None:
    """One folder per key with its rows as JSON. Rows of a key lie together, so a key is few files; with `spread`, a column of whole
    numbers, a key's rows are spread over tasks by its thousands, so that a key of any size is no single task."""
    d = df.repartition(F.col(key)) if spread is None else df.repartition(F.col(key), F.floor(F.coalesce(F.col(spread), F.lit(0)) / 1000))
    _whole(df, path, mode, lambda target: d.write.mode("overwrite" if mode == "overwrite" else mode).partitionBy(key).json(target))


def _whole(df: DataFrame, path: str, mode: str, write) -> None:
    """Overwrite a path by writing beside it and renaming, so that the old result stays until the new one is there."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if mode != "overwrite" or not fs.exists(at):
        write(path)
        return
    fresh, old = hadoop.Path(f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"), hadoop.Path(f"{path.rstrip('/')}.old-{uuid.uuid4().hex}")
    write(fresh.toString())
    if not (fs.rename(at, old) and fs.rename(fresh, at)):
        raise OSError(f"{path} could not be replaced; the new result is in {fresh.toString()}")
    fs.delete(old, True)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    _whole(df, path, mode, lambda target: df.write.mode(mode).json(target))


def write_table(df: DataFrame, name: str) -> None:
    """Replace a table of this name."""
    df.write.mode("overwrite").saveAsTable(name)


def numbers_to_one_decimal(df: DataFrame) -> DataFrame:
    return df.select(*[F.rint(F.col(f.name) * 10).__truediv__(10).alias(f.name) if f.dataType.simpleString() in ("double", "float") else F.col(f.name) for f in df.schema])


def append_summary(old: DataFrame | None, new: DataFrame, path: str) -> None:
    """Old and new summary rows in one CSV; columns that one side lacks are NULL there, numbers have one decimal.

    `path` must not be where `old` is read from.
    """
    both = numbers_to_one_decimal(new)
    if old is not None:
        text = lambda d: d.select(*[F.col(c).cast("string").alias(c) for c in d.columns])
        both = text(old).unionByName(text(both), allowMissingColumns=True)
    both.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_samples(samples: DataFrame, path: str, key: str = "video_id", all_keys: DataFrame | None = None) -> None:
    """Validated samples below their key's folder. With `all_keys` (key), `path`/_kept has the number of samples of each, 0 for one
    whose samples were all dropped and which therefore has no folder."""
    write_json_by_key(samples, path, key, spread="endpoint_timestamp" if "endpoint_timestamp" in samples.columns else None)
    if all_keys is not None:
        n = samples.groupBy(key).agg(F.count(F.lit(1)).alias("n_samples"))
        all_keys.select(key).distinct().join(n, key, "left").fillna(0, ["n_samples"]).write.mode("overwrite").json(f"{path}/_kept")


def match_info(match: DataFrame, frames: DataFrame, key: str) -> DataFrame:
    """Match tables as stored by the alignment stage, one row per key: matched ([gen, ref] pairs), missed, redundant, match_costs
    and semantic_scores."""
    f = frames.select(key, "seg", "pos", F.struct("gen", "ref", F.col("ts").alias("frame_idx_in_stream"), F.col("ts").alias("timestamp_in_stream")).alias("frame"))
    m = (match.join(f.select(key, "seg", F.col("pos").alias("i"), F.col("frame").alias("g")), [key, "seg", "i"], "left")
         .join(f.select(key, "seg", F.col("pos").alias("j"), F.col("frame").alias("r")), [key, "seg", "j"], "left"))
    rows = lambda kind, x: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("seg", "i", "j", x.alias("x")))))
    of = lambda name: F.transform(name, lambda y: y["x"])
    got = m.groupBy(key).agg(rows("matched", F.struct(F.array("g", "r").alias("pair"), "cost", "score")).alias("a"), rows("missed", F.col("r")).alias("b"), rows("redundant", F.col("g")).alias("c"))
    return got.select(key, F.transform("a", lambda y: y["x"]["pair"]).alias("matched"), of("b").alias("missed"), of("c").alias("redundant"),
                      F.transform("a", lambda y: y["x"]["cost"]).alias("match_costs"), F.transform("a", lambda y: y["x"]["score"]).alias("semantic_scores"))


def metrics_summary(macro: DataFrame, *by: str) -> DataFrame:
    """The averaged measures as nested fields: soft, hard and video_info."""
    pick = lambda **names: F.struct(*[F.col(v).alias(k) for k, v in names.items()])
    return macro.select(*by, pick(avg_soft_precision="avg_soft_precision", avg_soft_recall="avg_soft_recall", avg_soft_f1="avg_soft_f1").alias("soft"),
                        pick(avg_precision="avg_hard_precision", avg_recall="avg_hard_recall", avg_F1="avg_hard_f1").alias("hard"), pick(num_videos="n_keys").alias("video_info"))


def unfinished(keys: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Keys without a finished output (a readable row with conversations)."""
    return keys.join(done.where("conversations is not null").select(key), key, "left_anti")


def log_counts(df: DataFrame, what: str) -> tuple[DataFrame, Observation]:
    """The table with a counter on it: when an action has run through it, `report` logs the rows. No job of its own."""
    seen = Observation(what)
    return df.observe(seen, F.count(F.lit(1)).alias("n")), seen


def report(seen: Observation, what: str) -> int:
    n = seen.get["n"]
    log.info("%s: %d rows", what, n)
    return n
