"""Reading annotations, predictions, manifests and lists. Schemas are given; nothing is inferred."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza import schema
from cadenza.functions.paths import basename, stem

VIDEO_TYPES = (".mp4", ".mkv", ".mov", ".avi", ".webm")


def read_json_documents(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """JSON files below a path, each an object or an array of objects, as rows; empty and unreadable files give none.

    Adds `file` (path of the file). Big trees are best converted to Parquet once.
    """
    df = (spark.read.schema(f"{ddl}, _corrupt_record STRING").option("multiLine", True).option("recursiveFileLookup", True)
          .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("pathGlobFilter", "*.json").json(path))
    known = [c for c in df.columns if c != "_corrupt_record"]
    some = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(True)) for c in known], F.lit(False))  # an object without any known field is empty
    return df.withColumn("file", F.col("_metadata.file_path")).where(F.col("_corrupt_record").isNull() & some).drop("_corrupt_record")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    return read_json_documents(spark, path, schema.ANNOTATION)


def read_predictions(spark: SparkSession, root: str) -> DataFrame:
    """Prediction files of all models below a root, `model/.../video.json`; adds model and the relative name of the file."""
    below = re.sub(r"^\w+:/*", "/", root.rstrip("/"))
    path = F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B")))
    rel = F.regexp_extract(path, re.escape(below).replace("\\/", "/") + r"/(.*)$", 1)
    df = read_json_documents(spark, root, schema.PREDICTION).withColumn("relative", rel).withColumn("model", F.split("relative", "/")[0])
    # what a stage wrote lies in a folder named session=...; such a session is the row's name, else the file is
    folder = F.regexp_extract("relative", r"(?:^|/)session=([^/]*)/", 1)
    return df.withColumn("named", F.coalesce(F.nullif(folder, F.lit("")), stem(F.col("relative"))))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return read_json_documents(spark, path, schema.SAMPLE)


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    """Samples as a stage wrote them, JSON lines in one folder per session; the session is the folder's, as text."""
    return spark.read.schema(f"sample_id STRING, session STRING, video_id STRING, type STRING, videos ARRAY<STRING>, conversations ARRAY<STRUCT<{schema.TURN}>>, "
                             "endpoint_timestamp INT, sample_type INT").json(path)


def finished(spark: SparkSession, path: str) -> DataFrame:
    """(session) of the predictions that lie finished below a path; none where there is no such path."""
    ddl = "session STRING, conversations ARRAY<STRING>"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "session STRING")
    return spark.read.schema(ddl).json(path).where("size(conversations) > 0").select("session").distinct()


def read_keyed_match_info(spark: SparkSession, path: str, key: str = "relative") -> DataFrame:
    """Match tables as JSON lines with their key, as the score stage writes them."""
    return spark.read.schema(f"{key} STRING, {schema.MATCH_INFO}").json(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of events; blank lines are skipped."""
    return spark.read.schema(schema.EVENT).json(path)


def read_jsonl(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).json(path)


def read_match_info(spark: SparkSession, path: str) -> DataFrame:
    """Stored matches of each video, as in the alignment stage's JSON: matched pairs, missed, redundant, costs and scores."""
    return read_json_documents(spark, path, schema.MATCH_INFO)


def read_videos(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, length) of video files below a path; contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    ends = "(?i).*(" + "|".join(map(re.escape, VIDEO_TYPES)) + ")$"
    return df.where(F.col("path").rlike(ends)).select("path", basename(F.col("path")).alias("name"), "length")


def read_video_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(path, data): videos as base64 text, for requests."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.base64("content").alias("data"))


def read_subset(spark: SparkSession, path: str) -> DataFrame:
    """A list of relative paths, one a line: line (trimmed, blanks dropped), name (without directory and extension), domain (first part)."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where(F.length("line") > 0)
    return lines.withColumn("name", stem(F.col("line"))).withColumn("domain", F.when(F.instr("line", "/") > 0, F.split("line", "/")[0]))


def read_durations(spark: SparkSession, path: str) -> DataFrame:
    """(video, seconds); NULL or 0 where probing failed."""
    return spark.read.schema("video STRING, seconds DOUBLE").parquet(path)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """A summary CSV with a header; every column is text, as columns differ from file to file."""
    return spark.read.option("header", True).csv(path)


def judge_config(path: str) -> dict:
    """The judge's class path and arguments from a YAML file; empty if there is no such section."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return (yaml.safe_load(f) or {}).get("judger") or {}


def credentials(path: str | None = None, env: dict[str, str] | None = None) -> dict[str, str]:
    """Host and key of a service: environment before file, for each field. They stay on the driver, never in a column."""
    import yaml

    env = os.environ if env is None else env
    found: dict[str, str] = {}
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            found = {k.lower(): str(v) for k, v in (yaml.safe_load(f) or {}).items() if v is not None}
    out = {}
    for name, aliases in (("api_host", ("API_HOST", "API_BASE")), ("api_key", ("API_KEY", "API_TOKEN"))):
        value = next((env[a] for a in aliases if env.get(a)), None) or next((found[a.lower()] for a in aliases if found.get(a.lower())), None)
        if value:
            out[name] = value
    return out
