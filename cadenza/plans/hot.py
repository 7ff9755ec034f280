"""Problem 2 on the tables: results per source video of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.paths import with_source
from cadenza.operators import hotkeys
from cadenza.session import table


def keyed(samples: DataFrame) -> DataFrame:
    """(video, t, sample_type): the source video of the row's clips, or its video_id if it has none."""
    named = F.filter("videos", lambda p: F.length(F.trim(p)) > 0)
    s = with_source(samples.select("videos", "video_id", "endpoint_timestamp", "sample_type"), F.try_element_at(named, F.lit(1)), "named")
    return s.select(F.coalesce("named", F.nullif(F.col("video_id"), F.lit(""))).alias("video"), F.col("endpoint_timestamp").alias("t"), "sample_type")


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hotkeys.weights(keyed(table(spark, sf_dir, "samples")), "video", ["t", "sample_type"])


def per_video(w: DataFrame) -> DataFrame:
    speak = F.coalesce(F.col("sample_type") == 1, F.lit(False))
    return hotkeys.per_key(w, "video", sums={"n_rows": F.lit(True), "speak_rows": speak},
                           mins={"first_t": F.col("t")}, maxs={"last_t": F.col("t")})


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = table(spark, sf_dir, "samples").agg(F.count(F.lit(1)).alias("n"))
    return hotkeys.heavy_keys(per_video(_weights(spark, sf_dir)), "video", "n_rows", total)


def p2_per_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, speaking rows and distinct speaking seconds, first and last endpoint of every source video."""
    w = _weights(spark, sf_dir)
    secs = hotkeys.distinct_and_mode(w.where("sample_type = 1"), "video", "t").select(
        F.col("video").alias("_v"), F.col("n_distinct").alias("speak_seconds"))
    return (per_video(w).join(secs, F.col("video").eqNullSafe(F.col("_v")), "left").drop("_v")
            .withColumn("speak_seconds", F.coalesce("speak_seconds", F.lit(0))))


def p2_median_endpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hotkeys.percentile(_weights(spark, sf_dir), "video", "t", 0.5, 600.0).withColumnRenamed("value", "median_t")


_KEYED = r"""WITH f AS (SELECT trim(list_filter(videos, lambda p: length(trim(p)) > 0)[1]) p, video_id, endpoint_timestamp t, sample_type FROM samples),
b AS (SELECT *, regexp_replace(regexp_replace(p, '^.*[/\\]', ''), '\.[^.]*$', '') s FROM f),
k AS (SELECT coalesce(nullif(regexp_replace(s, '_[0-9]+_[0-9]+$', ''), ''), nullif(video_id, '')) video, t, sample_type FROM b) """

SQL = {
    "p2_found": _KEYED + "SELECT video FROM k WHERE video IS NOT NULL GROUP BY video HAVING count(*) * 20 >= (SELECT count(*) FROM samples)",
    "p2_per_video": _KEYED + """SELECT video, count(*) n_rows, count(CASE WHEN sample_type = 1 THEN 1 END) speak_rows,
        min(t) first_t, max(t) last_t, count(DISTINCT CASE WHEN sample_type = 1 THEN t END) speak_seconds FROM k GROUP BY video""",
    "p2_median_endpoint": _KEYED + """, r AS (SELECT video, t, row_number() OVER (PARTITION BY video ORDER BY t) i, count(*) OVER (PARTITION BY video) n
        FROM k WHERE t IS NOT NULL) SELECT video, min(t) median_t FROM r WHERE i >= ceil(n * 0.5) GROUP BY video""",
}
QUERIES = {"p2_found": p2_found, "p2_per_video": p2_per_video, "p2_median_endpoint": p2_median_endpoint}
