"""Problem 3 on the tables: the one-second clips of chunks in few files, each intact clip once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.paths import clip_key, with_clip
from cadenza.operators import compaction
from cadenza.session import shared_dir, table


def _intact(chunks: DataFrame) -> DataFrame:
    return chunks.where("valid and n_bytes > 0").withColumn("file_id", F.lpad(F.col("chunk_id").cast("string"), 20, "0"))


def intact(chunks: DataFrame) -> DataFrame:
    """Intact files (valid true, bytes above 0) with their clip as key; a path without interval is its own clip."""
    return (with_clip(_intact(chunks).select("file_id", "path", "n_bytes", "written_at", "payload"), F.col("path"), "parsed")
            .select("file_id", clip_key(F.col("parsed")).alias("clip"), "n_bytes", "written_at", "payload"))


def store_of(spark: SparkSession, sf_dir: str) -> str:
    store = shared_dir(spark, "clips")
    chunks = table(spark, sf_dir, "chunks")
    compaction.compact(intact(chunks), store, file_id="file_id", key="clip", size="n_bytes", time="written_at", payload="payload", bodies=_intact(chunks))
    return store


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that the committed run merged away: those the index shows in the container of another copy of their clip."""
    return (compaction.index(spark, store_of(spark, sf_dir)).where("input_id <> kept_id and container is not null")
            .select(F.col("input_id").cast("bigint").alias("chunk_id")))


def p3_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The containers written: records and bytes of each."""
    return compaction.live(spark, store_of(spark, sf_dir)).drop("run")


def p3_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All containers together, beside the files they were made of."""
    store = store_of(spark, sf_dir)
    held = compaction.live(spark, store).agg(F.sum("n_records").alias("n_records"), F.sum("n_bytes").alias("n_bytes"), F.every(F.col("n_bytes") <= 2 * compaction.Tiers().target_bytes).alias("none_too_large"))
    taken = compaction.index(spark, store).agg(F.count(F.lit(1)).alias("n_inputs"), F.sum("input_bytes").alias("input_bytes"))
    return held.select("*", *[taken.select(c).scalar().alias(c) for c in taken.columns])


def p3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the store holds after the run: every clip's chunk id and the bytes it holds."""
    store = store_of(spark, sf_dir)
    from pyspark.sql import types as T

    fields = T.StructType([T.StructField("file_id", T.StringType()), T.StructField("payload", T.BinaryType())])
    return compaction.read_store(spark, store, fields).select(
        F.col("file_id").cast("bigint").alias("chunk_id"), F.length("payload").cast("bigint").alias("stored_bytes"), F.md5("payload").alias("digest"))


_CLIPS = r"""WITH i AS (SELECT *, regexp_replace(regexp_replace(trim(path), '^.*[/\\]', ''), '\.[^.]*$', '') s FROM chunks WHERE valid AND n_bytes > 0),
c AS (SELECT *, regexp_replace(regexp_replace(s, '( \([0-9]+\)|_copy)+$', ''), '_0*([0-9]+)_0*([0-9]+)$', '_\1_\2') clip FROM i),
r AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY written_at, chunk_id) n FROM c) """

SQL = {
    "p3_found": _CLIPS + "SELECT chunk_id FROM r WHERE n > 1",
    "p3_totals": _CLIPS + """SELECT count(CASE WHEN n = 1 THEN 1 END) n_records, CAST(sum(CASE WHEN n = 1 THEN n_bytes END) AS BIGINT) n_bytes, TRUE none_too_large,
        count(*) n_inputs, CAST(sum(n_bytes) AS BIGINT) input_bytes FROM r""",
    "p3_records": _CLIPS + "SELECT chunk_id, octet_length(payload) stored_bytes, md5(payload) digest FROM r WHERE n = 1",
}
QUERIES = {"p3_found": p3_found, "p3_containers": p3_containers, "p3_totals": p3_totals, "p3_records": p3_records}
