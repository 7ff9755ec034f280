"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions.text import is_blank, is_silence
from cadenza.llm import langid, mixing, packing, pairs, runs, tokens, xfast
from cadenza.session import table, written


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    predictions = table(spark, sf_dir, "predictions")
    return pairs.label_pairs(pairs.pairs_of(predictions), pairs.fit_on(predictions)[0])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).where("defect is not null")


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by defect; sound pairs have a NULL defect."""
    return _pairs(spark, sf_dir).groupBy("defect").agg(F.count(F.lit(1)).alias("n_pairs"))


def _frames(df: DataFrame, text: str, name: str) -> DataFrame:
    """Talking frames with a time; the frame index stands in for a NULL timestamp."""
    talks = F.col(text).isNotNull() & ~is_silence(F.col(text)) & ~is_blank(F.col(text))
    return df.where(talks).select(F.col("session_id").alias("entity"), F.col(f"{text}_id").alias(name),
                                  F.coalesce("timestamp_in_stream", "frame_idx_in_stream").alias("seconds"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    gens = _frames(table(spark, sf_dir, "gen_frames"), "gen", "probe_id")
    refs = _frames(table(spark, sf_dir, "ref_frames"), "ref", "ref_id")
    return xfast.nearest(gens, refs, 2.0).select("ref_id", F.col("probe_id").alias("gen_id"))


def p5_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run, silences too, with its count and its duration in seconds."""
    return (runs.collapse(runs.sequences_of(table(spark, sf_dir, "predictions")))
            .select(F.col("id").alias("prediction_id"), "kind", "start_second", "end_second", "n_events",
                    (F.col("end_second") - F.col("start_second")).alias("duration"), "text"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_runs(spark, sf_dir).where("kind = 'talk' and n_events >= 2").select("prediction_id", "start_second", "end_second", "n_events")


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return written(tokens.with_sizes(docs, "text").drop("text"), "sizes")


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document's pieces, for every capacity."""
    sizes = _sized(spark, sf_dir)
    each = [packing.pack(sizes, r["capacity_tokens"]).select(F.lit(r["pack_name"]).alias("pack_name"), "*")
            for r in table(spark, sf_dir, "pack_sizes").collect()]
    return reduce(DataFrame.unionByName, each)


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity: containers, tokens, the fewest containers that any packing needs, and the share filled."""
    per = p6_packed(spark, sf_dir).groupBy("pack_name", "container").agg(F.sum("size").alias("filled"), F.count(F.lit(1)).alias("n_pieces"))
    per = per.groupBy("pack_name").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("filled").alias("tokens"), F.max("filled").alias("fullest"))
    return per.join(table(spark, sf_dir, "pack_sizes"), "pack_name").withColumn(
        "least_containers", F.ceil(F.col("tokens") / F.col("capacity_tokens"))).withColumn(
        "share_filled", F.col("tokens") / (F.col("n_containers") * F.col("capacity_tokens")))


def p6_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity, what must hold of any packing: every document is placed with all its tokens once, no container is
    over-full, and only documents above the capacity are cut."""
    sizes = _sized(spark, sf_dir)
    out = []
    for r in table(spark, sf_dir, "pack_sizes").collect():
        placed = written(packing.pack(sizes, r["capacity_tokens"]), "placed")
        fullest = placed.groupBy("container").agg(F.sum("size").alias("s")).agg(F.max("s"))
        per = placed.groupBy("doc_id").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"))
        per = sizes.join(per, "doc_id", "left").agg(
            F.count(F.lit(1)).alias("n_docs"), F.every(F.coalesce(F.col("s") == F.col("n_tokens"), F.lit(False))).alias("tokens_once"),
            F.every((F.col("n") == 1) | (F.col("n_tokens") > r["capacity_tokens"])).alias("whole_if_fits"))
        out.append(per.select(F.lit(r["pack_name"]).alias("pack_name"), "n_docs", "tokens_once", "whole_if_fits", (fullest.scalar() <= r["capacity_tokens"]).alias("none_over")))
    return reduce(DataFrame.unionByName, out)


def p7_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every use of a document in every mix, with its place."""
    return mixing.mix(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, targets = _sized(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    return mixing.shares(mixing.mix(sizes, targets), targets, sizes)


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per mix and source, what must hold of any mix: the repeats are kept, each use occurs once, and the source has its
    share of the budget (less one document at most) unless it is at its limit."""
    sizes, targets = _sized(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    mixed = written(mixing.mix(sizes, targets), "mixed")
    uses = mixed.groupBy("mix_name", "source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id", "use").alias("d"))
    got = mixing.shares(mixed, targets, sizes).join(uses, ["mix_name", "source"], "left").join(mixing.goals_of(targets).select("mix_name", "source", "budget_share"), ["mix_name", "source"])
    whole = sizes.agg(F.sum("n_tokens").alias("all_tokens"), F.max("n_tokens").alias("largest"))
    share = got.withColumn("part", F.col("target_share") / F.sum("target_share").over(Window.partitionBy("mix_name")))
    due = F.col("part") * F.col("budget_share") * whole.select("all_tokens").scalar() - whole.select("largest").scalar()
    return share.select("mix_name", "source", "target_share", "max_repeats", (F.col("most_uses") <= F.col("max_repeats")).alias("repeats_kept"),
                        F.coalesce(F.col("n") == F.col("d"), F.lit(True)).alias("uses_once"), (F.col("at_limit") | (F.col("tokens") >= due)).alias("share_reached"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return (langid.label_documents(docs, langid.fit_on(docs)).where("n_langs > 1 or given is null or given <> lang")
            .select(F.col("key").alias("doc_id"), "lang"))


def p8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of every document with its language and confidence."""
    docs = table(spark, sf_dir, "documents")
    return langid.label_passages(docs, langid.fit_on(docs)).withColumnRenamed("key", "doc_id")


_SILENT = r"""regexp_matches(lower({0}), '^[\s"'']*silent[\s"'']*[.]?[\s"'']*$') OR trim({0}) = '<|silent|>' OR regexp_matches({0}, '^[\s ​﻿]*$')"""
SQL = {
    "p4_found": f"""WITH g AS (SELECT gen_id, session_id s, CAST(round(coalesce(timestamp_in_stream, frame_idx_in_stream) * 1000000) AS BIGINT) t FROM gen_frames
            WHERE gen IS NOT NULL AND NOT ({_SILENT.format('gen')}) AND coalesce(timestamp_in_stream, frame_idx_in_stream) IS NOT NULL),
        r AS (SELECT ref_id, session_id s, CAST(round(coalesce(timestamp_in_stream, frame_idx_in_stream) * 1000000) AS BIGINT) t FROM ref_frames
            WHERE ref IS NOT NULL AND NOT ({_SILENT.format('ref')}) AND coalesce(timestamp_in_stream, frame_idx_in_stream) IS NOT NULL),
        j AS (SELECT ref_id, gen_id, row_number() OVER (PARTITION BY gen_id ORDER BY abs(g.t - r.t), ref_id) n
            FROM g JOIN r ON g.s = r.s WHERE abs(g.t - r.t) <= 2000000)
        SELECT ref_id, gen_id FROM j WHERE n = 1""",
    "p6_checks": "SELECT pack_name, (SELECT count(*) FROM documents) AS n_docs, TRUE AS tokens_once, TRUE AS whole_if_fits, TRUE AS none_over FROM pack_sizes",
    "p7_checks": r"""SELECT mix_name, regexp_replace(lower(trim(source)), '[\s_.\-]+', '-', 'g') AS source, sum(target_share) AS target_share, min(max_repeats) AS max_repeats,
        TRUE AS repeats_kept, TRUE AS uses_once, TRUE AS share_reached FROM mix_targets GROUP BY ALL""",
}
QUERIES = {"p1_found": p1_found, "p1_counts": p1_counts, "p4_found": p4_found, "p5_found": p5_found, "p5_runs": p5_runs, "p6_packed": p6_packed, "p6_fill": p6_fill, "p6_checks": p6_checks,
           "p7_mixed": p7_mixed, "p7_shares": p7_shares, "p7_checks": p7_checks, "p8_found": p8_found, "p8_passages": p8_passages}
