"""The stages end to end, and a command line for them.

    samples   annotations -> per-second samples, one folder per session
    validate  samples -> those whose clips all have a file
    infer     samples (ground-truth history) -> one prediction per session, by a model
    replay    annotations -> one prediction per session, the history being the model's own replies
    merge     samples with preds -> the turns of each session as rows
    score     predictions of one or more models -> report, events, measures

Sessions are named after their first video (`sampling.with_session`), so the outputs of one stage are what the next one reads.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.silence import PLACEHOLDERS_MATCHED
from cadenza.models import Echo, Maker, generate, hashed_embeddings, judge_with, model_embeddings
from cadenza.operators import assign, classify, merge, messages, metrics, sampling, segment
from cadenza.plans import report
from cadenza.session import clean_up, get_session, written
from cadenza.sources import readers, sinks
from cadenza.streaming.replay import USAGE, replay


def per_second_samples(annotations: DataFrame, window: int = 60, chunk: int = 1, low: int = 10, high: int = 15, seed: int = 0,
                       durations: DataFrame | None = None, system: str | None = None) -> DataFrame:
    """Samples of every second of every session: session, sample_id, video_id, type, videos, conversations (system turn, history with
    its <video> turns, target), endpoint_timestamp, sample_type."""
    named = sampling.with_session(annotations).where("session is not null")
    s = sampling.assembled(named, "session", "video_id", "type", system=messages.instruction(window) if system is None else system,
                           window=window, chunk=chunk, low=low, high=high, seed=seed, durations=durations)
    return s.withColumn("sample_id", F.concat_ws("#", "session", "endpoint_timestamp"))


def sample_requests(samples: DataFrame, last: int = 10) -> DataFrame:
    """(sample_id, system, messages) of samples: all turns but the target, with the last clips."""
    asked = "slice(conversations, 1, size(conversations) - 1)"
    r = samples.where("size(conversations) > 0").select("sample_id", "videos", F.expr(asked).alias("conv"))
    r = r.select("sample_id", messages.system_prompt("conv").alias("system"), messages.parts("conv", "videos", last).alias("m"))
    return r.select("sample_id", "system", messages.merged("m").alias("messages"))


def infer(samples: DataFrame, make, model: str, last: int = 10) -> DataFrame:
    """One prediction per session from its samples: session, video_id, type, conversations (question, then a turn per second with pred),
    gen_args (the sums over its samples). A sample whose request failed has no pred."""
    got = written(generate(sample_requests(samples, last), make, "sample_id"), "replies")
    target = F.try_element_at(F.filter("conversations", lambda c: c["from"] == "assistant"), F.lit(-1))
    s = samples.join(got, "sample_id").withColumn("target", target)
    turn = F.struct(F.lit("assistant").alias("from"), F.col("target.value").alias("value"), F.coalesce("target.timestamp", F.col("endpoint_timestamp").cast("double")).alias("timestamp"), "pred", "sample_type")
    rest = F.transform(F.filter("conversations", lambda c: c["from"] == "user"), lambda c: F.struct(c["from"].alias("from"), c["value"].alias("value"), c["timestamp"].alias("timestamp"),
                       F.lit(None).cast("string").alias("pred"), F.lit(None).cast("int").alias("sample_type")))
    d = s.select("session", "endpoint_timestamp", "video_id", "type", "videos", F.concat(rest, F.array(turn)).alias("conversations"), "sample_type", *USAGE)
    merged = merge.merged_turns(d, "session", "endpoint_timestamp", "pred")
    per = merge.conversations(merged, "session", "endpoint_timestamp")
    use = d.groupBy("session").agg(F.first("video_id", True).alias("video_id"), F.first("type", True).alias("type"), *[F.sum(F.coalesce(n, F.lit(0))).alias(n) for n in USAGE])
    return per.join(use, "session").select("session", "video_id", "type", "conversations", F.struct(F.lit(model).alias("model"), *USAGE).alias("gen_args"))


def replayed(annotations: DataFrame, make, model: str, window: int = 60, **span) -> DataFrame:
    """One prediction per session by replay: the same columns as `infer`. Of annotations with one name the least by all fields counts."""
    named = sampling.with_session(annotations).where("session is not null")
    rest = F.struct("conversations", "videos", "video_id", "type")
    one = named.groupBy("session").agg(F.min(rest).alias("x")).select(F.col("session").alias("session_id"), "x.*")
    said = written(replay(one, make, messages.instruction(window), window, usage=True, **span), "replayed")
    turn = F.struct(F.lit("assistant").alias("from"), F.col("gt").alias("value"), F.col("t").cast("double").alias("timestamp"), "pred", "sample_type")
    per = said.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("t", turn.alias("turn")))).alias("s"), *[F.max(n).alias(n) for n in USAGE])
    first = F.try_element_at(F.filter("conversations", lambda c: (c["from"] == "user") & ~c["value"].eqNullSafe(F.lit("<video>"))), F.lit(1))
    asks = one.select("session_id", "video_id", "type", first["value"].alias("q"), first["timestamp"].alias("at"))
    none = F.lit(None)
    ask = F.when(F.col("q").isNotNull(), F.array(F.struct(F.lit("user").alias("from"), F.col("q").alias("value"), F.col("at").alias("timestamp"), none.cast("string").alias("pred"), none.cast("int").alias("sample_type")))).otherwise(F.array())
    return per.join(asks, "session_id").select(F.col("session_id").alias("session"), "video_id", "type", F.concat(ask, F.transform("s", lambda x: x["turn"])).alias("conversations"),
                                               F.struct(F.lit(model).alias("model"), *USAGE).alias("gen_args"))


def matched_samples(match: DataFrame, frames_of: DataFrame, originals: DataFrame, key: str) -> DataFrame:
    """Matched pairs as conversations for the second judging: one row per key, with question and scene of the original.

    Pairs stand at their generated frame's time; an empty text becomes `silent`."""
    m = match.where("kind = 'matched'").select(key, "seg", "i", "j", F.col("gen_ts"))
    g = frames_of.select(key, "seg", F.col("pos").alias("i"), "gen")
    r = frames_of.select(key, "seg", F.col("pos").alias("j"), "ref")
    word = lambda c: F.when(F.col(c) == "", F.lit("silent")).otherwise(F.col(c))
    turn = F.struct(F.lit("assistant").alias("from"), word("ref").alias("value"), F.col("gen_ts").alias("timestamp"), word("gen").alias("pred"))
    pairs = m.join(g, [key, "seg", "i"]).join(r, [key, "seg", "j"])
    per = pairs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("gen_ts", "seg", "i", turn.alias("turn")))).alias("t"))
    named = originals.select(key, "type", "question")
    ask = F.struct(F.lit("user").alias("from"), F.coalesce("question", F.lit("")).alias("value"), F.lit(0.0).alias("timestamp"), F.lit(None).cast("string").alias("pred"))
    return per.join(named, key, "left").select(key, "type", F.concat(F.array(ask), F.transform("t", lambda x: x["turn"])).alias("conversations"))


def stored_pairs(info: DataFrame, originals: DataFrame, key: str) -> DataFrame:
    """The conversations for the second judging from stored match tables (`sinks.match_info`)."""
    word = lambda c: F.when(F.coalesce(c, F.lit("")) == "", F.lit("silent")).otherwise(c)
    turn = F.transform("matched", lambda p: F.struct(F.lit("assistant").alias("from"), word(p[1]["ref"]).alias("value"), p[0]["timestamp_in_stream"].alias("timestamp"), word(p[0]["gen"]).alias("pred")))
    ask = F.struct(F.lit("user").alias("from"), F.coalesce("question", F.lit("")).alias("value"), F.lit(0.0).alias("timestamp"), F.lit(None).cast("string").alias("pred"))
    return info.join(originals.select(key, "type", "question"), key, "left").select(key, "type", F.concat(F.array(ask), turn).alias("conversations"))


def score(predictions: DataFrame, key: str, judge=classify.length_judge, width: float = 2.0, vectors: DataFrame | None = None, embed=None, aligned: DataFrame | None = None,
          by: tuple[str, ...] = (), align: bool = True, stored: DataFrame | None = None) -> dict:
    """Alignment, stream judging and matched judging of one table: DataFrames by name (match, frames, per_key, macro, stream, matched).

    `aligned` restricts the alignment to some rows, `by` are columns that macro and events keep apart (the model). Text vectors
    come from `vectors`, else from `embed` (a function of a table of texts), else they are hashed. Events are written before they
    are returned, so that each reply is judged once, whatever is made of them. The second judging takes the matched pairs; without
    alignment those of `stored` match tables; without either the predictions themselves, each second against its own reference.
    """
    originals = predictions.select(key, *by, "type", classify.question().alias("question"))
    out: dict = {"stream": written(classify.events(predictions, key, width, judge=judge, carry=by), "events")}
    if align:
        frames = written(segment.segmented(predictions if aligned is None else aligned, key), "frames")
        if vectors is None:
            texts = frames.select(F.col("gen").alias("text")).unionByName(frames.select(F.col("ref").alias("text"))).where("text <> ''")
            vectors = written((embed or hashed_embeddings)(texts), "vectors")
        out["frames"], out["match"] = frames, written(assign.match(frames, key, vectors), "match")
        per = metrics.prf(out["match"], key)
        out["per_key"] = per.join(originals.select(key, *by), key, "left") if by else per
        out["macro"] = metrics.macro(out["per_key"], *by)
        again = matched_samples(out["match"], frames, originals, key)
    else:
        again = stored_pairs(stored, originals, key) if stored is not None else predictions.select(key, "type", "conversations")
    if by:
        again = again.join(originals.select(key, *by), key, "left")
    out["matched"] = written(classify.events(again, key, 0.0, PLACEHOLDERS_MATCHED, judge, by), "events-matched")
    return out


def reports(got: dict, by: str | None = None) -> DataFrame:
    """(model, value): the report's text for each model."""
    rows = {}
    one = lambda df, name: df if by is None else df.where(F.col(by).eqNullSafe(F.lit(name)))
    names = ["all"] if by is None else [r[0] for r in got["stream"].select(by).distinct().orderBy(by).collect()]  # one per model
    for name in names:
        macro = one(got["macro"], name).first() if "macro" in got else None
        rows[name] = report.render(str(name), macro.asDict() if macro else None, report.summary(one(got["stream"], name), str(name)), report.summary(one(got["matched"], name), str(name)))
    return got["stream"].sparkSession.createDataFrame(list(rows.items()), "model string, value string")


def _maker(path: str | None, kwargs: str | None):
    return Maker(path, json.loads(kwargs or "{}")) if path else None


def judge_of(path: str | None, kwargs: str | None = None, config: str | None = None):
    """The judge that a class path or a configuration file names: a text model from prompt to reply; else the offline one."""
    known = readers.judge_config(config) if config else {}
    make = _maker(path, kwargs) or (Maker(known["class"], known.get("args") or {}) if known.get("class") else None)
    return judge_with(make) if make else classify.length_judge


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="cadenza")
    sub = p.add_subparsers(dest="command", required=True)
    known = {"samples": "annotations to per-second samples", "validate": "samples whose clips all exist", "infer": "predictions from samples",
             "replay": "predictions by second-by-second replay", "merge": "merge the samples of each session", "score": "align, judge and report predictions"}
    a, b, i, c, e, d = (sub.add_parser(n, help=h) for n, h in known.items())
    for x in (a, b, i, c, e, d):
        x.add_argument("--input", required=True)
        x.add_argument("--output", required=True)
    for x in (a, c):
        x.add_argument("--window", type=int, default=60)
        x.add_argument("--chunk", type=int, default=1)
        x.add_argument("--tail-min", type=int, default=10)
        x.add_argument("--tail-max", type=int, default=15)
        x.add_argument("--seed", type=int, default=0 if x is a else 78)
        x.add_argument("--durations", help="Parquet of (video, seconds)")
    b.add_argument("--chunks", required=True, help="Parquet of (path, valid, n_bytes)")
    for x in (i, c):
        x.add_argument("--name", default="offline", help="name of the model, the folder of its predictions")
        x.add_argument("--model", help="dotted path of what makes a generator; without it the offline one")
        x.add_argument("--model-args", help="its arguments as JSON")
        x.add_argument("--subset", help="list of sessions, one a line")
        x.add_argument("--workers", type=int, help="requests at a time: number of tasks")
    i.add_argument("--last-clips", type=int, default=10)
    d.add_argument("--pc-window", type=float, default=2.0)
    d.add_argument("--subset", help="list of relative paths that the alignment is restricted to, compared by file name")
    d.add_argument("--models", nargs="*", help="only these models")
    d.add_argument("--judge", help="dotted path of what makes a judge (text to text)")
    d.add_argument("--judge-args", help="its arguments as JSON")
    d.add_argument("--config", help="YAML file whose section judger names the judge")
    d.add_argument("--embedder", help="dotted path of what makes an encoder (list of texts to vectors)")
    d.add_argument("--embedder-args", help="its arguments as JSON")
    d.add_argument("--debug", action="store_true", help="also write events, match tables, measures and their summary")
    d.add_argument("--no-align", action="store_true", help="leave the alignment out")
    d.add_argument("--match-info", help="stored match tables for the second judging where the alignment is left out")
    o, spark = p.parse_args(argv), get_session("cadenza")
    try:
        run(o, spark)
    finally:
        clean_up(spark)


def run(o: argparse.Namespace, spark: SparkSession) -> None:
    def known():
        return readers.read_durations(spark, o.durations) if o.durations else None

    if o.command == "samples":
        out = per_second_samples(readers.read_annotations(spark, o.input), o.window, max(1, o.chunk), o.tail_min, o.tail_max, o.seed, known())
        sinks.write_json_by_key(out, o.output, "session", spread="endpoint_timestamp")
    elif o.command == "validate":
        samples = readers.read_stage(spark, o.input)
        sinks.write_samples(sampling.validated(samples, spark.read.parquet(o.chunks)), o.output, "session", samples)
    elif o.command == "merge":
        sinks.write_jsonl(merge.merged_turns(readers.read_stage(spark, o.input), "session", "endpoint_timestamp", "value"), o.output)
    elif o.command in ("infer", "replay"):
        make = _maker(o.model, o.model_args) or Echo
        target = f"{o.output.rstrip('/')}/{o.name}"
        data = readers.read_stage(spark, o.input) if o.command == "infer" else sampling.with_session(readers.read_annotations(spark, o.input))
        if o.subset:
            data = merge.in_subset(data, readers.read_subset(spark, o.subset), "session", "name")
        data = merge.not_done(data, readers.finished(spark, target), "session")
        if o.workers:
            data = data.repartition(o.workers, *(["session"] if o.command == "replay" else ["session", "endpoint_timestamp"]))
        got = infer(data, make, o.name, o.last_clips) if o.command == "infer" else replayed(
            data, make, o.name, o.window, low=o.tail_min, high=o.tail_max, seed=o.seed, every=max(1, o.chunk), durations=known())
        sinks.write_json_by_key(got, target, "session", mode="append")
    else:
        preds = readers.read_predictions(spark, o.input)
        preds = preds.where(F.col("model").isin(o.models)) if o.models else preds
        preds = written(preds.withColumn("file_name", F.substring_index("relative", "/", -1)), "predictions")  # the files are read once
        aligned = merge.in_subset(preds, readers.read_subset(spark, o.subset), "named", "name") if o.subset else None
        embed = _maker(o.embedder, o.embedder_args)
        got = score(preds, "relative", judge_of(o.judge, o.judge_args, o.config), o.pc_window, embed=(lambda t: model_embeddings(t, embed)) if embed else None, aligned=aligned, by=("model",),
                    align=not o.no_align, stored=readers.read_keyed_match_info(spark, o.match_info) if o.match_info else None)
        text = reports(got, "model")
        text.select("model", "value").repartition("model").write.mode("overwrite").partitionBy("model").text(o.output)
        if o.debug:
            sinks.write_jsonl(got["stream"], f"{o.output}/_debug/events")
            sinks.write_jsonl(got["matched"], f"{o.output}/_debug/events_matched")
            if "match" in got:
                sinks.write_jsonl(sinks.match_info(got["match"], got["frames"], "relative"), f"{o.output}/_debug/match_info")
                sinks.write_jsonl(got["per_key"], f"{o.output}/_debug/measures")
                sinks.write_jsonl(sinks.metrics_summary(got["macro"], "model"), f"{o.output}/_debug/metrics_summary")
        for r in text.orderBy("model").collect():
            print(r["value"])


if __name__ == "__main__":
    main()
