"""From annotated sessions to one sample per second, with rolling windows of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.numbers import chunk_count, tail_seconds
from cadenza.functions.once import computed
from cadenza.functions.paths import basename, clip_key, stem, with_clip, with_interval

_ASKS = "filter(conversations, c -> c.from = 'user' and c.value is distinct from '<video>' and c.timestamp is not null)"
_SAYS = "filter(conversations, c -> c.from = 'assistant' and c.timestamp is not null)"


def bounds(sessions: DataFrame, *keys: str) -> DataFrame:
    """First second (first instruction, else first answer) and last answer of each session; sessions without a timed
    answer give no row. Times are cut to whole seconds."""
    return (sessions.withColumn("says", F.expr(f"transform({_SAYS}, c -> cast(c.timestamp as int))"))
            .withColumn("asks", F.expr(f"transform({_ASKS}, c -> cast(c.timestamp as int))"))
            .where("size(says) > 0")
            .select(*keys, F.coalesce(F.array_min("asks"), F.array_min("says")).alias("start_t"), F.array_max("says").alias("last_t"), "says"))


def spans(sessions: DataFrame, key: str, *carry: str, low: int = 10, high: int = 15, seed: int = 0, durations: DataFrame | None = None) -> DataFrame:
    """The sampled span of each session: key, carried columns, start_t, end_t, says (seconds with an answer).

    A span runs from the first instruction to the last answer plus a tail, drawn from the key, that a known duration cuts.
    `durations` has video (file name) and seconds; a missing, NULL or non-positive duration cuts nothing.
    """
    if durations is not None:
        known = durations.groupBy("video").agg(F.max("seconds").alias("duration"))
        b = bounds(sessions.withColumn("_file", basename(F.try_element_at("videos", F.lit(1)))), key, *carry, "_file")
        b = b.join(known, F.col("_file") == F.col("video"), "left").drop("video", "_file")
    else:
        b = bounds(sessions, key, *carry).withColumn("duration", F.lit(None).cast("double"))
    tail = tail_seconds(F.col(key), low, high, seed, sessions.schema[key].dataType.simpleString() == "string")
    cut = F.when(F.col("duration") > 0, F.least(tail, F.greatest(F.lit(0), F.col("duration").cast("int") - F.col("last_t")))).otherwise(tail)
    return b.withColumn("end_t", F.col("last_t") + cut).where("start_t <= end_t").select(key, *carry, "start_t", "end_t", "says")


def seconds(sessions: DataFrame, key: str, *carry: str, step: int = 1, **span) -> DataFrame:
    """One row per sampled second of each span: key, carried columns, t, sample_type (1 speak, 2 silent)."""
    b = spans(sessions, key, *carry, **span)
    return (b.withColumn("t", F.explode(F.sequence("start_t", "end_t", F.lit(step))))
            .select(key, *carry, "t", F.when(F.array_contains("says", F.col("t")), 1).otherwise(2).alias("sample_type")))


def history(conv: str = "conversations", t: str = "t") -> Column:
    """Turns up to second t, in their order; a turn without a time is kept."""
    return F.expr(f"filter({conv}, c -> c.timestamp is null or cast(c.timestamp as int) <= {t})")


def target(conv: str = "conversations", t: str = "t") -> Column:
    """What is to be said at second t: the answers of that second joined by a space, else `Silent`."""
    said = f"array_join(transform(filter({conv}, c -> c.from = 'assistant' and cast(c.timestamp as int) = {t}), c -> c.value), ' ')"
    has = f"exists({conv}, c -> c.from = 'assistant' and cast(c.timestamp as int) = {t})"
    return F.expr(f"if({has}, {said}, 'Silent')")


def window_items(conv: str = "conversations", t: str = "t", window: int = 60, chunk: int = 1) -> Column:
    """A sample's items: ARRAY<STRUCT<kind, start, end, pos>>, turns (kind `turn`) among the chunks (`video`) of the window.

    The turns are walked in their order: one whose second lies in the window beyond what is covered is preceded by chunks
    up to it; the rest of the window follows at the end. A chunk before a turn may be shorter than `chunk`.
    """
    item = "struct<kind: string, start: int, end: int, pos: int>"
    grid = lambda a, b: (f"if({a} < {b}, transform(sequence({a}, greatest({a}, {b} - 1), {chunk}), s -> named_struct('kind', 'video', 'start', s, 'end', least(s + {chunk}, {b}), "  # noqa: E731
                         f"'pos', cast(null as int))), cast(array() as array<{item}>))")
    lo = f"greatest(0, {t} - {window})"
    kept = f"filter(transform({conv}, (c, k) -> named_struct('s', cast(c.timestamp as int), 'k', k)), x -> x.s is null or x.s <= {t})"
    # how far the chunks reach before and at each turn; what is carried along is the turns only, the chunks are laid between them at the end
    walk = f"""aggregate({kept}, cast(array() as array<struct<a: int, b: int, s: int, k: int>>), (acc, x) -> array_append(acc, named_struct(
        'a', if(size(acc) = 0, {lo}, acc[size(acc) - 1].b), 'b', greatest(if(size(acc) = 0, {lo}, acc[size(acc) - 1].b), coalesce(x.s, 0)), 's', x.s, 'k', x.k)),
        acc -> array_append(acc, named_struct('a', if(size(acc) = 0, {lo}, acc[size(acc) - 1].b), 'b', greatest({t}, if(size(acc) = 0, {lo}, acc[size(acc) - 1].b)), 's', cast(null as int), 'k', -1)))"""
    return F.expr(f"""flatten(transform({walk}, w -> concat({grid('w.a', 'w.b')}, if(w.k < 0, cast(array() as array<{item}>),
        array(named_struct('kind', 'turn', 'start', w.s, 'end', w.s, 'pos', w.k))))))""")


def window_chunks(conv: str = "conversations", t: str = "t", window: int = 60, chunk: int = 1) -> Column:
    """The chunks of `window_items`: ARRAY<STRUCT<start, end>>. Turns lie on whole seconds, so one-second chunks are not cut
    by them and follow from t alone; longer ones need the walk over the turns."""
    if chunk == 1:
        lo = f"greatest(0, {t} - {window})"
        return F.expr(f"""if({t} > {lo}, transform(sequence({lo}, greatest({lo}, {t} - 1)), s -> named_struct('start', s, 'end', s + 1)),
            cast(array() as array<struct<start: int, end: int>>))""")
    return F.transform(F.filter(window_items(conv, t, window, chunk), lambda x: x["kind"] == "video"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))


def dense_chunks(durations: DataFrame, chunk: int = 1) -> DataFrame:
    """The grid of chunks of every video: video, start, end; the last one may pass the end of the video."""
    n = chunk_count(F.col("seconds"), chunk)
    return (durations.where(n > 0).select("video", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
            .select("video", (F.col("k") * chunk).alias("start"), ((F.col("k") + 1) * chunk).alias("end")))


def with_session(annotations: DataFrame, name: str = "session") -> DataFrame:
    """Adds the key of a session as text: the stem of its first video, else its video_id, else its session_id or its file's name.
    Blank names count as missing; what has none of them gets a NULL key."""
    known = annotations.columns
    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    names = [full(stem(F.try_element_at("videos", F.lit(1)))), full(F.col("video_id"))]
    names += [F.col("session_id").cast("string")] if "session_id" in known else []
    names += [full(stem(F.col("file")))] if "file" in known else []
    return annotations.withColumn(name, F.coalesce(*names))


def assembled(sessions: DataFrame, key: str, *carry: str, system: str = "", window: int = 60, chunk: int = 1, **span) -> DataFrame:
    """One sample per sampled second, as a model is asked: key, carried columns, endpoint_timestamp, sample_type, conversations
    and videos.

    A conversation is the system turn (if `system` is not empty), the turns up to the second in their order with a `<video>`
    turn for each chunk of the window where it falls between them, and the target at the end: the answers of the second
    stand there already, else a `Silent` turn is added. `videos` has the clips of the `<video>` turns in their order. A
    session without videos has turns only.
    """
    s = seconds(sessions, key, *dict.fromkeys([*carry, "videos", "conversations"]), step=chunk, **span)
    s = computed(s, "_items", window_items(window=window, chunk=chunk))
    s = s.withColumn("_items", F.when(F.size("videos") > 0, F.col("_items")).otherwise(F.filter("_items", lambda x: x["kind"] == "turn")))
    path = F.try_element_at("videos", F.lit(1))
    none = F.lit(None).cast("double")
    turn = lambda who, what, when: F.struct(F.lit(who).alias("from"), what.cast("string").alias("value"), when.alias("timestamp"))
    said = F.transform("_items", lambda x: F.when(x["kind"] == "video", turn("user", F.lit("<video>"), none)).otherwise(
        F.struct(F.get("conversations", x["pos"])["from"].alias("from"), F.get("conversations", x["pos"])["value"].alias("value"), F.get("conversations", x["pos"])["timestamp"].alias("timestamp"))))
    head = F.array(turn("system", F.lit(system), none)) if system else F.array().cast("array<struct<`from`: string, value: string, timestamp: double>>")
    tail = F.when(F.col("sample_type") == 2, F.array(turn("assistant", F.lit("Silent"), F.col("t").cast("double")))).otherwise(
        F.array().cast("array<struct<`from`: string, value: string, timestamp: double>>"))
    clips = F.transform(F.filter("_items", lambda x: x["kind"] == "video"), lambda x: chunk_path(path, x["start"], x["end"]))
    return s.select(key, *[c for c in carry if c not in ("videos", "conversations")], F.col("t").alias("endpoint_timestamp"), "sample_type",
                    F.concat(head, said, tail).alias("conversations"), clips.alias("videos"))


def chunk_path(path: Column, start: Column, end: Column) -> Column:
    return with_interval(path, start, end)


def output_name(videos: Column, video_id: Column, index: Column) -> Column:
    """File name of a sample: stem of its first video, else its video_id, else its number."""
    first = F.nullif(stem(F.try_element_at(videos, F.lit(1))), F.lit(""))
    return F.concat(F.coalesce(first, F.nullif(video_id, F.lit("")), F.concat(F.lit("sample_"), F.lpad(index.cast("string"), 6, "0"))), F.lit(".json"))


def validated(samples: DataFrame, chunks: DataFrame, key: str = "sample_id") -> DataFrame:
    """Samples that name at least one clip, all of them with an intact file (valid and not empty).

    Clips compare by source video and seconds, whatever their path's spelling; a path without interval never has a file.
    A distinct list of good clips is joined, so a clip with many files or samples stays one row on its side.
    """
    good = with_clip(chunks.where("valid and n_bytes > 0").select("path"), F.col("path"), "c").select(clip_key(F.col("c")).alias("clip")).where("clip is not null").distinct()
    named = samples.where("size(videos) > 0").select(key, F.explode("videos").alias("p"))
    named = with_clip(named, F.col("p"), "c").select(key, clip_key(F.col("c")).alias("clip"))
    bad = named.join(good, "clip", "left_anti").select(key).distinct()
    return samples.where("size(videos) > 0").join(bad, key, "left_anti")
