"""Queries of the evaluation operators over the domain tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions import numbers, paths, silence
from cadenza.functions.jsontext import judge_reply
from cadenza.models import Echo, generate, table_embeddings
from cadenza.operators import assign, classify, greedy, merge, messages, metrics, sampling, segment
from cadenza.operators.turns import computed, last_assistant, stream_frames, turns
from cadenza.plans import pipeline, report
from cadenza.session import table, written
from cadenza.streaming import replay

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---- SQL fragments -----------------------------------------------------------------------------------------

_SPACE = r"[\s\x1c-\x1f\x85\xa0]+"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{_SPACE}|{_SPACE}$', '', 'g')"


def _in(x: str, values) -> str:
    return f"{x} IN (" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _placeholder(x: str, values=silence.PLACEHOLDERS_STREAM) -> str:
    return f"coalesce({_in(f'lower({_strip(x)})', values)}, TRUE)"


def _aligned(x: str) -> str:
    return f"CASE WHEN lower({_strip(x)}) IN ('silent', '<|silent|>') THEN '' ELSE {x} END"


_T = 'turns AS (SELECT *, c."from" AS role, c.value AS value, c.timestamp AS ts FROM (SELECT {keys}, unnest(generate_series(0, len(conversations) - 1)) AS pos, unnest(conversations) AS c FROM {table}))'
_PT = _T.format(keys="prediction_id, session_id, type", table="predictions")
_AT = _T.format(keys="rid, session_id, videos", table="(SELECT *, row_number() OVER (ORDER BY session_id, meta, len(conversations)) AS rid FROM annotations)")
_ST = _T.format(keys="sample_id, session_id, endpoint_timestamp", table="samples")
_CLIP = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim({p}), '^.*[/\\]', ''), '\.[^.]*$', ''), '( \([0-9]+\)|_copy)+$', ''), '_0*([0-9]+)_0*([0-9]+)$', '_\1_\2')"""
_STEM = r"regexp_replace(regexp_replace({p}, '^.*[/\\]', ''), '\.[^.]*$', '')"

# Frames of the judged stages, candidates in the band, and greedy matching by recursion over the sorted candidates.
_FRAMES = f"""{_PT},
f AS (SELECT prediction_id AS k, coalesce(type, 'unknown') AS scene_type, row_number() OVER (PARTITION BY prediction_id ORDER BY pos) - 1 AS i, ts, value AS gt, coalesce(c.pred, '') AS pred,
    {_placeholder('value')} AS gs, {_placeholder('c.pred')} AS ps FROM turns WHERE role = 'assistant')"""
_BAND = """cand AS (SELECT p.k, p.i, g.i AS j, abs(p.ts - g.ts) AS dt FROM f p JOIN f g ON p.k = g.k WHERE NOT p.ps AND NOT g.gs AND abs(p.ts - g.ts) <= 2.0)"""
_GREEDY = """n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY dt, i, j) AS r FROM cand),
w AS (SELECT k, r, i, j, TRUE AS took, [i] AS ui, [j] AS uj FROM n WHERE r = 1
    UNION ALL SELECT n.k, n.r, n.i, n.j, NOT (list_contains(w.ui, n.i) OR list_contains(w.uj, n.j)),
        CASE WHEN list_contains(w.ui, n.i) OR list_contains(w.uj, n.j) THEN w.ui ELSE list_append(w.ui, n.i) END,
        CASE WHEN list_contains(w.ui, n.i) OR list_contains(w.uj, n.j) THEN w.uj ELSE list_append(w.uj, n.j) END
    FROM w JOIN n ON n.k = w.k AND n.r = w.r + 1),
m AS (SELECT k, i, j FROM w WHERE took)"""
_SCORE = """CASE WHEN lower(response) = lower(answer) THEN 5.0 ELSE CAST(floor(least(length(response), length(answer)) * 5 / greatest(length(response), length(answer), 1)) AS DOUBLE) END"""
_EVENTS = f"""{_FRAMES}, {_BAND}, {_GREEDY},
e AS (SELECT f.k, f.scene_type, f.i, f.ts, f.pred AS response, CASE WHEN NOT f.ps AND m.i IS NOT NULL THEN g.gt ELSE f.gt END AS answer,
    CASE WHEN NOT f.ps AND m.i IS NOT NULL THEN 'PartlyCorrect'
         WHEN NOT f.ps AND NOT EXISTS (SELECT 1 FROM cand c WHERE c.k = f.k AND c.i = f.i) THEN 'FalseAlarm'
         WHEN f.ps AND f.gs THEN 'CorrectSilent'
         WHEN f.ps AND a.j IS NULL THEN 'NoResponse' END AS category
    FROM f LEFT JOIN m ON m.k = f.k AND m.i = f.i LEFT JOIN f g ON g.k = f.k AND g.i = m.j LEFT JOIN m a ON a.k = f.k AND a.j = f.i),
ev AS (SELECT k, scene_type, i, ts, answer, response, category,
    CASE category WHEN 'CorrectSilent' THEN 100.0 WHEN 'PartlyCorrect' THEN 20.0 * {_SCORE} ELSE 0.0 END AS score FROM e WHERE category IS NOT NULL)"""
# Frames of the alignment stage with their segments and positions.
_SEG = f"""{_PT},
a AS (SELECT prediction_id AS k, row_number() OVER (PARTITION BY prediction_id ORDER BY pos) - 1 AS ord, ts, {_aligned('c.pred')} AS gen, coalesce({_aligned('value')}, '') AS ref FROM turns WHERE role = 'assistant'),
b AS (SELECT * FROM a WHERE gen IS NOT NULL AND ts IS NOT NULL),
r AS (SELECT k, ts, lag(ts) OVER (PARTITION BY k ORDER BY ts, ord) AS prev FROM b WHERE ref <> ''),
mid AS (SELECT k, (ts + prev) / 2 AS border FROM r WHERE prev IS NOT NULL),
u AS (SELECT k, ts, ord, gen, ref, 0 AS is_mid FROM b UNION ALL SELECT k, border, -1, NULL, NULL, 1 FROM mid),
s AS (SELECT *, sum(is_mid) OVER (PARTITION BY k ORDER BY ts, is_mid DESC, ord ROWS UNBOUNDED PRECEDING) AS seg FROM u),
fr AS (SELECT k, seg, row_number() OVER (PARTITION BY k, seg ORDER BY ts, ord) - 1 AS pos, ts, gen, ref FROM s WHERE is_mid = 0)"""
_VEC = "vec AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_PICK = "CAST(('0x' || substr(md5({x}), 1, 8)) AS BIGINT) % (SELECT count(*) FROM embeddings)"
_COST = f"""{_SEG}, {_VEC},
p AS (SELECT g.k, g.seg, g.pos AS i, r.pos AS j, g.gen, r.ref, g.ts AS gen_ts, r.ts AS ref_ts FROM fr g JOIN fr r ON g.k = r.k AND g.seg = r.seg WHERE g.gen <> '' AND r.ref <> ''),
cost AS (SELECT p.*, 1 - abs(list_cosine_similarity(x.v, y.v)) AS text_cost, 1 - exp(-0.01 * power(i - j, 2)) AS distance_cost
    FROM p JOIN vec x ON x.vec_id = {_PICK.format(x='p.gen')} JOIN vec y ON y.vec_id = {_PICK.format(x='p.ref')})"""


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "predictions")


# ---- text and numbers --------------------------------------------------------------------------------------

_D_QUOTED = f"""regexp_replace(regexp_replace({_strip('t')}, '^"+|"+$', '', 'g'), '^''+|''+$', '', 'g')"""
_D_TEST = _strip("regexp_replace(" + _strip(_D_QUOTED) + ", '[.!。！ ]+$', '')")


@query(f"""WITH {_PT}, d AS (SELECT DISTINCT c.pred AS t FROM turns WHERE role = 'assistant')
    SELECT t AS text, coalesce(({_aligned('t')}) = '', FALSE) AS aligned, {_placeholder('t')} AS stream,
        {_placeholder('t', silence.PLACEHOLDERS_MATCHED)} AS matched, coalesce(lower({_D_TEST}) = 'silent', TRUE) AS replayed FROM d""")
def silence_tests(spark, sf_dir):
    """The four tests of silence on every distinct pred."""
    t = turns(_predictions(spark, sf_dir)).where("role = 'assistant'").select(F.col("pred").alias("text")).distinct()
    x = F.col("text")
    return t.select("text", F.coalesce(silence.is_silent_aligned(x), F.lit(False)).alias("aligned"), silence.is_placeholder(x).alias("stream"),
                    silence.is_placeholder(x, silence.PLACEHOLDERS_MATCHED).alias("matched"), silence.is_silent_reply(x).alias("replayed"))


@query(r"""SELECT sample_id, regexp_replace(videos[1], '(\.[^./\\]*)?$', '') || '_' || endpoint_timestamp || '_' || (endpoint_timestamp + 1) || regexp_extract(videos[1], '(\.[^./\\]*)?$') AS path
    FROM samples WHERE len(videos) > 0 AND endpoint_timestamp IS NOT NULL""")
def path_suffix(spark, sf_dir):
    """An interval put before the extension."""
    s = table(spark, sf_dir, "samples").where("size(videos) > 0 and endpoint_timestamp is not null")
    return s.select("sample_id", paths.with_interval(F.col("videos")[0], F.col("endpoint_timestamp"), F.col("endpoint_timestamp") + 1).alias("path"))


@query(rf"""WITH s AS (SELECT chunk_id, string_split({_STEM.format(p="trim(path)")}, '_') AS x FROM chunks), y AS (SELECT chunk_id, try_cast(x[-2] AS INTEGER) AS a, try_cast(x[-1] AS INTEGER) AS b FROM s)
    SELECT chunk_id, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a ELSE 0 END AS "start", CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN b ELSE 0 END AS "end" FROM y""")
def parse_interval(spark, sf_dir):
    """The interval in a clip's name; (0, 0) where there is none."""
    p = paths.interval_pair(F.col("path"))
    return table(spark, sf_dir, "chunks").select("chunk_id", p["start"].alias("start"), p["end"].alias("end"))


@query(rf"""SELECT session_id, coalesce(nullif({_STEM.format(p='videos[1]')}, ''), nullif(video_id, ''), 'sample_' || lpad(CAST(session_id AS VARCHAR), 6, '0')) || '.json' AS name FROM annotations""")
def output_names(spark, sf_dir):
    """The output file of a session."""
    return table(spark, sf_dir, "annotations").select("session_id", sampling.output_name(F.col("videos"), F.col("video_id"), F.col("session_id")).alias("name"))


@query(f"""WITH {_AT} SELECT rid AS k, CAST(trunc(ts) AS INTEGER) AS t, string_agg(value, ' ' ORDER BY pos) AS said, count(*) AS n FROM turns
    WHERE role = 'assistant' AND ts IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 1""".replace("rid AS k", "session_id").replace("GROUP BY 1, 2", "GROUP BY rid, session_id, CAST(trunc(ts) AS INTEGER)"))
def same_second_answers(spark, sf_dir):
    """The answers of one second, joined in their order."""
    a = table(spark, sf_dir, "annotations").select("session_id", F.expr("filter(conversations, c -> c.from = 'assistant' and c.timestamp is not null)").alias("c"))
    a = a.select("session_id", "c", F.explode(F.expr("array_distinct(transform(c, x -> cast(x.timestamp as int)))")).alias("t"))
    own = "filter(c, x -> cast(x.timestamp as int) = t)"
    return a.select("session_id", "t", F.expr(f"array_join(transform({own}, x -> x.value), ' ')").alias("said"), F.expr(f"cast(size({own}) as bigint)").alias("n"))


@query("""SELECT video, seconds, CASE WHEN seconds > 0 THEN CAST(ceil(seconds / 5) AS INTEGER) ELSE 0 END AS n_chunks, round(1 - exp(-0.01 * power(seconds, 2)), 9) AS cost,
    CASE WHEN seconds IS NOT NULL THEN greatest(0.0, least(5.0, seconds / 20)) * 20 END AS points FROM durations""")
def numeric_functions(spark, sf_dir):
    """M1, M4, M6: distance cost, clamped points, chunk counts."""
    s = F.col("seconds")
    return table(spark, sf_dir, "durations").select("video", "seconds", numbers.chunk_count(s, 5).alias("n_chunks"),
                                                    F.round(numbers.distance_cost(s, F.lit(0.0)), 9).alias("cost"),
                                                    numbers.judge_points(s / 20).alias("points"))


@query("""WITH x AS (SELECT sample_id, CASE sample_id % 6 WHEN 0 THEN '{"explanation": "fine", "score": ' || (sample_id % 9 - 1) || '}' WHEN 1 THEN '```json {"score": "' || (sample_id % 5) || '.5"} ```'
        WHEN 2 THEN 'no score here' WHEN 3 THEN NULL WHEN 4 THEN '{"explanation": "text", "score": "high"}' ELSE 'Sure: {"score": ' || (sample_id % 7) || ', "explanation": "a"}' END AS r FROM samples),
    s AS (SELECT sample_id, r, CASE sample_id % 6 WHEN 0 THEN CAST(sample_id % 9 - 1 AS DOUBLE) WHEN 1 THEN sample_id % 5 + 0.5 WHEN 5 THEN CAST(sample_id % 7 AS DOUBLE) END AS n FROM x)
    SELECT sample_id, CASE WHEN n IS NULL THEN 0.0 ELSE greatest(0.0, least(5.0, n)) * 20 END AS points, CASE sample_id % 6 WHEN 0 THEN 'fine' WHEN 1 THEN '' WHEN 5 THEN 'a' ELSE 'unreadable reply' END AS explanation FROM s""")
def judge_replies(spark, sf_dir):
    """Scores read from JSON replies, plain, fenced, quoted and broken."""
    k = F.col("sample_id")
    text = lambda x: x.cast("string")
    r = (F.when(k % 6 == 0, F.concat(F.lit('{"explanation": "fine", "score": '), text(k % 9 - 1), F.lit("}")))
         .when(k % 6 == 1, F.concat(F.lit('```json {"score": "'), text(k % 5), F.lit('.5"} ```'))).when(k % 6 == 2, F.lit("no score here")).when(k % 6 == 3, F.lit(None))
         .when(k % 6 == 4, F.lit('{"explanation": "text", "score": "high"}')).otherwise(F.concat(F.lit('Sure: {"score": '), text(k % 7), F.lit(', "explanation": "a"}'))))
    v = judge_reply(r)
    return table(spark, sf_dir, "samples").select("sample_id", numbers.judge_points(v["score"]).alias("points"), v["explanation"].alias("explanation"))


@query(f"""WITH {_PT}, q AS (SELECT prediction_id, first_value(value) OVER (PARTITION BY prediction_id ORDER BY pos) AS question, row_number() OVER (PARTITION BY prediction_id ORDER BY pos) AS n FROM turns WHERE role = 'user')
    SELECT t.prediction_id, t.pos, md5('Rate from 0 to 5 how well the given answer does what the right answer does. Reply as JSON with the keys explanation and score.' || chr(10) || 'Question: ' || coalesce(q.question, '') || chr(10) ||
        'Given answer: ' || coalesce(t.c.pred, '') || chr(10) || 'Right answer: ' || coalesce(t.value, '') || chr(10)) AS digest
    FROM turns t LEFT JOIN q ON q.prediction_id = t.prediction_id AND q.n = 1 WHERE t.role = 'assistant'""")
def judge_prompts(spark, sf_dir):
    """A judge's prompt for every reply (as digest)."""
    p = _predictions(spark, sf_dir).withColumn("question", classify.question())
    return turns(p, "prediction_id", "question").where("role = 'assistant'").select(
        "prediction_id", "pos", F.md5(messages.judge_prompt(F.col("question"), F.col("pred"), F.col("value"))).alias("digest"))


# ---- sampling ----------------------------------------------------------------------------------------------

_BOUNDS = f"""{_AT}, says AS (SELECT rid, session_id, min(CAST(trunc(ts) AS INTEGER)) AS f, max(CAST(trunc(ts) AS INTEGER)) AS l FROM turns WHERE role = 'assistant' AND ts IS NOT NULL GROUP BY rid, session_id),
asks AS (SELECT rid, min(CAST(trunc(ts) AS INTEGER)) AS f FROM turns WHERE role = 'user' AND value IS DISTINCT FROM '<video>' AND ts IS NOT NULL GROUP BY rid),
bo AS (SELECT s.rid, s.session_id, coalesce(a.f, s.f) AS start_t, s.l AS last_t FROM says s LEFT JOIN asks a ON a.rid = s.rid)"""
_SECONDS = f"""{_BOUNDS}, du AS (SELECT video, max(seconds) AS d FROM durations GROUP BY video),
en AS (SELECT bo.*, last_t + CASE WHEN d > 0 THEN least(10 + (bo.session_id * 7) % 6, greatest(0, CAST(trunc(d) AS INTEGER) - last_t)) ELSE 10 + (bo.session_id * 7) % 6 END AS end_t
    FROM bo JOIN (SELECT rid, max(regexp_replace(videos[1], '^.*/', '')) AS file FROM turns GROUP BY rid) v ON v.rid = bo.rid LEFT JOIN du ON du.video = v.file),
se AS (SELECT rid, session_id, unnest(generate_series(start_t, end_t)) AS t FROM en WHERE start_t <= end_t)"""


@query(f"WITH {_BOUNDS} SELECT session_id, start_t, last_t FROM bo")
def session_bounds(spark, sf_dir):
    """AG16, F1: first and last second of every session."""
    return sampling.bounds(table(spark, sf_dir, "annotations"), "session_id").drop("says")


@query(f"""WITH {_SECONDS} SELECT se.session_id, se.t, CASE WHEN count(a.pos) > 0 THEN 1 ELSE 2 END AS sample_type, CASE WHEN count(a.pos) > 0 THEN string_agg(a.value, ' ' ORDER BY a.pos) ELSE 'Silent' END AS target,
    (SELECT count(*) FROM turns h WHERE h.rid = se.rid AND (h.ts IS NULL OR trunc(h.ts) <= se.t)) AS n_history
    FROM se LEFT JOIN turns a ON a.rid = se.rid AND a.role = 'assistant' AND trunc(a.ts) = se.t GROUP BY se.rid, se.session_id, se.t""")
def per_second_samples(spark, sf_dir):
    """W3, A1-A3, M7, JN1: every sampled second with its target and the turns before it."""
    s = sampling.seconds(table(spark, sf_dir, "annotations"), "session_id", "videos", "conversations", durations=table(spark, sf_dir, "durations"))
    return s.select("session_id", "t", "sample_type", sampling.target().alias("target"), F.size(sampling.history()).cast("bigint").alias("n_history"))


@query(f"""WITH {_SECONDS}, ch AS (SELECT rid, session_id, t, unnest(generate_series(greatest(0, t - 60), t - 1)) AS s FROM se WHERE t > 0)
    SELECT session_id, t, count(*) AS n_chunks, min(s) AS first_start, max(s) + 1 AS last_end FROM ch GROUP BY rid, session_id, t""")
def rolling_chunks(spark, sf_dir):
    """W1, JN2, ST4: the chunks of each second's rolling window."""
    s = sampling.seconds(table(spark, sf_dir, "annotations"), "session_id", "videos", "conversations", durations=table(spark, sf_dir, "durations"))
    v = s.where("t > 0").withColumn("v", sampling.window_chunks())
    return v.where("size(v) > 0").select("session_id", "t", F.size("v").cast("bigint").alias("n_chunks"), F.array_min("v")["start"].alias("first_start"),
                                         F.array_max(F.transform("v", lambda x: x["end"])).alias("last_end"))


_ASSEMBLED = f"""{_SECONDS}, tu AS (SELECT se.rid, se.session_id, se.t, h.pos, h.role, h.value, h.videos,
        greatest(0, se.t - 60, max(coalesce(CAST(trunc(h.ts) AS INTEGER), 0)) OVER (PARTITION BY se.rid, se.t ORDER BY h.pos)) AS m
        FROM se JOIN turns h ON h.rid = se.rid AND (h.ts IS NULL OR trunc(h.ts) <= se.t)),
    clip AS (SELECT rid, session_id, t, unnest(generate_series(greatest(0, t - 60), t - 1)) AS s FROM se WHERE t > 0 AND rid IN (SELECT rid FROM turns WHERE len(videos) > 0)),
    it AS (SELECT rid, session_id, t, m AS k1, 1 AS k2, pos AS k3, role, value FROM tu UNION ALL SELECT rid, session_id, t, s + 1, 0, 0, 'user', '<video>' FROM clip
        UNION ALL SELECT rid, session_id, t, -1, 0, 0, 'system', 'watch' FROM se
        UNION ALL SELECT rid, session_id, t, t, 2, 0, 'assistant', 'Silent' FROM se WHERE NOT EXISTS (SELECT 1 FROM turns a WHERE a.rid = se.rid AND a.role = 'assistant' AND trunc(a.ts) = se.t))"""


@query(f"""WITH {_ASSEMBLED} SELECT session_id, t, count(*) AS n_items, md5(string_agg(role || ':' || coalesce(value, '<null>'), '|' ORDER BY k1, k2, k3)) AS digest FROM it GROUP BY rid, session_id, t""")
def assembled_samples(spark, sf_dir):
    """A3, W1, ST2: every sample as a model is asked, its system turn, turns and <video> turns in their order, and its target (as digest)."""
    s = sampling.assembled(table(spark, sf_dir, "annotations"), "session_id", system="watch", durations=table(spark, sf_dir, "durations"))
    text = F.array_join(F.transform("conversations", lambda c: F.concat(c["from"], F.lit(":"), F.coalesce(c["value"], F.lit("<null>")))), "|")
    return s.select("session_id", F.col("endpoint_timestamp").alias("t"), F.size("conversations").cast("bigint").alias("n_items"), F.md5(text).alias("digest"))


@query(f"""WITH {_ASSEMBLED}, v AS (SELECT DISTINCT rid, videos[1] AS p FROM turns) SELECT c.session_id, c.t, count(*) AS n_clips,
        md5(string_agg(regexp_replace(p, '(\\.[^./\\\\]*)?$', '') || '_' || s || '_' || (s + 1) || regexp_extract(p, '(\\.[^./\\\\]*)?$'), '|' ORDER BY s)) AS digest
    FROM clip c JOIN v ON v.rid = c.rid GROUP BY c.rid, c.session_id, c.t""")
def assembled_clips(spark, sf_dir):
    """The clips that belong to the <video> turns, in their order (as digest)."""
    s = sampling.assembled(table(spark, sf_dir, "annotations"), "session_id", durations=table(spark, sf_dir, "durations")).where("size(videos) > 0")
    return s.select("session_id", F.col("endpoint_timestamp").alias("t"), F.size("videos").cast("bigint").alias("n_clips"), F.md5(F.array_join("videos", "|")).alias("digest"))


@query("""WITH k AS (SELECT video, unnest(generate_series(0, CAST(ceil(seconds) AS INTEGER) - 1)) AS k FROM durations WHERE seconds > 0) SELECT video, k AS "start", k + 1 AS "end" FROM k""")
def dense_chunks(spark, sf_dir):
    """W2, M6, ST5: the grid of one-second chunks of every probed video."""
    return sampling.dense_chunks(table(spark, sf_dir, "durations"))


@query(f"""WITH good AS (SELECT DISTINCT {_CLIP.format(p='path')} AS clip FROM chunks WHERE valid AND n_bytes > 0), named AS (SELECT sample_id, {_CLIP.format(p='p')} AS clip FROM (SELECT sample_id, unnest(videos) AS p FROM samples)),
    bad AS (SELECT DISTINCT n.sample_id FROM named n LEFT JOIN good g ON g.clip = n.clip WHERE g.clip IS NULL)
    SELECT sample_id FROM samples WHERE len(videos) > 0 AND sample_id NOT IN (SELECT sample_id FROM bad)""")
def validated_samples(spark, sf_dir):
    """F3, JN8, A10: samples all of whose clips have an intact file."""
    return sampling.validated(table(spark, sf_dir, "samples").select("sample_id", "videos"), table(spark, sf_dir, "chunks").select("path", "valid", "n_bytes")).select("sample_id")


@query("SELECT coalesce(sample_type, 0) AS sample_type, count(*) AS n_samples, count(DISTINCT session_id) AS n_sessions FROM samples GROUP BY coalesce(sample_type, 0)")
def speak_counts(spark, sf_dir):
    """AG13: samples by kind. Sessions are counted over distinct pairs, so no kind is one task's work."""
    pairs = table(spark, sf_dir, "samples").groupBy(F.coalesce("sample_type", F.lit(0)).alias("sample_type"), "session_id").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("sample_type").agg(F.sum("n").alias("n_samples"), F.count("session_id").alias("n_sessions"))


@query("SELECT valid, count(*) AS n_files, sum(n_bytes) AS n_bytes, count(CASE WHEN n_bytes = 0 THEN 1 END) AS n_empty FROM chunks GROUP BY valid")
def chunk_totals(spark, sf_dir):
    """AG15, F7: files and bytes by validity."""
    return table(spark, sf_dir, "chunks").groupBy("valid").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_bytes").alias("n_bytes"), F.count_if(F.col("n_bytes") == 0).alias("n_empty"))


# ---- merging and requests ----------------------------------------------------------------------------------

_PAIR = f"(SELECT sample_id, string_split({_STEM.format(p='videos[-1]')}, '_') AS x FROM samples)"


@query(f"""WITH {_ST}, la AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY pos DESC) AS n FROM turns WHERE role = 'assistant' AND value IS NOT NULL),
    fu AS (SELECT sample_id, session_id, value, row_number() OVER (PARTITION BY sample_id ORDER BY pos) AS n FROM turns WHERE role = 'user' AND value IS DISTINCT FROM '<video>'),
    fs AS (SELECT session_id, min(sample_id) AS sample_id FROM samples GROUP BY session_id), q AS (SELECT fs.session_id, fu.value FROM fs LEFT JOIN fu ON fu.sample_id = fs.sample_id AND fu.n = 1),
    pr AS (SELECT sample_id, try_cast(x[-2] AS INTEGER) AS a, try_cast(x[-1] AS INTEGER) AS b FROM {_PAIR})
    SELECT la.session_id, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a ELSE 0 END AS "start", CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN b ELSE 0 END AS "end", la.sample_id,
        coalesce(la.ts, la.endpoint_timestamp) AS timestamp, la.value AS text, s.sample_type, q.value AS question
    FROM la JOIN samples s ON s.sample_id = la.sample_id LEFT JOIN pr ON pr.sample_id = la.sample_id LEFT JOIN q ON q.session_id = la.session_id WHERE la.n = 1""")
def merged_samples(spark, sf_dir):
    """AG17, W5, A4, A5: each session's samples as turns in the order of their clips."""
    return merge.merged_turns(table(spark, sf_dir, "samples"), "session_id", "sample_id", "value")


_GAPS = f"""{_PT}, g AS (SELECT prediction_id, pos, role, value, CASE WHEN role = 'user' AND lag(role) OVER (PARTITION BY prediction_id ORDER BY pos) = 'user' THEN 0 ELSE 1 END AS fresh FROM turns WHERE role IN ('user', 'assistant')),
    h AS (SELECT *, sum(fresh) OVER (PARTITION BY prediction_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS msg FROM g)"""


@query(f"""WITH {_GAPS} SELECT prediction_id, msg - 1 AS msg, min(role) AS role, count(*) AS n_parts, md5(string_agg(coalesce(value, '<null>'), '|' ORDER BY pos)) AS digest FROM h GROUP BY prediction_id, msg""")
def merged_messages(spark, sf_dir):
    """A7, ST3c: turns as request messages, adjacent user turns in one."""
    m = _predictions(spark, sf_dir).select("prediction_id", messages.parts("conversations", "array()", 10).alias("m")).select("prediction_id", F.posexplode(messages.merged("m")).alias("msg", "x"))
    return m.select("prediction_id", F.col("msg").cast("bigint").alias("msg"), F.col("x.role").alias("role"), F.size("x.parts").cast("bigint").alias("n_parts"),
                    F.md5(F.array_join(F.transform("x.parts", lambda p: F.coalesce(p["text"], F.lit("<null>"))), "|")).alias("digest"))


@query(f"""WITH {_ST}, v AS (SELECT sample_id, unnest(videos) AS p, unnest(generate_series(1, len(videos))) AS n, len(videos) AS c FROM samples)
    SELECT sample_id, count(*) AS n_clips, string_agg(p, '|' ORDER BY n) AS clips FROM v WHERE n > c - 3 GROUP BY sample_id""".replace(_ST + ", ", ""))
def last_clips(spark, sf_dir):
    """A request keeps the last k clips of its sample (k = 3 here)."""
    s = table(spark, sf_dir, "samples").where("size(videos) > 0")
    conv = F.expr("transform(videos, v -> named_struct('from', 'user', 'value', '<video>'))")
    m = s.select("sample_id", "videos", conv.alias("conv")).withColumn("m", messages.parts("conv", "videos", 3))
    return m.select("sample_id", F.size("m").cast("bigint").alias("n_clips"), F.array_join(F.transform("m", lambda x: x["parts"][0]["text"]), "|").alias("clips"))


@query(f"""WITH {_ST}, la AS (SELECT sample_id, value, row_number() OVER (PARTITION BY sample_id ORDER BY pos DESC) AS n FROM turns WHERE role = 'assistant') SELECT sample_id, value AS text FROM la WHERE n = 1""")
def last_turns(spark, sf_dir):
    """A4: the target turn of every sample."""
    return table(spark, sf_dir, "samples").select("sample_id", last_assistant().alias("c")).where("c is not null").select("sample_id", F.col("c.value").alias("text"))


@query(f"""WITH {_PT}, a AS (SELECT prediction_id, pos, CAST(trunc(ts) AS INTEGER) AS t FROM turns WHERE role = 'assistant' AND ts IS NOT NULL)
    SELECT a.prediction_id, a.t, count(u.pos) AS n_released, max(u.ts) AS latest FROM a LEFT JOIN turns u ON u.prediction_id = a.prediction_id AND u.role = 'user' AND u.ts IS NOT NULL AND trunc(u.ts) <= a.t GROUP BY a.prediction_id, a.pos, a.t""")
def released_instructions(spark, sf_dir):
    """JN10: at every turn, the instructions released so far and the time of the latest."""
    asked = "filter(conversations, u -> u.from = 'user' and u.timestamp is not null and cast(u.timestamp as int) <= t)"
    a = _predictions(spark, sf_dir).select("prediction_id", "conversations", F.explode(F.expr("filter(conversations, c -> c.from = 'assistant' and c.timestamp is not null)")).alias("c")).withColumn("t", F.col("c.timestamp").cast("int"))
    return a.select("prediction_id", "t", F.expr(f"cast(size({asked}) as bigint)").alias("n_released"), F.expr(f"array_max(transform({asked}, u -> u.timestamp))").alias("latest"))


@query("SELECT a.session_id, a.video_id FROM annotations a WHERE a.session_id % 2 = 0 AND EXISTS (SELECT 1 FROM predictions p WHERE p.session_id = a.session_id)")
def subset_sessions(spark, sf_dir):
    """JN7, SC8: sessions on a list (here: the even ones that have predictions)."""
    listed = _predictions(spark, sf_dir).where("session_id % 2 = 0").select(F.col("session_id").cast("string").alias("line"))
    a = table(spark, sf_dir, "annotations").select("session_id", "video_id", F.col("session_id").cast("string").alias("key"))
    return merge.in_subset(a, listed, "key").drop("key")


@query("SELECT a.session_id FROM annotations a WHERE NOT EXISTS (SELECT 1 FROM predictions p WHERE p.session_id = a.session_id)")
def resume_sessions(spark, sf_dir):
    """JN9, SK11: sessions that no finished output has."""
    return merge.not_done(table(spark, sf_dir, "annotations").select("session_id"), _predictions(spark, sf_dir), "session_id")


@query("""WITH a AS (SELECT coalesce(video_id, '') AS n, min(session_id) AS o, arg_max(coalesce(type, 'unknown'), session_id) AS v FROM (SELECT session_id, any_value(video_id) AS video_id, any_value(type) AS type FROM annotations GROUP BY session_id) GROUP BY coalesce(video_id, '')),
    k AS (SELECT DISTINCT video FROM durations), j AS (SELECT k.video, a.v, row_number() OVER (PARTITION BY k.video ORDER BY a.o) AS r FROM k JOIN a ON contains(k.video, a.n) OR contains(a.n, k.video))
    SELECT k.video, j.v AS scene FROM k LEFT JOIN j ON j.video = k.video AND j.r = 1""".replace("(SELECT session_id, any_value(video_id) AS video_id, any_value(type) AS type FROM annotations GROUP BY session_id)", "(SELECT session_id, max(video_id) AS video_id, max(type) AS type FROM annotations GROUP BY session_id)"))
def contained_names(spark, sf_dir):
    """JN5, S12: the first session whose name is in the video's name, or the other way round."""
    a = table(spark, sf_dir, "annotations").groupBy("session_id").agg(F.max("video_id").alias("video_id"), F.max("type").alias("type"))
    a = a.select("session_id", "video_id", F.coalesce("type", F.lit("unknown")).alias("scene"))
    return merge.first_containing(table(spark, sf_dir, "durations").select("video").distinct(), "video", a, "video_id", "session_id", "scene")


# ---- alignment ---------------------------------------------------------------------------------------------


def _segmented(spark, sf_dir) -> DataFrame:
    return segment.segmented(_predictions(spark, sf_dir), "prediction_id")


def _vectors(spark, sf_dir, frames: DataFrame) -> DataFrame:
    texts = frames.select(F.explode(F.array("gen", "ref")).alias("text")).where("text <> ''")
    return table_embeddings(texts, table(spark, sf_dir, "embeddings"))


@query(f"WITH {_SEG} SELECT k AS prediction_id, seg, pos, ts, gen, ref FROM fr")
def segments(spark, sf_dir):
    """Frames with their segment and position."""
    return _segmented(spark, sf_dir)


@query(f"WITH {_COST} SELECT k AS prediction_id, seg, i, j, round(text_cost, 6) AS text_cost, round(distance_cost, 6) AS distance_cost, round(text_cost + distance_cost, 6) AS total FROM cost")
def match_costs(spark, sf_dir):
    """M1-M3, AS1-AS3, JN4, D10: costs of talking frames against talking references."""
    f = written(_segmented(spark, sf_dir), "frames")
    c = assign.pair_costs(f, "prediction_id", _vectors(spark, sf_dir, f))
    return c.select("prediction_id", "seg", "i", "j", F.round("text_cost", 6).alias("text_cost"), F.round("distance_cost", 6).alias("distance_cost"),
                    F.round(F.col("text_cost") + F.col("distance_cost"), 6).alias("total"))


def _matched(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    f = written(_segmented(spark, sf_dir), "frames")
    return f, written(assign.match(f, "prediction_id", _vectors(spark, sf_dir, f)), "match")


@query(f"""WITH {_COST}, one AS (SELECT k, seg FROM fr GROUP BY k, seg HAVING count(CASE WHEN ref <> '' THEN 1 END) = 1 AND count(CASE WHEN ref <> '' AND gen <> '' THEN 1 END) = 0),
    best AS (SELECT cost.*, row_number() OVER (PARTITION BY cost.k, cost.seg ORDER BY text_cost + distance_cost, i) AS n FROM cost JOIN one ON one.k = cost.k AND one.seg = cost.seg)
    SELECT k AS prediction_id, seg, i, j, round(text_cost + distance_cost, 6) AS cost, round(1 - text_cost, 6) AS score FROM best WHERE n = 1 AND text_cost + distance_cost <= 1""")
def assigned_free(spark, sf_dir):
    """AS4, AS5 where the reference's own frame is silent: the winner of each segment."""
    f, m = _matched(spark, sf_dir)
    one = f.groupBy("prediction_id", "seg").agg(F.count_if(F.col("ref") != "").alias("r"), F.count_if((F.col("ref") != "") & (F.col("gen") != "")).alias("b")).where("r = 1 and b = 0")
    return m.where("kind = 'matched'").join(one, ["prediction_id", "seg"], "left_semi").select("prediction_id", "seg", "i", "j", F.round("cost", 6).alias("cost"), F.round("score", 6).alias("score"))


@query(f"""WITH {_COST}, sz AS (SELECT k, seg, count(CASE WHEN gen <> '' THEN 1 END) AS talks FROM fr GROUP BY k, seg HAVING count(CASE WHEN ref <> '' THEN 1 END) > 0),
    w AS (SELECT t.k, t.seg, sz.talks, t.pos AS i, c.pos AS c, c.ref <> '' AS is_ref, coalesce(cost.text_cost, 1.0) AS tc, coalesce(cost.text_cost, 1.0) + 1 - exp(-0.01 * power(t.pos - c.pos, 2)) AS w
        FROM fr t JOIN sz ON sz.k = t.k AND sz.seg = t.seg AND sz.talks <= 2 JOIN fr c ON c.k = t.k AND c.seg = t.seg LEFT JOIN cost ON cost.k = t.k AND cost.seg = t.seg AND cost.i = t.pos AND cost.j = c.pos WHERE t.gen <> ''),
    one AS (SELECT k, seg, arg_min(struct_pack(i := i, c := c), w) AS a, NULL AS b FROM w WHERE talks = 1 GROUP BY k, seg),
    two AS (SELECT x.k, x.seg, struct_pack(i := x.i, c := x.c) AS a, struct_pack(i := y.i, c := y.c) AS b FROM w x JOIN w y ON x.k = y.k AND x.seg = y.seg AND x.i < y.i AND x.c <> y.c WHERE x.talks = 2
        QUALIFY row_number() OVER (PARTITION BY x.k, x.seg ORDER BY round(x.w + y.w, 9), x.is_ref DESC) = 1),
    took AS (SELECT k, seg, a.i AS i, a.c AS c FROM one UNION ALL SELECT k, seg, a.i, a.c FROM two UNION ALL SELECT k, seg, b.i, b.c FROM two),
    m AS (SELECT w.k, w.seg, w.i, w.c, w.is_ref, w.tc, w.w FROM took JOIN w ON w.k = took.k AND w.seg = took.seg AND w.i = took.i AND w.c = took.c)
    SELECT k AS prediction_id, seg, 'matched' AS kind, i, c AS j, round(w, 6) AS cost, round(1 - tc, 6) AS score FROM m WHERE is_ref
    UNION ALL SELECT k, seg, 'redundant', i, NULL, NULL, NULL FROM m WHERE NOT is_ref
    UNION ALL SELECT f.k, f.seg, 'missed', NULL, f.pos, NULL, NULL FROM fr f JOIN sz ON sz.k = f.k AND sz.seg = f.seg AND sz.talks <= 2 WHERE f.ref <> '' AND NOT EXISTS (SELECT 1 FROM m WHERE m.k = f.k AND m.seg = f.seg AND m.c = f.pos)""")
def assigned_small(spark, sf_dir):
    """AS4, AS5 against enumeration: the whole match of the segments that have references and at most two talking frames,
    displaced frames and several references at one time included. At equal cost the earlier frame takes the reference."""
    f, m = _matched(spark, sf_dir)
    few = f.groupBy("prediction_id", "seg").agg(F.count_if(F.col("ref") != "").alias("r"), F.count_if(F.col("gen") != "").alias("g")).where("r > 0 and g <= 2")
    return m.join(few, ["prediction_id", "seg"], "left_semi").select("prediction_id", "seg", "kind", "i", "j", F.round("cost", 6).alias("cost"), F.round("score", 6).alias("score"))


@query()
def assigned(spark, sf_dir):
    """AS4, AS5, JN6, JN11, D9: the whole match table."""
    return _matched(spark, sf_dir)[1]


@query(f"""WITH {_SEG} SELECT k AS prediction_id, count(CASE WHEN gen <> '' THEN 1 END) AS talking, count(CASE WHEN ref <> '' THEN 1 END) AS refs FROM fr GROUP BY k HAVING count(CASE WHEN gen <> '' OR ref <> '' THEN 1 END) > 0""")
def assigned_totals(spark, sf_dir):
    """Matched and redundant frames are all talking ones; matched and missed are all talking references."""
    m = _matched(spark, sf_dir)[1]
    return m.groupBy("prediction_id").agg(F.count_if(F.col("kind").isin("matched", "redundant")).alias("talking"), F.count_if(F.col("kind").isin("matched", "missed")).alias("refs"))


@query()
def prf_per_key(spark, sf_dir):
    """AG1-AG7: precision, recall, F1 and the other measures of every prediction."""
    return metrics.prf(_matched(spark, sf_dir)[1], "prediction_id")


@query()
def prf_macro(spark, sf_dir):
    """AG8: the measures' means over predictions."""
    return metrics.macro(prf_per_key(spark, sf_dir))


# A match table that SQL can make too: the nearest talking frame takes each talking reference frame of the frames tables.
_NEAR = """g AS (SELECT session_id AS k, gen_id AS i, coalesce(timestamp_in_stream, frame_idx_in_stream) AS ts FROM gen_frames WHERE gen IS NOT NULL AND lower(trim(gen)) NOT IN ('silent', '<|silent|>', '')),
r AS (SELECT session_id AS k, ref_id AS j, coalesce(timestamp_in_stream, frame_idx_in_stream) AS ts FROM ref_frames WHERE ref IS NOT NULL AND lower(trim(ref)) NOT IN ('silent', '<|silent|>', '')),
c AS (SELECT g.k, g.i, r.j, abs(g.ts - r.ts) AS dt, g.ts AS gts, r.ts AS rts FROM g JOIN r ON g.k = r.k WHERE abs(g.ts - r.ts) <= 3),
b AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY dt, j) AS n, row_number() OVER (PARTITION BY j ORDER BY dt, i) AS m FROM c),
mt AS (SELECT k, 'matched' AS kind, 1 / (1 + dt) AS score, gts, rts FROM b WHERE n = 1 AND m = 1
    UNION ALL SELECT k, 'redundant', NULL, ts, NULL FROM g WHERE i NOT IN (SELECT i FROM b WHERE n = 1 AND m = 1)
    UNION ALL SELECT k, 'missed', NULL, NULL, ts FROM r WHERE j NOT IN (SELECT j FROM b WHERE n = 1 AND m = 1))"""
_PRF = f"""WITH {_NEAR}, a AS (SELECT k, count(CASE WHEN kind = 'matched' THEN 1 END) AS m, count(CASE WHEN kind = 'missed' THEN 1 END) AS x, count(CASE WHEN kind = 'redundant' THEN 1 END) AS r, count(CASE WHEN score > 0.5 THEN 1 END) AS h,
    coalesce(sum(score), 0.0) AS s, coalesce(avg(CASE WHEN score >= 0.5 THEN score END), 0.0) AS sem, coalesce(avg(CASE WHEN score > 0.5 THEN abs(gts - rts) END), 0.0) AS td FROM mt GROUP BY k),
q AS (SELECT *, CASE WHEN m + r > 0 THEN s / (m + r) ELSE 0.0 END AS sp, CASE WHEN m + x > 0 THEN s / (m + x) ELSE 0.0 END AS sr, CASE WHEN m + r > 0 THEN h / (m + r) ELSE 0.0 END AS hp, CASE WHEN m + x > 0 THEN h / (m + x) ELSE 0.0 END AS hr FROM a),
per AS (SELECT k AS session_id, sp AS soft_precision, sr AS soft_recall, CASE WHEN sp + sr > 0 THEN 2 * sp * sr / (sp + sr) ELSE 0.0 END AS soft_f1, hp AS hard_precision, hr AS hard_recall, CASE WHEN hp + hr > 0 THEN 2 * hp * hr / (hp + hr) ELSE 0.0 END AS hard_f1,
    CASE WHEN m + x + r > 0 THEN h / (m + x + r) ELSE 0.0 END AS jaccard, CASE WHEN m + x > 0 THEN x / (m + x) ELSE 0.0 END AS missing_rate, CASE WHEN m + r > 0 THEN r / (m + r) ELSE 0.0 END AS redundant_rate, sem AS semantic_score, td AS time_diff,
    h AS n_matched, m - h AS n_mismatched, x AS n_missed, r AS n_redundant FROM q)"""


def _near_matches(spark, sf_dir) -> DataFrame:
    side = lambda name, text, key: table(spark, sf_dir, name).where(
        F.col(text).isNotNull() & ~F.lower(F.trim(text)).isin("silent", "<|silent|>", "")).select(
        F.col("session_id").alias("key"), F.col(f"{text}_id").alias(key), F.coalesce("timestamp_in_stream", "frame_idx_in_stream").alias("ts"))
    g, r = side("gen_frames", "gen", "i"), side("ref_frames", "ref", "j")
    c = greedy.band_pairs(g, r, 3.0)
    of_i = c.groupBy("i").agg(F.min(F.struct("dt", "j")).alias("bi")).select("i", F.col("bi.j").alias("j"), F.col("bi.dt").alias("dt"))
    of_j = c.groupBy("j").agg(F.min(F.struct("dt", "i")).alias("bj")).select("j", F.col("bj.i").alias("i"))
    both = of_i.join(of_j, ["i", "j"])
    m = (both.join(g.withColumnRenamed("ts", "gen_ts"), "i").join(r.select("j", F.col("ts").alias("ref_ts")), "j")
         .select("key", F.lit("matched").alias("kind"), (1 / (1 + F.col("dt"))).alias("score"), "gen_ts", "ref_ts", "i", "j"))
    none = F.lit(None).cast("double")
    extra = g.join(both, "i", "left_anti").select("key", F.lit("redundant").alias("kind"), none.alias("score"), F.col("ts").alias("gen_ts"), none.alias("ref_ts"))
    missed = r.join(both, "j", "left_anti").select("key", F.lit("missed").alias("kind"), none.alias("score"), none.alias("gen_ts"), F.col("ts").alias("ref_ts"))
    return m.drop("i", "j").unionByName(extra).unionByName(missed).withColumnRenamed("key", "session_id")


@query(_PRF + " SELECT * FROM per")
def frame_prf(spark, sf_dir):
    """AG1-AG7, F6 on frames that are each other's nearest."""
    return metrics.prf(_near_matches(spark, sf_dir), "session_id")


@query(_PRF + " SELECT " + ", ".join(f"avg({n}) AS avg_{n}" for n in metrics._METRICS) + ", count(*) AS n_keys FROM per")
def frame_prf_macro(spark, sf_dir):
    """AG8 on the same."""
    return metrics.macro(frame_prf(spark, sf_dir))


@query("""WITH g AS (SELECT session_id AS key, gen_id AS i, timestamp_in_stream AS ts FROM gen_frames), r AS (SELECT session_id AS key, ref_id AS j, timestamp_in_stream AS ts FROM ref_frames)
    SELECT g.key, i, j, round(abs(g.ts - r.ts), 6) AS dt FROM g JOIN r ON g.key = r.key WHERE abs(g.ts - r.ts) <= 2.0""")
def band_pairs(spark, sf_dir):
    """JN3: frames of a session at most two seconds apart."""
    g = table(spark, sf_dir, "gen_frames").select(F.col("session_id").alias("key"), F.col("gen_id").alias("i"), F.col("timestamp_in_stream").alias("ts"))
    r = table(spark, sf_dir, "ref_frames").select(F.col("session_id").alias("key"), F.col("ref_id").alias("j"), F.col("timestamp_in_stream").alias("ts"))
    return greedy.band_pairs(g, r, 2.0).withColumn("dt", F.round("dt", 6))


@query(f"WITH RECURSIVE {_FRAMES}, {_BAND}, {_GREEDY} SELECT k AS prediction_id, i, j FROM m")
def greedy_pairs(spark, sf_dir):
    """AS6, W7: greedy nearest-first matching of talking preds and references."""
    f = computed(_predictions(spark, sf_dir), "f", stream_frames(silence.PLACEHOLDERS_STREAM)).select("prediction_id", "f")
    f = greedy.with_candidates(f, "f", 2.0)
    return f.select("prediction_id", F.explode(greedy.matched("cand")).alias("x")).select("prediction_id", "x.i", "x.j")


# ---- events ------------------------------------------------------------------------------------------------


def _events(spark, sf_dir) -> DataFrame:
    return classify.events(_predictions(spark, sf_dir), "prediction_id", judge=classify.length_judge)


@query(f"WITH RECURSIVE {_EVENTS} SELECT k AS prediction_id, scene_type, i, ts AS timestamp, answer, response, category, score FROM ev")
def classified_events(spark, sf_dir):
    """CL1, CL3, S3: the events of every stream, judged offline."""
    return _events(spark, sf_dir).drop("question", "explanation")


@query(f"""WITH RECURSIVE {_EVENTS}, al AS (SELECT 'all' AS subset, category, score FROM ev UNION ALL SELECT scene_type, category, score FROM ev),
    g AS (SELECT subset, category, count(*) AS n, avg(score) AS mean_score FROM al GROUP BY subset, category) SELECT subset, category, n, n * 100.0 / sum(n) OVER (PARTITION BY subset) AS percent, mean_score FROM g""")
def category_distribution(spark, sf_dir):
    """AG10: shares and means of the categories, over all and by scene."""
    return metrics.distribution(_events(spark, sf_dir), "scene_type")


@query(f"WITH RECURSIVE {_EVENTS} SELECT count(*) AS n_events, avg(score) AS mean_score, round_even(avg(score) * 10, 0) / 10 AS final_score FROM ev")
def final_score(spark, sf_dir):
    """AG9, M5: the mean score over all events."""
    return metrics.final_score(_events(spark, sf_dir))


@query(f"WITH RECURSIVE {_EVENTS} SELECT scene_type, count(*) AS n_events, avg(score) AS mean_score, round_even(avg(score) * 10, 0) / 10 AS final_score FROM ev GROUP BY scene_type")
def scene_scores(spark, sf_dir):
    """AG11: the mean score of every scene."""
    return metrics.final_score(_events(spark, sf_dir), "scene_type")


@query(f"""WITH RECURSIVE {_EVENTS}, md AS (SELECT prediction_id AS k, gen_args.model AS model FROM predictions) SELECT model, count(*) AS n_events, avg(score) AS mean_score, round_even(avg(score) * 10, 0) / 10 AS final_score
    FROM ev JOIN md ON md.k = ev.k GROUP BY model""")
def scores_per_model(spark, sf_dir):
    """SC4, AG9: the mean score of every model's own events."""
    p = _predictions(spark, sf_dir).withColumn("model", F.col("gen_args.model"))
    return metrics.final_score(classify.events(p, "prediction_id", judge=classify.length_judge, carry=("model",)), "model")


@query()
def matched_events(spark, sf_dir):
    """CL2, CL4, S4: matched pairs judged again at their own second."""
    p = _predictions(spark, sf_dir)
    f, m = _matched(spark, sf_dir)
    again = pipeline.matched_samples(m, f, p.select("prediction_id", "type", classify.question().alias("question")), "prediction_id")
    return classify.events(again, "prediction_id", 0.0, silence.PLACEHOLDERS_MATCHED, classify.length_judge)


@query("""SELECT gen_args.model AS model, sum(coalesce(gen_args.input_tokens, 0)) AS input_tokens, sum(coalesce(gen_args.output_tokens, 0)) AS output_tokens, sum(coalesce(gen_args.total_tokens, 0)) AS total_tokens,
    sum(coalesce(gen_args.api_calls, 0)) AS api_calls, count(*) AS n_rows FROM predictions GROUP BY gen_args.model""")
def usage_sums(spark, sf_dir):
    """AG14: token counters by model."""
    p = _predictions(spark, sf_dir).withColumn("model", F.col("gen_args.model"))
    return metrics.usage(p, "model")


@query(f"""WITH {_PT} SELECT prediction_id, count(CASE WHEN role = 'assistant' AND c.pred IS NOT NULL THEN 1 END) AS n_preds, count(CASE WHEN role = 'assistant' THEN 1 END) AS n_turns FROM turns GROUP BY prediction_id""")
def pred_counts(spark, sf_dir):
    """AG12, F4: turns with a pred."""
    n = lambda c: F.expr(f"cast(size(filter(conversations, c -> {c})) as bigint)")
    return _predictions(spark, sf_dir).where("size(conversations) > 0").select("prediction_id", n("c.from = 'assistant' and c.pred is not null").alias("n_preds"), n("c.from = 'assistant'").alias("n_turns"))


@query(r"""WITH v AS (SELECT sample_id, list_slice(videos, greatest(1, len(videos) - 9), len(videos)) AS vs, list_transform(list_filter(conversations, lambda c: c."from" = 'user' AND c.value IS DISTINCT FROM '<video>'), lambda c: c.value) AS asks
        FROM samples WHERE len(videos) > 0),
    x AS (SELECT sample_id, len(vs) + len(asks) AS n, coalesce(list_sum(list_transform(vs, lambda p: length(coalesce(p, '')))), 0) + coalesce(list_sum(list_transform(asks, lambda a: length(coalesce(a, '')))), 0) AS size,
        list_filter(asks, lambda a: a <> '')[-1] AS said FROM v),
    y AS (SELECT sample_id, size, CASE WHEN said IS NOT NULL AND n % 5 = 0 THEN array_to_string(list_slice(regexp_split_to_array(trim(said), '\s+'), 1, 4), ' ') ELSE 'Silent.' END AS pred FROM x)
    SELECT sample_id, pred, CAST(size AS BIGINT) AS input_tokens, length(pred) AS output_tokens, CAST(size + length(pred) AS BIGINT) AS total_tokens, 1 AS api_calls FROM y""")
def offline_generation(spark, sf_dir):
    """ST3, U1, AG14: the offline model on the requests of every sample."""
    s = table(spark, sf_dir, "samples").where("size(videos) > 0")
    turn = F.expr("transform(videos, v -> named_struct('from', 'user', 'value', '<video>'))")
    ask = F.transform(F.filter("conversations", lambda c: c["from"] == "user"), lambda c: F.struct(c["from"].alias("from"), c["value"].alias("value")))
    r = s.select("sample_id", "videos", F.concat(turn, ask).alias("conv"))
    r = r.select("sample_id", messages.system_prompt("conv").alias("system"), messages.parts("conv", "videos", 10).alias("m"))
    return generate(r.select("sample_id", "system", messages.merged("m").alias("messages")), Echo, "sample_id")


def _sessions(spark, sf_dir) -> DataFrame:
    """Each session once: of copies the least by all its fields."""
    a = table(spark, sf_dir, "annotations")
    rest = F.struct(*[F.col(c) for c in ("conversations", "videos", "video_id", "type", "meta")])
    return a.groupBy("session_id").agg(F.min(rest).alias("x")).select("session_id", "x.*")


@query(rf"""WITH RECURSIVE {_SECONDS}, pk AS (SELECT session_id, min(rid) AS rid FROM turns WHERE len(videos) > 0 GROUP BY session_id),
    ak AS (SELECT DISTINCT h.rid, CAST(trunc(h.ts) AS INTEGER) AS s, h.value AS v FROM turns h JOIN pk ON pk.rid = h.rid WHERE h.role = 'user' AND h.value IS DISTINCT FROM '<video>' AND h.ts IS NOT NULL),
    st AS (SELECT se.rid, se.session_id, se.t, (SELECT count(*) FROM ak WHERE ak.rid = se.rid AND ak.s <= se.t) AS asked,
        (SELECT v FROM ak WHERE ak.rid = se.rid AND ak.s <= se.t AND v <> '' ORDER BY s DESC, v DESC LIMIT 1) AS said, row_number() OVER (PARTITION BY se.rid ORDER BY se.t) AS n FROM se JOIN pk ON pk.rid = se.rid),
    go AS (SELECT rid, 0 AS n, 0 AS own, CAST(NULL AS BOOLEAN) AS talk FROM pk
        UNION ALL SELECT st.rid, st.n, go.own + CASE WHEN st.said IS NOT NULL AND (st.asked + go.own + least(st.t, 60)) % 5 = 0 THEN 1 ELSE 0 END,
            st.said IS NOT NULL AND (st.asked + go.own + least(st.t, 60)) % 5 = 0 FROM go JOIN st ON st.rid = go.rid AND st.n = go.n + 1)
    SELECT st.session_id, st.t, CASE WHEN count(a.pos) > 0 THEN 1 ELSE 2 END AS sample_type, CASE WHEN count(a.pos) > 0 THEN string_agg(a.value, ' ' ORDER BY a.pos) ELSE 'Silent' END AS gt,
        CASE WHEN go.talk THEN array_to_string(list_slice(regexp_split_to_array(trim(st.said), '\s+'), 1, 4), ' ') ELSE 'Silent.' END AS pred, st.asked + go.own AS n_history
    FROM st JOIN go ON go.rid = st.rid AND go.n = st.n LEFT JOIN turns a ON a.rid = st.rid AND a.role = 'assistant' AND trunc(a.ts) = st.t GROUP BY st.rid, st.session_id, st.t, st.said, st.asked, go.talk, go.own""")
def replayed_sessions(spark, sf_dir):
    """ST1, ST2, ST6, ST7, S5, S10: second-by-second replay with fed-back history (offline model)."""
    return replay.replay(_sessions(spark, sf_dir), Echo, messages.instruction(60), durations=table(spark, sf_dir, "durations"))


@query()
def report_row(spark, sf_dir):
    """AG8-AG10, SK7, S14: one row with all that the report shows."""
    got = pipeline.score(_predictions(spark, sf_dir), "prediction_id", vectors=None)
    texts: Column = F.lit("stream")
    one = report.wide(metrics.distribution(got["stream"])).withColumn("part", texts)
    macro = got["macro"].select("avg_soft_precision", "avg_soft_recall", "avg_soft_f1").withColumn("part", texts)
    score = metrics.final_score(got["stream"]).select(F.col("final_score"), texts.alias("part"))
    again = metrics.final_score(got["matched"]).select(F.col("final_score").alias("score_matched"), texts.alias("part"))
    return one.join(macro, "part").join(score, "part").join(again, "part").drop("part")


# ---- generic relational checks on the star-schema tables --------------------------------------------------


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice * (1 - l_discount)) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def pricing_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT c_mktsegment, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey) SELECT c_mktsegment, o_orderkey, o_totalprice, n FROM r WHERE n <= 3""")
def top_orders(spark, sf_dir):
    """The top of each group. The rank filter becomes a group limit before the exchange, so few rows of a group travel."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    rank = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return o.select("c_mktsegment", "o_orderkey", "o_totalprice", rank.alias("n")).where("n <= 3").withColumn("n", F.col("n").cast("bigint"))


@query("""SELECT event_type, date_trunc('hour', ts) AS "hour", count(*) AS n, sum(value) AS total FROM events GROUP BY event_type, date_trunc('hour', ts)""")
def hourly_events(spark, sf_dir):
    """ST5 on event time: tumbling windows."""
    return table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
