from pyspark.sql import functions as F

from cadenza.functions import numbers, paths, silence, text
from cadenza.functions.jsontext import judge_reply


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


GRID = ["Silent", " silent ", "Silent.", '"Silent"', "<|silent|>", "OK", "   ", "", "\tsilent\n"]


def test_silence_grid(spark):
    hits = lambda f: {i + 1 for i, v in enumerate(column(spark, GRID, f)) if v}
    assert hits(silence.is_silent_aligned) == {1, 2, 5, 8, 9}
    assert hits(silence.is_placeholder) == {1, 2, 3, 5, 6, 7, 8, 9}
    assert hits(lambda x: silence.is_placeholder(x, silence.PLACEHOLDERS_MATCHED)) == {1, 2, 6, 7, 8, 9}
    assert hits(silence.is_silent_reply) == {1, 2, 3, 4, 9}
    assert len(silence.PLACEHOLDERS_STREAM) == 31 and len(silence.PLACEHOLDERS_MATCHED) == 29
    assert column(spark, [None], silence.is_placeholder) == [True]
    assert column(spark, [None], silence.is_silent_reply) == [True]
    assert column(spark, [None], silence.is_silent_aligned) == [None]


def test_silence_of_the_tables(spark):
    got = column(spark, [*GRID, "\xa0SILENT.​", "Silent!", None, "silent night"], text.is_silence)
    assert got == [True, True, True, True, True, False, False, False, True, True, False, None, False]
    assert column(spark, ["", " ​﻿", "x", None], text.is_blank) == [True, True, False, None]


def test_clip_names(spark):
    names = ["video_clips/kt_07_3_4_5.mp4", " a/../b/0009_00012_00013.MP4 ", r"video_clips\R0-12-G_2_3.mp4", "backup/x_1_2_copy.mp4", "x_1_2 (3).mp4",
             "file:///d/übung-1_5_6.mkv", "x.mp4", "", None, "a_b_7.mp4", "Copy of x_1_2.mp4"]
    got = column(spark, names, paths.clip)
    assert [tuple(c) if c else None for c in got] == [
        ("kt_07_3", 4, 5), ("0009", 12, 13), ("R0-12-G", 2, 3), ("x", 1, 2), ("x", 1, 2), ("übung-1", 5, 6), None, None, None, None, ("x", 1, 2)]
    assert column(spark, names, paths.source_video) == ["kt_07_3", "0009", "R0-12-G", "x", "x", "übung-1", "x", None, None, "a_b_7", "x"]
    assert [tuple(c) for c in column(spark, ["R0-12-G_146_206.mp4", "x.mp4", "a_b_7.mp4", "", None], paths.interval_pair)] == [(146, 206), (0, 0), (0, 0), (0, 0), (0, 0)]
    assert column(spark, ["d.x/v.mp4", "v", ""], lambda x: paths.with_interval(x, F.lit(1), F.lit(2))) == ["d.x/v_1_2.mp4", "v_1_2", "_1_2"]


def test_judge_replies(spark):
    got = column(spark, ['{"score":4}', '```json\n{"score": 3, "explanation": "ok"}\n```', '{"score": "4.5"}', '{"score": 9}', '{"score": -1}', "text", None, '{"score": 2,}'], judge_reply)
    assert [r[0] * 20 for r in got] == [80, 60, 90, 100, 0, 0, 0, 40]
    assert got[1][1] == "ok" and got[5][1] == "unreadable reply"


def test_numbers(spark):
    df = spark.createDataFrame([([1.0, 0.0], [-0.8, 0.6]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(F.round(1 - numbers.semantic_cost(numbers.cosine("a", "b")), 9)).collect()] == [0.8, None, None]
    one = spark.range(1)
    assert one.select(numbers.judge_points(F.lit(float("nan")))).first()[0] == 100
    assert [one.select(numbers.mean_1(F.lit(x))).first()[0] for x in (2.25, 0.35)] == [2.2, 0.4]
    assert one.select(numbers.chunk_count(F.lit(2.3), 1), numbers.chunk_count(F.lit(None).cast("double"), 1)).first()[:] == (3, 0)
