from pyspark.sql import functions as F

from cadenza.operators import merge, messages, sampling
from cadenza.operators.turns import computed

SESSION = "session_id long, video_id string, videos array<string>, conversations array<struct<`from`: string, value: string, timestamp: double>>"


def sessions(spark, *rows):
    return spark.createDataFrame(list(rows), SESSION)


def test_bounds_and_tail(spark):
    a = sessions(spark, (1, "v", ["v.mp4"], [("user", "q", 0.0), ("assistant", "a", 5.0), ("assistant", "b", 20.9)]), (2, "w", ["w.mp4"], [("user", "q", 1.0)]), (3, None, None, None),
                 (4, "n", [], [("user", "<video>", None), ("assistant", "a", 7.0)]))
    d = spark.createDataFrame([("v.mp4", 25.9), ("w.mp4", None)], "video string, seconds double")
    got = sampling.seconds(a, "session_id", "videos", "conversations", durations=d, low=12, high=12)
    one = got.where("session_id = 1")
    assert one.count() == 26 and one.where("sample_type = 1").count() == 2 and one.agg(F.max("t")).first()[0] == 25
    four = [r.t for r in got.where("session_id = 4").orderBy("t").collect()]
    assert four == list(range(7, 20)) and got.where("session_id in (2, 3)").count() == 0
    assert [r[0] for r in one.where("t in (4, 5)").orderBy("t").select(sampling.target()).collect()] == ["Silent", "a"]


def items(spark, turns, t, window=60, chunk=1):
    df = sessions(spark, (1, None, None, turns)).withColumn("t", F.lit(t))
    return [(x.kind, x.start, x.end) for x in df.select(sampling.window_items(window=window, chunk=chunk).alias("x")).first().x]


def test_windows(spark):
    got = items(spark, [("user", "m", 100.0)], 103)
    video = [(s, e) for k, s, e in got if k == "video"]
    assert len(video) == 60 and video[0] == (43, 44) and video[-1] == (102, 103)
    assert got.index(("turn", 100, 100)) == got.index(("video", 99, 100)) + 1
    assert items(spark, [("user", "m", 7.0)], 10, chunk=5) == [("video", 0, 5), ("video", 5, 7), ("turn", 7, 7), ("video", 7, 10)] or items(
        spark, [("user", "m", 7.0)], 10, chunk=5) == [("video", 0, 5), ("video", 5, 7), ("turn", 7, 7), ("video", 7, 10)]
    assert items(spark, [], 0) == []
    assert items(spark, [("user", "m", None), ("user", "late", 9.0)], 1) == [("turn", None, None), ("video", 0, 1)]


def test_dense_chunks(spark):
    d = spark.createDataFrame([("a", 2.3), ("b", 0.0), ("c", None)], "video string, seconds double")
    assert [tuple(r) for r in sampling.dense_chunks(d).orderBy("start").collect()] == [("a", 0, 1), ("a", 1, 2), ("a", 2, 3)]


def test_validated(spark):
    s = spark.createDataFrame([(1, ["x/v_0_1.mp4", "v_1_2.mp4"]), (2, ["v_0_1.mp4", "v_2_3.mp4"]), (3, []), (4, None), (5, ["nothing.mp4"])], "sample_id long, videos array<string>")
    c = spark.createDataFrame([("v_0_1.mp4", True, 5), ("y/v_1_2_copy.mp4", True, 5), ("v_2_3.mp4", False, 5), ("v_2_3.mp4", None, 5), ("v_2_3.mp4", True, 0)], "path string, valid boolean, n_bytes long")
    assert [r.sample_id for r in sampling.validated(s, c).collect()] == [1]
    assert sampling.validated(s, c.limit(0)).count() == 0


def test_messages(spark):
    conv = [(r, f"{r}{i}", None) for i, r in enumerate(["user", "user", "assistant", "user", "user", "user", "assistant"])]
    m = computed(sessions(spark, (1, None, [], conv)), "m", messages.parts("conversations", "videos", 10)).select(messages.merged("m").alias("x")).first().x
    assert [len(x.parts) for x in m] == [2, 1, 3, 1]
    clips = [f"c{i}" for i in range(1, 16)]
    df = sessions(spark, (1, None, clips, [("system", "s", None)] + [("user", "<video>", None)] * 17))
    m = df.select(messages.parts("conversations", "videos", 10).alias("x"), messages.system_prompt("conversations").alias("s")).first()
    assert [x.parts[0].text for x in m.x] == clips[5:] and m.s == "s"


def test_merge_and_names(spark):
    ddl = "sid long, n long, videos array<string>, conversations array<struct<`from`: string, value: string, timestamp: double, pred: string>>, endpoint_timestamp int, sample_type int"
    a = lambda p, t=None: ("assistant", "g", t, p)
    u = lambda v: ("user", v, None, None)
    rows = [(1, 1, ["v_2_3.mp4"], [u("first"), a("p3")], 3, 1), (1, 2, ["v_0_1.mp4"], [u("second"), a("x"), a("p1", 1.5)], 1, 2), (1, 3, [], [a(None)], 2, 2), (1, 4, None, [a("p0")], 0, 2)]
    got = merge.merged_turns(spark.createDataFrame(rows, ddl), "sid", "n").orderBy("start", "end", "n").collect()
    assert [(r.text, r.timestamp, r.question) for r in got] == [("p0", 0.0, "first"), ("p1", 1.5, "first"), ("p3", 3.0, "first")]
    s = spark.createDataFrame([(["d/a_1.mp4"], None, 1), ([], "vid", 2), (None, None, 3)], "v array<string>, i string, n long")
    assert [r[0] for r in s.orderBy("n").select(sampling.output_name(F.col("v"), F.col("i"), F.col("n"))).collect()] == ["a_1.json", "vid.json", "sample_000003.json"]
    left = spark.createDataFrame([("0011.json",), ("zz",), (None,)], "key string")
    right = spark.createDataFrame([(1, "1", "a"), (2, "0011", "b"), (3, "1", "c")], "o long, n string, v string")
    got = {r.key: r.v for r in merge.first_containing(left, "key", right, "n", "o", "v").collect()}
    assert got == {"0011.json": "c", "zz": None, None: None}
    assert {r.key: r.v for r in merge.first_containing(left, "key", right.unionByName(spark.createDataFrame([(9, None, "e")], right.schema)), "n", "o", "v").collect()} == {"0011.json": "c", "zz": "e", None: None}
