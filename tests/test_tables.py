"""Hot keys, compaction, sources, sinks, replay and report."""

import json
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from cadenza.models import Echo, Http, Local, Reply, ServiceError, chat_payload, chat_reply, contents_payload, contents_reply, is_final, template_messages, with_retry
from cadenza.operators import compaction, hotkeys
from cadenza.plans import report
from cadenza.plans.hot import keyed
from cadenza.sources import readers, sinks
from cadenza.streaming import replay


def test_weights_equal_direct_results(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice([None, *range(30)]), rng.choice([1, 2, None])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "video string, t int, sample_type int")
    w = hotkeys.weights(df, "video", ["t", "sample_type"])
    by = defaultdict(list)
    for k, t, _ in rows:
        by[k].append(t)
    got = {r.video: r for r in hotkeys.per_key(w, "video", sums={"n": F.lit(True), "s": F.col("sample_type") == 1}, mins={"lo": F.col("t")}, maxs={"hi": F.col("t")}).collect()}
    assert {k: (r.n, r.lo, r.hi) for k, r in got.items()} == {k: (len(v), min(x for x in v if x is not None), max(x for x in v if x is not None)) for k, v in by.items()}
    assert sum(r.s for r in got.values()) == sum(x == 1 for *_, x in rows)
    modes = {r.video: (r.n_distinct, r.mode, r.mode_rows) for r in hotkeys.distinct_and_mode(w, "video", "t").collect()}
    for k, v in by.items():
        c = Counter(x for x in v if x is not None)
        top = max(c.values())
        assert modes[k] == (len(c), min(x for x in c if c[x] == top), top)
    for p in (0.5, 0.9, 1.0):
        q = {r.video: r.value for r in hotkeys.percentile(w.where("video is not null"), "video", "t", p, 4).collect()}
        for k, v in by.items():
            if k is not None:
                s = sorted(x for x in v if x is not None)
                assert q[k] == s[-(-len(s) * round(p * 10) // 10) - 1]
    total = df.agg(F.count(F.lit(1)))
    heavy = hotkeys.heavy_keys(hotkeys.per_key(w, "video", sums={"n": F.lit(True)}), "video", "n", total)
    assert {r.video for r in heavy.collect()} == {k for k, v in by.items() if k and len(v) * 20 >= len(rows)}
    assert hotkeys.per_key(w.limit(0), "video", sums={"n": F.lit(True)}).count() == 0


def test_source_of_samples(spark):
    s = spark.createDataFrame([(["a/v_0_1.mp4"], "x", 1, 1), ([], "x", 2, 2), (None, None, 3, None), ([""], "y", None, 1)], "videos array<string>, video_id string, endpoint_timestamp int, sample_type int")
    assert sorted((r.video or "", r.t) for r in keyed(s).collect() if r.t) == [("", 3), ("v", 1), ("x", 2)]


def files(spark, rows):
    return spark.createDataFrame(rows, "id string, clip string, n long, at int, payload binary, bytes string")  # `bytes` clashes with a name inside


def run(df, store, tiers):
    return compaction.compact(df, store, file_id="id", key="clip", size="n", time="at", payload="payload", tiers=tiers)


def stored(spark, store):
    from pyspark.sql import types as T

    ddl = T.StructType([T.StructField("file_id", T.StringType()), T.StructField("payload", T.BinaryType())])
    rows = compaction.read_store(spark, store, ddl).select("file_id", "payload").collect()
    assert len({r.file_id for r in rows}) == len(rows)
    return {r.file_id: bytes(r.payload) for r in rows}


def test_compaction(spark, tmp_path):
    tiers = compaction.Tiers(target_bytes=4000, fan_in=4, base_bytes=60, window_rows=50)
    rng = random.Random(2)
    rows = [(f"f{i:04d}", rng.choice(["hot"] * 100 + [f"c{j}" for j in range(200)] + [None]), None, rng.choice([None, *range(9)]), bytes(rng.randbytes(rng.randint(1, 60))), "x") for i in range(500)]
    rows = [(a, b, len(p), t, p, x) for a, b, _, t, p, x in rows]
    store = str(tmp_path / "store")
    run(files(spark, rows), store, tiers)
    first = {}
    for i, clip, _, t, p, _ in rows:
        key = clip or i
        if key not in first or (t is None, t or 0, i) < first[key][0]:
            first[key] = ((t is None, t or 0, i), i, p)
    assert stored(spark, store) == {i: p for _, i, p in first.values()}
    dup = {(r.input_id, r.output_id) for r in compaction.journal(spark, store).where("action = 'duplicate'").collect()}
    assert dup == {(i, first[c][1]) for i, c, *_ in rows if c and first[c][1] != i}
    live = compaction.live(spark, store).collect()
    assert sum(r.n_records for r in live) == len(first) and len(live) < 20
    run(files(spark, rows), store, tiers)  # the same again: nothing new
    assert stored(spark, store) == {i: p for _, i, p in first.values()}
    more = [(f"g{i:04d}", f"d{i}" if i % 3 else "hot", 30, 1, b"y" * 30, "x") for i in range(60)]
    run(files(spark, rows + more), store, tiers)
    want = {i: p for _, i, p in first.values()} | {i: p for i, c, _, _, p, _ in more if c != "hot"}
    assert stored(spark, store) == want
    assert {r.input_id for r in compaction.journal(spark, store).where("action = 'duplicate' and input_id like 'g%'").collect()} == {i for i, c, *_ in more if c == "hot"}


def test_runs_without_commit_never_happened(spark, tmp_path):
    tiers = compaction.Tiers(target_bytes=4000, fan_in=4, base_bytes=60, file_bytes=2000)
    rows = [(f"f{i}", f"c{i % 90}", 20, i, bytes([i % 250]) * 20, "x") for i in range(100)]
    store = str(tmp_path / "store")
    run(files(spark, rows), store, tiers)
    had = stored(spark, store)
    assert len(had) == 90 and {r.input_id for r in compaction.index(spark, store).where("input_id <> kept_id").collect()} == {f"f{i}" for i in range(90, 100)}
    more = [(f"g{i}", f"d{i}", 20, i, b"z" * 20, "x") for i in range(30)]
    spark.createDataFrame([("duplicate", -1, "g1", "f1", 20, "lost")], compaction.JOURNAL).write.mode("append").parquet(f"{store}/journal")
    spark.createDataFrame([("g1", "f1", "d1", None, 20, "lost")], compaction.INDEX).write.mode("append").parquet(f"{store}/index")
    spark.createDataFrame([("f1", "c1", b"half", "L0-1-1")], "file_id string, key string, payload binary, container string").write.parquet(f"{store}/data/run=lost")
    assert stored(spark, store) == had and compaction.journal(spark, store).where("run = 'lost'").count() == 0
    assert compaction.vacuum(spark, store) == 1 and compaction.vacuum(spark, store) == 0
    run(files(spark, rows + more), store, tiers)
    now = stored(spark, store)
    assert now == had | {i: p for i, _, _, _, p, _ in more}
    compaction.vacuum(spark, store)
    assert stored(spark, store) == now
    assert len(list((tmp_path / "store" / "data").glob("run=*"))) <= 2


def test_compaction_of_nothing(spark, tmp_path):
    run(files(spark, []), str(tmp_path / "s"), compaction.Tiers())
    assert stored(spark, str(tmp_path / "s")) == {}


def test_readers(spark, tmp_path):
    one = {"session_id": 1, "video_id": "a", "videos": ["a.mp4"], "conversations": [{"from": "user", "value": "q", "timestamp": 1}], "extra": {"x": 1}}
    root = tmp_path / "model" / "sub"
    root.mkdir(parents=True)
    (root / "a.json").write_text(json.dumps(one))
    (root / "b.json").write_text(json.dumps([one, {**one, "session_id": 2}]))
    (root / "c.json").write_text("")
    (root / "d.json").write_text('{"session_id": ')
    got = readers.read_annotations(spark, str(tmp_path))
    assert sorted(r.session_id for r in got.select("session_id").collect()) == [1, 1, 2]
    p = readers.read_predictions(spark, str(tmp_path)).select("model", "relative").distinct().collect()
    assert {(r.model, r.relative) for r in p} == {("model", "model/sub/a.json"), ("model", "model/sub/b.json")}
    (tmp_path / "list.txt").write_text(" dom/x_1.json \n\ny.json\n")
    assert [(r.line, r.name, r.domain) for r in readers.read_subset(spark, str(tmp_path / "list.txt")).collect()] == [("dom/x_1.json", "x_1", "dom"), ("y.json", "y", None)]
    (tmp_path / "v").mkdir()
    for n in ("a.MP4", "b.txt"):
        (tmp_path / "v" / n).write_bytes(b"abc")
    assert [(r.name, r.length) for r in readers.read_videos(spark, str(tmp_path / "v")).collect()] == [("a.MP4", 3)]
    (tmp_path / "c.yaml").write_text("judger:\n  class: m.C\napi_host: h\napi_key: k\n")
    assert readers.judge_config(str(tmp_path / "c.yaml")) == {"class": "m.C"}
    assert readers.credentials(str(tmp_path / "c.yaml"), {"API_KEY": "env"}) == {"api_host": "h", "api_key": "env"}


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([("m", 1.26, "x")], "name string, score double, old string")
    b = spark.createDataFrame([("n", 2.25)], "name string, score double")
    sinks.append_summary(None, a, str(tmp_path / "1"))
    sinks.append_summary(readers.read_summary(spark, str(tmp_path / "1")), b, str(tmp_path / "2"))
    got = readers.read_summary(spark, str(tmp_path / "2")).orderBy("name").collect()
    assert [(r.name, r.score, r.old) for r in got] == [("m", "1.3", "x"), ("n", "2.2", None)]
    sinks.write_json_by_key(a, str(tmp_path / "k"), "name")
    assert (tmp_path / "k" / "name=m").exists()
    done = spark.createDataFrame([("m", [1]), ("n", None)], "name string, conversations array<int>")
    assert [r.name for r in sinks.unfinished(b.unionByName(a, allowMissingColumns=True).select("name"), done, "name").collect()] == ["n"]


def test_models():
    messages = [{"role": "user", "parts": [{"kind": "video", "text": "p"}, {"kind": "text", "text": "go"}]}, {"role": "assistant", "parts": [{"kind": "text", "text": "ok"}]}]
    chat = chat_payload("m", "sys", messages, lambda p: b"v", temperature=0.5)
    assert chat["messages"][0] == {"role": "system", "content": "sys"} and chat["messages"][1]["content"][0]["video_url"]["url"].startswith("data:video/mp4;base64,")
    assert [m["role"] for m in template_messages("", [*messages, {"role": "user", "parts": [{"kind": "text", "text": ""}]}])] == ["user", "assistant"]
    assert contents_payload("s", messages, lambda p: b"v")["contents"][1]["role"] == "model"
    assert chat_reply({"choices": [{"message": {"content": "x"}}], "usage": {"total_tokens": 7}}) == Reply("x", 0, 0, 7, 1)
    body = {"candidates": [{"content": {"parts": [{"text": "think", "thought": True}, {"text": "a"}, {"text": "b"}]}}], "usageMetadata": {"candidatesTokenCount": 2, "thoughtsTokenCount": 3}}
    assert contents_reply(body) == Reply("ab", 0, 5, 0, 1)
    calls = []

    def flaky(system, msgs):
        calls.append(1)
        if len(calls) < 3:
            raise OSError("reset")
        return Reply("ok")

    assert with_retry(flaky, sleep=lambda s: None)("", []).text == "ok" and len(calls) == 3

    def broken(system, msgs):
        calls.append(1)
        raise ValueError("404 not found")

    calls.clear()
    assert with_retry(broken, sleep=lambda s: None)("", []).text is None and len(calls) == 1


def test_final_errors_by_status():
    for text, final in (("404 not found", True), ("status code: 403", True), ("HTTP/1.1 400 Bad Request", True), ("took 4001 ms", False), ("error 429", False), ("status: 429", False), ("status=503", False), ("read 404 bytes", False)):
        assert is_final(OSError(text)) == final, text
    assert is_final(ServiceError("no", 401)) and not is_final(ServiceError("slow", 408)) and not is_final(ServiceError("gone", 500)) and is_final(FileNotFoundError("x.mp4"))


def test_local_models_and_transport():
    import http.server
    import threading

    said = Local(lambda m: (m[-1]["content"][0]["text"].upper(), (3, 2)))("sys", [{"role": "user", "parts": [{"kind": "text", "text": "go"}, {"kind": "video", "text": ""}]}])
    assert said == Reply("GO", 3, 2, 5, 1)
    assert contents_reply({"candidates": [{"content": {"parts": [{"text": "hm", "thought": True}]}}]}).text == "" and contents_reply({"candidates": [{}]}).text == ""

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.send_response(200 if self.headers["Authorization"] == "Bearer k" else 403)
            self.end_headers()
            self.wfile.write(json.dumps({"got": body}).encode())

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    assert Http(url, "k", timeout=5)({"a": 1}) == {"got": {"a": 1}}
    try:
        Http(url, "wrong", timeout=5)({})
        raise AssertionError
    except ServiceError as e:
        assert e.status == 403 and is_final(e)
    server.shutdown()


def test_names_and_tails(spark):
    from cadenza.functions import numbers, paths

    d = spark.createDataFrame([("a/b.veryLongExtension",), ("b.c.mp4",), (".hidden",), ("plain",), (None,)], "p string")
    assert [r[0] for r in d.select(paths.stem(F.col("p"))).collect()] == ["b", "b.c", ".hidden", "plain", None]
    t = spark.range(200).select(F.concat(F.lit("v"), "id").alias("k")).select(numbers.tail_seconds(F.col("k"), text=True).alias("t"))
    assert {r.t for r in t.collect()} == set(range(10, 16))


def test_counts_without_a_job_of_their_own(spark):
    df, seen = sinks.log_counts(spark.range(7), "rows")
    df.write.format("noop").mode("overwrite").save()
    assert sinks.report(seen, "rows") == 7


def test_replay_feeds_back_and_streams(spark, tmp_path):
    ddl = "session_id long, video_id string, videos array<string>, conversations array<struct<`from`: string, value: string, timestamp: double>>"
    rows = [(k, None, ["v.mp4"], [("user", "please do it now", float(k)), ("assistant", "a", 3.0), ("assistant", "b", 3.4), ("user", "then that", 4.0), ("assistant", "c", 8.0)]) for k in range(3)]
    rows += [(8, None, [], rows[0][3]), (9, None, ["v.mp4"], [("user", "q", 1.0)])]
    sessions = spark.createDataFrame(rows, ddl)
    got = replay.replay(sessions, Echo).collect()
    assert {r.session_id for r in got} == {0, 1, 2}
    assert [r.gt for r in got if r.t == 3] == ["a b"] * 3
    assert all(r.pred == "Silent." or r.n_history > 1 for r in got if r.t > 4)
    secs = replay.sampled(sessions)
    for i in range(3):
        secs.where(f"session_id = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = (replay.replay_stream(spark.readStream.schema(secs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), Echo)
         .writeStream.format("memory").queryName("replayed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("replayed").collect())) == sorted(map(tuple, got))


def test_dumped_batches(spark, tmp_path):
    spark.range(6).repartition(2).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    replay.dump_batches(s, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r.id for r in spark.read.json(str(tmp_path / "out")).select("id").collect()) == list(range(6))


def test_stream_windows(spark, tmp_path):
    spark.sql("select timestamp_seconds(x) as at, 'k' as k from (select explode(sequence(0, 9)) as x)").coalesce(1).write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema("at timestamp, k string").parquet(str(tmp_path / "e"))
    q = (replay.windowed_counts(s, "at", "k", "4 seconds", "2 seconds", "0 seconds").writeStream.outputMode("update").format("memory").queryName("windows")
         .option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    assert max(r.n_rows for r in spark.table("windows").collect()) == 4


def test_report():
    text = report.render("m", {"avg_soft_precision": 0.5}, {"final_score": 12.25, "FalseAlarm(all)": "1.0%(0.0)"}, None)
    assert "soft precision: 0.5000" in text and "soft f1: N/A" in text and "FalseAlarm: 1.0%(0.0)" in text and "(0-100): 12.2" in text
