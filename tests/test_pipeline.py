"""The command line end to end, from annotation files without session ids to the reports of two models."""

import json

import pytest

from cadenza.operators import merge
from cadenza.plans import pipeline
from cadenza.sources import readers, sinks


def turn(who, value, at=None):
    return {"from": who, "value": value, **({} if at is None else {"timestamp": at})}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("pipeline")
    (root / "annotations").mkdir()
    one = {"video_id": "x", "type": "cooking", "videos": ["clips/Pan 01.mp4"], "conversations": [turn("user", "How do I fry it?", 1), turn("assistant", "Heat the pan", 4), turn("assistant", "Turn it", 9), turn("user", "And then?", 6)]}
    two = {"video_id": "y", "type": None, "videos": ["b.long_name.mpeg"], "conversations": [turn("assistant", "Go", 2)]}
    (root / "annotations" / "a.json").write_text(json.dumps(one))
    (root / "annotations" / "b.json").write_text(json.dumps([two]))
    (root / "list.txt").write_text("cooking/Pan 01.json\n")
    spark.createDataFrame([("clips/Pan 01.mp4", 11.9), ("Pan 01.mp4", 11.9)], "video string, seconds double").write.parquet(str(root / "durations"))
    clips = [(f"z/Pan 01_{s}_{s + 1}.mp4", True, 5) for s in range(20)] + [(f"b.long_name_{s}_{s + 1}.mpeg", s > 0, 5) for s in range(20)]
    spark.createDataFrame(clips, "path string, valid boolean, n_bytes long").write.parquet(str(root / "chunks"))
    main = lambda *args: pipeline.main([str(a) for a in args])
    main("samples", "--input", root / "annotations", "--output", root / "samples", "--durations", root / "durations")
    main("validate", "--input", root / "samples", "--output", root / "valid", "--chunks", root / "chunks")
    main("infer", "--input", root / "valid", "--output", root / "preds", "--name", "teacher", "--model", "tests.fakes.speaker", "--model-args", '{"word": "Heat the pan"}', "--workers", 3)
    main("replay", "--input", root / "annotations", "--output", root / "preds", "--name", "own", "--model", "tests.fakes.speaker", "--durations", root / "durations")
    main("merge", "--input", root / "valid", "--output", root / "merged")
    main("score", "--input", root / "preds", "--output", root / "report", "--judge", "tests.fakes.NotingJudge", "--judge-args", json.dumps({"path": str(root / "calls")}), "--embedder", "tests.fakes.Lengths", "--debug")
    return root


def test_samples_hold_the_whole_conversation(spark, folder):
    s = readers.read_stage(spark, str(folder / "samples"))
    pan = {r.endpoint_timestamp: r for r in s.where("session = 'Pan 01'").collect()}
    assert sorted(pan) == list(range(1, 12))
    five = pan[5]
    assert five.conversations[0]["from"] == "system" and five.sample_type == 2
    assert [c.value for c in five.conversations[1:]] == ["<video>", "How do I fry it?"] + ["<video>"] * 3 + ["Heat the pan", "<video>", "Silent"]
    assert five.videos == [f"clips/Pan 01_{k}_{k + 1}.mp4" for k in range(5)]
    assert [c.value for c in pan[4].conversations[-2:]] == ["<video>", "Heat the pan"] and pan[4].sample_type == 1
    assert s.where("session = 'b.long_name'").count() > 10


def test_validation_keeps_a_count_of_every_session(spark, folder):
    s = readers.read_stage(spark, str(folder / "valid"))
    assert {r.session for r in s.select("session").distinct().collect()} == {"Pan 01"}
    kept = {r.session: r.n_samples for r in spark.read.json(str(folder / "valid" / "_kept")).collect()}
    assert kept == {"Pan 01": 11, "b.long_name": 0}


def test_predictions_and_usage(spark, folder):
    p = {(r.model, r.named): r for r in readers.read_predictions(spark, str(folder / "preds")).collect()}
    assert set(p) == {("teacher", "Pan 01"), ("own", "Pan 01"), ("own", "b.long_name")}
    t = p["teacher", "Pan 01"]
    assert [c["from"] for c in t.conversations] == ["user"] + ["assistant"] * 11 and [c.timestamp for c in t.conversations[1:]] == [float(k) for k in range(1, 12)]
    assert t.gen_args.api_calls == 11 and t.gen_args.input_tokens == 77 and t.gen_args.model == "teacher"
    assert {c.pred for c in t.conversations[1:]} == {"Heat the pan", "Silent"}
    own = p["own", "Pan 01"]
    assert own.conversations[0].value == "How do I fry it?" and len(own.conversations) == 12 and own.gen_args.api_calls == 11


def test_reports_of_each_model_and_one_judgement_a_reply(spark, folder):
    texts = {r.model: r.value for r in spark.read.text(str(folder / "report"), wholetext=True).collect()}
    assert set(texts) == {"teacher", "own"} and all(f"Results of {k}" in v for k, v in texts.items()) and "N/A" not in texts["teacher"].split("Response")[0]
    events = spark.read.json(str(folder / "report" / "_debug" / "events"))
    again = spark.read.json(str(folder / "report" / "_debug" / "events_matched"))
    judged = events.where("category = 'PartlyCorrect'").count() + again.where("category = 'PartlyCorrect'").count()
    assert judged > 0 and len((folder / "calls").read_text().splitlines()) == judged
    assert {r.score for r in events.where("category = 'PartlyCorrect'").collect()} == {80.0}
    summary = {r.model: r for r in spark.read.json(str(folder / "report" / "_debug" / "metrics_summary")).collect()}
    assert summary["own"].video_info.num_videos == 2 and summary["teacher"].soft.avg_soft_f1 > 0


def test_finished_sessions_are_not_asked_again(spark, folder):
    before = {str(f) for f in (folder / "preds" / "own").rglob("*.json")}
    pipeline.main(["replay", "--input", str(folder / "annotations"), "--output", str(folder / "preds"), "--name", "own", "--model", "tests.fakes.speaker"])
    assert {str(f) for f in (folder / "preds" / "own").rglob("*.json")} == before


def test_stored_matches_and_the_fallback(spark, folder):
    stored = str(folder / "report" / "_debug" / "match_info")
    again = spark.read.json(str(folder / "report" / "_debug" / "events_matched"))
    for k, extra in enumerate((["--match-info", stored], [])):
        out = str(folder / f"report{k}")
        pipeline.main(["score", "--input", str(folder / "preds"), "--output", out, "--no-align", "--debug", *extra])
        got = spark.read.json(f"{out}/_debug/events_matched")
        key = lambda d: sorted((r.relative, r.timestamp, r.category, r.response) for r in d.collect())
        assert (key(got) == key(again)) == (k == 0)
    subset = str(folder / "subset")
    pipeline.main(["score", "--input", str(folder / "preds"), "--output", subset, "--subset", str(folder / "list.txt"), "--models", "own", "--debug"])
    m = spark.read.json(f"{subset}/_debug/measures").collect()
    assert [r.model for r in m] == ["own"] and "Pan 01" in m[0].relative.replace("%20", " ")


def test_lists_by_line_file_and_name(spark):
    lines = spark.createDataFrame([(" dom/x_1.json ",), ("",), ("y.json",)], "line string")
    df = spark.createDataFrame([("dom/x_1.json",), ("x_1.json",), ("x_1",), ("y",), ("y.json",)], "k string")
    got = lambda by: sorted(r.k for r in merge.in_subset(df, lines, "k", by).collect())
    assert (got("line"), got("file"), got("name")) == (["dom/x_1.json", "y.json"], ["x_1.json", "y.json"], ["x_1", "y"])
    assert {r.k: r.domain for r in merge.domains(df, lines, "k").collect()} == {"dom/x_1.json": None, "x_1.json": "dom", "x_1": None, "y": None, "y.json": "unknown"}


def test_overwriting_keeps_the_old_result_until_the_end(spark, tmp_path):
    at = str(tmp_path / "x")
    sinks.write_jsonl(spark.range(3), at)
    bad = spark.range(3).selectExpr("if(id < 2, id, raise_error('no')) as id")
    with pytest.raises(Exception):  # noqa: B017, PT011
        sinks.write_jsonl(bad, at)
    assert spark.read.json(at).count() == 3
    sinks.write_jsonl(spark.range(5), at)
    assert spark.read.json(at).count() == 5
