import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from cadenza.functions.silence import PLACEHOLDERS_MATCHED
from cadenza.operators import assign, classify, greedy, metrics, segment

PRED = "k long, type string, conversations array<struct<`from`: string, value: string, timestamp: double, pred: string>>"


def cost_matrix(n, talks, refs, text):
    c = np.ones((len(talks), n))
    for a, i in enumerate(talks):
        for j in range(n):
            c[a, j] = (text[i, j] if j in refs else 1.0) + 1 - np.exp(-assign.SIGMA * (i - j) ** 2)
    return c


def brute(c):
    return min(sum(c[a, j] for a, j in enumerate(p)) for p in itertools.permutations(range(c.shape[1]), c.shape[0]))


def test_solver_and_closed_form_are_optimal():
    rng = random.Random(4)
    for _ in range(400):
        n = rng.randint(1, 6)
        talks = sorted(rng.sample(range(n), rng.randint(1, n)))
        refs = sorted(rng.sample(range(n), rng.randint(1, min(2, n))))
        text = {(i, j): rng.choice([rng.random(), 0.0, 1.0]) for i in talks for j in refs}
        c = cost_matrix(n, talks, refs, text)
        best = brute(c)
        assert abs(sum(c[a, j] for a, j in enumerate(assign.solve(c))) - best) < 1e-9
        got, extra, missed = assign.match_segment(n, talks, refs, text)
        assert len(got) + len(extra) == len(talks) and len(got) + len(missed) == len(refs)
        if len(refs) == 1:
            r = refs[0]
            # the best total in which the chosen frame takes the reference (or nobody does) is the best of all
            i = next(iter(got), None)
            totals = [sum(c[a, j] for a, j in enumerate(p)) for p in itertools.permutations(range(n), len(talks))
                      if (r not in p if i is None else p[talks.index(i)] == r)]
            assert abs(min(totals) - best) < 1e-9


def test_fixed_segments():
    m = assign.match_segment
    assert m(2, [1], [0], {(1, 0): 0.1})[0] == {1: 0}
    assert m(21, [20], [0], {(20, 0): 0.5}) == ({}, [20], [0])
    assert m(3, [0, 1], [0], {(0, 0): 0.9, (1, 0): 0.05})[0] == {1: 0}
    assert m(3, [0, 1, 2], [], {}) == ({}, [0, 1, 2], [])


def turn(value, ts, pred, who="assistant"):
    return (who, value, ts, pred)


def test_segments_at_midpoints(spark):
    rows = [(1, "a", [turn("q", 0.0, None, "user"), turn("x", 2.0, "Silent"), turn("y", 6.0, "z"), turn("Silent", 4.0, "t"), turn("Silent", 3.0, "u")]),
            (2, None, [turn("x", 5.0, "a"), turn("y", 5.0, "b"), turn("Silent", 1.0, "c"), turn("z", 9.0, None)]), (3, None, None), (4, None, [])]
    got = {(r.k, r.ts, r.gen): (r.seg, r.pos) for r in segment.segmented(spark.createDataFrame(rows, PRED), "k").collect()}
    assert got == {(1, 2.0, ""): (0, 0), (1, 3.0, "u"): (0, 1), (1, 4.0, "t"): (1, 0), (1, 6.0, "z"): (1, 1),
                   (2, 1.0, "c"): (0, 0), (2, 5.0, "a"): (1, 0), (2, 5.0, "b"): (1, 1)}


def test_match_and_measures(spark):
    rows = [(1, None, [turn("ref", 2.0, "gen"), turn("Silent", 3.0, "more"), turn("other", 9.0, "Silent")])]
    f = segment.segmented(spark.createDataFrame(rows, PRED), "k")
    m = assign.match(f, "k")
    assert sorted((r.kind, r.score) for r in m.collect() if r.kind == "matched") == [("matched", 1.0)]
    assert m.count() == 3
    empty = assign.match(f.limit(0), "k")
    assert empty.count() == 0 and metrics.macro(metrics.prf(empty, "k")).first()["avg_jaccard"] is None
    table = spark.createDataFrame([(1, "matched", 0.5, 1.0, 1.0), (1, "matched", 0.9, 1.0, 3.0), (1, "redundant", None, 4.0, None), (1, "missed", None, None, 7.0)],
                                  "k long, kind string, score double, gen_ts double, ref_ts double")
    r = metrics.prf(table, "k").first()
    assert abs(r.soft_precision - 1.4 / 3) < 1e-12 and abs(r.soft_recall - 1.4 / 3) < 1e-12
    assert (r.n_matched, r.n_mismatched, r.semantic_score, r.jaccard, r.time_diff) == (1, 1, 0.7, 0.25, 2.0)


def events(spark, turns, **kw):
    df = spark.createDataFrame([(1, None, turns)], PRED)
    return [(r.timestamp, r.category) for r in classify.events(df, "k", judge=classify.length_judge, **kw).orderBy("i").collect()]


def test_events(spark):
    s = "Silent"
    assert events(spark, [turn(s, 10.0, "a"), turn("b", 12.0, s)]) == [(10.0, "PartlyCorrect")]
    assert events(spark, [turn(s, 10.0, "a"), turn("b", 12.1, s)]) == [(10.0, "FalseAlarm"), (12.1, "NoResponse")]
    assert events(spark, [turn(s, 0.0, "a"), turn("g", 1.0, s), turn(s, 2.0, "c")]) == [(0.0, "PartlyCorrect")]
    assert events(spark, [turn("g", 1.0, None), turn(s, 2.0, s)]) == [(1.0, "NoResponse"), (2.0, "CorrectSilent")]
    assert events(spark, [turn("OK", 1.0, "a sentence")], width=0.0, placeholders=PLACEHOLDERS_MATCHED) == [(1.0, "FalseAlarm")]
    none = spark.createDataFrame([(1, None, None), (2, "x", [])], PRED)
    assert classify.events(none, "k").count() == 0
    bare = spark.createDataFrame([(1, None, [turn("g", 1.0, "p")])], PRED)
    assert [(r.category, r.score, r.scene_type) for r in classify.events(bare, "k").collect()] == [("Error (no LLM)", 0.0, "unknown")]


def test_greedy_is_the_loop(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for k in range(60):
        turns = [turn(rng.choice(["Silent", "g"]), float(rng.randint(0, 9)), rng.choice(["Silent", "p"])) for _ in range(rng.randint(0, 10))]
        rows.append((k, None, turns))
        c = sorted((abs(a[2] - b[2]), i, j) for i, a in enumerate(turns) if a[3] == "p" for j, b in enumerate(turns) if b[1] == "g" and abs(a[2] - b[2]) <= 2)
        got = []
        for _, i, j in c:
            if all(i != x and j != y for x, y in got):
                got.append((i, j))
        want[k] = sorted(got)
    from cadenza.functions.silence import PLACEHOLDERS_STREAM
    from cadenza.operators.turns import computed, stream_frames

    d = computed(spark.createDataFrame(rows, PRED), "f", stream_frames(PLACEHOLDERS_STREAM)).withColumn("c", greedy.candidates("f", 2.0))
    have = {r.k: sorted((x.i, x.j) for x in r.m) for r in d.select("k", greedy.matched("c").alias("m")).collect()}
    assert have == want


def test_band_pairs(spark):
    rng = random.Random(3)
    a = [(rng.choice([1, 1, 2, None]), i, rng.choice([None, rng.randint(0, 200) / 10])) for i in range(80)]
    b = [(rng.choice([1, 1, 2, None]), i, rng.choice([None, rng.randint(0, 200) / 10])) for i in range(80)]
    left, right = spark.createDataFrame(a, "key long, i long, ts double"), spark.createDataFrame(b, "key long, j long, ts double")
    for w in (2.0, 0.0):
        want = sorted((k, i, j) for k, i, t in a for q, j, u in b if k is not None and k == q and t is not None and u is not None and abs(t - u) <= w)
        assert sorted((r.key, r.i, r.j) for r in greedy.band_pairs(left, right, w).collect()) == want
    assert greedy.band_pairs(left.limit(0), right, 1.0).count() == 0


def test_distribution(spark):
    e = spark.createDataFrame([("a", "x", 100.0), ("a", "y", 0.0), ("b", "x", 50.0)], "scene_type string, category string, score double")
    got = {(r.subset, r.category): (r.n, round(r.percent, 3), r.mean_score) for r in metrics.distribution(e, "scene_type").collect()}
    assert got[("all", "x")] == (2, 66.667, 75.0) and got[("a", "y")] == (1, 50.0, 0.0) and len(got) == 5
    assert metrics.final_score(e).first()["final_score"] == 50.0
    assert metrics.distribution(e.limit(0), "scene_type").count() == 0
    assert F is not None
