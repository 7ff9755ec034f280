import random
import time

import pytest

from cadenza.llm import runs, xfast


def test_trie_neighbours():
    rng = random.Random(1)
    for _ in range(200):
        bits = rng.randint(1, 8)
        keys = [rng.randrange(1 << bits) for _ in range(rng.randint(0, 12))]
        t = xfast.XFastTrie(keys, bits)
        for q in range(1 << bits):
            below, above = [k for k in keys if k <= q], [k for k in keys if k >= q]
            assert t.neighbours(q) == (max(below, default=None), min(above, default=None))


@pytest.mark.parametrize("per_part", [50_000, 40, 7, 1])
def test_nearest_is_brute_force(spark, per_part):
    rng = random.Random(per_part)
    time = lambda: rng.choice([None, float("nan"), *[rng.randint(-40, 300) / 4 for _ in range(12)]])
    entity = lambda: rng.choice([1, 1, 1, 2, None])
    p = [(entity(), time(), i, "x") for i in range(300)] + [(1, 2.0, 5, "again")]
    r = [(entity(), time(), i, "y") for i in range(80)]
    probes = spark.createDataFrame(p, "entity long, seconds double, probe_id long, tick string")  # `tick` clashes with a name inside
    refs = spark.createDataFrame(r, "entity long, seconds double, ref_id long, block string")
    want = []
    for e, s, i, _ in p:
        near = [(round(abs(s - u) * 1e6), j) for f, u, j, _ in r if e is not None and e == f and s is not None and u is not None and s == s and u == u and abs(s - u) <= 2]
        if near:
            gap, j = min(near)
            want.append((i, j, gap))
    got = xfast.nearest(probes, refs, 2.0, block_seconds=5, rows_per_part=per_part)
    assert sorted((x.probe_id, x.ref_id, x.gap_ticks) for x in got.collect()) == sorted(want)
    assert xfast.nearest(probes.limit(0), refs, 2.0).count() == 0 == xfast.nearest(probes, refs.limit(0), 2.0).count()


def test_decimal_edges(spark):
    probes = spark.createDataFrame([(1, 27.01, 1), (1, 30.3, 2)], "entity long, seconds double, probe_id long")
    refs = spark.createDataFrame([(1, 25.01, 9), (1, 28.299, 8)], "entity long, seconds double, ref_id long")
    assert [(x.probe_id, x.ref_id) for x in xfast.nearest(probes, refs, 2.0).collect()] == [(1, 8)]
    assert [(x.probe_id, x.ref_id) for x in xfast.nearest(probes.where("probe_id = 1"), refs.where("ref_id = 9"), 2.0).collect()] == [(1, 9)]


SAME = [("Good, slide the pan.", "good slide the  pan!"), ("Slide the pan now", "*Slide the pan now* 👍"), ("So, slide the pan.", "Slide the pan."), ("Slide the blue pan", "Silde the blue pan"),
        ("Tighten the plate", "Tighhten the pate"), ("嗯，把灯打开", "把灯打开。"), ("Turn to 1,5 now", "turn to 1,5 now."), ("Slide thepan", "slide the pan")]
OTHER = [("Turn left now", "Turn right now"), ("Hold for 49 breaths", "Hold for 39 breaths"), ("Lift the pan", "Lift the cup"), ("把左膝弯下去", "把右膝弯下去"), ("Turn to 1.5", "Turn to 15"), ("Turn to 1 5", "Turn to 15")]


def test_dissimilarity():
    for a, b in SAME:
        assert runs.dissimilarity(runs.tokens(a), runs.tokens(b)) < runs.PENALTY, (a, b)
    for a, b in OTHER:
        assert runs.dissimilarity(runs.tokens(a), runs.tokens(b)) > runs.PENALTY, (a, b)


def brute_cost(forms, cuts, cost):
    total = 0.0
    for a, b in cuts:
        total += 1.0 + min(sum(cost(x, m) for x in forms[a:b]) for m in forms[a:b])
    return total


def test_segmentation_is_optimal():
    rng = random.Random(5)
    table = {(a, b): rng.choice([0.1, 0.4, 0.9, float("inf")]) for a in range(5) for b in range(a)}
    cost = lambda a, b: 0.0 if a == b else table[max(a, b), min(a, b)]
    for _ in range(150):
        forms = [rng.randrange(5) for _ in range(rng.randint(1, 8))]
        best = min(brute_cost(forms, [(a, b) for a, b in zip([0, *cut], [*cut, len(forms)])], cost)
                   for mask in range(1 << (len(forms) - 1)) for cut in [[i + 1 for i in range(len(forms) - 1) if mask >> i & 1]])
        got = runs.segment(forms, 1.0, cost, lambda a, b: False)
        assert got[0][0] == 0 and got[-1][1] == len(forms) and all(x[1] == y[0] for x, y in zip(got, got[1:]))
        assert abs(brute_cost(forms, got, cost) - best) < 1e-9


def test_two_slips_meet_in_the_right_word():
    forms = [runs.tokens(x) for x in ("roll the blaknet", "roll the blanet", "roll the blanket", "roll the rug")]
    assert runs.segment(forms) == [(0, 3), (3, 4)]
    assert len(runs.segment([runs.tokens("a b")] * 20_000)) == 1


def test_slips_said_again_never_split_a_run():
    a, one, two, three = (runs.tokens(x) for x in ("slide the small blanket", "slide the small blaknet", "slide the smal blaknet", "slidde the smal blaknet"))
    for n, slipped in ((6, one), (3, two), (2, three), (500, three)):
        assert runs.segment([a] * n + [slipped] * n) == [(0, 2 * n)]
        assert runs.segment(([a] * n + [slipped] * n) * 2 + [runs.tokens("slide the rug")] * n) == [(0, 4 * n), (4 * n, 5 * n)]
    left, right = runs.tokens("turn the blanket left"), runs.tokens("turn the blanket right")
    assert runs.segment([left] * 9 + [right] + [left] * 9) == [(0, 9), (9, 10), (10, 19)]
    got = runs.runs_of([(t, "Slide the small blanket" if t < 6 else "slide the small blaknet!") for t in range(12)] + [(12, None)])
    assert [r[:4] for r in got] == [("talk", 0, 11, 12), ("silence", 12, 12, 1)]


def test_fewest_runs_then_least_dissimilarity():
    rng = random.Random(6)
    table = {(a, b): rng.choice([0.1, 0.4, 0.9, float("inf")]) for a in range(5) for b in range(a)}
    cost = lambda a, b: 0.0 if a == b else table[max(a, b), min(a, b)]
    for _ in range(150):
        forms = [rng.randrange(5) for _ in range(rng.randint(1, 8))]
        total = lambda cuts: (len(cuts), round(brute_cost(forms, cuts, cost) - len(cuts), 6))
        every = [[(a, b) for a, b in zip([0, *cut], [*cut, len(forms)])] for mask in range(1 << (len(forms) - 1)) for cut in [[i + 1 for i in range(len(forms) - 1) if mask >> i & 1]]]
        best = min(total(cuts) for cuts in every if brute_cost(forms, cuts, cost) < float("inf"))
        assert total(runs.segment(forms, None, cost, lambda a, b: False)) == best


def test_runs(spark):
    ddl = "prediction_id long, conversations array<struct<`from`: string, value: string, timestamp: double, pred: string>>, at string"
    a = lambda t, p: ("assistant", "v", t, p)
    rows = [(1, [a(5.0, "B"), a(1.0, "Slide the pan"), a(2.0, None), a(3.0, "slide the pan!"), a(4.0, "So, slide teh pan"), a(6.0, " Silent "), a(7.0, "<|silent|>"), a(8.0, "B"), ("user", "B", 5.5, None), a(None, "B")], "x"),
            (2, None, None), (3, [], None), (4, [a(1.0, None)], None), (5, [a(float(t), "go on " * 2000) for t in range(3)], None), (None, [a(1.0, "x")], None)]
    got = runs.collapse(runs.sequences_of(spark.createDataFrame(rows, ddl)))
    one = [(r.kind, r.start_second, r.end_second, r.n_events) for r in got.where("id = 1").orderBy("start_second").collect()]
    assert one == [("talk", 1, 4, 3), ("talk", 5, 5, 1), ("silence", 6, 7, 2), ("talk", 8, 8, 1)]
    assert [(r.id, r.n_events) for r in got.where("id <> 1").collect()] == [(5, 3)]
    assert runs.collapse(runs.sequences_of(spark.createDataFrame([], ddl))).count() == 0


def test_fractional_times_keep_their_order(spark):
    ddl = "prediction_id long, conversations array<struct<`from`: string, value: string, timestamp: double, pred: string>>"
    a = lambda t, p: ("assistant", "v", t, p)
    rows = [(1, [a(4.0, "Turn the wheel"), a(3.7, "Close the lid"), a(3.2, "Turn the wheel"), a(4.0, "Lift it")])]
    got = runs.collapse(runs.sequences_of(spark.createDataFrame(rows, ddl))).collect()
    assert [(r.start_second, r.end_second, r.n_events, r.text) for r in got] == [(3, 3, 1, "Turn the wheel"), (3, 3, 1, "Close the lid"), (4, 4, 1, "Turn the wheel"), (4, 4, 1, "Lift it")]


def test_long_sequences_of_like_events():
    rng = random.Random(9)
    text = "slide the small blanket over the wooden table"

    def slip(x):
        w = x.split()
        i = rng.choice([0, 2, 3, 6, 7])
        k = rng.randrange(1, len(w[i]) - 1)
        w[i] = w[i][:k] + rng.choice("qxz") + w[i][k:] if rng.random() < 0.5 else w[i][:k] + w[i][k + 1:]
        return " ".join(w)

    forms = [runs.tokens(slip(text) if rng.random() < 0.5 else text) for _ in range(100_000)]
    began = time.perf_counter()
    assert runs.segment(forms) == [(0, 100_000)]
    assert time.perf_counter() - began < 30
    different = [runs.tokens(f"step {i % 7} of it") for i in range(100_000)]
    assert len(runs.segment(different)) == 100_000


def test_a_dense_block_is_cut(spark):
    n = 300_000
    refs = spark.range(n).selectExpr("1L as entity", "id * 0.0001 as seconds", "id as ref_id")
    probes = spark.range(200_000).selectExpr("1L as entity", "if(id % 2 = 0, 20.00004, id * 0.00015 + 0.00001) as seconds", "id as probe_id")
    got = xfast.nearest(probes, refs, 2.0)
    want = probes.selectExpr("probe_id", "cast(round(seconds * 10000) as bigint) as want")
    assert got.count() == 200_000
    assert got.join(want, "probe_id").where("ref_id <> want").count() == 0
