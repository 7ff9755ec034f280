import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cadenza.llm import mixing, packing, tokens


def check_plan(hist, capacity, plan):
    fill, ranks = Counter(), defaultdict(list)
    for size, lo, hi, first, per in plan.segments:
        for r in range(lo, hi):
            ranks[size].append(r)
            c = first + (r - lo) // per
            assert 0 <= c < plan.n
            fill[c] += size
    assert max(fill.values(), default=0) <= capacity
    for s, n in hist.items():
        assert sorted(ranks[s]) == list(range(n))
    return fill


def test_plans_hold_and_are_tight():
    rng = random.Random(3)
    for _ in range(60):
        cap = rng.choice([16, 100, 512])
        hist = {s: rng.randint(0, 40) for s in rng.sample(range(cap + 1), rng.randint(0, min(cap, 60)))}
        plan = packing.plan(hist, cap)
        check_plan(hist, cap, plan)
        least = -(-sum(s * n for s, n in hist.items()) // cap)
        big = sum(n for s, n in hist.items() if 2 * s > cap)
        assert plan.n <= 1.25 * max(least, big) + 4


def test_configurations_beat_halving():
    # 600 items of 51 in containers of 100 cannot pair; 200 of 34 and 200 of 33 fill threes
    assert sum(n for _, n in packing.configurations([51], [600], 100)) == 600
    assert sum(n for _, n in packing.configurations([50, 34, 33], [10, 20, 40], 100)) == 25


@pytest.fixture
def small_buckets(monkeypatch):
    real = packing.ranked
    monkeypatch.setattr(packing, "ranked", lambda p, most: real(p, most, rows=13))


def test_pack(spark, small_buckets):
    rng = random.Random(8)
    rows = [(i, rng.choice([None, 0, 7, 7, 7, rng.randint(1, 130), 250]), "x") for i in range(400)]
    items = spark.createDataFrame(rows, "doc_id long, n_tokens long, size string")
    got = packing.pack(items, 100).collect()
    by = defaultdict(list)
    fill = Counter()
    for r in got:
        by[r.doc_id].append((r.piece, r.start, r.size))
        fill[r.container] += r.size
    assert max(fill.values()) <= 100 and set(by) == {i for i, *_ in rows}
    for i, n, _ in rows:
        p = sorted(by[i])
        assert sum(s for *_, s in p) == (n or 0) and [a for _, a, _ in p] == [100 * k for k in range(len(p))]
        assert len(p) == max(1, -(-(n or 0) // 100))
    assert len(fill) <= 1.05 * sum(fill.values()) / 100 + 3
    assert packing.pack(items.limit(0), 100).count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "a" * 50_000), (5, "<|endoftext|>")], "i int, t string")
    n = {r.i: r.n_tokens for r in tokens.with_sizes(df, "t").collect()}
    assert n[2] == n[3] == 0 and 2 <= n[1] <= 4 and n[4] > 100 and n[5] > 1


def test_quotas():
    t = [mixing.Target("a", 0.5, 1, 1000), mixing.Target("b", 0.3, 2, 100), mixing.Target("c", 0.2, 1, 0)]
    q = mixing.quotas(t, 1000)
    assert q == {"b": 200.0, "a": 800.0}
    s = mixing.quotas(t, 1000, "shrink")
    assert abs(s["b"] - 200) < 1e-9 and abs(s["a"] / s["b"] - 5 / 3) < 1e-9
    assert mixing.quotas(t, 0) == {} == mixing.quotas([], 10)


def test_schedule_lag():
    rng = random.Random(2)
    for _ in range(40):
        amounts = {k: float(rng.randint(1, 50)) for k in "abcdef"[: rng.randint(1, 6)]}
        total = sum(amounts.values())
        plan = mixing.schedule(amounts, 1.0)
        assert [s for s, _, _ in plan] == list(range(len(plan)))
        got = Counter()
        for slot, s, j in plan:
            assert got[s] == j
            got[s] += 1
            for k in amounts:
                assert abs(got[k] - amounts[k] / total * (slot + 1)) < 1
        assert got == {k: int(v) for k, v in amounts.items()}


def test_mix(spark, monkeypatch):
    real = mixing.positions
    monkeypatch.setattr(mixing, "positions", lambda d, rows: real(d, rows, per_bucket=40))
    rng = random.Random(5)
    docs = [(i, rng.choice(["big", "Big ", "BIG", "small_one", "small-one", None, "other"]) if i % 9 else "big", rng.choice([None, 0, rng.randint(1, 60)]), "x") for i in range(1500)]
    d = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long, use string")
    t = spark.createDataFrame([("m", 0.6, "big", 0.5, 1), ("m", 0.6, "small one", 0.5, 2), ("m", 0.6, "gone", 0.1, 3), ("n", 0.1, "other", 1.0, 1)],
                              "mix_name string, budget_share double, source string, target_share double, max_repeats int")
    mixed = mixing.mix(d, t, blocks=64)
    uses = mixed.collect()
    per = Counter((r.mix_name, r.doc_id) for r in uses)
    assert max(v for (m, _), v in per.items() if m == "m") <= 2
    assert all(n == 1 for (m, i), n in per.items() if m == "n")
    assert len({(r.mix_name, r.doc_id, r.use) for r in uses}) == len(uses)
    total = sum(n or 0 for *_, n, _ in docs)
    got = {(r.mix_name, r.source): r for r in mixing.shares(mixed, t, d).collect()}
    assert got["m", "gone"].tokens == 0
    assert abs(sum(r.tokens for r in got.values() if r.mix_name == "n") - 0.1 * total) <= 60
    limit = {s: sum(n or 0 for _, x, n, _ in docs if x and x.strip().lower().replace("_", "-") == s) for s in ("big", "small-one")}
    want = mixing.quotas([mixing.Target("big", 0.5, 1, limit["big"]), mixing.Target("small-one", 0.5, 2, limit["small-one"]), mixing.Target("gone", 0.1, 3, 0)], 0.6 * total)
    for s, q in want.items():
        assert abs(got["m", s].tokens - q) <= 60
    order = sorted((r.slot, r.at, r.source, r.n_tokens) for r in uses if r.mix_name == "m")
    assert len({x[0] for x in order}) > 50
    assert mixing.mix(d.limit(0), t).count() == 0
    assert mixed.where(F.col("n_tokens") <= 0).count() == 0


TARGETS = "mix_name string, budget_share double, source string, target_share double, max_repeats int"


def test_targets_named_twice_count_together(spark):
    d = spark.createDataFrame([(i, "a" if i % 2 else "b", 10) for i in range(1000)], "doc_id long, source string, n_tokens long")
    t = spark.createDataFrame([("m", 0.5, "a", 0.3, 3), ("m", 0.5, " A ", 0.3, 1), ("m", 0.5, "b", 0.4, 1), ("m", 0.5, " ", 0.4, 1)], TARGETS)
    got = {r.source: r for r in mixing.shares(mixing.mix(d, t), t, d).collect()}
    assert set(got) == {"a", "b"} and abs(got["a"].tokens - 3000) <= 10 and abs(got["b"].tokens - 2000) <= 10
    assert (got["a"].target_share, got["a"].max_repeats) == (0.6, 1)


def test_at_limit_means_all_tokens_used(spark):
    d = spark.createDataFrame([(i, "scarce" if i < 100 else "rich", 10) for i in range(1100)], "doc_id long, source string, n_tokens long")
    t = spark.createDataFrame([("m", 0.25, "scarce", 0.8, 3), ("m", 0.25, "rich", 0.2, 1), ("n", 1.0, "scarce", 0.8, 3), ("n", 1.0, "rich", 0.2, 1)], TARGETS)
    got = {(r.mix_name, r.source): (r.tokens, r.at_limit) for r in mixing.shares(mixing.mix(d, t), t, d).collect()}
    assert abs(got["m", "scarce"][0] - 2200) <= 10 and not got["m", "scarce"][1] and not got["m", "rich"][1]
    assert got["n", "scarce"] == (3000, True) and abs(got["n", "rich"][0] - 8000) <= 10 and not got["n", "rich"][1]


def test_cycles_keep_blocks_small(spark):
    d = spark.createDataFrame([(i, "a" if i % 4 else "b", 7) for i in range(4000)], "doc_id long, source string, n_tokens long")
    t = spark.createDataFrame([("m", 1.0, "a", 0.75, 1), ("m", 1.0, "b", 0.25, 1)], TARGETS)
    uses = sorted((r.slot, r.at, r.source, r.n_tokens) for r in mixing.mix(d, t, blocks=16, block_tokens=100).collect())
    assert len(uses) == 4000
    a = b = 0
    for _, _, s, n in uses:
        a, b = a + n * (s == "a"), b + n * (s == "b")
        assert abs(b - 0.25 * (a + b)) <= 2 * 100 + 7
