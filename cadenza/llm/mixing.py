"""Mixing sources to target shares: quotas, repeats, and a Pfair interleaving of blocks.

A mix of a budget is cut into `blocks` slots. A source of weight w owns blocks 1, 2, ...; block j may start at slot
floor((j - 1) / w) and must be done by slot ceil(j / w). Earliest deadline first over the released blocks keeps every
source within less than one block of its share at any time. The schedule is made on the driver; its length is the
parameter `blocks`, not the data's size: a mix too large for blocks of `block_tokens` runs through the same schedule in
as many equal cycles as keep the blocks that small, and every cycle ends exactly on the shares. Documents find their
place by prefix sums of tokens along a hash order.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.text import strip
from cadenza.session import small, written


def source_name(x: Column) -> Column:
    """One spelling for each source: lower case, and single hyphens for white space, `_`, `-` and `.`. Blank gives NULL."""
    return F.nullif(F.regexp_replace(F.lower(strip(x)), r"(?U)[\s_.\-]+", "-"), F.lit(""))


@dataclass(frozen=True)
class Target:
    source: str
    share: float
    max_repeats: int
    available: int  # tokens of the source, each document once

    @property
    def limit(self) -> int:
        return self.available * self.max_repeats


def quotas(targets: list[Target], budget: float, on_shortfall: str = "redistribute") -> dict[str, float]:
    """Tokens to take of each source.

    `redistribute` keeps the budget: a source that cannot give its share gives all it may, and the others take over
    what is missing in proportion to their shares. `shrink` keeps the shares: the mix gets as small as its scarcest
    source demands. Shares are normalised to a sum of 1; a source without tokens or with share 0 gets nothing.
    """
    live = [t for t in targets if t.share > 0 and t.limit > 0]
    total = sum(t.share for t in targets if t.share > 0)
    if not live or budget <= 0:
        return {}
    if on_shortfall == "shrink":
        size = min([budget, *(t.limit * total / t.share for t in live)])
        return {t.source: size * t.share / total for t in live}
    got: dict[str, float] = {}
    left, open_ = budget, list(live)
    while open_:
        rate = left / sum(t.share for t in open_)
        full = [t for t in open_ if t.limit <= rate * t.share]
        if not full:
            return got | {t.source: rate * t.share for t in open_}
        for t in full:
            got[t.source] = float(t.limit)
            left -= t.limit
        open_ = [t for t in open_ if t not in full]
    return got


def schedule(amounts: dict[str, float], block: float) -> list[tuple[int, str, int]]:
    """(slot, source, block number from 0), one block to a slot: earliest deadline first over released blocks.

    Weights are the amounts' shares. A source's last block may be partly empty.
    """
    total = sum(amounts.values())
    waiting, ready = [], []
    count = {s: max(1, math.ceil(a / block - 1e-9)) for s, a in amounts.items() if a > 0}
    weight = {s: Fraction(amounts[s] / total).limit_denominator(10**9) for s in count}
    for s in count:
        heapq.heappush(waiting, (0, math.ceil(1 / weight[s]), s, 0))
    out, slot = [], 0
    while waiting or ready:
        while waiting and waiting[0][0] <= slot:
            _, due, s, j = heapq.heappop(waiting)
            # at equal deadlines, a block whose successor's window overlaps its own goes first
            overlap = math.ceil((j + 1) / weight[s]) > math.floor((j + 1) / weight[s])
            heapq.heappush(ready, (due, not overlap, s, j))
        if not ready:
            slot = waiting[0][0]
            continue
        _, _, s, j = heapq.heappop(ready)
        out.append((slot, s, j))
        if j + 1 < count[s]:
            heapq.heappush(waiting, (math.floor((j + 1) / weight[s]), math.ceil((j + 2) / weight[s]), s, j + 1))
        slot += 1
    return out


def positions(docs: DataFrame, rows: int, per_bucket: int = 50_000, seed: int = 17) -> DataFrame:
    """Adds `ahead`: tokens of the documents before this one in its source's hash order.

    Running sums are taken in hash ranges of about `per_bucket` documents of a source; the ranges' sums give the offsets,
    so a source of any size is spread over many tasks.
    """
    buckets = max(1, math.ceil(rows / per_bucket))
    h = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40))
    d = docs.withColumn("h", h).withColumn("bucket", F.floor(F.col("h") * F.lit(buckets) / F.lit(1 << 40)))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("ahead", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    if buckets > 1:
        before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        off = (docs.withColumn("h", h).withColumn("bucket", F.floor(F.col("h") * F.lit(buckets) / F.lit(1 << 40)))
               .groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t"))
               .select("source", "bucket", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("off")))
        d = d.join(off, ["source", "bucket"]).withColumn("ahead", F.col("ahead") + F.col("off")).drop("off")
    return d.drop("h", "bucket")


def goals_of(targets: DataFrame) -> DataFrame:
    """Targets with one row per mix and source: of a source named more than once in a mix, under any spelling, the shares
    are added and the least repeats hold; a mix's budget_share is the largest it names. Blank sources are left out; NULL
    shares count as 0, NULL repeats as 1."""
    t = targets.select("mix_name", "budget_share", source_name(F.col("source")).alias("source"),
                       F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))
    budget = Window.partitionBy("mix_name")
    return (t.where("source is not null").withColumn("budget_share", F.coalesce(F.max("budget_share").over(budget), F.lit(0.0)))
            .groupBy("mix_name", "budget_share", "source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats")))


def mix(docs: DataFrame, targets: DataFrame, *, blocks: int = 4096, block_tokens: int = 1 << 20, on_shortfall: str = "redistribute") -> DataFrame:
    """One row per use of a document: mix_name, source, slot, at (tokens of the source before it), doc_id, use, n_tokens.

    `docs` has doc_id (unique), source and n_tokens; `targets` has mix_name, budget_share, source, target_share and
    max_repeats, read as `goals_of` does. (slot, at) orders a mix. Spellings of a source count together. Documents without tokens or source are in
    no mix, though all tokens count for the budget. A document is used where the middle of its tokens lies within its
    source's quota, so a quota is missed by half a document at most. Use k of a document comes after use k - 1 of all
    documents of its source.
    """
    spark = docs.sparkSession
    goals = goals_of(targets).collect()  # the fixed table of targets
    d = written(docs.select("doc_id", source_name(F.col("source")).alias("source"), F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens")), "mix-docs")
    all_tokens = d.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    used = d.where(F.col("n_tokens") > 0).where(F.col("source").isin([g["source"] for g in goals]))
    have = {r["source"]: (r["t"], r["c"]) for r in used.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("c")).collect()}
    takes, plan = [], []
    for name in sorted({g["mix_name"] for g in goals}):
        own = [g for g in goals if g["mix_name"] == name]
        amounts = quotas([Target(g["source"], g["target_share"], g["max_repeats"], have.get(g["source"], (0, 0))[0]) for g in own],
                         own[0]["budget_share"] * all_tokens, on_shortfall)
        cycles = max(1, math.ceil(sum(amounts.values()) / (blocks * block_tokens)))
        block = max(1.0, sum(amounts.values()) / (blocks * cycles))
        cycle = schedule({s: a / cycles for s, a in amounts.items()}, block)
        repeats = {g["source"]: g["max_repeats"] for g in own}
        takes += [(name, s, float(a), float(have[s][0]), a / cycles, block, len(cycle), repeats[s], sum(x == s for _, x, _ in cycle) - 1) for s, a in amounts.items()]
        plan += [(name, s, j, slot) for slot, s, j in cycle]
    # of bounded size: the targets, and `blocks` (plus one for each source) rows for each mix
    take = small(spark, takes, "mix_name string, source string, quota double, once double, turn double, block double, n_slots long, max_repeats int, top long")
    slots = small(spark, plan, "mix_name string, source string, j long, slot long")
    at = positions(used, max((c for _, c in have.values()), default=0))
    mid = F.col("ahead") + F.col("n_tokens") / 2
    uses = (at.join(take, "source").where(mid <= F.col("quota"))
            .withColumn("use", F.explode(F.sequence(F.lit(0), F.least(F.floor((F.col("quota") - mid) / F.col("once")).cast("int"), F.col("max_repeats") - 1))))
            .withColumn("at", (F.col("use") * F.col("once") + F.col("ahead")).cast("bigint"))
            .withColumn("cycle", F.floor(F.col("at") / F.col("turn")))
            .withColumn("j", F.least(F.floor((F.col("at") - F.col("cycle") * F.col("turn")) / F.col("block")), F.col("top"))))
    return (uses.join(slots, ["mix_name", "source", "j"])
            .select("mix_name", "source", (F.col("cycle") * F.col("n_slots") + F.col("slot")).alias("slot"), "at", "doc_id", "use", "n_tokens"))


def shares(mixed: DataFrame, targets: DataFrame, docs: DataFrame) -> DataFrame:
    """Per mix and source: tokens, uses, most uses of one document, actual and target share, and whether the source is at its
    limit, that is, all its tokens are used as often as the repeats allow. `docs` are those of `mix`."""
    goals = goals_of(targets).select("mix_name", "source", "target_share", "max_repeats")
    got = mixed.groupBy("mix_name", "source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_uses"), (F.max("use") + 1).alias("most_uses"))
    have = docs.where("n_tokens > 0").groupBy(source_name(F.col("source")).alias("source")).agg(F.sum("n_tokens").alias("available"))
    of = Window.partitionBy("mix_name")
    out = (goals.join(got, ["mix_name", "source"], "left").join(have, "source", "left").select(
        "mix_name", "source", "target_share", "max_repeats", "tokens", "n_uses", "most_uses", "available").fillna(0, ["tokens", "n_uses", "most_uses", "available"]))
    return (out.withColumn("actual_share", F.coalesce(F.col("tokens") / F.nullif(F.sum("tokens").over(of), F.lit(0)), F.lit(0.0)))
            .withColumn("at_limit", F.col("tokens") >= F.col("available") * F.col("max_repeats")).drop("available"))
