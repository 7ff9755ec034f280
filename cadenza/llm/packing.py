"""Filling containers of fixed capacity: linear grouping, configurations, substitution, best fit.

The plan is made on the driver from the histogram of sizes, which has at most capacity + 1 entries whatever the
data's size. Sizes above capacity / `small` are large: they are split into groups of equal cardinality, each rounded
up to its largest size (a size with a group's share of items is a group); a linear program over configurations (column generation, knapsack pricing) says how many
containers of each configuration to make; actual items then take the rounded ones' places, so that a container's
true space left is known from the ranks of its items. Small sizes go, largest first, to the containers with the least
space that holds them; what is left over opens new containers. The plan is a list of rank ranges of each size, with the
containers they fill; each item finds its container by its rank among the items of its size.
"""

from __future__ import annotations

import bisect
import logging
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.session import small as small_table
from cadenza.session import written

log = logging.getLogger("cadenza")


@dataclass
class Plan:
    """segments: (size, first rank, end rank, first container, items per container); n: number of containers."""

    segments: list[tuple[int, int, int, int, int]]
    n: int


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[list[int], int]]:
    """(items of each size, number of containers) that hold the demand; sizes are above 0 and at most the capacity.

    After `rounds` columns without an optimum the best plan so far is used, which holds the demand too; that is logged."""
    k = len(sizes)
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    b = np.array(demand, float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        x = inverse @ b
        y = inverse.sum(0)  # duals: every configuration costs 1
        value, column = _knapsack(sizes, y, capacity)
        if value <= 1 + 1e-7:
            break
        d = inverse @ column
        ok = d > 1e-9
        if not ok.any():
            break
        ratio = np.where(ok, x / np.where(ok, d, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    else:
        log.warning("no optimum of the configurations after %d columns; the best plan so far is used", rounds)
    x = np.linalg.solve(basis, b)
    made, rest = [], np.array(demand, "int64")
    for j in np.argsort(-x):
        column = np.rint(basis[:, j]).astype("int64")
        n = int(math.floor(x[j] + 1e-7))
        if n > 0:
            over = column > 0
            n = min(n, int((rest[over] // column[over]).min()))
        if n > 0:
            made.append((column.tolist(), n))
            rest -= column * n
    order = np.argsort(-np.array(sizes))
    while rest.any():  # what rounding down left: first fit, decreasing, in bulk
        room, column = capacity, np.zeros(k, "int64")
        for g in order:
            column[g] = min(rest[g], room // sizes[g])
            room -= column[g] * sizes[g]
        over = column > 0
        n = int((rest[over] // column[over]).min())
        made.append((column.tolist(), n))
        rest -= column * n
    return made


def _knapsack(sizes: list[int], worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within the capacity."""
    unit = math.gcd(*sizes, capacity)
    s, cap = [x // unit for x in sizes], capacity // unit
    best, take = [0.0] * (cap + 1), [-1] * (cap + 1)
    pairs = [(a, float(w), g) for g, (a, w) in enumerate(zip(s, worth)) if w > 1e-12]
    low = min((a for a, _, _ in pairs), default=cap + 1)
    for c in range(low, cap + 1):
        v, t = best[c - 1], -1
        for a, w, g in pairs:
            if a <= c and best[c - a] + w > v + 1e-12:
                v, t = best[c - a] + w, g
        best[c], take[c] = v, t
    column, c = np.zeros(len(sizes)), cap
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            column[take[c]] += 1
            c -= s[take[c]]
    return best[cap], column


def plan(histogram: dict[int, int], capacity: int, groups: int = 32, small: int = 8) -> Plan:
    """A plan for `histogram` (size -> number of items), sizes from 0 to the capacity."""
    segments: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # space left -> (first container, how many)
    spaces: list[int] = []
    n = 0

    def leave(first: int, count: int, space: int) -> None:
        if count and space > 0:
            if space not in room:
                bisect.insort(spaces, space)
                room[space] = []
            room[space].append((first, count))

    large = sorted((s for s, c in histogram.items() if s * small > capacity and c), reverse=True)
    total = sum(histogram[s] for s in large)
    if total:
        # a size that has a group's share by itself is a group, so that its items are not rounded up
        alone = {s for s in large if histogram[s] * groups >= total}
        others = sum(histogram[s] for s in large if s not in alone)
        members: list[list[int]] = []
        before, last = 0, None
        for s in large:
            g = ("alone", s) if s in alone else before * groups // others
            if g != last:
                members.append([])
            last = g
            members[-1].append(s)
            if s not in alone:
                before += histogram[s]
        rounded = [m[0] for m in members]
        demand = [sum(histogram[s] for s in m) for m in members]
        # ranks run through a group from its largest size on; `at` is the next free rank
        at, starts = [0] * len(members), []
        for m in members:
            ends = np.cumsum([histogram[s] for s in m]).tolist()
            starts.append([0, *ends])
        for column, count in configurations(rounded, demand, capacity):
            slots = [g for g, m in enumerate(column) for _ in range(m)]
            cuts = {0, count}
            taken = []
            for g in slots:
                a, z = at[g], at[g] + count
                at[g] = z
                taken.append((g, a))
                i = bisect.bisect_right(starts[g], a) - 1
                while starts[g][i] < z:
                    lo, hi = max(a, starts[g][i]), min(z, starts[g][i + 1])
                    segments.append((members[g][i], lo - starts[g][i], hi - starts[g][i], n + lo - a, 1))
                    cuts |= {lo - a, hi - a}
                    i += 1
            edges = sorted(cuts)
            for lo, hi in zip(edges, edges[1:]):
                used = sum(members[g][bisect.bisect_right(starts[g], a + lo) - 1] for g, a in taken)
                leave(n + lo, hi - lo, capacity - used)
            n += count
    for s in sorted((s for s, c in histogram.items() if 0 < s and s * small <= capacity and c), reverse=True):
        left, rank = histogram[s], 0

        def fill(first: int, count: int, space: int) -> None:
            """Put items of size s into `count` containers with this space, as many into each as fit."""
            nonlocal left, rank
            q = space // s
            whole = min(count, left // q)
            if whole:
                segments.append((s, rank, rank + whole * q, first, q))
                leave(first, whole, space - q * s)
                rank, left = rank + whole * q, left - whole * q
            if whole < count and left:
                segments.append((s, rank, rank + left, first + whole, left))
                leave(first + whole, 1, space - left * s)
                rank, left, whole = rank + left, 0, whole + 1
            leave(first + whole, count - whole, space)

        while left:
            i = bisect.bisect_left(spaces, s)
            if i == len(spaces):
                break
            space = spaces[i]
            first, count = room[space].pop()
            if not room[space]:
                del room[space], spaces[i]
            fill(first, count, space)
        if left:
            count = -(-left // (capacity // s))
            start, n = n, n + count
            fill(start, count, capacity)
    if histogram.get(0):  # items of no size: all with the first container
        segments.append((0, 0, histogram[0], 0, histogram[0]))
        n = max(n, 1)
    return Plan(segments, n)


def pieces(items: DataFrame, capacity: int, key: str, size: str) -> DataFrame:
    """Items as (key, piece, start, size): whole where they fit, else cut into pieces of the capacity and a rest."""
    s = F.coalesce(F.col(size), F.lit(0)).cast("bigint")
    cap = F.lit(capacity).cast("bigint")
    last = F.greatest(F.ceil(s / cap) - 1, F.lit(0)).cast("bigint")
    return (items.select(F.col(key).alias("key"), s.alias("s"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
            .select("key", "piece", (F.col("piece") * cap).alias("start"),
                    F.when(F.col("s") > cap, F.least(cap, F.col("s") - F.col("piece") * cap)).otherwise(F.col("s")).alias("size")))


def ranked(p: DataFrame, most: int, rows: int = 100_000) -> DataFrame:
    """Adds `rank`, from 0, among the pieces of one size. `most` is the largest number of pieces of one size.

    A size with many pieces is ranked in hash buckets of about `rows` pieces, whose counts give the offsets.
    """
    buckets = max(1, math.ceil(most / rows))
    p = p.withColumn("bucket", F.pmod(F.xxhash64("key", "piece"), F.lit(buckets)))
    one = Window.partitionBy("size", "bucket").orderBy("key", "piece")
    r = p.withColumn("rank", F.row_number().over(one) - 1)
    if buckets > 1:
        before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        off = (p.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("c"))
               .select("size", "bucket", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("off")))
        r = r.join(off, ["size", "bucket"]).withColumn("rank", F.col("rank") + F.col("off")).drop("off")
    return r.drop("bucket").withColumn("rank", F.col("rank").cast("bigint"))


def pack(items: DataFrame, capacity: int, *, key: str = "doc_id", size: str = "n_tokens", groups: int = 32, small: int = 8) -> DataFrame:
    """One row per piece: key, piece, start, size, container (from 0). Keys are unique.

    Only an item above the capacity is cut. Items of NULL or no size go to container 0. Empty input gives no rows.
    """
    spark = items.sparkSession
    p = written(pieces(items, capacity, key, size), "pack-pieces")
    histogram = {r[0]: r[1] for r in p.groupBy("size").count().collect()}  # at most capacity + 1 rows
    made = plan(histogram, capacity, groups, small)
    # segments number at most a few times the capacity, whatever the data's size; `small_table` checks it before it hints a broadcast
    segments = small_table(spark, made.segments or [(-1, 0, 0, 0, 1)], "size long, lo long, hi long, first long, per long")
    r = ranked(p, max(histogram.values(), default=0))
    inside = (F.col("p.size") == F.col("g.size")) & (F.col("p.rank") >= F.col("g.lo")) & (F.col("p.rank") < F.col("g.hi"))
    return (r.alias("p").join(segments.alias("g"), inside)
            .select(F.col("p.key").alias(key), F.col("p.piece").cast("int").alias("piece"), F.col("p.start").alias("start"), F.col("p.size").alias("size"),
                    (F.col("g.first") + F.floor((F.col("p.rank") - F.col("g.lo")) / F.col("g.per"))).cast("bigint").alias("container")))
