"""Optimal assignment of generated to reference frames, segment by segment.

A talking frame of the model may take any frame position of its segment: its own cost is the text cost (0..1 between
two talking frames, 1 against a silent reference) plus a Gaussian of the distance in positions. The assignment of
least total cost decides which talking frame takes each talking reference; taking a silent one means redundant.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, inf

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.numbers import cosine, distance_cost, semantic_cost

SIGMA = 0.01


def solve(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a matching of all rows of least cost (rows <= columns): shortest augmenting paths with
    potentials. Of equal reduced costs the lower column is taken first."""
    n, m = cost.shape
    u, v = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    for r in range(n):
        dist = np.full(m, inf)
        prev = np.full(m, -1)
        done = np.zeros(m, bool)
        i, reach, at = r, 0.0, -1
        while True:
            alt = reach + cost[i] - u[i] - v
            better = ~done & (alt < dist - 1e-15)
            dist[better] = alt[better]
            prev[better] = at
            j = int(np.where(done, inf, dist).argmin())
            reach = dist[j]
            done[j] = True
            if row_of[j] < 0:
                break
            i, at = int(row_of[j]), j
        for k in np.flatnonzero(done):
            v[k] -= reach - dist[k]
            if row_of[k] >= 0:
                u[row_of[k]] += reach - dist[k]
        u[r] += reach
        while j >= 0:
            p = int(prev[j])
            row_of[j] = row_of[p] if p >= 0 else r
            j = p
    out = np.full(n, -1)
    for j, i in enumerate(row_of):
        if i >= 0:
            out[i] = j
    return out


def one_reference(n: int, talks: list[int], r: int, text: dict[int, float]) -> int | None:
    """The talking position that takes the one talking reference r of a segment of n frames, or None if nobody does.

    Any talking frame may stay on its own silent column at cost 1, the least there; so only column r matters, and, if
    the frame at r talks itself, the way of that frame to a free column (which may push others along).
    """
    g = lambda a, b: 1 - exp(-SIGMA * (a - b) ** 2)
    own = set(talks)
    if r not in own:
        best = min(((text[i] + g(i, r), i) for i in talks), default=(inf, None))
        return best[1] if best[0] <= 1 else None
    # shortest ways from r over talking positions to a free one
    way = {r: 0.0}
    open_ = set(own)
    free = [p for p in range(n) if p not in own]
    while open_:
        a = min((p for p in open_ if p in way), key=way.__getitem__, default=None)
        if a is None:
            break
        open_.discard(a)
        for b in open_:
            if way[a] + g(a, b) < way.get(b, inf):
                way[b] = way[a] + g(a, b)
    out = min((way[a] + g(a, b) for a in own for b in free), default=inf)
    options = [(text[r], r)]
    for i in talks:
        if i != r:
            options.append((text[i] + g(i, r) + min(out, way[i]), i))
    return min(options)[1]


def match_segment(n: int, talks: list[int], refs: list[int], text: dict[tuple[int, int], float]) -> tuple[dict[int, int], list[int], list[int]]:
    """(reference of each matched talking position, redundant positions, missed references) of one segment."""
    if not refs or not talks:
        return {}, list(talks), list(refs)
    if len(refs) == 1:
        i = one_reference(n, talks, refs[0], {i: text[i, refs[0]] for i in talks})
        got = {} if i is None else {i: refs[0]}
    else:
        cost = 1 - np.exp(-SIGMA * (np.array(talks)[:, None] - np.arange(n)[None]) ** 2.0) + 1.0
        for c in refs:
            cost[:, c] += [text[i, c] - 1.0 for i in talks]
        column = solve(np.where(cost == 0, 1e-10, cost))
        got = {i: int(c) for i, c in zip(talks, column) if c in set(refs)}
    return got, [i for i in talks if i not in got], [c for c in refs if c not in got.values()]


def pair_costs(frames: DataFrame, key: str, vectors: DataFrame | None = None) -> DataFrame:
    """Costs of all (talking frame i, talking reference j) of each segment: key, seg, i, j, gen, ref, text_cost, distance_cost.

    `vectors` has text (distinct) and vec; a text without vector, or no vectors at all, gives text cost 0. The join is on
    key and segment: a segment has one reference (more only at equal times), so pairs number about the talking frames.
    """
    g = frames.where("gen <> ''").select(key, "seg", F.col("pos").alias("i"), "gen", F.col("ts").alias("gen_ts"))
    r = frames.where("ref <> ''").select(key, "seg", F.col("pos").alias("j"), "ref", F.col("ts").alias("ref_ts"))
    p = g.join(r, [key, "seg"])
    if vectors is None:
        p = p.withColumn("text_cost", F.lit(0.0))
    else:
        p = (p.join(vectors.select(F.col("text").alias("gen"), F.col("vec").alias("a")), "gen", "left")
             .join(vectors.select(F.col("text").alias("ref"), F.col("vec").alias("b")), "ref", "left")
             .withColumn("text_cost", F.coalesce(semantic_cost(cosine("a", "b")), F.lit(0.0))).drop("a", "b"))
    return p.select(key, "seg", "i", "j", "gen", "ref", "gen_ts", "ref_ts", "text_cost", distance_cost(F.col("i"), F.col("j"), SIGMA).alias("distance_cost"))


def match(frames: DataFrame, key: str, vectors: DataFrame | None = None) -> DataFrame:
    """The match table: key, seg, kind (matched, missed, redundant), i, j, cost, score, gen_ts, ref_ts.

    score is 1 - text cost, cost the text cost plus the distance cost. Segments without a talking reference need no
    solver; the others go to it as one row each, from one midpoint to the next. Frames with a NULL key match nothing.
    """
    with_refs = frames.where("ref <> ''").select(key, "seg").distinct()
    sides = frames.join(with_refs, [key, "seg"], "left_semi").groupBy(key, "seg").agg(
        F.count(F.lit(1)).cast("int").alias("n"),
        F.array_sort(F.collect_list(F.when(F.col("gen") != "", F.struct("pos", "ts")))).alias("talks"),
        F.array_sort(F.collect_list(F.when(F.col("ref") != "", F.struct("pos", "ts")))).alias("refs"))
    # a session without references is one segment of any length: its frames stay rows
    none = frames.where("gen <> ''").join(with_refs, [key, "seg"], "left_anti").select(
        key, "seg", F.lit("redundant").alias("kind"), F.col("pos").alias("i"), F.lit(None).cast("int").alias("j"),
        F.lit(None).cast("double").alias("cost"), F.lit(None).cast("double").alias("score"), F.col("ts").alias("gen_ts"), F.lit(None).cast("double").alias("ref_ts"))
    costs = pair_costs(frames, key, vectors).groupBy(key, "seg").agg(F.collect_list(F.struct("i", "j", "text_cost")).alias("text"))
    work = sides.join(costs, [key, "seg"], "left")
    kind = work.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [key, "seg", "kind", "i", "j", "cost", "score", "gen_ts", "ref_ts"]
        for pdf in batches:
            rows = []
            for k, seg, n, talks, refs, text in zip(pdf[key], pdf["seg"], pdf["n"], pdf["talks"], pdf["refs"], pdf["text"]):
                t, r = {x["pos"]: x["ts"] for x in talks}, {x["pos"]: x["ts"] for x in refs}
                c = {(x["i"], x["j"]): x["text_cost"] for x in text} if text is not None else {}
                got, extra, missed = match_segment(n, list(t), list(r), c)
                rows += [(k, seg, "matched", i, j, c[i, j] + 1 - exp(-SIGMA * (i - j) ** 2), 1 - c[i, j], t[i], r[j]) for i, j in got.items()]
                rows += [(k, seg, "redundant", i, None, None, None, t[i], None) for i in extra]
                rows += [(k, seg, "missed", None, j, None, None, None, r[j]) for j in missed]
            out = pd.DataFrame(rows, columns=cols)
            yield out.astype({"i": "Int32", "j": "Int32", "seg": "int32", "cost": "float64", "score": "float64", "gen_ts": "float64", "ref_ts": "float64"})

    solved = work.mapInPandas(run, f"{key} {kind}, seg int, kind string, i int, j int, cost double, score double, gen_ts double, ref_ts double")
    return solved.unionByName(none)
