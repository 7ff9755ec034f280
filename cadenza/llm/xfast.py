"""Matching records by nearest time: x-fast tries per entity and time block.

A trie stores integer keys of `bits` bits. For every prefix length it has a hash table from the prefixes that
occur to the smallest and largest key below them; the keys themselves form a linked list. A look-up binary
searches the longest stored prefix of the wanted key (log2(bits) hash look-ups), which gives one neighbour,
and the list gives the other.

An entity may hold any share of all rows, so the unit of work is (entity, block of time): references are
copied into the neighbouring block where they lie within the tolerance of the border, and equal times of an
entity are reduced to one reference before the shuffle. A block with many rows is cut into parts of consecutive
time cells that hold about `rows_per_part` rows each, with the nearest reference before and behind added to each part;
probes of one part beyond that number (many at one time) are spread over salts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["entity", "block", "part", "salt"]
CELLS = 1 << 16  # time cells of a block with many rows
TICKS = 1_000_000  # ticks in a second: times are compared as exact decimals, not as binary fractions


class XFastTrie:
    """Predecessor and successor over a fixed set of integers below 2**bits."""

    def __init__(self, keys: list[int], bits: int):
        self.bits = bits
        keys = sorted(set(keys))
        self.before = dict(zip(keys[1:], keys))
        self.after = dict(zip(keys, keys[1:]))
        self.levels: list[dict[int, tuple[int, int]]] = []
        for length in range(bits + 1):
            self.levels.append(self._level(keys, bits - length))

    @staticmethod
    def _level(keys: list[int], shift: int) -> dict[int, tuple[int, int]]:
        """The smallest and largest key of each prefix. Arrays pay only where there are many keys."""
        if len(keys) < 500:
            table: dict[int, tuple[int, int]] = {}
            for k in keys:
                p = k >> shift
                table[p] = (table[p][0], k) if p in table else (k, k)
            return table
        all_ = np.array(keys, "int64")
        prefix, first = np.unique(all_ >> shift, return_index=True)
        last = np.append(first[1:], len(keys)) - 1
        return dict(zip(prefix.tolist(), zip(all_[first].tolist(), all_[last].tolist())))

    def neighbours(self, q: int) -> tuple[int | None, int | None]:
        """Largest key at most q and smallest key at least q."""
        if not self.levels[0]:
            return None, None
        lo, hi = 0, self.bits  # the longest prefix of q that is stored has a length in [lo, hi]
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if q >> (self.bits - mid) in self.levels[mid]:
                lo = mid
            else:
                hi = mid - 1
        if lo == self.bits:
            return q, q
        least, most = self.levels[lo][q >> (self.bits - lo)]
        if q >> (self.bits - lo - 1) & 1:  # only the 0 child exists, all of it is below q
            return most, self.after.get(most)
        return self.before.get(least), least


def _bits(width: int) -> int:
    return max(1, (width - 1).bit_length())


def _matcher(block: int, tolerance: int):
    """mapInPandas over rows sorted by (entity, block, part, salt, side, tick): references come before probes."""
    span = block + 2 * tolerance + 1
    bits = _bits(span)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, refs, trie, base = None, {}, None, 0
        for pdf in batches:
            out_probe, out_ref, out_gap = [], [], []
            for entity, b, part, salt, side, tick, rid in zip(*(pdf[c] for c in KEYS), pdf["side"], pdf["tick"], pdf["rid"]):
                if (entity, b, part, salt) != key:
                    key, refs, trie, base = (entity, b, part, salt), {}, None, b * block - tolerance
                if side == 0:
                    refs[tick - base] = rid
                    continue
                if not refs:
                    continue
                trie = trie or XFastTrie(list(refs), bits)
                q = tick - base
                best = min(((abs(q - k), refs[k]) for k in trie.neighbours(q) if k is not None), default=None)
                if best and best[0] <= tolerance:
                    out_probe.append(rid)
                    out_ref.append(best[1])
                    out_gap.append(best[0])
            yield pd.DataFrame({"probe_id": pd.Series(out_probe, dtype="int64"), "ref_id": pd.Series(out_ref, dtype="int64"),
                                "gap_ticks": pd.Series(out_gap, dtype="int64")})

    return run


def to_ticks(seconds: Column) -> Column:
    """Seconds as whole ticks; NULL, NaN and times outside the range of ticks give NULL."""
    t = F.round(seconds * F.lit(TICKS))
    return F.when(F.abs(t) < F.lit(4e18), t.cast("bigint"))


def _in_parts(both: DataFrame, heavy: DataFrame, block: int, tol: int, limit: int) -> DataFrame:
    """`both` with part and salt. The cells of a heavy block number at most CELLS, so its cumulative counts are bounded too,
    and a cell holds few distinct times; the neighbours of a part come from aggregates, not from its rows."""
    span = block + 2 * tol + 1
    cell = F.floor((F.col("tick") - F.col("block") * F.lit(block) + F.lit(tol)) * F.lit(float(CELLS)) / F.lit(float(span))).cast("int")
    both = both.withColumn("cell", cell)
    at = F.when(F.col("side") == 0, F.struct("tick", "rid"))
    cells = (both.join(heavy, ["entity", "block"], "left_semi").groupBy("entity", "block", "cell")
             .agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("least"), F.max(at).alias("most")))
    order = Window.partitionBy("entity", "block").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("part", F.floor(F.coalesce(F.sum("n").over(order), F.lit(0)) / F.lit(limit)))
    parts = cells.groupBy("entity", "block", "part").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    before = Window.partitionBy("entity", "block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("entity", "block").orderBy("part").rowsBetween(1, Window.unboundedFollowing)
    parts = parts.select("entity", "block", "part", F.ceil(F.col("n") / F.lit(limit)).cast("int").alias("salts"),
                         F.array(F.last("most", True).over(before), F.first("least", True).over(behind)).alias("near"))
    place = cells.select("entity", "block", "cell", "part").join(parts.select("entity", "block", "part", "salts"), ["entity", "block", "part"])
    rows = (both.join(place, ["entity", "block", "cell"], "left").withColumn("part", F.coalesce("part", F.lit(0))).withColumn("salts", F.coalesce("salts", F.lit(1)))
            .select("entity", "block", "part", "side", "tick", "rid", "salts"))
    edges = (parts.select("entity", "block", "part", "salts", F.explode(F.array_compact("near")).alias("r"))
             .select("entity", "block", "part", F.lit(0).alias("side"), "r.tick", "r.rid", "salts"))
    # references go to every salt of their part, probes to one
    own = F.when(F.col("side") == 0, F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("rid", "tick"), F.col("salts")).cast("int")))
    return rows.unionByName(edges).withColumn("salt", F.explode(own)).drop("salts")


def nearest(probes: DataFrame, refs: DataFrame, tolerance: float, *, block_seconds: int = 256,
            rows_per_part: int = 50_000) -> DataFrame:
    """(probe_id, ref_id, gap_ticks): each probe's nearest reference of its entity within the tolerance.

    Both sides have `entity` BIGINT, `seconds` DOUBLE and `probe_id` or `ref_id` BIGINT. At equal distance the
    smaller ref_id wins. Rows with a NULL entity or time match nothing. Ids need not be unique: every probe row
    gets its own result row. Blocks of more than `rows_per_part` rows are cut into parts; if there are none (one count
    before the join tells), the joins that cut them are left out of the plan.
    """
    block, tol = block_seconds * TICKS, round(tolerance * TICKS)
    if tol >= block:
        raise ValueError("the tolerance must be shorter than a block")
    floor_block = lambda c: ((c - F.pmod(c, F.lit(block))) / F.lit(block)).cast("bigint")
    p = (probes.select("entity", to_ticks(F.col("seconds")).alias("tick"), F.col("probe_id").alias("rid"))
         .where("entity is not null and tick is not null").withColumn("block", floor_block(F.col("tick"))))
    r = (refs.select("entity", to_ticks(F.col("seconds")).alias("tick"), F.col("ref_id").alias("rid"))
         .where("entity is not null and tick is not null").groupBy("entity", "tick").agg(F.min("rid").alias("rid")))
    r = r.withColumn("block", F.explode(F.array_distinct(F.array(
        floor_block(F.col("tick") - F.lit(tol)), floor_block(F.col("tick")), floor_block(F.col("tick") + F.lit(tol))))))
    cols = ["entity", "block", "tick", "rid"]
    both = r.select(F.lit(0).alias("side"), *cols).unionByName(p.select(F.lit(1).alias("side"), *cols))
    heavy = both.groupBy("entity", "block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows_per_part).select("entity", "block")
    if heavy.take(1):
        both = _in_parts(both, heavy, block, tol, rows_per_part)
    else:
        both = both.withColumn("part", F.lit(0).cast("bigint")).withColumn("salt", F.lit(0))
    return (both.select(*KEYS, "side", "tick", "rid").repartition(*KEYS).sortWithinPartitions(*KEYS, "side", "tick")
            .mapInPandas(_matcher(block, tol), "probe_id long, ref_id long, gap_ticks long"))
