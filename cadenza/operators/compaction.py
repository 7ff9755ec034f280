"""Consolidating tiny files: size-tiered incremental compaction with an idempotent journal.

A store is a folder with four Parquet parts:

* `journal`: the transactions. action `merge`: input_id went into output_id at a level; action `place`: the container
  input_id of an earlier run ended in output_id after all levels; action `duplicate`: input_id is another copy of the
  clip that output_id stands for, and was merged away with it.
* `index`: one row per input file: the file that stands for its clip (kept_id) and the container this one came into.
* `data/run=...`: the bytes, in files of about `file_bytes`; a file holds whole containers, named in a column.
* `commits`: one row per container whose data was written in full, and one without a container that ends its run. A run
  without commits never happened: readers skip its rows, and `vacuum` removes its files.

Ids of outputs are made from their inputs, so a run that is repeated after a crash makes the same transactions again.
Planning moves metadata only; bytes are read and written once, when a run's final containers are written.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.session import dropped, written

_S, _L = T.StringType(), T.LongType()
JOURNAL = T.StructType([T.StructField("action", _S), T.StructField("level", T.IntegerType()), T.StructField("input_id", _S), T.StructField("output_id", _S),
                        T.StructField("input_bytes", _L), T.StructField("run", _S)])
INDEX = T.StructType([T.StructField("input_id", _S), T.StructField("kept_id", _S), T.StructField("key", _S), T.StructField("container", _S), T.StructField("input_bytes", _L), T.StructField("run", _S)])
COMMITS = T.StructType([T.StructField("output_id", _S), T.StructField("level", T.IntegerType()), T.StructField("n_records", _L), T.StructField("n_bytes", _L), T.StructField("run", _S)])
FILE = T.StructType([T.StructField("file_id", _S), T.StructField("key", _S), T.StructField("payload", T.BinaryType())])


@dataclass(frozen=True)
class Tiers:
    """Level L holds items of less than base * fan_in**(L+1) bytes; items of `target` bytes are left alone.

    A window of the planner holds about `window_groups` outputs of its level or `window_rows` items. Files of the data are
    written with about `file_bytes` each, by as many tasks.
    """

    target_bytes: int = 64 << 20
    fan_in: int = 16
    base_bytes: int = 16 << 10
    window_groups: int = 64
    window_rows: int = 200_000
    file_bytes: int = 256 << 20

    def cap(self, level: int) -> int:
        return min(self.target_bytes, self.base_bytes * self.fan_in ** (level + 1))

    @property
    def levels(self) -> int:
        return max(1, math.ceil(math.log(self.target_bytes / self.base_bytes, self.fan_in)))


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    fs, at = _fs(spark, path)
    return spark.read.schema(schema).parquet(path) if fs.exists(at) else spark.createDataFrame([], schema)


def _ended(spark: SparkSession, store: str) -> DataFrame:
    return _read(spark, f"{store}/commits", COMMITS).where("output_id is null").select("run").distinct()


def journal(spark: SparkSession, store: str) -> DataFrame:
    """The transactions of the runs that were committed."""
    return _read(spark, f"{store}/journal", JOURNAL).join(_ended(spark, store), "run", "left_semi").dropDuplicates(["action", "input_id", "output_id"])


def index(spark: SparkSession, store: str) -> DataFrame:
    """Every file that the store has taken in: input_id, kept_id, key, container, input_bytes, run. A file whose kept_id is another
    was merged away as a copy; its container is NULL if the other was in the store before."""
    return _read(spark, f"{store}/index", INDEX).join(_ended(spark, store), "run", "left_semi").select(*INDEX.fieldNames())


def commits(spark: SparkSession, store: str) -> DataFrame:
    return _read(spark, f"{store}/commits", COMMITS).where("output_id is not null").join(_ended(spark, store), "run", "left_semi").dropDuplicates(["output_id"])


def live(spark: SparkSession, store: str) -> DataFrame:
    """Committed containers that no later committed one has taken in."""
    taken = journal(spark, store).where("action = 'place'").select(F.col("input_id").alias("output_id"))
    return commits(spark, store).join(taken, "output_id", "left_anti").select(*COMMITS.fieldNames())


def read_store(spark: SparkSession, store: str, schema: T.StructType) -> DataFrame:
    """All records of the live containers, with their container; `schema` is that of the data files."""
    data = _read(spark, f"{store}/data", T.StructType([*schema.fields, T.StructField("container", _S), T.StructField("run", _S)]))
    return data.join(live(spark, store).select(F.col("output_id").alias("container"), "run"), ["container", "run"], "left_semi").drop("run")


def vacuum(spark: SparkSession, store: str) -> int:
    """Delete the data of runs that hold no live container: superseded ones and those that crashed. Returns how many.

    Safe to repeat. No run may be in progress. What a run holds beside live containers stays until those are merged too.
    """
    needed = {r["run"] for r in live(spark, store).select("run").distinct().collect()}  # one per run of the store
    fs, at = _fs(spark, f"{store}/data")
    n = 0
    for f in fs.listStatus(at) if fs.exists(at) else []:
        name = f.getPath().getName()
        if name.startswith("run=") and name[4:] not in needed:
            fs.delete(f.getPath(), True)
            n += 1
    return n


def keep_first(files: DataFrame, *, file_id: str, key: str, time: str) -> DataFrame:
    """(file_id, kept_id) for every file: kept_id is its key's earliest file, ties by id; a NULL time is last.

    The earliest is an aggregate that is combined before the shuffle. A key with very many files is one row
    on the side of the aggregate, so adaptive skew handling may split the other side freely.
    """
    order = F.struct(F.col(time).isNull(), F.col(time), F.col(file_id))
    first = files.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.col(file_id), order).alias("kept_id"))
    return files.join(first, F.col(key) == F.col("_key")).drop("_key")


def plan_level(items: DataFrame, level: int, tiers: Tiers) -> DataFrame:
    """Group one level's items (item_id, bytes) into outputs of about the level's size: adds output_id.

    Items are spread by hash over windows of bounded size, and cut by running sum inside each. The id of an
    output is a digest of its inputs. Groups of one item get NULL: they pass to the next level as they are.
    """
    cap = tiers.cap(level)
    n, total = items.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    windows = max(1, math.ceil(total / (cap * tiers.window_groups)), math.ceil(n / tiers.window_rows))
    w = Window.partitionBy("win").orderBy("bytes", "item_id").rowsBetween(Window.unboundedPreceding, -1)
    cut = (items.withColumn("win", F.pmod(F.xxhash64("item_id"), F.lit(windows)))
           .withColumn("cut", F.floor(F.coalesce(F.sum("bytes").over(w), F.lit(0)) / F.lit(cap))))
    made = cut.groupBy("win", "cut").agg(
        F.count(F.lit(1)).alias("n"),
        F.concat(F.lit(f"L{level}-"), F.hex(F.bit_xor(F.xxhash64("item_id"))), F.lit("-"),
                 F.hex(F.sum(F.xxhash64(F.reverse("item_id")) % F.lit(1 << 40)))).alias("made"))
    return cut.join(made, ["win", "cut"]).select("item_id", "bytes", F.when(F.col("n") > 1, F.col("made")).alias("output_id"))


def compact(files: DataFrame, store: str, *, file_id: str, key: str, size: str, time: str, payload: str,
            tiers: Tiers = Tiers(), bodies: DataFrame | None = None) -> str:
    """Merge `files` into the store and return the name of this run.

    `files` holds intact files only: a string id, the key of what they contain, bytes and payload. Rows with a
    NULL key are stored under their own id. Files that the store holds, or has as duplicates, are left out;
    files whose key the store holds already are journalled as duplicates. Empty input makes no transaction. `bodies` may
    give (file_id, payload) by a plainer way than `files`, whose other columns are needed for planning only.
    The bytes that are written are counted against the plan before the run is committed.
    """
    spark = files.sparkSession
    run = spark.range(1).select(F.expr("uuid()")).first()[0]
    made_here: list[DataFrame] = []

    def kept(df: DataFrame, label: str) -> DataFrame:
        made_here.append(written(df, label))
        return made_here[-1]

    def log(df: DataFrame, action: str, level) -> DataFrame:
        return df.select(F.lit(action).alias("action"), level.cast("int").alias("level"), "input_id", "output_id", "input_bytes", F.lit(run).alias("run"))

    meta = files.select(F.col(file_id).alias("input_id"), F.coalesce(key, file_id).alias("key"),
                        F.col(size).cast("bigint").alias("bytes"), F.col(time).alias("at"))
    old_data = live(spark, store)
    fresh = not old_data.take(1)
    if fresh:
        meta = meta.withColumn("held", F.lit(None).cast("string"))
    else:
        before = index(spark, store)
        meta = (meta.join(before.select("input_id"), "input_id", "left_anti")
                .join(before.where("input_id = kept_id").select("key", F.col("input_id").alias("held")), "key", "left"))
    meta = kept(meta, "compact-meta")  # names are parsed once
    first = kept(keep_first(meta, file_id="input_id", key="key", time="at")
                 .select("input_id", F.coalesce("held", "kept_id").alias("kept_id"), "key", "bytes", F.col("held").isNotNull().alias("in_store")), "compact-first")
    waiting = first.where("input_id = kept_id").select(F.col("input_id").alias("item_id"), "bytes")
    # Files enter at level 0; containers of earlier runs join at the level of their size.
    old = old_data.where(F.col("n_bytes") < tiers.target_bytes).select(F.col("output_id").alias("item_id"), F.col("n_bytes").alias("bytes"))
    merges = []
    for level in range(tiers.levels):
        fits = F.col("bytes") < tiers.cap(level)
        low = 0 if level == 0 else tiers.cap(level - 1)
        joins = old.where(fits & (F.col("bytes") >= low)) if not fresh else None
        items = waiting.where(fits) if joins is None else waiting.where(fits).unionByName(joins)
        plan = kept(plan_level(items, level, tiers), f"compact-plan{level}")
        merges.append(plan.where("output_id is not null"))
        merged = merges[-1].groupBy(F.col("output_id").alias("item_id")).agg(F.sum("bytes").alias("bytes"))
        rest = plan.where("output_id is null").select("item_id", "bytes")
        if joins is not None:  # an old container that found no partner stays what it is
            rest = rest.join(old, "item_id", "left_anti")
        waiting = merged.unionByName(rest).unionByName(waiting.where(~fits))

    def follow(df: DataFrame) -> DataFrame:
        """Where each `src` ends after all levels."""
        df = df.withColumn("at_id", F.col("src"))
        for plan in merges:
            df = df.join(plan.select(F.col("item_id").alias("at_id"), F.col("output_id").alias("to_id")), "at_id", "left").select(
                *[c for c in df.columns if c != "at_id"], F.coalesce("to_id", "at_id").alias("at_id"))
        return df

    # A file that met no other becomes a container of its own; one whose clip the store holds already comes into none.
    own = F.concat(F.lit("L0-"), F.sha2("src", 256))
    (follow(first.withColumn("src", F.col("kept_id")))
     .select("input_id", "kept_id", "key", F.when(~F.col("in_store"), F.when(F.col("src") == F.col("at_id"), own).otherwise(F.col("at_id"))).alias("container"),
             F.col("bytes").alias("input_bytes"), F.lit(run).alias("run"))
     .write.mode("append").parquet(f"{store}/index"))
    placed = _read(spark, f"{store}/index", INDEX).where(F.col("run") == run)
    where = placed.where("input_id = kept_id").select(F.col("input_id").alias("src"), "key", F.col("input_bytes").alias("bytes"), "container")
    moved = kept(follow(old.select(F.col("item_id").alias("src"))).where("src <> at_id"), "compact-moved") if not fresh else None

    steps = [log(p.select(F.col("item_id").alias("input_id"), "output_id", F.col("bytes").alias("input_bytes")), "merge", F.lit(i)) for i, p in enumerate(merges)]
    steps.append(log(where.where(F.col("container") == own).select(F.col("src").alias("input_id"), F.col("container").alias("output_id"), F.col("bytes").alias("input_bytes")), "merge", F.lit(0)))
    steps.append(log(placed.where("input_id <> kept_id").select("input_id", F.col("kept_id").alias("output_id"), "input_bytes"), "duplicate", F.lit(-1)))
    if moved is not None:
        steps.append(log(moved.select(F.col("src").alias("input_id"), F.col("at_id").alias("output_id"), F.lit(None).cast("bigint").alias("input_bytes")), "place", F.lit(-1)))
    out = steps[0]
    for step in steps[1:]:
        out = out.unionByName(step)
    out.write.mode("append").parquet(f"{store}/journal")
    made = where.groupBy(F.col("container").alias("output_id")).agg(F.count(F.lit(1)).alias("n_records"), F.sum("bytes").alias("n_bytes"))
    body = ((files if bodies is None else bodies).select(F.col(file_id).alias("file_id"), F.col(payload).alias("payload")).join(where.select(F.col("src").alias("file_id"), "key", "container"), "file_id")
            .select("file_id", "key", "payload", "container"))
    if moved is not None:
        took = moved.join(commits(spark, store).select(F.col("output_id").alias("src"), "n_records", "n_bytes"), "src")
        made = made.unionByName(took.select(F.col("at_id").alias("output_id"), "n_records", "n_bytes")).groupBy("output_id").agg(F.sum("n_records").alias("n_records"), F.sum("n_bytes").alias("n_bytes"))
        body = body.unionByName(read_store(spark, store, FILE).join(moved, F.col("container") == F.col("src")).select("file_id", "key", "payload", F.col("at_id").alias("container")))
    made = kept(made, "compact-made")
    n_records, n_bytes = made.agg(F.coalesce(F.sum("n_records"), F.lit(0)), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    if n_records:
        seen = Observation()
        tasks = max(1, math.ceil(n_bytes / tiers.file_bytes))
        (body.observe(seen, F.count(F.lit(1)).alias("n")).repartition(tasks, "container").sortWithinPartitions("container")
         .write.mode("overwrite").parquet(f"{store}/data/run={run}"))
        if seen.get["n"] != n_records:
            raise RuntimeError(f"{seen.get['n']} records written where {n_records} were planned; the run is not committed")
    end = spark.createDataFrame([(None, None, 0, 0, run)], COMMITS)
    (made.select("output_id", F.regexp_extract("output_id", r"^L(\d+)-", 1).cast("int").alias("level"), "n_records", "n_bytes", F.lit(run).alias("run"))
     .unionByName(end).write.mode("append").parquet(f"{store}/commits"))
    for df in made_here:
        dropped(df)
    return run
