"""Names of one-second clips: `dir/{source}_{start}_{end}{ext}`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.once import computed

# Marks that copying tools put at the end (or front) of a name; they are not part of the clip.
_MARKS = (r"^(?i:copy[ _]of[ _]|kopie[ _]von[ _])"
          r"|(?:[ _.\-]*(?i:copy|copie|kopie|copia|duplicate|dup|bak)(?:[ _\-]*\d+)?|\s*[(\[]\d+[)\]])+$")
_OUTER = " \t\n\r\x0b\x0c\x85\xa0\u2007\u202f\u3000\ufeff"


def basename(path: Column) -> Column:
    """Last part of a path; back slashes count as separators, outer white space is dropped."""
    return F.substring_index(F.substring_index(F.btrim(path, F.lit(_OUTER)), "/", -1), "\\", -1)


def stem(path: Column) -> Column:
    """Base name without its last extension."""
    return F.regexp_replace(basename(path), r"(?<=[^.])\.[^.]*$", "")


def _bare(path: Column) -> Column:
    """The stem without marks of copying."""
    return F.regexp_replace(stem(path), _MARKS, "")


def _clip(s: Column) -> Column:
    tail = F.substring_index(s, "_", -2)
    first, last = (F.substring_index(tail, "_", n).try_cast("bigint") for n in (1, -1))
    video = F.left(s, F.length(s) - F.length(tail) - 1)
    timed = tail.rlike(r"^\d+_\d+$") & (F.length(tail) < F.length(s)) & first.isNotNull() & last.isNotNull()
    return F.when(timed, F.struct(video.alias("video"), first.alias("first"), last.alias("last")))


def clip(path: Column) -> Column:
    """STRUCT<video, first, last> of a clip's path; NULL where the name holds no interval (or path is NULL).

    Upper and lower case differ in `video`; marks of copying and the extension do not belong to the clip. On tables,
    `with_clip` does the same with less work.
    """
    return _clip(_bare(path))


def with_clip(df: DataFrame, path: Column, name: str = "clip") -> DataFrame:
    """Adds the clip of a path as a column, each step of the parsing done once per row."""
    step = f"_bare_{name}"
    return computed(computed(df, step, _bare(path)), name, _clip(F.col(step))).drop(step)


def clip_key(c: Column) -> Column:
    """A clip as one text, NULL for NULL."""
    return F.when(c.isNotNull(), F.concat_ws("\t", c["video"], c["first"].cast("string"), c["last"].cast("string")))


def source_video(path: Column) -> Column:
    """The source video of a path: its clip's, else the stem; NULL for a NULL or blank path."""
    return F.nullif(F.coalesce(clip(path)["video"], stem(path)), F.lit(""))


def with_source(df: DataFrame, path: Column, name: str = "video") -> DataFrame:
    """Adds the source video of a path as a column, each step of the parsing done once per row."""
    step, c = f"_stem_{name}", f"_clip_{name}"
    d = computed(df, step, stem(path))
    d = computed(d, c, F.regexp_replace(F.col(step), _MARKS, ""))
    return computed(d, name, F.nullif(F.coalesce(_clip(F.col(c))["video"], F.col(step)), F.lit(""))).drop(step, c)


def with_interval(path: Column, start: Column, end: Column) -> Column:
    """Insert `_start_end` before the last extension of the path."""
    base = F.regexp_extract(path, r"^(.*?)(\.[^./\\]*)?$", 1)
    ext = F.regexp_extract(path, r"^(.*?)(\.[^./\\]*)?$", 2)
    return F.concat(base, F.lit("_"), start.cast("string"), F.lit("_"), end.cast("string"), ext)


def interval_pair(path: Column) -> Column:
    """STRUCT<start, end> from the last two `_` parts of the stem; (0, 0) if either is not an integer."""
    parts = F.split(stem(path), "_")
    a = F.try_element_at(parts, F.lit(-2)).try_cast("int")
    b = F.try_element_at(parts, F.lit(-1)).try_cast("int")
    both = a.isNotNull() & b.isNotNull()
    return F.struct(F.when(both, a).otherwise(0).alias("start"), F.when(both, b).otherwise(0).alias("end"))
