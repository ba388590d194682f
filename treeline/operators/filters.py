"""Predicates over manifests, and the filter specification that scans and plans share."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.functions import paths


def glob_match(col: Column, pattern: str) -> Column:
    """``*`` matches all, ``*x*`` contained, ``*x`` suffix, ``x*`` prefix, else equality; a star
    inside is an ordinary character."""
    if pattern == "*":
        return F.lit(True)
    if len(pattern) > 1 and pattern[0] == pattern[-1] == "*":
        return F.contains(col, F.lit(pattern[1:-1]))
    if pattern.startswith("*"):
        return F.endswith(col, F.lit(pattern[1:]))
    if pattern.endswith("*"):
        return F.startswith(col, F.lit(pattern[:-1]))
    return col == pattern


def matches(name: str, pattern: str) -> bool:
    """glob_match for one name, for the scan that prunes while it walks."""
    if pattern == "*":
        return True
    if len(pattern) > 1 and pattern[0] == pattern[-1] == "*":
        return pattern[1:-1] in name
    if pattern.startswith("*"):
        return name.endswith(pattern[1:])
    if pattern.endswith("*"):
        return name.startswith(pattern[:-1])
    return name == pattern


def _any(col: Column, patterns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (glob_match(col, p) for p in patterns), F.lit(False))


@dataclass(frozen=True)
class FilterSpec:
    """What a scan or plan leaves out.  Sizes are inclusive bounds."""

    exclude_files: tuple[str, ...] = ()
    exclude_dirs: tuple[str, ...] = ()
    min_size: int | None = None
    max_size: int | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        out = exclude_dirs(exclude_files(df, self.exclude_files), self.exclude_dirs)
        return size_between(out, self.min_size, self.max_size)


def exclude_files(df: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Without the rows whose base name matches."""
    return df.filter(~_any(paths.base_name("path"), patterns)) if patterns else df


def exclude_dirs(df: DataFrame, patterns: Sequence[str], root: str | None = None) -> DataFrame:
    """Without the subtrees of matching directories.  The last component of a file is its name,
    not a directory.  With ``root``, its own components are tested too."""
    if not patterns:
        return df
    parts = paths.components("path")
    if "kind" in df.columns:
        dirs = F.when(F.col("kind") == "dir", parts).otherwise(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))))
    else:
        dirs = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    if root:
        dirs = F.concat(F.array(*[F.lit(x) for x in root.split("/") if x]), dirs)
    return df.filter(~F.exists(dirs, lambda x: _any(x, patterns)))


def size_between(df: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    if low is not None:
        df = df.filter(F.col("size") >= low)
    if high is not None:
        df = df.filter(F.col("size") <= high)
    return df


def link_policy(df: DataFrame, drop_links: bool = False, drop_dir_links: bool = False, drop_file_links: bool = False) -> DataFrame:
    """Drops links: all, those to directories, or those to files; a link's target is found by its
    path among the rows, relative targets from the link's directory."""
    if drop_links:
        return df.filter("kind <> 'symlink'")
    if not (drop_dir_links or drop_file_links):
        return df
    target = paths.normalize_path(
        F.when(F.startswith("link_target", F.lit("/")), F.substring("link_target", 2, 1 << 20)).otherwise(
            F.concat_ws("/", F.nullif(paths.parent("path"), F.lit("")), F.col("link_target"))
        )
    )
    kinds = df.select(F.col("path").alias("_target"), F.col("kind").alias("_target_kind"))
    dirs = df.select(F.explode(paths.ancestors("path")).alias("_target"), F.lit("dir").alias("_target_kind"))
    kinds = kinds.unionByName(dirs).groupBy("_target").agg(F.min("_target_kind").alias("_target_kind"))
    out = df.withColumn("_target", F.when(F.col("kind") == "symlink", target)).join(kinds, "_target", "left")
    drop = [k for k, on in (("dir", drop_dir_links), ("file", drop_file_links)) if on]
    keep = (F.col("kind") != "symlink") | ~F.coalesce(F.col("_target_kind").isin(*drop), F.lit(False))
    return out.filter(keep).select(*df.columns)


def empty_dirs(df: DataFrame, include: bool = True) -> DataFrame:
    """All rows, or without the directories that hold no file or link at any depth."""
    if include:
        return df
    used = df.filter("kind <> 'dir'").select(F.explode(paths.ancestors("path")).alias("path")).distinct()
    return df.filter("kind <> 'dir'").unionByName(df.filter("kind = 'dir'").join(used, "path", "left_semi"))


def files_only(df: DataFrame) -> DataFrame:
    return df.filter("kind = 'file'")


class TooManyRows(ValueError):
    pass


def assert_max_rows(df: DataFrame, n: int = 1_000_000) -> DataFrame:
    """df, or TooManyRows; looks at no more than n + 1 rows."""
    if df.limit(n + 1).count() > n:
        raise TooManyRows(f"more than {n} rows")
    return df


def latest_by_key(df: DataFrame, key: str, ts: str, n: int = 10) -> DataFrame:
    """The latest row of each key, of these the n latest."""
    first = Window.partitionBy(key).orderBy(F.col(ts).desc())
    return df.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank").orderBy(F.col(ts).desc(), key).limit(n)
