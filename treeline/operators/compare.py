"""Comparisons of manifests: need, extras, verification, parity, as joins on the path.

Every join has an equi key; sides are whole manifests, so none is broadcast by hand: Catalyst picks
by size and AQE splits skew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.functions import paths

NEWER_US = 3_000_000  # a source counts as newer from 3 seconds on

LABELS = {
    "local": ("changed", "missing_dest", "extra_dest"),
    "push": ("changed", "missing_remote", "extra_remote"),
    "pull": ("changed", "missing_local", "extra_local"),
}


def _sided(df: DataFrame, side: str) -> DataFrame:
    return df.select("path", *[F.col(c).alias(f"{c}_{side}") for c in df.columns if c != "path"])


def need_copy(src: DataFrame, dst: DataFrame, compare: str = "size_mtime") -> DataFrame:
    """Source rows to copy, with reason: missing, size, newer (by 3 s or more), digest, unknown.

    mtime in whole seconds; where both sides have mtime_us (microseconds), that decides.  ``compare="checksum"`` tests digests of pairs of equal size; those are
    what ``equal_size_pairs`` gives, so content of others need not be read."""
    unknown = F.col("size").isNull() | F.col("size_dst").isNull()
    reason = F.when(F.col("there").isNull(), "missing").when(unknown, "unknown").when(F.col("size") != F.col("size_dst"), "size")
    if compare == "checksum":
        reason = reason.when(F.coalesce(F.col("digest") != F.col("digest_dst"), F.lit(True)), "digest")
    else:
        exact = "mtime_us" in src.columns and "mtime_us" in dst.columns
        newer = F.col("mtime_us") - F.col("mtime_us_dst") if exact else (F.col("mtime") - F.col("mtime_dst")) * 1_000_000
        newer = newer >= NEWER_US
        reason = reason.when(F.coalesce(newer, F.lit(True)), "newer")
    marked = src.join(_sided(dst, "dst").withColumn("there", F.lit(True)), "path", "left").withColumn("reason", reason)
    return marked.filter("reason is not null").select(*src.columns, "reason")


def need_all(manifest: DataFrame) -> DataFrame:
    return manifest.filter(F.col("kind").isin("file", "symlink")).select("path")


def need_filter(files: DataFrame, need: DataFrame) -> DataFrame:
    return files.join(need.select("path"), "path", "left_semi")


def extra_files(dst: DataFrame, src: DataFrame, fold: bool = False) -> DataFrame:
    """Destination rows without a source row of the same key."""
    keys = src.select(paths.path_key("path", fold).alias("_key")).distinct()
    return dst.withColumn("_key", paths.path_key("path", fold)).join(keys, "_key", "left_anti").drop("_key")


def extra_dirs(dst: DataFrame, src: DataFrame, fold: bool = False) -> DataFrame:
    """Destination directories that are neither source directories nor above a source row."""
    above = src.select(F.explode(paths.ancestors("path")).alias("path"))
    known = src.filter("kind = 'dir'").select("path").unionByName(above)
    return extra_files(dst.filter("kind = 'dir'"), known, fold)


def pull_extras(dst: DataFrame, received: DataFrame) -> DataFrame:
    """Files and links not received, then the directories that this leaves empty: (path, kind)."""
    keep = dst.filter("kind <> 'dir'").join(received.select("path"), "path", "left_semi")
    gone = dst.filter("kind <> 'dir'").join(received.select("path"), "path", "left_anti").select("path", "kind")
    used = keep.select(F.explode(paths.ancestors("path")).alias("path")).unionByName(received.select("path")).distinct()
    dirs = dst.filter("kind = 'dir'").join(used, "path", "left_anti").select("path", "kind")
    return gone.unionByName(dirs)


def verify(src: DataFrame, dst: DataFrame, compare: str = "size", labels: str = "local", parity_times: bool = False) -> DataFrame:
    """Differences (kind, path, size_src, size_dest, mtime_src, mtime_dest) of two manifests.

    compare: size, size_mtime, or checksum (a missing digest differs).  ``labels="pull"`` names
    rows of src alone extra_local's counterpart: src is the remote side, so what only it has is
    extra_local, and what only dst has is missing_local."""
    changed, missing, extra = LABELS[labels]
    if labels == "pull":
        missing, extra = extra, missing
    j = _sided(src, "src").withColumn("in_src", F.lit(True)).join(_sided(dst, "dest").withColumn("in_dest", F.lit(True)), "path", "full_outer")
    if compare == "checksum":
        same = F.coalesce(F.col("digest_src") == F.col("digest_dest"), F.lit(False))
    else:
        same = F.col("size_src") == F.col("size_dest")
        if compare == "size_mtime":
            same = same & (F.abs(F.col("mtime_src") - F.col("mtime_dest")) * 1_000_000 < NEWER_US)
        same = F.coalesce(same, F.lit(False))
    kind = F.when(F.col("in_dest").isNull(), missing).when(F.col("in_src").isNull(), extra).when(~same, changed)

    def shown(c: str) -> Column:
        return F.lit(0).cast("bigint").alias(c) if parity_times and c.startswith("mtime") else F.coalesce(c, F.lit(0)).cast("bigint").alias(c)

    return j.withColumn("kind", kind).filter("kind is not null").select("kind", "path", *[shown(c) for c in ("size_src", "size_dest", "mtime_src", "mtime_dest")])


def lookup_hashes(wanted: DataFrame, hashes: DataFrame) -> DataFrame:
    """wanted (path) with digests of hashes (path, status, digest) of status 0."""
    return wanted.join(hashes.filter("status = 0").select("path", "digest"), "path", "left")


def tree_parity(src: DataFrame, dst: DataFrame) -> DataFrame:
    """One row: counts and bytes of both sides, and whether they agree (two one-row frames)."""
    def total(df: DataFrame, side: str) -> DataFrame:
        return df.agg(F.count("*").alias(f"files_{side}"), F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias(f"bytes_{side}")).withColumn("one", F.lit(1))

    both = total(src, "src").join(total(dst, "dest"), "one").drop("one")
    return both.withColumn("equal", (F.col("files_src") == F.col("files_dest")) & (F.col("bytes_src") == F.col("bytes_dest")))


def fold_collisions(df: DataFrame) -> DataFrame:
    """Keys under which several paths merge when ASCII case is folded."""
    key = paths.path_key("path", True)
    return df.groupBy(key.alias("folded")).agg(F.count("*").alias("n"), F.min("path").alias("first_path")).filter("n > 1")


def key_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("path").union(b.select("path")).distinct()


def key_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("path").join(b.select("path"), "path", "left_anti")


def key_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("path").intersect(b.select("path"))


def all_dirs(df: DataFrame) -> DataFrame:
    return df.select(F.explode(paths.ancestors("path")).alias("path")).distinct()


def equal_size_pairs(src: DataFrame, dst: DataFrame) -> DataFrame:
    """Paths of equal size on both sides: the only ones whose content a comparison must read."""
    return src.select("path", "size").join(dst.select("path", "size"), ["path", "size"]).select("path")
