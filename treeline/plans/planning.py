"""Plans as tables: direction, size classes, bundles, ranges, guards and previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.functions import paths
from treeline.schema import MIB

SMALL, LARGE = MIB, 100 * MIB
PUSH_SMALL, RANGED = 1_000_000, 256 * MIB
STRIDE = 16 * MIB
BUCKETS = 64
BUCKET_FILES, BUCKET_BYTES = 100_000, 1 << 30  # of a bucket, about
FILE_OVERHEAD = 4096  # what a file of a bundle counts for, besides its bytes


def direction(src: Column, dst: Column, scheme: str = paths.SCHEME) -> Column:
    """push, pull, local, or both_remote (to be rejected)."""
    s, d = paths.parse_endpoint(src, scheme).isNotNull(), paths.parse_endpoint(dst, scheme).isNotNull()
    return F.when(s & d, "both_remote").when(d, "push").when(s, "pull").otherwise("local")


def is_root(path: Column) -> Column:
    """A filesystem root: only slashes, or a bare drive."""
    return path.rlike(r"^(?:/+|[A-Za-z]:[/\\]?)$")


def guard_roots(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs (verb, src, dst): those allowed, and those refused (move from, or mirror into, a root)."""
    bad = ((F.col("verb") == "move") & is_root(F.col("src"))) | ((F.col("verb") == "mirror") & is_root(F.col("dst")))
    bad = F.coalesce(bad, F.lit(False))
    return jobs.filter(~bad), jobs.filter(bad)


def size_class(size: Column | str, small: int = SMALL, large: int = LARGE) -> Column:
    s = F.col(size) if isinstance(size, str) else size
    return F.when(s < small, "small").when(s < large, "medium").otherwise("large")


def push_class(size: Column | str) -> Column:
    """small (bundled), whole, or ranged."""
    s = F.col(size) if isinstance(size, str) else size
    return F.when(s < PUSH_SMALL, "small").when(s < RANGED, "whole").otherwise("ranged")


def class_rank(name: Column) -> Column:
    return F.when(name == "small", 0).when(name == "medium", 1).otherwise(2)


def in_class_order(plan: DataFrame) -> DataFrame:
    """small, then medium, then large, by union."""
    parts = [plan.filter(F.col("size_class") == c).withColumn("rank", F.lit(k)) for k, c in enumerate(("small", "medium", "large"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def assign_bundles(plan: DataFrame, target_bytes: int = 64 * MIB, buckets: int = BUCKETS, overhead: int = 0) -> DataFrame:
    """plan with bucket and bundle_id: the prefix sum of sizes, by bucket (hash of the path) and path, in units of
    target_bytes.

    The sum has two levels: within a bucket by a window, so none holds more than a bucket (``buckets_for`` a
    plan), and over the buckets' totals, one row each.  So bundles fill to the target across buckets, and only the last
    one is short.  Each file counts for ``overhead`` bytes more, which bounds the files of a bundle too."""
    bucket = F.pmod(F.conv(F.substring(F.md5("path"), 1, 8), 16, 10).cast("bigint"), F.lit(buckets)).cast("bigint")
    weight = F.col("size") + overhead
    dealt = plan.withColumn("bucket", bucket)
    totals = dealt.groupBy("bucket").agg(F.sum(weight).alias("_sum"))
    ahead = totals.select("bucket", F.coalesce(F.sum("_sum").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    upto = F.sum(weight).over(Window.partitionBy("bucket").orderBy("path").rowsBetween(Window.unboundedPreceding, 0))
    placed = dealt.withColumn("_upto", upto).join(ahead, "bucket")
    return placed.withColumn("bundle_id", F.floor((F.col("_ahead") + F.col("_upto") - weight) / F.lit(target_bytes)).cast("bigint")).select(*plan.columns, "bucket", "bundle_id")


def buckets_for(plan: DataFrame, bucket_files: int = BUCKET_FILES, bucket_bytes: int = BUCKET_BYTES) -> int:
    """As many buckets as the plan's files and bytes ask for."""
    files, size = plan.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    return max(1, -(-files // bucket_files), -(-size // bucket_bytes))


def should_bundle(plan: DataFrame, force: bool = False, forbid: bool = False) -> DataFrame:
    """One row (files, avg_size, bundle): bundling pays from a count that depends on the average."""
    per = plan.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("_bytes")).withColumn("avg_size", F.when(F.col("files") > 0, F.expr("_bytes div files")).otherwise(F.lit(0)).cast("bigint"))
    least = F.when(F.col("avg_size") < 1024, 200).when(F.col("avg_size") < 8192, 500).otherwise(1000)
    rule = F.lit(False) if forbid else F.lit(True) if force else F.col("files") > least
    return per.select("files", "avg_size", rule.alias("bundle"))


def split_ranges(plan: DataFrame, stride: int = STRIDE, min_size: int = RANGED) -> DataFrame:
    """Rows (path, off, len) that tile every file of at least min_size; min_size 0 takes all,
    an empty file has no range."""
    big = plan.filter((F.col("size") >= min_size) & (F.col("size") > 0))
    each = big.select("path", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(stride).cast("bigint"))).alias("off"))
    return each.select("path", "off", F.least(F.lit(stride).cast("bigint"), F.col("size") - F.col("off")).alias("len"))


def preview(plan: DataFrame, n: int = 20) -> DataFrame:
    """The first n planned files, small ones first, with how many more there are."""
    total = plan.agg(F.count("*").alias("total"))
    top = plan.withColumn("rank", class_rank(F.col("size_class"))).orderBy("rank", "path").limit(n).select("rank", "size_class", "path", "size")
    # Two frames of known size: n rows and one.
    return top.crossJoin(F.broadcast(total)).select("*", F.greatest(F.col("total") - n, F.lit(0)).alias("more")).drop("total")


def preview_deletes(deletes: DataFrame, n: int = 10) -> DataFrame:
    """The first n deletions of each kind, with how many more there are of it."""
    first = Window.partitionBy("kind").orderBy("path")
    counts = deletes.groupBy("kind").agg(F.greatest(F.count("*") - n, F.lit(0)).alias("more"))
    top = deletes.select("kind", "path").withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= n)
    return top.join(counts, "kind").select("kind", F.col("rank").cast("bigint").alias("rank"), "path", "more")


def delete_order(dirs: DataFrame) -> DataFrame:
    """Deepest first, then by path descending, with depth."""
    return dirs.withColumn("depth", paths.depth("path")).orderBy(F.col("depth").desc(), F.col("path").desc())


def sample_diff(diff: DataFrame, n: int = 50) -> DataFrame:
    return diff.orderBy("path").limit(n)


def sort_listing(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("is_dir").desc(), "name")


def dry_run(plan: DataFrame, deletes: DataFrame) -> dict[str, DataFrame]:
    """What a run would do, as tables: counts by class, the first files, deletions."""
    from treeline.operators import report

    return {
        "classes": report.class_counts(plan),
        "files": preview(plan),
        "delete_counts": report.delete_counts(deletes),
        "deletes": preview_deletes(deletes),
    }
