"""Totals, run statistics, verification summaries, and their CSV, JSON, text and log forms."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.functions import paths

SAMPLE = 50


def tree_totals(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("bytes"))


def class_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("size_class").agg(F.count("*").alias("files"), F.sum("size").cast("bigint").alias("bytes"))


def errors(results: DataFrame) -> DataFrame:
    return results.filter(~F.col("ok")).select("path", "action", "error")


def run_stats(results: DataFrame) -> DataFrame:
    """One row: files, bytes, errors.  The error texts stay rows (``errors``)."""
    ok = F.col("ok")
    return results.agg(
        F.count_if(ok).alias("files"),
        F.coalesce(F.sum(F.when(ok, F.col("bytes"))), F.lit(0)).cast("bigint").alias("bytes"),
        F.count_if(~ok).alias("errors"),
    )


def run_report(results: DataFrame, seconds: float) -> DataFrame:
    """run_stats with gb, seconds and mb_per_s as text of two decimals."""
    rate = F.lit(0.0) if seconds <= 0 else F.col("bytes") / 1048576.0 / F.lit(float(seconds))
    return run_stats(results).select(
        "files", "bytes", "errors", paths.human_gb("bytes").alias("gb"), F.lit(float(seconds)).alias("seconds"), paths.two_decimals(rate).alias("mb_per_s")
    )


def verify_summary(diff: DataFrame, n: int = SAMPLE) -> DataFrame:
    """One row: identical, changed_count (changed or missing), extras_count, sample (the first n by
    path, as an array)."""
    extra = F.startswith("kind", F.lit("extra"))
    counts = diff.agg(F.count_if(~extra).alias("changed_count"), F.count_if(extra).alias("extras_count"))
    first = diff.orderBy("path").limit(n).agg(F.sort_array(F.collect_list(F.struct("path", "kind", "size_src", "size_dest", "mtime_src", "mtime_dest"))).alias("sample"))
    # Two one-row frames.
    return counts.crossJoin(first).select(
        ((F.col("changed_count") == 0) & (F.col("extras_count") == 0)).alias("identical"), "changed_count", "extras_count", "sample"
    )


def result_code(summary: DataFrame) -> int:
    return 0 if summary.first()["identical"] else 1


def average_size(files: DataFrame) -> DataFrame:
    total = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("b"))
    return total.select(F.when(F.col("files") > 0, F.expr("b div files")).otherwise(F.lit(0)).cast("bigint").alias("avg_size"))


def delete_counts(deletes: DataFrame) -> DataFrame:
    return deletes.groupBy("kind").agg(F.count("*").alias("n"))


def bundle_stats(bundles: DataFrame) -> DataFrame:
    return bundles.groupBy("bundle_id").agg(F.count("*").alias("files"), F.sum("size").cast("bigint").alias("bytes"))


def connection_summary(lines: DataFrame, line: str = "line") -> DataFrame:
    """Totals of the summary lines of connections in a server's log."""
    names = ("files_sent", "bytes_sent", "files_received", "bytes_received", "elapsed_ms")
    hits = lines.filter(F.contains(F.col(line), F.lit("files_sent=")))
    values = hits.select(*[F.regexp_extract(line, f"{n}=([0-9]+)", 1).try_cast("bigint").alias(n) for n in names])
    return values.agg(F.count("*").alias("connections"), *[F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(n) for n in names])


def write_diff_csv(diff: DataFrame, path: str, limit: int | None = None) -> None:
    """All rows, quoted where needed, under the header type,path,size_src,..."""
    rows = diff.orderBy("path").limit(limit) if limit else diff
    rows.withColumnRenamed("kind", "type").select("type", "path", "size_src", "size_dest", "mtime_src", "mtime_dest").write.mode("overwrite").option("header", True).option(
        "escape", '"'
    ).csv(path)


def summary_json(summary: DataFrame) -> DataFrame:
    return summary.select(F.to_json(F.struct("identical", "changed_count", "extras_count", "sample")).alias("json"))


def summary_text(summary: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """Rows (n, line): a head line, then the first ``limit`` of the sample."""
    head = F.format_string("identical=%s changed=%d extras=%d", F.col("identical").cast("string"), F.col("changed_count"), F.col("extras_count"))
    lines = F.transform(F.slice("sample", 1, limit), lambda x: F.concat_ws(" ", x["kind"], x["path"]))
    return summary.select(F.posexplode(F.concat(F.array(head), lines)).alias("n", "line"))


def log_line(stamp: Column, tag: Column, src: Column, dst: Column, path: Column, ctx: Column, msg: Column, files: Column, bytes_: Column, seconds: Column) -> Column:
    body = (
        F.when(tag == "START", F.concat(F.lit("src="), src, F.lit(" dst="), dst))
        .when(tag == "COPY", F.concat(F.lit("src="), src, F.lit(" dst="), dst, F.lit(" bytes="), bytes_.cast("string")))
        .when(tag == "ERROR", F.concat(F.lit("ctx="), ctx, F.lit(" path="), path, F.lit(" msg="), msg))
        .when(tag == "DONE", F.concat(F.lit("files="), files.cast("string"), F.lit(" bytes="), bytes_.cast("string"), F.lit(" seconds="), F.format_string("%.3f", seconds)))
    )
    return F.concat(F.lit("["), stamp, F.lit("] "), tag, F.lit(" "), body)


def log_lines(results: DataFrame, src_root: str, dst_root: str, stamp: Column | None = None) -> DataFrame:
    """Rows (line): COPY for what went well, ERROR for the rest."""
    at = stamp if stamp is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    none = F.lit(None).cast("string")
    join = lambda root: F.concat(F.lit(root + "/"), F.col("path"))
    return results.select(
        log_line(at, F.when(F.col("ok"), "COPY").otherwise("ERROR"), join(src_root), join(dst_root), F.col("path"), F.col("action"), F.coalesce("error", F.lit("")), none, F.col("bytes"), F.col("seconds")).alias("line")
    )


def write_log(results: DataFrame, path: str, src_root: str, dst_root: str, stamp: Column | None = None) -> None:
    log_lines(results, src_root, dst_root, stamp).select("line").write.mode("append").text(path)


def write_run_log(results: DataFrame, path: str, src_root: str, dst_root: str, began: datetime, ended: datetime) -> None:
    """The lines of a whole run: START, COPY for each path that was copied or written, ERROR for what failed in any
    action, DONE with the totals of what was copied."""
    copied = F.col("action").isin("copy", "write")
    none = F.lit(None).cast("string")
    # COPY and ERROR lines, between the two of the run itself.
    each = log_lines(results.filter(copied | ~F.col("ok")), src_root, dst_root, F.lit(ended.isoformat()))
    start = log_line(F.lit(began.isoformat()), F.lit("START"), F.lit(src_root), F.lit(dst_root), none, none, none, none, none, none)
    totals = results.filter(copied & F.col("ok")).agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    done = log_line(F.lit(ended.isoformat()), F.lit("DONE"), none, none, none, none, none, F.col("files"), F.col("bytes"), F.lit((ended - began).total_seconds()))
    lines = results.sparkSession.range(1).select(start.alias("line")).unionByName(each).unionByName(totals.select(done.alias("line")))
    lines.write.mode("append").text(path)
