"""The verbs: copy, update, mirror, move, verify, push and pull plans, dry runs.

A plan is stored before anything is done, and a verb's outcome is a table of results."""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions import paths
from treeline.operators import compare, filters, jobs, report
from treeline.operators.filters import FilterSpec
from treeline.plans import planning
from treeline.sinks import new_folder, shared_dir, stored
from treeline.sources.rooted import local_path
from treeline.sources.tree import bundle_members, manifest_seconds, scan, scan_tree, tree_digests


@dataclass(frozen=True)
class Options:
    """What a run does.  skip_unchanged and delete follow from the verb where they are None."""

    spec: FilterSpec = FilterSpec()
    compare: str = "size_mtime"
    skip_unchanged: bool | None = None
    delete_excluded: bool = True  # what is excluded at the source counts as extra at the destination
    files_only: bool = False  # delete no directories
    follow_links: bool = False
    include_empty_dirs: bool = True
    preserve_mtime: bool = True
    force_bundle: bool = False
    forbid_bundle: bool = False
    allow_empty_source: bool = False
    fold: bool = False  # extras are judged by keys without case
    clear_readonly: bool = False  # what is read-only is deleted too
    drop_links: bool = False  # links of the source are left out
    journal: str | None = None  # table folder of ranges that are done; one of the two roots' own where None
    log: str | None = None  # folder for the lines of the run: START, a line for each path, DONE


def transfer_plan(src: DataFrame, dst: DataFrame, options: Options, skip_unchanged: bool) -> DataFrame:
    """Rows of src to transfer (path, kind, link_target, size, mtime, reason, size_class), from two
    manifests with mtime in seconds."""
    wanted = src.filter("kind <> 'dir'")
    if skip_unchanged:
        regular = compare.need_copy(wanted.filter("kind = 'file'"), dst.filter("kind = 'file'"), options.compare)
        had = dst.filter("kind = 'symlink'").select("path", F.col("link_target").alias("old"))
        links = wanted.filter("kind = 'symlink'").join(had, "path", "left").filter("old is null or old <> link_target").drop("old")
        need = regular.unionByName(links.withColumn("reason", F.lit("link")), allowMissingColumns=True)
    else:
        need = wanted.withColumn("reason", F.lit("all"))
    need = need if "mtime_us" in need.columns else need.withColumn("mtime_us", F.lit(None).cast("bigint"))
    return need.select("path", "kind", "link_target", "size", "mtime", "mtime_us", "reason", planning.size_class("size").alias("size_class"))


def delete_plan(src: DataFrame, dst: DataFrame, options: Options, unread: DataFrame | None = None) -> DataFrame:
    """(path, kind) of what only the destination has.  Nothing at or below a path of ``unread``, what could not
    be read of the source, and no file where the ranges of a source file gather."""
    fold = options.fold
    gone = compare.extra_files(dst.filter("kind <> 'dir'"), src.filter("kind <> 'dir'"), fold).select("path", "kind")
    gone = gone.join(src.filter("kind = 'file'").select(jobs.part_path().alias("path")), "path", "left_anti")
    if not options.files_only:
        gone = gone.unionByName(compare.extra_dirs(dst, src, fold).select("path", "kind"))
    if unread is None:
        return gone
    # Folders above what is kept would fail to go; they stay too.
    up = F.concat(F.array(F.lit(""), "path"), paths.ancestors("path"))
    hit = gone.select("path", F.explode(up).alias("at")).join(unread.select(F.col("path").alias("at")).distinct(), "at", "left_semi").select("path").distinct()
    above = hit.select(F.explode(paths.ancestors("path")).alias("path")).distinct()
    return gone.join(hit.unionByName(above), "path", "left_anti")


def conflict_plan(src: DataFrame, dst: DataFrame, options: Options, delete: bool) -> DataFrame:
    """(path, kind) of what stands at the destination in the way of another kind of thing, to go before anything
    is copied.

    Where extras are deleted, that is files and links where the source has something else, and folders where it has
    a file or link, with all below them (all of it is extra anyway; with files_only folders stay, and copying
    fails there).  Elsewhere only links where the source has a folder: writing through them would
    leave the destination."""
    wanted = src.select("path", "kind").unionByName(compare.all_dirs(src).withColumn("kind", F.lit("dir"))).groupBy("path").agg(F.min("kind").alias("wanted"))
    odd = dst.select("path", "kind").join(wanted, "path").filter("kind <> wanted")
    if not delete:
        return odd.filter("kind = 'symlink' and wanted = 'dir'").select("path", "kind")
    first = odd.filter("kind <> 'dir'").select("path", "kind")
    if options.files_only:
        return first
    folders = odd.filter("kind = 'dir'").select(F.col("path").alias("at"))
    up = F.concat(F.array("path"), paths.ancestors("path"))
    below = dst.select("path", "kind", F.explode(up).alias("at")).join(folders, "at", "left_semi").select("path", "kind")
    return first.unionByName(below).distinct()


def _split_root(root: str) -> tuple[str, str | None]:
    """A root and, where it is a single file, the folder that holds it and its name."""
    plain = local_path(root)
    return (os.path.dirname(plain) or "/", os.path.basename(plain)) if os.path.isfile(plain) else (root, None)


def _manifests(spark: SparkSession, src_root: str, dst_root: str, options: Options, only: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Manifests of both sides, and what of the source could not be read."""
    found = scan(spark, src_root, options.spec, options.follow_links, only=only)
    src = manifest_seconds(found.manifest)
    dst = manifest_seconds(scan_tree(spark, dst_root, None if options.delete_excluded else options.spec, only=only))
    src = filters.link_policy(src, drop_links=True) if options.drop_links else src
    src = stored(filters.empty_dirs(src, options.include_empty_dirs))
    dst = stored(dst)
    if options.compare == "checksum":
        src, dst = _digested(src, dst, src_root, dst_root)
    return src, dst, found.unread


def _digested(src: DataFrame, dst: DataFrame, src_root: str, dst_root: str) -> tuple[DataFrame, DataFrame]:
    """Digests of files of equal size on both sides only; null elsewhere."""
    pairs = compare.equal_size_pairs(src.filter("kind = 'file'"), dst.filter("kind = 'file'"))
    out = [side.join(tree_digests(side.join(pairs, "path", "left_semi"), root), "path", "left") for side, root in ((src, src_root), (dst, dst_root))]
    return stored(out[0]), stored(out[1])


def _journal(spark: SparkSession, src_root: str, dst_root: str) -> str:
    """The journal of all runs between two roots, so a repeat finds what the run before it has done."""
    both = hashlib.sha256(f"{local_path(src_root)}\0{local_path(dst_root)}".encode()).hexdigest()
    return f"{shared_dir(spark)}/treeline-journal-{both[:32]}"


def _transfer(spark: SparkSession, plan: DataFrame, src_root: str, dst_root: str, options: Options) -> DataFrame:
    """Small files in bundles where that pays, ranged files by ranges, all others one by one."""
    big = plan.filter((F.col("kind") == "file") & (F.col("size") >= planning.RANGED))
    other = plan.filter((F.col("kind") != "file") | (F.col("size") < planning.RANGED))
    small, rest = other.filter("kind = 'file' and size_class = 'small'"), other.filter("kind <> 'file' or size_class <> 'small'")
    out = []
    # Bundles keep times and take no link for what it leads to.
    plain = options.preserve_mtime and not options.follow_links
    if planning.should_bundle(small, options.force_bundle, options.forbid_bundle or not plain).first()["bundle"]:
        folder = new_folder(spark, "bundles")
        dealt = planning.assign_bundles(small, buckets=planning.buckets_for(small), overhead=planning.FILE_OVERHEAD)
        jobs.write_bundles(dealt, src_root, folder)
        out.append(jobs.unpack_bundles(bundle_members(spark, folder), folder, dst_root))
        lost = jobs.bundle_index(spark, folder).filter("error is not null")
        out.append(lost.select("path", F.lit("bundle").alias("action"), F.lit(False).alias("ok"), F.lit(0).cast("bigint").alias("bytes"), "error", F.lit(0.0).alias("seconds")))
    else:
        rest = rest.unionByName(small)
    out.append(jobs.run_copy(rest, src_root, dst_root, options.preserve_mtime, options.follow_links))
    if not big.isEmpty():
        journal = options.journal or _journal(spark, src_root, dst_root)
        out.append(jobs.run_copy_ranges(big, planning.split_ranges(big), src_root, dst_root, journal, options.follow_links))
    results = out[0]
    for more in out[1:]:
        results = results.unionByName(more)
    return stored(results)


def _run(spark: SparkSession, src_root: str, dst_root: str, options: Options, skip: bool, delete: bool) -> DataFrame:
    began = datetime.now(timezone.utc)
    src_root, only = _split_root(src_root)
    delete = delete and only is None  # a single file has no extras
    src, dst, unread = _manifests(spark, src_root, dst_root, options, only)
    if delete and not options.allow_empty_source and src.isEmpty():
        raise ValueError("the source is empty; allow_empty_source=True mirrors it all the same")
    plan = stored(transfer_plan(src, dst, options, skip))
    in_the_way = stored(conflict_plan(src, dst, options, delete))
    doomed = stored(delete_plan(src, dst, options, unread).join(in_the_way, "path", "left_anti")) if delete else None
    results = stored(jobs.run_delete(in_the_way, dst_root, options.clear_readonly)) if not in_the_way.isEmpty() else None
    done = stored(jobs.make_dirs(src.filter("kind = 'dir'"), dst_root)).unionByName(_transfer(spark, plan, src_root, dst_root, options))
    results = done if results is None else results.unionByName(done)
    if doomed is not None:
        results = results.unionByName(stored(jobs.run_delete(doomed, dst_root, options.clear_readonly)))
    if options.log:
        report.write_run_log(results, options.log, src_root, dst_root, began, datetime.now(timezone.utc))
    return results


def copy(spark: SparkSession, src_root: str, dst_root: str, options: Options = Options()) -> DataFrame:
    return _run(spark, src_root, dst_root, options, bool(options.skip_unchanged), delete=False)


def update(spark: SparkSession, src_root: str, dst_root: str, options: Options = Options()) -> DataFrame:
    return _run(spark, src_root, dst_root, options, options.skip_unchanged is not False, delete=False)


def mirror(spark: SparkSession, src_root: str, dst_root: str, options: Options = Options()) -> DataFrame:
    if dst_root.rstrip("/") in ("", "file:"):
        raise ValueError("refusing to mirror into a filesystem root")
    return _run(spark, src_root, dst_root, options, options.skip_unchanged is not False, delete=True)


def move(spark: SparkSession, src_root: str, dst_root: str, confirm: bool = False, options: Options = Options()) -> DataFrame:
    """mirror, verification of files by content, of links by target and of directories, then deletion
    of what was verified.

    Nothing is deleted if any row of the mirror failed or anything differs.  Only rows of the manifest
    that was verified go, and only those whose size and mtime are as they were then: what was made or
    changed since stays, as do the directories that hold it (their rows fail)."""
    if not confirm:
        raise ValueError("move deletes the source; pass confirm=True")
    if src_root.rstrip("/") in ("", "file:"):
        raise ValueError("refusing to move a filesystem root")
    results = mirror(spark, src_root, dst_root, options)
    failed = results.filter("not ok").count()
    if failed:
        raise RuntimeError(f"{failed} paths were not copied or deleted; the source stays")
    root, only = _split_root(src_root)
    src = stored(manifest_seconds(scan_tree(spark, root, options.spec, options.follow_links, only=only)))
    dst = stored(manifest_seconds(scan_tree(spark, dst_root, options.spec, only=only)))
    files = _digested(src, dst, root, dst_root)
    bad = compare.verify(*(m.filter("kind = 'file'") for m in files), "checksum").filter("kind not like 'extra%'").count()
    had = dst.select("path", F.col("kind").alias("kind_dst"), F.col("link_target").alias("target_dst"))
    alike = (F.col("kind") == F.col("kind_dst")) & ((F.col("kind") == "dir") | F.col("link_target").eqNullSafe(F.col("target_dst")))
    kept = F.lit(False) if options.include_empty_dirs else F.col("kind") == "dir"
    bad += src.filter("kind <> 'file'").filter(~kept).join(had, "path", "left").filter(~F.coalesce(alike, F.lit(False))).count()
    if bad:
        raise RuntimeError(f"the trees differ in {bad} paths after copying; the source stays")
    now = manifest_seconds(scan_tree(spark, root, options.spec, options.follow_links, only=only)).select("path", "kind", F.col("size").alias("size_now"), F.col("mtime_us").alias("us_now"))
    same = (F.col("kind") == "dir") | ((F.col("size") == F.col("size_now")) & (F.col("mtime_us") == F.col("us_now")))
    verified = stored(src.join(now, ["path", "kind"]).filter(same).select("path", "kind", "real_path"))
    if options.follow_links:
        # Links go as links, and only what lies in the source itself goes, by whatever route it was reached.
        own = scan_tree(spark, root, options.spec, only=only).select("path", "kind", "real_path")
        verified = stored(own.join(verified.select("real_path").distinct(), "real_path", "left_semi"))
    return results.unionByName(stored(jobs.run_delete(verified.select("path", "kind"), root, options.clear_readonly)))


def verify(spark: SparkSession, src_root: str, dst_root: str, mode: str = "size", options: Options = Options(), labels: str = "local") -> DataFrame:
    """The differences of two trees' files, or of two files of one name; content is read for pairs of
    equal size only."""
    (src_root, only), (dst_root, _) = _split_root(src_root), _split_root(dst_root)
    src = stored(manifest_seconds(scan_tree(spark, src_root, options.spec, kinds=("file",), only=only)))
    dst = stored(manifest_seconds(scan_tree(spark, dst_root, options.spec, kinds=("file",), only=only)))
    if mode == "checksum":
        src, dst = _digested(src, dst, src_root, dst_root)
    return compare.verify(src, dst, mode, labels)


@dataclass(frozen=True)
class Verdict:
    """code: 0 where the trees are alike, 1 else; diff and summary are tables, text a table of lines."""

    code: int
    diff: DataFrame
    summary: DataFrame
    text: DataFrame


def verify_report(
    spark: SparkSession, src_root: str, dst_root: str, mode: str = "size", options: Options = Options(), csv: str | None = None, json: str | None = None, sample: int = report.SAMPLE
) -> Verdict:
    """verify as a whole: the differences once, their summary, reports in the folders csv and json
    where these are given, and the result code."""
    diff = stored(verify(spark, src_root, dst_root, mode, options))
    summary = stored(report.verify_summary(diff, sample))
    if csv:
        report.write_diff_csv(diff, csv)
    if json:
        report.summary_json(summary).write.mode("overwrite").text(json)
    return Verdict(report.result_code(summary), diff, summary, report.summary_text(summary, sample))


def push_plan(src: DataFrame, dst: DataFrame, spec: FilterSpec = FilterSpec(), need: str = "delta") -> DataFrame:
    """(path, kind, size, mtime, reason, push_class): what goes to a remote side.  ``need="all"``
    asks for every file and link."""
    wanted = spec.apply(src)
    if need == "all":
        asked = compare.need_all(wanted).withColumn("reason", F.lit("all"))
    else:
        asked = compare.need_copy(wanted.filter("kind = 'file'"), dst).select("path", "reason").unionByName(
            wanted.filter("kind = 'symlink'").select("path", F.lit("link").alias("reason"))
        )
    return wanted.join(asked, "path").select("path", "kind", "size", "mtime", "reason", planning.push_class("size").alias("push_class"))


def pull_plan(remote: DataFrame, local: DataFrame, spec: FilterSpec = FilterSpec(), delete: bool = True) -> DataFrame:
    """(path, kind, action): mkdir, link, write; with ``delete`` also what goes locally."""
    wanted = spec.apply(remote)
    need = compare.need_copy(wanted.filter("kind = 'file'"), local).select("path", "kind", F.lit("write").alias("action"))
    links = wanted.filter("kind = 'symlink'").select("path", "kind", F.lit("link").alias("action"))
    dirs = wanted.filter("kind = 'dir'").select("path", "kind", F.lit("mkdir").alias("action"))
    plan = dirs.unionByName(links).unionByName(need)
    if delete:
        plan = plan.unionByName(compare.pull_extras(local, wanted).withColumn("action", F.lit("delete")))
    return plan


def dry_run(spark: SparkSession, src_root: str, dst_root: str, options: Options = Options()) -> dict[str, DataFrame]:
    src, dst, unread = _manifests(spark, src_root, dst_root, options)
    plan = stored(transfer_plan(src, dst, options, options.skip_unchanged is not False))
    return planning.dry_run(plan, stored(delete_plan(src, dst, options, unread))) | {"totals": report.tree_totals(plan)}
