"""File trees as tables: scans, listings, contents, bundles and run logs.

Roots must be paths that all executors see (a shared mount)."""

from __future__ import annotations

import hashlib
import os
import re
import stat
import tarfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline.functions import paths
from treeline.operators.filters import FilterSpec, matches
from treeline.schema import MANIFEST, MIB
from treeline.sinks import new_folder, stored
from treeline.sources.rooted import local_path, to_name, to_text

CONTENT_LIMIT = 64 * MIB
HELD = 4 * MIB  # of contents that a task holds before they go on
TASK_BYTES = 256 * MIB
TASK_FILES = 2000
LIST_LIMIT = 1000
SLICE = 5000  # names of a folder that one row of the frontier stands for
BATCH = 2000  # rows that a task holds before they go on
BUDGET = 20_000  # entries that one row of the frontier leads to in one round

INDEX = "members"  # the table of a folder of bundles that tells what is in them
MEMBERS = "bundle_id bigint, bundle string, path string, kind string, size bigint, mtime_us bigint, mode bigint, link_target string, offset bigint, error string"
_FOUND = MANIFEST + ", step string, names binary, error string"
_KINDS = {"size": pa.int64(), "mtime": pa.timestamp("us", "UTC"), "mode": pa.int32(), "readonly": pa.bool_(), "names": pa.binary()}
_FOUND_ARROW = pa.schema([(n, _KINDS.get(n, pa.string())) for n in (f.split()[0] for f in _FOUND.split(", "))])


@dataclass(frozen=True)
class Scan:
    """manifest: what was found; unread: rows (path, error) of what couldn't be read, "" for the root."""

    manifest: DataFrame
    unread: DataFrame


class _Walk:
    """Lists folders for one task: rows of step ``row`` (entries), ``todo`` (folders, or names of a folder that
    was listed, for the next round) and ``error``."""

    def __init__(self, root: str, spec: FilterSpec, kinds: tuple[str, ...], follow: bool, only: str | None, slice_: int, budget: int):
        self.root, self.spec, self.kinds, self.follow, self.only = root, spec, kinds, follow, only
        self.slice, self.budget = slice_, budget
        self.real_root = os.path.realpath(root)

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FOUND_ARROW, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(cols, schema=_FOUND_ARROW)

        for given in batches:
            for path, names in zip(*(given.column(c).to_pylist() for c in ("path", "names")), strict=True):
                for row in self._from(path, names):
                    rows.append(row)
                    if len(rows) >= BATCH:
                        yield batch()
        if rows:
            yield batch()

    def _step(self, path: str, step: str, names: bytes | None = None, error: str | None = None, real: str | None = None) -> tuple:
        return (path, None, None, None, None, None, None, real, self.root, step, names, error)

    def _named(self, folder: str) -> Iterator[list[str]]:
        """The names in a folder, ``slice`` of them at a time."""
        with os.scandir(folder) as found:
            names = (e.name for e in found if self.only in (None, e.name))
            while some := list(islice(names, self.slice)):
                yield some

    def _from(self, path: str, given: bytes | None) -> Iterator[tuple]:
        """Of each folder, which is listed once, the first slice is looked at, the names of the others go on."""
        todo: list[tuple[str, list[str] | None]] = [(path, None if given is None else [os.fsdecode(n) for n in given.split(b"\0")])]
        left = self.budget
        while todo:
            path, names = todo.pop()
            if left <= 0:
                yield self._step(path, "todo")
                continue
            folder = os.path.join(self.root, to_name(path)) if path else self.root
            left -= 1
            try:
                for k, some in enumerate(self._named(folder) if names is None else [names]):
                    if k:
                        yield self._step(path, "todo", b"\0".join(map(os.fsencode, some)))
                        continue
                    left -= len(some)
                    for name in some:
                        rel = f"{path}/{to_text(name)}" if path else to_text(name)
                        full = os.path.join(folder, name)
                        try:
                            row, enter = self._entry(rel, name, full)
                        except OSError as error:
                            yield self._step(rel, "error", error=f"{type(error).__name__}: {error.strerror}")
                            continue
                        if row is not None:
                            yield (*row, "row", None, None)
                        if enter and self.only is None:
                            if self.follow:
                                yield self._step(rel, "todo", real=to_text(os.path.realpath(full)))
                            else:
                                todo.append((rel, None))
            except OSError as e:
                yield self._step(path, "error", error=f"{type(e).__name__}: {e.strerror}")

    def _entry(self, rel: str, name: str, full: str) -> tuple[tuple | None, bool]:
        """(row of the manifest or None, whether it is a folder to list)."""
        st = os.lstat(full)
        if self.follow and stat.S_ISLNK(st.st_mode):
            try:
                st = os.stat(full)
            except OSError:
                pass  # a link without a target
        kind = "symlink" if stat.S_ISLNK(st.st_mode) else "dir" if stat.S_ISDIR(st.st_mode) else "file" if stat.S_ISREG(st.st_mode) else None
        if kind == "dir" and any(matches(name, p) for p in self.spec.exclude_dirs):
            return None, False
        size = st.st_size if kind == "file" else 0
        low, high = self.spec.min_size, self.spec.max_size
        left_out = kind == "file" and (any(matches(name, p) for p in self.spec.exclude_files) or (low is not None and size < low) or (high is not None and size > high))
        if kind not in self.kinds or left_out:
            return None, kind == "dir"
        row = (
            rel,
            kind,
            size,
            datetime.fromtimestamp(st.st_mtime_ns // 1_000_000_000, timezone.utc) + timedelta(microseconds=st.st_mtime_ns // 1000 % 1_000_000),
            stat.S_IMODE(st.st_mode),
            not st.st_mode & stat.S_IWUSR,
            to_text(os.readlink(full)) if kind == "symlink" else None,
            # Without links on the way the real path is the path.
            to_text(os.path.realpath(full)) if self.follow or kind == "symlink" else f"{to_text(self.real_root).rstrip('/')}/{rel}",
            to_text(self.root),
        )
        return row, kind == "dir"


def scan(
    spark: SparkSession, root: str, spec: FilterSpec | None = None, follow_links: bool = False, kinds: tuple[str, ...] = ("file", "dir", "symlink"), only: str | None = None,
    slice_: int = SLICE, budget: int = BUDGET,
) -> Scan:
    """The manifest of a tree, or of the entry ``only`` of its top, as a written table, so that filters and
    columns of what is done with it reach its Parquet scan.

    The tree is listed in rounds.  A round deals the frontier, folders to list, to tasks.  A task goes on
    downwards for ``budget`` entries for each row of the frontier and leaves the rest to the next round,
    so rounds grow with the logarithm of the tree, not its depth.  A folder is listed once: of more than ``slice_`` names
    its task looks at the first, the others go to the next round as lists of names, which need no listing.  ``spec`` is applied while walking.

    With follow_links a round is one level, and a table of visited real folders is joined against, so each is
    listed once, by the shortest route to it, of these the first by path; links in a circle end.  Of
    files that several routes lead to, one row stays by the same rule.

    What can't be read is left out of the manifest and told in ``unread``."""
    place = local_path(root)
    walk = _Walk(place, spec or FilterSpec(), kinds, follow_links, only, slice_, budget)
    frontier = spark.createDataFrame([("", None)], "path string, names binary").coalesce(1)
    folder, tasks = new_folder(spark, "scan"), 4 * spark.sparkContext.defaultParallelism
    rounds = []

    visited = None
    while True:
        rounds.append(f"{folder}/{len(rounds)}")
        frontier.mapInArrow(walk.run, _FOUND).write.parquet(rounds[-1])
        todo = spark.read.schema(_FOUND).parquet(rounds[-1]).filter("step = 'todo'")
        if follow_links:
            first = F.min_by("path", F.struct(paths.depth("path"), "path")).alias("path")
            new = todo.filter("real_path is not null").groupBy("real_path").agg(first)
            if visited is None:
                visited = stored(spark.createDataFrame([(to_text(os.path.realpath(place)),)], "real_path string"))
            new = stored(new.join(visited, "real_path", "left_anti"))
            visited = stored(visited.unionByName(new.select("real_path")))
            todo = todo.filter("real_path is null").select("path", "names").unionByName(new.select("path", F.lit(None).cast("binary").alias("names")))
        left = todo.count()
        if not left:
            break
        frontier = todo.select("path", "names").repartition(min(left, tasks))
    found = spark.read.schema(_FOUND).parquet(*rounds)
    rows = found.filter("step = 'row'").drop("step", "names", "error")
    if follow_links:
        rest = [c for c in rows.columns if c != "real_path"]
        one = rows.groupBy("real_path").agg(F.min_by(F.struct(*rest), F.struct(paths.depth("path"), "path")).alias("r"))
        rows = stored(one.select("r.*", "real_path").select(*rows.columns))
    return Scan(rows, found.filter("step = 'error'").select("path", "error"))


def scan_tree(spark: SparkSession, root: str, spec: FilterSpec | None = None, follow_links: bool = False, kinds: tuple[str, ...] = ("file", "dir", "symlink"), only: str | None = None) -> DataFrame:
    """The manifest of ``scan``."""
    return scan(spark, root, spec, follow_links, kinds, only).manifest


def manifest_seconds(df: DataFrame) -> DataFrame:
    """A manifest with mtime in whole epoch seconds, as comparisons take it, and exact in mtime_us."""
    return df.withColumns({"mtime_us": F.unix_micros("mtime"), "mtime": paths.mtime_sec("mtime")})


def list_dir(manifest: DataFrame, path: str = "", limit: int = LIST_LIMIT) -> DataFrame:
    """Rows (name, is_dir, truncated): ``..`` and the directory's children, directories first, by
    name; sorted before it is cut to ``limit`` rows."""
    base = f"{path}/" if path else ""
    below = manifest.filter(F.startswith("path", F.lit(base))).select(F.substring("path", len(base) + 1, 1 << 30).alias("rest"), "kind")
    first = F.substring_index("rest", "/", 1)
    children = below.groupBy(first.alias("name")).agg(F.max(F.contains("rest", F.lit("/")) | (F.col("kind") == "dir")).alias("is_dir"))
    up = manifest.sparkSession.range(1).select(F.lit("..").alias("name"), F.lit(True).alias("is_dir"))
    top = children.unionByName(up).orderBy(F.col("is_dir").desc(), "name").limit(limit + 1)
    return top.withColumn("_n", F.row_number().over(Window.orderBy(F.col("is_dir").desc(), "name"))).withColumn(
        "truncated", F.max(F.col("_n")).over(Window.partitionBy()) > limit
    ).filter(F.col("_n") <= limit).select("name", "is_dir", "truncated")


def children_only(listing: DataFrame) -> DataFrame:
    """A listing without its parent mark."""
    return listing.filter("name <> '..'")


def expand_tree(manifest: DataFrame, base: str) -> DataFrame:
    """All rows below base."""
    return manifest.filter(F.startswith("path", F.lit(f"{base}/")))


def edges(manifest: DataFrame) -> DataFrame:
    """(parent, child, kind) of all rows and the directories above them."""
    rows = manifest.select("path", "kind").unionByName(manifest.select(F.explode(paths.ancestors("path")).alias("path"), F.lit("dir").alias("kind")))
    return rows.groupBy("path").agg(F.min("kind").alias("kind")).select(paths.parent("path").alias("parent"), F.col("path").alias("child"), "kind")


def expand_edges(edge_table: DataFrame, base: str) -> DataFrame:
    """(path, kind) of all below base, from one-level listings: a join for each level, each checkpointed,
    so depth and number of rows have no bound.  What was met before is not entered again."""
    known = edge_table.select("parent", F.col("child").alias("path"), "kind")
    level = known.filter(F.col("parent") == base).select("path", "kind").checkpoint()
    out = level
    while not level.isEmpty():
        below = known.join(level.filter("kind <> 'file'").select(F.col("path").alias("parent")).distinct(), "parent").select("path", "kind")
        level = below.join(out.select("path"), "path", "left_anti").checkpoint()
        out = out.unionByName(level)
    return out


def suggest(manifest: DataFrame, host: str, port: int, path: str = "", scheme: str = paths.SCHEME) -> DataFrame:
    """Rows (suggestion): the endpoint of each child, directories with a slash behind."""
    base = f"{scheme}://{host}:{port}/" + (f"{path}/" if path else "")
    names = children_only(list_dir(manifest, path))
    return names.select(F.concat(F.lit(base), F.col("name"), F.when(F.col("is_dir"), "/").otherwise("")).alias("suggestion"))


def tasks_for(plan: DataFrame, task_bytes: int = TASK_BYTES, task_files: int = TASK_FILES) -> int:
    """As many tasks as a plan's bytes and files ask for."""
    files, size = plan.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    return max(1, -(-size // task_bytes), -(-files // task_files))


def spread(plan: DataFrame, task_bytes: int = TASK_BYTES, task_files: int = TASK_FILES, of: tuple[str | Column, ...] = ("path",)) -> DataFrame:
    """plan dealt to as many tasks as its bytes and files ask for."""
    return plan.repartition(tasks_for(plan, task_bytes, task_files), F.xxhash64(*of))


def read_content(manifest: DataFrame, limit: int = CONTENT_LIMIT) -> DataFrame:
    """Rows (path, content, error) of all files.  Where content is null error says why: a file can't be
    read, or has more than ``limit`` bytes and goes by ranges (``read_ranges``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, held, contents, errors = 0, 0, [], []
            for k, (path, root, size) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("path", "root", "size")), strict=True)):
                content = error = None
                if size > limit:
                    error = f"more than {limit} bytes"
                else:
                    try:
                        with open(os.path.join(to_name(root), to_name(path)), "rb") as f:
                            content = f.read()
                    except (OSError, ValueError) as e:
                        error = f"{type(e).__name__}: {getattr(e, 'strerror', None) or e}"
                contents.append(content)
                errors.append(error)
                held += len(content or b"")
                if held > HELD or k + 1 == batch.num_rows:
                    own = batch.column("path").slice(begin, k + 1 - begin)
                    yield pa.RecordBatch.from_arrays([own, pa.array(contents, pa.binary()), pa.array(errors, pa.string())], ["path", "content", "error"])
                    begin, held, contents, errors = k + 1, 0, [], []

    return spread(manifest.filter("kind = 'file'")).select("path", "root", "size").mapInArrow(run, "path string, content binary, error string")


def read_ranges(ranges: DataFrame, root: str) -> DataFrame:
    """Rows (path, off, len, content) of (path, off, len); content is null where it can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (path, off, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("path", "off", "len")), strict=True)):
                content = None
                try:
                    with open(os.path.join(root, to_name(path)), "rb") as f:
                        f.seek(off)
                        content = f.read(n)
                except (OSError, ValueError):
                    pass
                yield pa.RecordBatch.from_arrays([*batch.slice(k, 1).columns, pa.array([content], pa.binary())], ["path", "off", "len", "content"])

    return ranges.select("path", "off", "len").mapInArrow(run, "path string, off bigint, len bigint, content binary")


def tree_digests(manifest: DataFrame, root: str, stride: int = CONTENT_LIMIT) -> DataFrame:
    """Rows (path, digest): SHA-256 of the content; of files over ``stride``, of the list of their
    ranges' digests; null where content can't be read.  Both sides of a comparison must use one stride."""
    from treeline.plans.planning import split_ranges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for path, base, off, n in zip(*(batch.column(c).to_pylist() for c in ("path", "base", "off", "len")), strict=True):
                have, left = hashlib.sha256(), n
                try:
                    with open(os.path.join(to_name(base), to_name(path)), "rb", buffering=0) as f:
                        f.seek(off)
                        # A file is read to its end, a range for its length.
                        while data := f.read(HELD if n is None else min(HELD, left)):
                            have.update(data)
                            left = None if n is None else left - len(data)
                    digests.append(have.hexdigest())
                except (OSError, ValueError):
                    digests.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("off"), pa.array(digests, pa.string())], ["path", "off", "d"])

    def hashed(pieces: DataFrame) -> DataFrame:
        return pieces.select("path", "base", "off", "len").mapInArrow(run, "path string, off bigint, d string")

    files = manifest.filter("kind = 'file'")
    small = spread(files.filter(F.col("size") <= stride).select("path", "size", "root"))
    none = F.lit(None).cast("bigint")
    whole = hashed(small.select("path", F.col("root").alias("base"), F.lit(0).cast("bigint").alias("off"), none.alias("len"))).select("path", F.col("d").alias("digest"))
    parts = hashed(spread(split_ranges(files, stride, stride + 1).withColumn("size", F.col("len")), of=("path", "off")).withColumn("base", F.lit(root)))
    listed = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("off", "d"))), lambda x: x["d"]), ""), 256)
    ranged = parts.groupBy("path").agg(F.when(F.count("d") == F.count("*"), listed).alias("digest"))
    return whole.unionByName(ranged)


def bundle_members(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (bundle_id, bundle, path, kind, size, mtime_us, mode, link_target, offset, error) of the members of the tar files in a
    folder: from its index, or, where tars came without one, from their headers."""
    place = local_path(folder)
    if os.path.isdir(os.path.join(place, INDEX)):
        return spark.read.schema(MEMBERS).parquet(f"{folder}/{INDEX}").filter("error is null")
    names = sorted(n for n in os.listdir(place) if n.endswith(".tar"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for name in (n for part in parts for n in part["bundle"]):
            rows = []
            with tarfile.open(os.path.join(place, name)) as tar:
                for m in tar:
                    kind = "file" if m.isfile() else "dir" if m.isdir() else "symlink" if m.issym() else None
                    if kind:
                        rows.append((0, name, to_text(m.name), kind, m.size if kind == "file" else 0, round(m.mtime * 1e6), m.mode, to_text(m.linkname) if m.issym() else None, m.offset_data, None))
                    if len(rows) >= 10_000:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
                    tar.members = []  # else it remembers all
            yield pd.DataFrame(rows, columns=columns)

    columns = [f.split()[0] for f in MEMBERS.split(", ")]
    files = spark.createDataFrame([(n,) for n in names], "bundle string").repartition(max(1, len(names)))
    return files.mapInPandas(run, MEMBERS)


def read_bundles(spark: SparkSession, folder: str, limit: int = CONTENT_LIMIT) -> DataFrame:
    """Rows (bundle, path, kind, size, mtime, mtime_us, mode, link_target, content, error) of all members.  content is null for folders, links
    and files over ``limit`` bytes, which ``unpack_bundles`` writes without holding them."""
    place = local_path(folder)
    names = ["bundle", "path", "kind", "size", "mtime", "mtime_us", "mode", "link_target"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, held, contents, errors = 0, 0, [], []
            for k, (bundle, kind, size, offset) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("bundle", "kind", "size", "offset")), strict=True)):
                content = error = None
                if kind == "file" and size > limit:
                    error = f"more than {limit} bytes"
                elif kind == "file":
                    try:
                        with open(os.path.join(place, bundle), "rb") as f:
                            f.seek(offset)
                            content = f.read(size)
                        if len(content) < size:
                            content, error = None, "the bundle ends early"
                    except OSError as e:
                        error = f"{type(e).__name__}: {e.strerror}"
                contents.append(content)
                errors.append(error)
                held += len(content or b"")
                if held > limit or k + 1 == batch.num_rows:
                    cols = [*batch.slice(begin, k + 1 - begin).columns[:-1], pa.array(contents, pa.binary()), pa.array(errors, pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, [*names, "content", "error"])
                    begin, held, contents, errors = k + 1, 0, [], []

    members = bundle_members(spark, folder).withColumn("mtime", F.floor(F.col("mtime_us") / 1_000_000)).select(*names, "offset")
    return members.mapInArrow(run, "bundle string, path string, kind string, size bigint, mtime bigint, mtime_us bigint, mode bigint, link_target string, content binary, error string")


def parse_log(lines: DataFrame, line: str = "line") -> DataFrame:
    """Rows (ts, tag, src, dst, path, ctx, msg, files, bytes, seconds) of run-log lines."""
    def part(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))

    tag = F.regexp_extract(line, r"^\[[^\]]*\] (START|COPY|ERROR|DONE) ", 1)
    return lines.filter(tag != "").select(
        F.regexp_extract(line, r"^\[([^\]]*)\]", 1).alias("ts"),
        tag.alias("tag"),
        part(r" src=(.*?) dst=").alias("src"),
        part(r" dst=(.*?)(?: bytes=[0-9]+)?$").alias("dst"),
        part(r" path=(.*?) msg=").alias("path"),
        part(r" ctx=(.*?) path=").alias("ctx"),
        part(r" msg=(.*)$").alias("msg"),
        part(r" files=([0-9]+)").try_cast("bigint").alias("files"),
        part(r" bytes=([0-9]+)").try_cast("bigint").alias("bytes"),
        part(r" seconds=([0-9.]+)$").try_cast("double").alias("seconds"),
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_log(spark.read.text(path), "value")
