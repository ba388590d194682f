"""What the jobs must never do: leave a root, take a half copy for whole, forget what couldn't be read."""

import os
import random
import tarfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.test_verbs import made, names
from treeline.operators import delta, jobs
from treeline.operators.filters import FilterSpec
from treeline.plans import planning, sync
from treeline.sinks import stored
from treeline.sources import tree
from treeline.sources.rooted import Rooted, local_path, part_name


def results(df):
    return {r.path: r for r in stored(df).collect()}


def plan_of(spark, root):
    return stored(tree.manifest_seconds(tree.scan_tree(spark, root, kinds=("file",))))


# Roots -----------------------------------------------------------------------------------------


def test_local_paths():
    assert [local_path(x) for x in ("/a/b/", "file:///a", "file:/a", "a/b", "/")] == ["/a/b", "/a", "/a", "a/b", "/"]
    for x in ("hdfs://h/a", "s3a://b/c", "viewfs://store/x"):
        with pytest.raises(ValueError):
            local_path(x)


def test_rooted_refuses(tmp_path):
    made(tmp_path, in__f="1", out__f="2")
    os.symlink("../out", tmp_path / "in/link")
    root = Rooted(str(tmp_path / "in"))
    for path in ("../out/f", "link/f", "a//b", "./f", "", "nul\0"):
        with pytest.raises((OSError, ValueError)):
            with root.reading(path):
                pass
    with root.reading("f") as fd:
        assert os.read(fd, 9) == b"1"
    with Rooted(str(tmp_path / "in"), follow=True).reading("link/f") as fd:
        assert os.read(fd, 9) == b"2"


def test_jobs_stay_below_their_roots(spark, tmp_path):
    src, dst, out = made(tmp_path / "s", x__f="new"), made(tmp_path / "d", own="o"), made(tmp_path / "o", f="outside")
    os.symlink("../o", f"{dst}/x")
    plan = plan_of(spark, src)
    content = spark.createDataFrame([("x/g", bytearray(b"1"), 5)], "path string, content binary, mtime bigint")
    gone = spark.createDataFrame([("x/f", "file"), ("x", "dir")], "path string, kind string")
    for df in (
        jobs.run_copy(plan, src, dst), jobs.write_files(content, dst), jobs.make_dirs(content, dst), jobs.preallocate(plan, dst),
        jobs.run_copy_ranges(plan, planning.split_ranges(plan, 2, 0), src, dst), jobs.run_delete(gone, dst),
    ):
        assert not any(r.ok for r in results(df).values())
    assert names(out) == {"f"} and Path(out, "f").read_text() == "outside" and os.path.islink(f"{dst}/x")


def test_mirror_over_other_kinds(spark, tmp_path):
    src, out = made(tmp_path / "s", x__f="new", y="file", z__deep__g="g", l__in="1"), made(tmp_path / "o", f="outside")
    os.symlink("y", f"{src}/to")
    dst = made(tmp_path / "d", y__old__er="1", z="a file", to__inner="2")
    for link in ("x", "l"):
        os.symlink("../o", f"{dst}/{link}")
    got = sync.mirror(spark, src, dst)
    assert got.filter("not ok").count() == 0
    assert names(dst) == names(src) and Path(dst, "x/f").read_text() == "new" and os.readlink(f"{dst}/to") == "y"
    assert sync.verify(spark, src, dst, "checksum").count() == 0
    assert names(out) == {"f"} and Path(out, "f").read_text() == "outside"


def test_copy_replaces_links_only(spark, tmp_path):
    src, out = made(tmp_path / "s", x__f="new", z__g="g"), made(tmp_path / "o", f="outside")
    dst = made(tmp_path / "d", z="a file")
    os.symlink("../o", f"{dst}/x")
    failed = {r.path for r in sync.copy(spark, src, dst).filter("not ok").collect()}
    assert failed == {"z", "z/g"} and Path(dst, "z").read_text() == "a file"
    assert Path(dst, "x/f").read_text() == "new" and names(out) == {"f"}


def test_move_through_links(spark, tmp_path):
    src, out, dst = made(tmp_path / "s", a="1"), made(tmp_path / "o", f="outside", sub__g="2"), str(tmp_path / "d")
    os.symlink("../o", f"{src}/link")
    sync.move(spark, src, dst, confirm=True, options=sync.Options(follow_links=True))
    assert names(src) == set() and names(out) == {"f", "sub", "sub/g"}
    assert names(dst) == {"a", "link", "link/f", "link/sub", "link/sub/g"} and not os.path.islink(f"{dst}/link")


# Ranges ----------------------------------------------------------------------------------------


def test_ranges_of_a_lost_source(spark, tmp_path):
    src, dst, journal = made(tmp_path / "s", a="x" * 5000, b="y" * 3000), made(tmp_path / "d", a="old"), str(tmp_path / "journal")
    plan = plan_of(spark, src)
    ranges = planning.split_ranges(plan, 1000, 0)
    st = os.stat(f"{src}/a")
    os.rename(f"{src}/a", tmp_path / "away")
    got = results(jobs.run_copy_ranges(plan, ranges, src, dst, journal))
    assert not got["a"].ok and got["a"].error and got["b"].ok
    assert Path(dst, "a").read_text() == "old" and Path(dst, "b").read_text() == "y" * 3000
    os.rename(tmp_path / "away", f"{src}/a")
    got = results(jobs.run_copy_ranges(plan.filter("path = 'a'"), ranges.filter("path = 'a'"), src, dst, journal))
    assert got["a"].ok and got["a"].bytes == 5000 and Path(dst, "a").read_text() == "x" * 5000
    assert os.stat(f"{dst}/a").st_mtime_ns // 1000 == st.st_mtime_ns // 1000
    assert names(dst) == {"a", "b"}


def test_repeat_copies_missing_ranges_only(spark, tmp_path):
    src, dst, journal = made(tmp_path / "s", a="".join(map(chr, range(100))) * 50), str(tmp_path / "d"), str(tmp_path / "journal")
    plan = plan_of(spark, src)
    ranges = planning.split_ranges(plan, 1000, 0)
    short = Path(src, "a").read_bytes()
    at = os.stat(f"{src}/a")
    Path(src, "a").write_bytes(short[:2500])  # became shorter after it was planned
    got = results(jobs.run_copy_ranges(plan, ranges, src, dst, journal))
    assert not got["a"].ok and "early" in got["a"].error and got["a"].bytes == 2000
    part = Path(dst, part_name("a"))
    assert names(dst) == {part.name}
    Path(src, "a").write_bytes(short)
    os.utime(f"{src}/a", ns=(at.st_atime_ns, at.st_mtime_ns))
    with open(part, "r+b") as f:  # one of the two ranges in place is damaged
        f.seek(1500)
        f.write(b"?")
    got = results(jobs.run_copy_ranges(plan, ranges, src, dst, journal))
    assert got["a"].ok and got["a"].bytes == len(short) - 1000 and Path(dst, "a").read_bytes() == short and names(dst) == {"a"}


def test_ranges_of_a_source_that_changes(spark, tmp_path):
    src, dst = made(tmp_path / "s", a="x" * 100), str(tmp_path / "d")
    plan = plan_of(spark, src)
    Path(src, "a").write_text("y" * 100)
    os.utime(f"{src}/a", (1, 1))
    got = results(jobs.run_copy_ranges(plan, planning.split_ranges(plan, 30, 0), src, dst))
    assert not got["a"].ok and "changed" in got["a"].error and not os.path.exists(f"{dst}/a")


def test_mirror_by_ranges_after_a_failure(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(planning, "RANGED", 1000)
    monkeypatch.setattr(planning.split_ranges, "__defaults__", (700, 1000))
    src, dst = made(tmp_path / "s", a="x" * 5000, b="small"), made(tmp_path / "d", extra="e")
    real = jobs.write_ranges
    monkeypatch.setattr(jobs, "write_ranges", lambda ranges, *more: real(ranges.filter("off < 2000"), *more))
    assert {r.path for r in sync.mirror(spark, src, dst).filter("not ok").collect()} == {"a"}
    assert names(dst) == {"b", part_name("a")}
    copied = []
    monkeypatch.setattr(jobs, "write_ranges", lambda ranges, *more: copied.append(ranges.count()) or real(ranges, *more))
    assert sync.update(spark, src, dst).filter("not ok").count() == 0
    assert copied == [5] and Path(dst, "a").read_text() == "x" * 5000 and names(dst) == {"a", "b"}


def test_short_range_is_an_error(spark, tmp_path):
    src, dst = made(tmp_path / "s", a="0123456789"), made(tmp_path / "d", a="." * 100)
    ranges = spark.createDataFrame([("a", 0, 100)], "path string, off bigint, len bigint")
    assert not results(jobs.write_ranges(ranges, src, dst))["a"].ok


def test_rows_without_content_fail(spark, tmp_path):
    rows = spark.createDataFrame([("a", None, 1), ("b", bytearray(b"1"), 1)], "path string, content binary, mtime bigint")
    assert {p: r.ok for p, r in results(jobs.write_files(rows, str(tmp_path / "d"))).items()} == {"a": False, "b": True}
    assert {r[0] for r in rows.select(delta.weak_checksum(F.col("content")).alias("w")).collect()} == {None, delta.weak_of([b"1"])[0]}


# Scans -----------------------------------------------------------------------------------------


def test_linked_folders_at_any_depth(spark, tmp_path):
    base, out = made(tmp_path / "root", own__x="1"), made(tmp_path / "out", top="t", sub__f="f", sub__deep__g="g", side__h="h")
    os.symlink("../out", f"{base}/link")
    os.symlink("../../out/sub", f"{base}/own/near")
    os.symlink("../root", f"{out}/back")  # a circle
    os.symlink("../..", f"{out}/sub/deep/up")
    got = {r.path: r for r in tree.scan_tree(spark, base, follow_links=True).collect()}
    files = {p for p, r in got.items() if r.kind == "file"}
    assert files == {"own/x", "link/top", "link/sub/f", "link/sub/deep/g", "link/side/h"}
    assert len({r.real_path for r in got.values()}) == len(got)


def test_scan_in_rounds(spark, tmp_path):
    rng = random.Random(3)
    files = {"__".join([*(f"d{rng.randrange(3)}" for _ in range(rng.randrange(6))), f"f{k}"]): "x" * rng.randrange(9) for k in range(300)}
    files |= {f"flat__n{k:04d}": "" for k in range(400)} | {"é\udcff__ü": "1"}
    root = made(tmp_path / "r", **files)
    want = {str(p.relative_to(root)): p for p in Path(root).rglob("*")}
    for slice_, budget in ((5000, 20_000), (50, 60), (7, 1)):
        found = tree.scan(spark, root, slice_=slice_, budget=budget)
        rows = found.manifest.collect()
        assert len(rows) == len(want) and {tree.to_name(r.path) for r in rows} == set(want) and found.unread.count() == 0
        assert all(r.size == want[tree.to_name(r.path)].stat().st_size for r in rows if r.kind == "file")
    small = tree.scan(spark, root, FilterSpec(exclude_dirs=("flat",), max_size=3), kinds=("file",), slice_=20, budget=30).manifest
    assert {tree.to_name(r.path) for r in small.collect()} == {p for p, f in want.items() if f.is_file() and not p.startswith("flat") and f.stat().st_size <= 3}


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    df = tree.scan_tree(spark, made(tmp_path / "r", a="1", b="22")).filter("size > 1").select("path")
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "GreaterThan(size,1)" in plan and "link_target" not in plan.split("ReadSchema")[1]
    assert [r.path for r in df.collect()] == ["b"]


def deep_folder(root: str, depth: int, length: int = 200) -> str:
    """A folder whose path is too long to be opened by name; its path below root."""
    name, fd = "n" * length, os.open(root, os.O_RDONLY)
    for _ in range(depth):
        os.mkdir(name, dir_fd=fd)
        below = os.open(name, os.O_RDONLY, dir_fd=fd)
        os.close(fd)
        fd = below
    os.close(os.open("hidden", os.O_CREAT | os.O_WRONLY, dir_fd=fd))
    os.close(fd)
    return "/".join([name] * depth)


def test_what_cannot_be_read_is_not_deleted(spark, tmp_path):
    src, dst = made(tmp_path / "s", a="1"), made(tmp_path / "d", a="1", extra__e="2")
    deep = deep_folder(src, 24)
    found = tree.scan(spark, src)
    unread = [r.path for r in found.unread.collect()]
    assert len(unread) == 1 and deep.startswith(unread[0])
    assert tree.scan(spark, str(tmp_path / "nowhere")).unread.first().path == ""
    schema = "path string, kind string"
    dst_rows = [("a", "file"), ("x/b/c", "file"), ("x/b", "dir"), ("x", "dir"), ("y/f", "file"), ("y", "dir")]
    have, rows = spark.createDataFrame([("a", "file")], schema), spark.createDataFrame(dst_rows, schema)
    left = lambda *p: {r.path for r in sync.delete_plan(have, rows, sync.Options(), spark.createDataFrame([(x, "") for x in p], "path string, error string")).collect()}
    assert left("x/b") == {"y/f", "y"} and left("") == set() and left("other") == {"x/b/c", "x/b", "x", "y/f", "y"}
    assert sync.mirror(spark, src, dst).filter("not ok and action <> 'mkdir'").count() == 0
    assert not os.path.exists(f"{dst}/extra")


# Deletion --------------------------------------------------------------------------------------


@pytest.mark.parametrize("limit", [1, 5, 10_000])
def test_deep_trees_go_in_three_jobs(spark, tmp_path, limit, monkeypatch):
    rng = random.Random(limit)
    root = made(tmp_path / "r", **{"__".join(["top", *(f"d{rng.randrange(3)}" for _ in range(rng.randrange(12))), f"f{k}"]): "1" for k in range(80)})
    made(tmp_path / "r", kept__in__f="1", top__d0__stay="2")
    ran = []
    monkeypatch.setattr(jobs, "stored", lambda df: ran.append(1) or stored(df))
    rows = stored(tree.scan_tree(spark, root).filter("path like 'top%' and path <> 'top/d0/stay'").select("path", "kind"))
    got = results(jobs.run_delete(rows, root, limit=limit))
    assert {p for p, r in got.items() if not r.ok} == {"top", "top/d0"}
    assert names(root) == {"kept", "kept/in", "kept/in/f", "top", "top/d0", "top/d0/stay"} and len(ran) == 4  # the subtrees and three jobs


# Bundles ---------------------------------------------------------------------------------------


def test_bundles_hold_whole_trees(spark, tmp_path):
    src, out, dst = made(tmp_path / "s", d__f="content", d__big="b" * 3000), str(tmp_path / "b"), str(tmp_path / "d")
    os.symlink("d/f", f"{src}/link")
    (tmp_path / "s/empty").mkdir()
    os.utime(f"{src}/d/f", ns=(0, 1_700_000_000_123_456_000))
    plan = stored(tree.scan_tree(spark, src).withColumn("bundle_id", F.lit(0)))
    plan = plan.unionByName(plan.limit(1).withColumn("path", F.lit("gone")))
    total = jobs.write_bundles(plan, src, out).first()
    assert total.files == 5 and total.bytes == 3007 and total.error.startswith("gone")
    rows = {r.path: r for r in tree.read_bundles(spark, out, limit=1000).collect()}
    assert {p: r.kind for p, r in rows.items()} == {"d": "dir", "d/f": "file", "d/big": "file", "link": "symlink", "empty": "dir"}
    assert bytes(rows["d/f"].content) == b"content" and rows["link"].link_target == "d/f" and rows["d/f"].mtime_us == 1_700_000_000_123_456
    assert rows["d/big"].content is None and "1000" in rows["d/big"].error
    assert all(r.ok for r in results(jobs.unpack_bundles(tree.bundle_members(spark, out), out, dst)).values())
    assert names(dst) == names(src) and Path(dst, "d/big").read_text() == "b" * 3000 and os.readlink(f"{dst}/link") == "d/f"
    assert os.stat(f"{dst}/d/f").st_mtime_ns // 1000 == 1_700_000_000_123_456
    with tarfile.open(next(Path(out).glob("*.tar"))) as tar:  # any tar reader reads them
        assert tar.extractfile("d/f").read() == b"content" and tar.getmember("link").issym()


def test_tars_without_an_index(spark, tmp_path):
    made(tmp_path / "t", d__f="content")
    os.symlink("f", tmp_path / "t/d/link")
    (tmp_path / "b").mkdir()
    with tarfile.open(tmp_path / "b/x.tar", "w") as tar:
        tar.add(tmp_path / "t/d", arcname="d")
    rows = {r.path: r for r in tree.read_bundles(spark, str(tmp_path / "b")).collect()}
    assert {p: r.kind for p, r in rows.items()} == {"d": "dir", "d/f": "file", "d/link": "symlink"} and bytes(rows["d/f"].content) == b"content"


def test_tars_of_lost_tasks_do_not_count(spark, tmp_path):
    src, out = made(tmp_path / "s", a="1"), tmp_path / "b"
    jobs.write_bundles(stored(tree.scan_tree(spark, src).withColumn("bundle_id", F.lit(0))), src, str(out))
    with tarfile.open(out / "bundle-00000000-lost.tar", "w") as tar:
        tar.add(src + "/a", arcname="a")
    assert tree.read_bundles(spark, str(out)).count() == 1


@pytest.mark.parametrize("buckets", [1, 7, 64])
def test_bundles_fill_over_buckets(spark, buckets):
    plan = spark.range(3000).selectExpr("concat('f', id) path", "id * 37 % 1000 size")
    sizes = [r["s"] for r in planning.assign_bundles(plan, 50_000, buckets).groupBy("bundle_id").agg(F.sum("size").alias("s")).orderBy("bundle_id").collect()]
    assert sum(sizes) == sum(k * 37 % 1000 for k in range(3000)) and all(49_000 < s < 51_000 for s in sizes[:-1])


# Deltas over ranges ----------------------------------------------------------------------------


def test_large_files_are_signed(spark, tmp_path):
    src, dst = made(tmp_path / "s", big="a" * 1000 + "b", small="1"), made(tmp_path / "d", big="a" * 1000 + "c", small="1")
    files = plan_of(spark, src)
    sig = lambda root: stored(delta.file_signatures(files, root, 8, 100))
    assert {tuple(r) for r in delta.need_ranges(sig(src), sig(dst)).collect()} == {("big", 1000, 1)}
    os.remove(f"{src}/small")
    assert {tuple(r) for r in delta.need_ranges(sig(src), sig(dst)).collect()} == {("big", 1000, 1), ("small", None, None)}
    content = spark.createDataFrame([("p", None), ("q", bytearray(b"x"))], "path string, content binary")
    assert {tuple(r) for r in delta.need_ranges(delta.block_signatures(content, 8), delta.block_signatures(content, 8)).collect()} == {("p", None, None)}


def plain_delta(new, old, block):
    place, out, i, done = {}, [], 0, 0
    for o in range(0, len(old) - block + 1, block):
        place.setdefault(old[o : o + block], o)
    while i + block <= len(new):
        hit = place.get(new[i : i + block])
        if hit is None:
            i += 1
            continue
        out += [(done, i - done, None)] * (i > done) + [(i, block, hit)]
        i = done = i + block
    return out + [(done, len(new) - done, None)] * (done < len(new))


@pytest.mark.parametrize("stride", [8, 20, 64, 1 << 20])
def test_delta_over_ranges(spark, tmp_path, stride):
    rng, block, texts = random.Random(stride), 8, {}
    for k in range(20):
        old = "".join(rng.choices("ab", k=rng.randint(0, 400)))
        at = rng.randint(0, len(old))
        texts[f"p{k}"] = (old[:at] + "".join(rng.choices("abc", k=rng.randint(0, 60))) + old[at:], old)
    texts |= {"zeros": ("0" * 333, "0" * 100), "none": ("1" * 90, ""), "empty": ("", "x" * 20), "same": ("xy" * 200, "xy" * 200), "gap": ("a" * 8 + "?" * 200 + "a" * 16, "a" * 8)}
    src, dst = made(tmp_path / "s", **{k: v[0] for k, v in texts.items()}), made(tmp_path / "d", **{k: v[1] for k, v in texts.items()})
    sig = stored(delta.file_signatures(plan_of(spark, dst), dst, block, 24))
    got = {}
    for r in delta.file_delta(plan_of(spark, src), src, sig, block, stride).orderBy("path", "off").collect():
        got.setdefault(r.path, []).append((r.off, r.len, r.dst_off))
    assert got == {k: w for k, (new, old) in texts.items() if (w := plain_delta(new.encode(), old.encode(), block))}


def test_delta_of_what_cannot_be_read(spark, tmp_path):
    src = made(tmp_path / "s", a="a" * 50, b="b" * 50)
    files = plan_of(spark, src)
    sig = stored(delta.file_signatures(files, src, 8))
    os.remove(f"{src}/a")
    rows = [tuple(r) for r in delta.file_delta(files, src, sig, 8, 16).orderBy("path", "off").collect()]
    assert rows[0] == ("a", None, None, None) and {r[0] for r in rows[1:]} == {"b"}


def test_hits_grow_with_matches(spark):
    rng = random.Random(9)
    new = rng.randbytes(100_000)
    content = spark.createDataFrame([("p", bytearray(new))], "path string, content binary")
    other = spark.createDataFrame([("p", bytearray(rng.randbytes(19_200) + new[5000:5064]))], "path string, content binary")
    hits = delta.rolling_hits(content, delta.block_signatures(other, 64), 64)
    assert hits.count() < 12_000 and hits.filter("off = 5000").count() == 1  # at most one in 16 passes by chance


# Log -------------------------------------------------------------------------------------------


def test_log_of_a_run(spark, tmp_path):
    src, dst = made(tmp_path / "s", a="1", d__b="22", z__g="g"), made(tmp_path / "d", z="a file")
    sync.copy(spark, src, dst, sync.Options(log=str(tmp_path / "log")))
    rows = tree.read_log(spark, str(tmp_path / "log")).collect()
    by = {t: [r for r in rows if r.tag == t] for t in ("START", "COPY", "ERROR", "DONE")}
    assert by["START"][0].src == src and by["START"][0].dst == dst
    assert {(r.src, r.bytes) for r in by["COPY"]} == {(f"{src}/a", 1), (f"{src}/d/b", 2)}
    assert {r.path for r in by["ERROR"]} == {"z", "z/g"}
    assert (by["DONE"][0].files, by["DONE"][0].bytes) == (2, 3) and by["DONE"][0].seconds > 0
