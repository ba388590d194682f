"""Scans, copies and verbs over real trees."""

import os

import pytest

from treeline.operators import compare, delta, filters, jobs
from treeline.operators.filters import FilterSpec
from treeline.plans import planning, sync
from treeline.sinks import stored
from treeline.sources import tree

FILES = {"a.txt": b"x" * 10, "zero": b"", "_under/f": b"1", ".hid/g": b"2", "_u": b"u", ".dot": b"d", "sp ace/n\nl": b"3", "é/ü": b"4", "s/t/v": b"5", "small": b"q" * 1048575, "medium": b"q" * 1048576}


@pytest.fixture
def root(tmp_path):
    top = tmp_path / "a"
    for name, data in FILES.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(data)
    (top / "empty").mkdir()
    os.symlink("a.txt", top / "to_file")
    os.symlink("s", top / "to_dir")
    os.symlink("..", top / "s/loop")
    with open(os.fsencode(top) + b"/bad\xff", "wb") as f:
        f.write(b"7")
    os.chmod(top / "a.txt", 0o444)
    return str(top)


def test_scan(spark, root):
    got = {r.path: r for r in tree.scan_tree(spark, root).collect()}
    assert {p for p, r in got.items() if r.kind == "file"} == {*FILES, "bad\\udcff"}
    assert {p for p, r in got.items() if r.kind == "symlink"} == {"to_file", "to_dir", "s/loop"}
    assert {p for p, r in got.items() if r.kind == "dir"} == {"_under", ".hid", "sp ace", "é", "s", "s/t", "empty"}
    assert got["to_file"].link_target == "a.txt" and got["small"].size == 1048575 and got["a.txt"].readonly
    assert tree.scan_tree(spark, root + "/empty").count() == 0


def test_scan_filtered(spark, root):
    spec = FilterSpec(exclude_files=("_u",), exclude_dirs=("s",), min_size=1, max_size=1048575)
    got = {r.path for r in tree.scan_tree(spark, root, spec, kinds=("file",)).collect()}
    assert got == {"a.txt", "_under/f", ".hid/g", ".dot", "sp ace/n\nl", "é/ü", "small", "bad\\udcff"}


def test_scan_follows_links_once(spark, root):
    got = tree.scan_tree(spark, root, follow_links=True).collect()
    assert len({r.real_path for r in got}) == len(got)
    assert {r.path for r in got if r.kind == "file"} >= {"zero", "medium"}


def test_mirror_verify_move(spark, root, tmp_path):
    other = tmp_path / "b"
    (other / "x/y").mkdir(parents=True)
    (other / "x/y/extra").write_text("e")
    (other / "zero").write_text("not empty")
    results = sync.mirror(spark, root, str(other))
    assert results.filter("not ok").count() == 0
    assert sync.verify(spark, root, str(other), "checksum").count() == 0
    assert not (other / "x").exists() and (other / "empty").is_dir() and os.readlink(other / "to_dir") == "s"
    again = sync.mirror(spark, root, str(other))
    assert again.filter("action <> 'mkdir'").count() == 0
    dry = sync.dry_run(spark, root, str(other))
    assert dry["files"].count() == 0 and dry["delete_counts"].count() == 0
    with pytest.raises(ValueError):
        sync.move(spark, root, str(tmp_path / "c"))
    sync.move(spark, root, str(tmp_path / "c"), confirm=True)
    assert os.listdir(root) == []
    assert sync.verify(spark, str(other), str(tmp_path / "c"), "checksum").count() == 0


def test_bundled_copy_and_checksum_update(spark, root, tmp_path):
    other = str(tmp_path / "b")
    assert sync.copy(spark, root, other, sync.Options(force_bundle=True)).filter("not ok").count() == 0
    assert sync.verify(spark, root, other, "checksum").count() == 0
    at = os.stat(other + "/zero")
    with open(other + "/_u", "wb") as f:
        f.write(b"v")
    os.utime(other + "/_u", (at.st_mtime + 100, at.st_mtime + 100))
    assert sync.verify(spark, root, other, "size").count() == 0
    assert [r.path for r in sync.verify(spark, root, other, "checksum").collect()] == ["_u"]
    sync.update(spark, root, other, sync.Options(compare="checksum"))
    assert sync.verify(spark, root, other, "checksum").count() == 0


def test_mirror_refuses(spark, root, tmp_path):
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        sync.mirror(spark, str(tmp_path / "none"), root)
    with pytest.raises(ValueError):
        sync.mirror(spark, root, "/")
    with pytest.raises(ValueError):
        jobs.run_delete(tree.scan_tree(spark, root).select("path", "kind"), "/")


def test_errors_become_rows(spark, root, tmp_path):
    plan = spark.createDataFrame([("a.txt", 10), ("missing", 5)], "path string, size bigint")
    got = {r.path: r for r in stored(jobs.run_copy(plan, root, str(tmp_path / "b"))).collect()}
    assert got["a.txt"].ok and not got["missing"].ok and "FileNotFoundError" in got["missing"].error
    gone = spark.createDataFrame([("nowhere", "file"), ("s", "dir")], "path string, kind string")
    got = {r.path: r.ok for r in jobs.run_delete(gone, root).collect()}
    assert got == {"nowhere": True, "s": False}


@pytest.mark.parametrize("gap, copied", [(-5, False), (0, False), (2, False), (3, True), (4, True)])
def test_newer_edge(spark, gap, copied):
    src = spark.createDataFrame([("p", 1, 100 + gap)], "path string, size bigint, mtime bigint")
    dst = spark.createDataFrame([("p", 1, 100)], "path string, size bigint, mtime bigint")
    assert (compare.need_copy(src, dst).count() == 1) is copied


def test_unknown_metadata_is_copied(spark):
    src = spark.createDataFrame([("p", None, 1), ("q", 1, None)], "path string, size bigint, mtime bigint")
    dst = spark.createDataFrame([("p", 1, 1), ("q", 1, 1)], "path string, size bigint, mtime bigint")
    assert {r.reason for r in compare.need_copy(src, dst).collect()} == {"unknown", "newer"}


def test_ranges_tile(spark):
    plan = spark.createDataFrame([(f"f{n}", n) for n in (0, 1, 9, 10, 11, 25)], "path string, size bigint")
    by = {}
    for r in planning.split_ranges(plan, 10, 0).orderBy("path", "off").collect():
        assert r.off == by.get(r.path, 0) and r.len > 0
        by[r.path] = r.off + r.len
    assert by == {"f1": 1, "f9": 9, "f10": 10, "f11": 11, "f25": 25}


def test_rolling_equals_fresh(spark):
    data = bytes(range(256)) * 3
    for block in (1, 3, 64):
        fresh = []
        for k in range(len(data) - block + 1):
            c = [b + 31 for b in data[k : k + block]]
            fresh.append((sum(c) & 0xFFFF) | ((sum((block - i) * x for i, x in enumerate(c)) & 0xFFFF) << 16))
        assert delta.rolling(data, block).tolist() == fresh
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(bytearray(b"Hello, World!"),), (bytearray(b""),)], "c binary")
    assert sorted(r[0] for r in df.select(delta.weak_checksum(F.col("c"))).collect()) == [0, 714475004]


def test_delta_rebuilds_source(spark):
    old, new = bytes(range(200)) * 4, b"##" + bytes(range(200)) * 2 + b"inserted" + bytes(range(200)) * 2
    src = spark.createDataFrame([("p", bytearray(new)), ("only", bytearray(b"abc")), ("empty", bytearray())], "path string, content binary")
    dst = spark.createDataFrame([("p", bytearray(old))], "path string, content binary")
    rows = delta.delta_match(src, delta.block_signatures(dst, 32), 32).orderBy("path", "off").collect()
    out, done = {}, {}
    for r in rows:
        assert r.off == done.get(r.path, 0)
        done[r.path] = r.off + r.len
        piece = old[r.dst_off : r.dst_off + r.len] if r.dst_off is not None else {"p": new, "only": b"abc"}[r.path][r.off : r.off + r.len]
        out[r.path] = out.get(r.path, b"") + piece
    assert out == {"p": new, "only": b"abc"}
    assert sum(r.len for r in rows if r.path == "p" and r.dst_off is not None) > 700


def test_log_round_trip(spark, tmp_path):
    from pyspark.sql import functions as F

    from treeline.operators import report

    results = spark.createDataFrame([("a", "copy", True, 5, None, 1.0), ("b c", "copy", False, 0, "denied now", 1.0)], "path string, action string, ok boolean, bytes bigint, error string, seconds double")
    report.write_log(results, str(tmp_path / "log"), "/s", "/d", F.lit("t"))
    got = {r.tag: r for r in tree.read_log(spark, str(tmp_path / "log")).collect()}
    assert (got["COPY"].src, got["COPY"].dst, got["COPY"].bytes) == ("/s/a", "/d/a", 5)
    assert (got["ERROR"].path, got["ERROR"].msg) == ("b c", "denied now")


def test_links_and_limits(spark):
    rows = [("d/f", "file", None), ("l1", "symlink", "d"), ("l2", "symlink", "d/f"), ("d/l3", "symlink", "f"), ("l4", "symlink", "gone")]
    df = spark.createDataFrame(rows, "path string, kind string, link_target string")
    left = lambda **k: {r.path for r in filters.link_policy(df, **k).collect()}
    assert left(drop_dir_links=True) == {"d/f", "l2", "d/l3", "l4"}
    assert left(drop_file_links=True) == {"d/f", "l1", "l4"}
    assert left(drop_links=True) == {"d/f"}
    with pytest.raises(filters.TooManyRows):
        filters.assert_max_rows(df, 4)
