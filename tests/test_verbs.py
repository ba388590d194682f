"""The verbs on real trees: what move must not lose, single files, reports, options."""

import os
from pathlib import Path

import pytest

from treeline.functions import paths
from treeline.operators import compare, delta, filters, jobs
from treeline.plans import planning, sync
from treeline.sources import tree


def made(root: Path, **files: str) -> str:
    for name, text in files.items():
        p = root / name.replace("__", "/")
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(root)


def names(root) -> set[str]:
    return {str(p.relative_to(root)) for p in Path(root).rglob("*")}


def test_move_takes_everything(spark, tmp_path):
    src = made(tmp_path / "s", a="1", d__b="22")
    os.symlink("a", f"{src}/d/link")
    (tmp_path / "s/empty").mkdir()
    os.chmod(f"{src}/a", 0o444)
    dst = made(tmp_path / "t", old="x")
    sync.move(spark, src, dst, confirm=True, options=sync.Options(clear_readonly=True))
    assert names(src) == set() and names(dst) == {"a", "d", "d/b", "d/link", "empty"}
    assert os.readlink(f"{dst}/d/link") == "a" and Path(dst, "d/b").read_text() == "22"


def test_move_stops_where_a_link_fails(spark, tmp_path):
    src = made(tmp_path / "s", a="1")
    os.symlink("a", f"{src}/x")
    dst = made(tmp_path / "t", x__inner="in the way")
    with pytest.raises(RuntimeError):  # files_only: the folder in the way stays
        sync.move(spark, src, dst, confirm=True, options=sync.Options(files_only=True))
    assert names(src) == {"a", "x"} and os.readlink(f"{src}/x") == "a"


def test_move_stops_where_a_copy_fails(spark, tmp_path):
    src, dst = made(tmp_path / "s", a="1", x="2"), made(tmp_path / "t", x__inner="in the way")
    with pytest.raises(RuntimeError):
        sync.move(spark, src, dst, confirm=True, options=sync.Options(files_only=True))
    assert names(src) == {"a", "x"}


def test_move_leaves_what_came_later(spark, tmp_path, monkeypatch):
    src, dst = made(tmp_path / "s", a="1", d__b="2", c="3"), str(tmp_path / "t")
    digested = sync._digested

    def later(*args):
        out = digested(*args)
        made(tmp_path / "s", d__new="late", c="changed")
        return out

    monkeypatch.setattr(sync, "_digested", later)
    sync.move(spark, src, dst, confirm=True)
    assert names(src) == {"c", "d", "d/new"} and Path(src, "c").read_text() == "changed"
    assert names(dst) == {"a", "c", "d", "d/b"}


def test_single_file(spark, tmp_path):
    src, dst = made(tmp_path / "s", a="1", b="2"), made(tmp_path / "t", old="x")
    sync.copy(spark, f"{src}/a", dst)
    assert names(dst) == {"a", "old"}
    assert sync.verify(spark, f"{src}/a", f"{dst}/a", "checksum").count() == 0
    sync.move(spark, f"{src}/b", dst, confirm=True)
    assert names(src) == {"a"} and names(dst) == {"a", "b", "old"}


def test_verify_report(spark, tmp_path):
    src, dst = made(tmp_path / "s", a="1", b="22", c="3"), made(tmp_path / "t", a="1", b="2", d="4")
    got = sync.verify_report(spark, src, dst, csv=str(tmp_path / "csv"), json=str(tmp_path / "json"))
    one = got.summary.first()
    assert got.code == 1 and (one.changed_count, one.extras_count) == (2, 1) and {r.path for r in got.diff.collect()} == {"b", "c", "d"}
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3
    assert '"identical":false' in spark.read.text(str(tmp_path / "json")).first()[0]
    assert got.text.count() == 4
    assert sync.verify_report(spark, src, src).code == 0


def test_delete_readonly(spark, tmp_path):
    root = made(tmp_path / "r", a="1", b="2")
    os.chmod(f"{root}/a", 0o444)
    plan = spark.createDataFrame([("a", "file"), ("bad\0name", "file")], "path string, kind string")
    got = {r.path: r.ok for r in jobs.run_delete(plan, root, clear_readonly=True).collect()}
    assert got == {"a": True, "bad\0name": False} and names(root) == {"b"}


def test_content_of_all_files(spark, tmp_path):
    root = made(tmp_path / "r", small="1", large="2" * 100, empty="")
    m = tree.scan_tree(spark, root).unionByName(tree.scan_tree(spark, root).filter("path = 'small'").selectExpr("'gone' path", "kind", "size", "mtime", "mode", "readonly", "link_target", "real_path", "root"))
    got = {r.path: (r.content, r.error) for r in tree.read_content(m, 50).collect()}
    assert bytes(got["small"][0]) == b"1" and bytes(got["empty"][0]) == b"" and got["large"] == (None, "more than 50 bytes")
    assert got["gone"][0] is None and "FileNotFoundError" in got["gone"][1]
    digests = {r.path: r.digest for r in tree.tree_digests(m, root, 50).collect()}
    assert digests["gone"] is None and digests["large"] and len(digests) == 4


def test_edges_of_a_deep_tree(spark):
    edges = [("/".join("d" * k), "/".join("d" * (k + 1)), "dir") for k in range(12)] + [("", "x", "file")]
    got = {r.path for r in tree.expand_edges(spark.createDataFrame(edges, "parent string, child string, kind string"), "d").collect()}
    assert got == {"/".join("d" * k) for k in range(2, 13)}


def test_double_star_and_exact_times(spark):
    from pyspark.sql import functions as F

    assert filters.matches("any", "**") and spark.range(1).select(filters.glob_match(F.lit("any"), "**")).first()[0]
    schema = "path string, size bigint, mtime bigint, mtime_us bigint"
    dst = spark.createDataFrame([("p", 1, 100, 100_900_000)], schema)
    for us, count in ((103_000_000, 0), (103_900_000, 1), (103_899_999, 0)):
        assert compare.need_copy(spark.createDataFrame([("p", 1, us // 1_000_000, us)], schema), dst).count() == count


def test_odd_endpoints(spark):
    texts = ["\t sync://h:0000000080/a\nb ", "sync:h", "sync://h:70000/x", "nothing"]
    got = [r.e for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(paths.parse_endpoint("t", "sync").alias("e")).collect()]
    assert (got[0].host, got[0].port, got[0].path) == ("h", 80, "/a\nb") and got[1].host == "h" and got[2] is None and got[3] is None


def test_bundles_follow_the_plan(spark):
    plan = spark.range(5000).selectExpr("concat('f', id) path", "cast(0 as bigint) size")
    assert planning.buckets_for(plan, bucket_files=1000) == 5
    got = planning.assign_bundles(plan, 1 << 20, 5, overhead=planning.FILE_OVERHEAD).groupBy("bucket", "bundle_id").count().collect()
    assert max(r["count"] for r in got) <= 256 and sum(r["count"] for r in got) == 5000


def test_delta_match_against_brute_force(spark):
    import random

    rng, block = random.Random(4), 8
    rows, want = [], {}
    for k in range(30):
        old = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 90)))
        at = rng.randint(0, len(old))
        new = old[:at] + bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 9))) + old[at:]
        rows.append((f"p{k}", bytearray(new), bytearray(old)))
        place = {}
        for o in range(0, len(old) - block + 1, block):
            place.setdefault(old[o : o + block], o)
        i = done = 0
        while i < len(new):
            hit = place.get(new[i : i + block]) if i + block <= len(new) else None
            if hit is None:
                i += 1
                continue
            if i > done:
                want[f"p{k}", done] = (i - done, None)
            want[f"p{k}", i] = (block, hit)
            i = done = i + block
        if done < len(new):
            want[f"p{k}", done] = (len(new) - done, None)
    df = spark.createDataFrame(rows, "path string, content binary, old binary")
    sig = delta.block_signatures(df.selectExpr("path", "old content"), block)
    assert {(r.path, r.off): (r.len, r.dst_off) for r in delta.delta_match(df.select("path", "content"), sig, block).collect()} == want
