"""Faults that only size or odd values show."""

import hashlib
import os
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from treeline.functions import paths
from treeline.operators import delta, jobs
from treeline.operators.filters import FilterSpec
from treeline.plans import planning
from treeline.sources import tree
from treeline.sources.rooted import Rooted, written_to


def test_blocks_carry_no_whole_content(spark):
    """only the path goes with each block of a content."""
    df = spark.createDataFrame([("p", bytearray(b"0123456789")), ("q", bytearray()), ("r", None)], "path string, content binary")
    blocks = delta.block_contents(df, 4)
    assert sorted(tuple(r) for r in blocks.collect()) == [("p", 0, 0, 4, b"0123"), ("p", 1, 4, 4, b"4567"), ("p", 2, 8, 2, b"89")]
    plan = blocks.select("path", "block", delta.weak_checksum(F.col("content")))._jdf.queryExecution().executedPlan().toString()
    carried = re.findall(r"Generate posexplode\(.*\), \[([^\]]*)\], (?:true|false)", plan)
    assert carried and all(c.startswith("path#") and "," not in c for c in carried)


def test_sizes_round_as_in_sql(spark, duck):
    """ties go to the even digit, anything else by its exact value."""
    rng = random.Random(5)
    sizes = [k * 2**17 for k in range(64)] + [k * 2**27 for k in range(64)] + [rng.randrange(2**rng.randint(1, 53)) for _ in range(20000)] + [k * 1309 for k in range(0, 10**6, 97)]
    df = spark.createDataFrame([(k, n) for k, n in enumerate(sizes)], "k bigint, size bigint")
    got = df.select("k", paths.human_mb("size").alias("mb"), paths.human_gb("size").alias("gb"), paths.two_decimals(F.col("size") / 1048576.0 / 8.0).alias("rate")).orderBy("k").toPandas()
    sql = "select k, printf('%.2f', size/1048576.0) mb, printf('%.2f', size/1073741824.0) gb, printf('%.2f', size/1048576.0/8.0) rate from given order by k"
    duck.register("given", df.toPandas())
    assert got.equals(duck.execute(sql).df())
    duck.unregister("given")
    assert spark.sql("select cast(null as bigint) size").select(paths.human_mb("size")).first()[0] is None


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("covered", [1, 5, 1000])
def test_cover_takes_many_ranges_at_a_time(spark, monkeypatch, covered):
    """no Python call a range; ranges that batches cut through are covered whole."""
    monkeypatch.setattr(delta, "COVERED", covered)
    rng, block, stride, rows, want = random.Random(covered), 4, 10, [], set()
    sizes = [(f"p{k}", rng.randint(1, 300)) for k in range(40)]
    for path, size in sizes:
        offs = [o for o in range(size - block + 1) if rng.random() < 0.4]
        rows += [(path, o, 1000 + o) for o in offs]
        done = 0
        for o in offs:
            if o >= done:
                want |= {(path, done, o - done, None)} if o > done else set()
                want.add((path, o, block, 1000 + o))
                done = o + block
        want |= {(path, done, size - done, None)} if size > done else set()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        made = delta.cover(spark.createDataFrame(rows, "path string, off bigint, dst_off bigint"), spark.createDataFrame(sizes, "path string, size bigint"), block, stride)
        assert {tuple(r) for r in made.collect()} == want
        assert "FlatMapGroupsInPandas" not in plan_text(made)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_signatures_are_made_once(spark, tmp_path):
    """F8, F9: ranges need no join, and needed ranges read each side once."""
    files = spark.createDataFrame([("a", 100), ("b", 0)], "path string, size bigint")
    (tmp_path / "a").write_bytes(bytes(range(100)))
    (tmp_path / "b").write_bytes(b"")
    sig = delta.file_signatures(files, str(tmp_path), 8, 20)
    assert "Join" not in plan_text(sig)
    assert [(r.off, r.len) for r in sig.orderBy("off").collect()] == [(o, min(8, 100 - o)) for o in range(0, 100, 8)]
    assert plan_text(delta.need_ranges(sig, sig)).count("MapInArrow") <= 2


def test_digests_are_made_where_files_are_read(spark, tmp_path):
    """digests need no content in rows, and tasks follow the number of files."""
    (tmp_path / "a").write_bytes(b"x" * 100)
    (tmp_path / "b").write_bytes(b"y")
    rows = [("a", "file", 100, str(tmp_path)), ("b", "file", 1, str(tmp_path)), ("gone", "file", 1, str(tmp_path))]
    m = spark.createDataFrame(rows, "path string, kind string, size bigint, root string")
    made = tree.tree_digests(m, str(tmp_path), 40)
    assert "content" not in plan_text(made)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    whole = sha("".join(sha(b"x" * n) for n in (40, 40, 20)).encode())
    assert {tuple(r) for r in made.collect()} == {("a", whole), ("b", sha(b"y")), ("gone", None)}
    many = spark.range(5000).selectExpr("concat('f', id) path", "'file' kind", "cast(0 as bigint) size", f"'{tmp_path}' root")
    assert tree.read_content(many).rdd.getNumPartitions() == 3


def test_folders_that_are_there_are_not_made(tmp_path, monkeypatch):
    """writing a file takes no lock on the folders above its own."""
    made, real = [], os.mkdir
    monkeypatch.setattr(os, "mkdir", lambda *a, **k: (made.append(a[0]), real(*a, **k))[1])
    for name in "xy":
        Rooted(str(tmp_path / "r")).place(f"a/b/{name}", lambda fd, temp: os.close(written_to(fd, temp)))
    assert sorted(os.listdir(tmp_path / "r/a/b")) == ["x", "y"] and [m for m in made if m in ("a", "b")] == ["a", "b"]


def test_bundles_are_dealt_by_what_they_hold(spark, tmp_path):
    """F16, F17: many small bundles share a task, and unpacking takes tasks by the number of members."""
    src, folder, out = tmp_path / "s", str(tmp_path / "b"), tmp_path / "o"
    src.mkdir()
    for k in range(40):
        (src / f"f{k}").write_bytes(b"x" * k)
    plan = spark.range(40).selectExpr("id bundle_id", "concat('f', id) path", "id size")
    assert jobs.write_bundles(plan, str(src), folder).count() == 40
    parts = [n for n in os.listdir(f"{folder}/{tree.INDEX}") if n.endswith(".parquet")]
    assert len(parts) == 1 and len([n for n in os.listdir(folder) if n.endswith(".tar")]) == 40
    done = jobs.unpack_bundles(tree.bundle_members(spark, folder), folder, str(out))
    assert done.filter("ok").count() == 40 and [(out / f"f{k}").stat().st_size for k in range(40)] == list(range(40))
    many = spark.range(5000).selectExpr("'b' bundle", "concat('f', id) path", "'file' kind", "cast(9 as bigint) size", "id mtime_us", "cast(null as string) link_target", "id * 20000 offset", "cast(null as string) error")
    assert jobs.unpack_bundles(many, folder, str(out)).rdd.getNumPartitions() == 3


def test_a_folder_is_listed_once(tmp_path, monkeypatch):
    """however many names a folder has, and a task holds no more of them than a slice."""
    for k in range(95):
        (tmp_path / f"n{k}").write_bytes(b"x")
    (tmp_path / os.fsdecode(b"odd\xff")).mkdir()
    listed, real = [], os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: (listed.append(p), real(p))[1])
    walk, todo, found = tree._Walk(str(tmp_path), FilterSpec(), ("file", "dir"), False, None, 10, 10**6), [("", None)], []
    while todo:
        given = tree.pa.record_batch([tree.pa.array(c, t) for c, t in zip(zip(*todo, strict=True), (tree.pa.string(), tree.pa.binary()), strict=True)], names=["path", "names"])
        rows = [r for b in walk.run(iter([given])) for r in b.to_pylist()]
        found += [r["path"] for r in rows if r["step"] == "row"]
        todo = [(r["path"], r["names"]) for r in rows if r["step"] == "todo"]
        assert all(names is None or len(names.split(b"\0")) <= 10 for _, names in todo)
    assert sorted(found) == sorted([f"n{k}" for k in range(95)] + ["odd\\udcff"])
    assert sorted(listed) == sorted([str(tmp_path), str(tmp_path / os.fsdecode(b"odd\xff"))])


def test_a_repeat_leaves_whole_files(spark, tmp_path):
    """what an earlier run has finished is read back, not written again; ranges of a file share handles."""
    src, dst, journal = tmp_path / "s", tmp_path / "d", str(tmp_path / "journal")
    src.mkdir()
    for name in ("same", "damaged", "changed"):
        (src / name).write_bytes(bytes(range(200)) * 20)
    plan = tree.manifest_seconds(tree.scan_tree(spark, str(src)))
    ranges = tree.stored(planning.split_ranges(plan, 1000, 0))
    run = lambda: {r.path: r for r in tree.stored(jobs.run_copy_ranges(plan, ranges, str(src), str(dst), journal)).collect()}
    assert {(r.ok, r.bytes) for r in run().values()} == {(True, 4000)}
    node, at = (dst / "same").stat().st_ino, (dst / "damaged").stat()
    with open(dst / "damaged", "r+b") as f:
        f.write(b"?")
    os.utime(dst / "damaged", ns=(at.st_atime_ns, at.st_mtime_ns))
    os.utime(src / "changed", (1, 1))
    got = run()
    assert (got["same"].ok, got["same"].bytes) == (True, 0) and (dst / "same").stat().st_ino == node
    assert got["damaged"].ok and got["damaged"].bytes == 4000 and (dst / "damaged").read_bytes() == (src / "same").read_bytes()
    assert not got["changed"].ok and "changed" in got["changed"].error
    opened = []
    held = jobs._Opened(lambda stack, path: (opened.append(path), stack.callback(opened.append, "-"))[:1])
    for path in "aabba":
        held(path)
    held.close()
    assert opened == ["a", "-", "b", "-", "a", "-"]


def test_long_contents_are_held_a_few_at_a_time(monkeypatch):
    """what a task holds as Python objects follows bytes, not only rows."""
    monkeypatch.setattr(jobs, "HELD", 1000, raising=False)
    held = []
    rows = [("a", b"x" * 400), ("b", b"x" * 400), ("c", b"x" * 400), ("d", b"x" * 5000), ("e", None), ("f", b"")]
    batch = pa.RecordBatch.from_pylist([{"path": p, "content": c} for p, c in rows])

    class Frame:
        def mapInArrow(self, run, schema):
            for out in run(iter([batch, batch.slice(0, 0)])):
                held.append(out.column("path").to_pylist())
            return self

    jobs._run_more(Frame(), "x", lambda row: (len(row.content or b""),), jobs.RESULTS)
    assert held == [["a", "b"], ["c"], ["d"], ["e", "f"]]


def test_signatures_are_not_broadcast(spark, tmp_path):
    """signatures made of a small manifest are many all the same; no side of them goes through the driver."""
    (tmp_path / "a").write_bytes(bytes(range(100)))
    spark.createDataFrame([("a", 100)], "path string, size bigint").write.parquet(str(tmp_path / "m"))
    files = spark.read.parquet(str(tmp_path / "m"))
    sig = delta.file_signatures(files, str(tmp_path), 8, 20)
    made = delta.need_ranges(sig, sig.withColumn("strong", F.when(F.col("block").isin(2, 3), F.sha2("path", 256)).otherwise(F.col("strong"))))
    assert {tuple(r) for r in made.collect()} == {("a", 16, 16)}
    assert "Broadcast" not in plan_text(made) and "SortMergeJoin" in plan_text(made)


def plain_delta(new: bytes, old: bytes, block: int) -> list[tuple]:
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


def two_trees(spark, folder, texts: dict[str, tuple[bytes, bytes]]):
    """The destination's contents and the source's files and contents, as tables and as trees."""
    for path, sides in texts.items():
        for name, text in zip("sd", sides, strict=True):
            (folder / name).mkdir(exist_ok=True)
            (folder / name / path).write_bytes(text)
    df = spark.createDataFrame([(p, bytearray(new), bytearray(old)) for p, (new, old) in texts.items()], "path string, new binary, old binary")
    files = lambda side: df.select("path", F.length(side).cast("bigint").alias("size"))
    return files("new"), files("old"), df.selectExpr("path", "new content"), df.selectExpr("path", "old content")


def test_only_matches_that_are_taken_become_rows(spark, tmp_path, monkeypatch):
    """a file that repeats itself matches at every byte; what is written follows its blocks."""
    files, old, new_content, old_content = two_trees(spark, tmp_path, {"zeros": (b"0" * 50_000, b"0" * 640), "text": (bytes(range(250)) * 4, bytes(range(250)) * 4)})
    written, real = [], delta.stored
    monkeypatch.setattr(delta, "stored", lambda df: (made := real(df), written.append((made.columns, made.count())))[0])
    sig = delta.file_signatures(old, str(tmp_path / "d"), 64)
    for made in (delta.file_delta(files, str(tmp_path / "s"), sig, 64, 1024), delta.delta_match(new_content, delta.block_signatures(old_content, 64), 64, 1024)):
        assert made.count() == 50_000 // 64 + 1 + 1000 // 64 + 1
    assert max(n for _, n in written) < 1000 and not any("strong" in columns for columns, _ in written)


@pytest.mark.parametrize("alone, known, windows", [(0, 10**6, 10**6), (10**6, 10**6, 7), (150, 9, 50), (10**6, 0, 64)])
def test_deltas_of_one_task_and_by_ranges(spark, tmp_path, monkeypatch, alone, known, windows):
    """the same delta whether one task covers a file, or its size or its destination's blocks send it by ranges."""
    for name, value in (("ALONE", alone), ("KNOWN", known), ("WINDOWS", windows)):
        monkeypatch.setattr(delta, name, value)
    rng, block, texts = random.Random(alone + known), 8, {}
    for k in range(30):
        old = bytes(rng.choices(b"ab", k=rng.randint(0, 400)))
        at = rng.randint(0, len(old))
        texts[f"p{k}"] = (old[:at] + bytes(rng.choices(b"abc", k=rng.randint(0, 60))) + old[at:], old)
    texts |= {"none": (b"1" * 90, b""), "empty": (b"", b"x" * 20), "same": (b"xy" * 200, b"xy" * 200), "short": (b"abc", b"abc")}
    files, old_files, content, old_content = two_trees(spark, tmp_path, texts)
    want = {(p, *row) for p, (new, old) in texts.items() for row in plain_delta(new, old, block)}
    lost = spark.createDataFrame([("lost", 5), ("gone", 400)], "path string, size bigint")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        made = delta.file_delta(files.unionByName(lost), str(tmp_path / "s"), delta.file_signatures(old_files, str(tmp_path / "d"), block, 24), block, 20)
        assert sorted(map(tuple, made.collect()), key=str) == sorted(want | {("lost", None, None, None), ("gone", None, None, None)}, key=str)
        made = delta.delta_match(content.unionByName(spark.createDataFrame([("null", None)], content.schema)), delta.block_signatures(old_content, block), block, 20)
        assert sorted(map(tuple, made.collect()), key=str) == sorted(want | {("null", None, None, None)}, key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_contents_go_to_files_from_where_they_are_read(spark, tmp_path, monkeypatch):
    """a table of enough parts is not shuffled on its way to a tree."""
    from tests.conftest import SMALL
    from treeline import queries

    spark.read.parquet(f"{SMALL}/documents.parquet").repartition(16).write.parquet(str(tmp_path / "documents.parquet"))
    spreads, real = [], tree.spread
    monkeypatch.setattr(tree, "spread", lambda *a, **k: (spreads.append(1), real(*a, **k))[1])
    for folder, want in ((str(tmp_path), 0), (SMALL, 2)):
        spreads.clear()
        _, files, _, other = queries._text_trees(spark, folder)
        assert files.count() == other.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count() and len(spreads) == want
