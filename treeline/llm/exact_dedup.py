"""Exact dedup by composable polynomial fingerprints and chunkwise comparison.

Texts are equal when identical without white space (space, tab, line feed, vertical tab, form feed,
return).  Of equal texts the one with the most code points stays, then the smallest key, null last.

1. Huge texts are cut into segments, which tasks hash in parallel; the hashes of a text's segments are
   combined by length-shifted arithmetic.  Texts of one segment are hashed where they are read.
2. Rows of one fingerprint form a group; its keeper is found with map-side combining.
3. Rows of groups of two or more are compared with their keeper byte by byte, chunk by chunk.  A
   group's rows are dealt to one salt per SALT_ROWS rows, to each of which the keeper's chunks are
   sent, so no task gets a whole large group.
4. Rows that differ from their keeper in spite of equal fingerprints form new groups, until none is
   left.

Null text counts as empty; empty texts are equal to each other.  Rows are grouped and compared by
a number of their own, not by key, so each is judged by its own text.  One row of a group is kept: of
rows that share key and text, any one.  Where a row without a key is the keeper, keep_id is null.  An
empty table gives an empty result.  Only key and text are read, so other columns' names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm import fingerprint as fp
from treeline.llm.common import WHITE, numbered, written

SEGMENT = 1 << 22  # code points hashed at a time
SALT_ROWS = 128


def _plain(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select("row", F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def _hashed(rows: DataFrame, moduli: tuple[int, ...], sha: bool) -> DataFrame:
    """rows (row, ..., text) with length, hashes and, if asked for, the digest of the normalised text
    in place of text."""
    names = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[list] = [[], [], []]
            texts = batch.column("text").cast(pa.binary())
            for k in range(batch.num_rows):
                data = texts[k].as_py().translate(None, WHITE)
                of = fp.of(data, moduli)
                for col, x in zip(made, (of.length, of.hashes, hashlib.sha256(data).hexdigest() if sha else None), strict=True):
                    col.append(x)
            cols = [pa.array(made[0], pa.int64()), pa.array(made[1], pa.list_(pa.int64())), pa.array(made[2], pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *cols], [*names, "length", "hashes", "text_sha256"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(run, f"{kinds}, length bigint, hashes array<bigint>, text_sha256 string")


def fingerprints(plain: DataFrame, moduli: tuple[int, ...] = fp.MODULI, segment: int = SEGMENT) -> DataFrame:
    """Rows (row, key, chars, print, text_sha256) of (row, key, text): print is the fingerprint as
    text, text_sha256 the digest of the normalised text."""
    sized = plain.withColumn("chars", F.length("text"))
    printed = F.concat_ws(".", F.col("length").cast("string"), F.col("hashes").cast("array<string>")).alias("print")
    short = _hashed(sized.filter(F.col("chars") <= segment), moduli, True).select("row", "key", "chars", printed, "text_sha256")
    long = sized.filter(F.col("chars") > segment)
    seg = F.explode(F.sequence(F.lit(0), F.ceil(F.col("chars") / segment).cast("int") - 1)).alias("seg")
    pieces = long.select("row", "text", seg).select("row", "seg", F.substring("text", F.col("seg") * segment + 1, F.lit(segment)).alias("text"))
    hashed = _hashed(pieces.repartition("row", "seg"), moduli, False).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("seg", "length", "hashes"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column("parts").to_pylist():
                whole = fp.Print(0, (0,) * len(moduli))
                for p in parts:
                    whole = whole.then(fp.Print(p["length"], tuple(p["hashes"])), moduli)
                out.append(".".join(map(str, (whole.length, *whole.hashes))))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], ["row", "print"])

    joined = hashed.mapInArrow(run, "row bigint, print string")
    # The digest isn't composable: it is worked out in one go.
    sha = F.sha2(F.regexp_replace("text", r"[\x20\x09-\x0D]", "").cast("binary"), 256).alias("text_sha256")
    return short.unionByName(long.select("row", "key", "chars", sha).join(joined, "row").select(short.columns))


def _groups(rows: DataFrame) -> DataFrame:
    """rows (row, key, chars, print) with keep_row, keep_id (its key) and group_size.

    Only groups of two or more are joined, from a table of their own, so a large one can be split."""
    first = F.min(F.struct(-F.col("chars"), F.col("key").isNull(), F.col("key"), F.col("row")))
    per = rows.groupBy("print").agg(F.count("*").alias("group_size"), first.alias("first")).filter("group_size > 1")
    many = written(per.select("print", "group_size", F.col("first.row").alias("keep_row"), F.col("first.key").alias("first_key")))
    keep_id = F.when(F.col("keep_row").isNull(), F.col("key")).otherwise(F.col("first_key"))
    joined = rows.join(many, "print", "left").withColumn("keep_id", keep_id).drop("first_key")
    return joined.withColumns({"keep_row": F.coalesce("keep_row", "row"), "group_size": F.coalesce("group_size", F.lit(1).cast("bigint"))})


def _compared(plain: DataFrame, pairs: DataFrame, chunk: int) -> DataFrame:
    """pairs (row, keep_row, group_size) with same: whether the texts are equal, chunk by chunk."""
    salts = F.ceil(F.col("group_size") / SALT_ROWS).cast("int")
    keeper = F.col("row") == F.col("keep_row")
    # A keeper goes to every salt of its group, any other row to one.
    dealt = pairs.select(
        "row",
        "keep_row",
        keeper.alias("keeper"),
        F.when(keeper, F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.pmod(F.xxhash64("row"), salts).cast("int"))).alias("salts"),
    )
    placed = plain.join(dealt, "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column("text").cast(pa.binary())
            for k in range(batch.num_rows):
                normal = data[k].as_py().translate(None, WHITE)
                starts = range(0, max(len(normal), 1), chunk)
                one = pa.array([k] * len(starts), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).take(one) for c in ("row", "keep_row", "keeper", "salts")),
                        pa.array(range(len(starts)), pa.int32()),
                        pa.array([len(starts)] * len(starts), pa.int32()),
                        pa.array([normal[s : s + chunk] for s in starts], pa.binary()),
                    ],
                    ["row", "keep_row", "keeper", "salts", "chunk", "chunks", "piece"],
                )

    cut = placed.select("row", "keep_row", "keeper", "salts", "text").mapInArrow(
        run, "row bigint, keep_row bigint, keeper boolean, salts array<int>, chunk int, chunks int, piece binary"
    )
    spread = cut.withColumn("salt", F.explode("salts")).drop("salts")
    one = spread.filter("keeper").select("keep_row", "salt", "chunk", F.col("piece").alias("kept_piece"), F.col("chunks").alias("kept_chunks"))
    other = spread.filter("not keeper")
    same = F.coalesce((F.col("piece") == F.col("kept_piece")) & (F.col("chunks") == F.col("kept_chunks")), F.lit(False))
    return other.join(one, ["keep_row", "salt", "chunk"], "left").groupBy("row", "keep_row").agg(F.min(same).alias("same"))


def judged(df: DataFrame, key: str = "doc_id", text: str = "text", moduli: tuple[int, ...] = fp.MODULI, chunk: int = fp.CHUNK, segment: int = SEGMENT) -> DataFrame:
    """Rows (row, key, keep_id, group_size, kept, text_sha256) of a numbered table."""
    plain = _plain(df, key, text)
    rows = written(fingerprints(plain, moduli, segment))
    grouped = written(_groups(rows))
    todo, round_, odd = grouped, 0, None
    while True:
        pairs = todo.filter("group_size > 1").select("row", "keep_row", "group_size")
        differ = _compared(plain, pairs, chunk).filter("not same").select("row").checkpoint()
        if differ.isEmpty():
            break
        # Equal fingerprints of different texts: these rows look for a keeper among themselves.
        todo = written(_groups(todo.select("row", "key", "chars", "print").join(differ, "row", "left_semi")))
        now = todo.select("row", F.struct("keep_row", "keep_id").alias("own"), F.lit(round_).alias("round"))
        odd = now if odd is None else odd.unionByName(now)
        round_ += 1
    if odd is not None:
        own = odd.groupBy("row").agg(F.max_by("own", "round").alias("own"))
        new = {c: F.when(F.col("own").isNull(), F.col(c)).otherwise(F.col("own")[c]) for c in ("keep_row", "keep_id")}
        moved = grouped.join(own, "row", "left").withColumns(new).drop("own", "group_size")
        grouped = moved.join(moved.groupBy("keep_row").agg(F.count("*").alias("group_size")), "keep_row")
    kept = F.col("row") == F.col("keep_row")
    return grouped.select("row", F.col("key").alias(key), "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def exact_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", moduli: tuple[int, ...] = fp.MODULI, chunk: int = fp.CHUNK, segment: int = SEGMENT) -> DataFrame:
    """Rows (key, keep_id, group_size, kept, text_sha256), one for each row of df."""
    return judged(numbered(df.select(key, text)), key, text, moduli, chunk, segment).drop("row")
