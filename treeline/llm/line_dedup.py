"""Line dedup by content-defined chunks of lines.

Lines (split at \\n) are hashed, and ROLLS rolling hashes run over windows of two line hashes.  Where the
top bit of one is 0 a chunk of that chunking ends, so a boundary depends on the two lines beside it only
and shifts with them: a passage that two documents share has the same chunks in both but for the first
and the last of each chunking.  Chunks have any number of lines, two on average; several chunkings find
what one has cut into single lines.

A chunk of two lines with a word or more that occurs more than once in all documents, as a chunk, is a
candidate by digest, but for its first occurrence (smallest key, null last, then row, then smallest
position).  Then bytes are compared: every two neighbouring lines with a word (blank lines between them
aside) are looked up by digest, and compared byte by byte with where they occurred first.  A candidate
goes only if all neighbours in it occurred before in these bytes, and with it the lines around it, one by
one, as long as the next two neighbours occurred before: the whole run that holds the chunk leaves
``text``.  A digest that two chunks share by chance thus never removes lines that are new.

A short passage may hold no whole chunk (README: shares found by length).  ``text_without_runs`` needs
none: of it all runs are gone, and of a passage of two lines or more that is repeated as a whole, nothing
is left but its first occurrence.

Occurrences of two neighbours are dealt to one salt per SALT_ROWS of them, with the first sent to each.

Null text stays null and empty text empty: nothing to remove.  Rows are told apart by a number of their
own, so rows that share a key, or have none, are documents of their own; of equal rows one stays whole.
An empty table gives an empty result; other columns pass through, except that those named like an
output are replaced.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeline.llm.bpe import slices
from treeline.llm.common import WHITE, written

SALT_ROWS = 256
ROLLS = 6
_FACTORS = [int.from_bytes(hashlib.blake2b(b"roll %d" % k, digest_size=8).digest(), "little") | 1 for k in range(ROLLS)]
_SPANS = T.ArrayType(T.StructType([T.StructField("first_line", T.IntegerType()), T.StructField("lines", T.IntegerType())]))
_WHITE = WHITE.decode()
OUTPUTS = ["n_lines", "removed_chunks", "removed_lines", "removed_spans", "run_lines", "text_without_runs"]


def _hashes(lines: list[bytes]) -> list[bytes]:
    return [hashlib.blake2b(x, digest_size=8).digest() for x in lines]


def _chunks(digests: list[bytes]) -> list[list[tuple[int, int]]]:
    hashes = np.frombuffer(b"".join(digests), "<u8")
    out = []
    for factor in _FACTORS:
        f = np.uint64(factor)
        rolled = (hashes[:-1] * f + hashes[1:]) * f  # modulo 2^64
        starts = [0, *(np.flatnonzero(rolled < np.uint64(1 << 63)) + 1).tolist(), len(digests)]
        out.append(list(zip(starts, starts[1:])))
    return out


def chunks(lines: list[bytes]) -> list[list[tuple[int, int]]]:
    """(first line, line after the last) of each chunk, for each of the ROLLS chunkings."""
    return _chunks(_hashes(lines))


def _pairs(lines: list[bytes]) -> Iterator[tuple[int, int, bool, bool, bytes]]:
    """(first, last, is chunk, is run, digest): chunks of two lines with a word and more, and neighbours
    in the run of lines with a word.  A chunk that is two neighbours is one row."""
    digests = _hashes(lines)
    worded = [k for k, x in enumerate(lines) if x.strip(WHITE)]
    after = dict(zip(worded, worded[1:]))
    before = np.concatenate(([0], np.cumsum(np.bincount(worded, minlength=len(lines))))).tolist()
    chunk = {(i, j - 1) for one in _chunks(digests) for i, j in one if before[j] - before[i] > 1}
    for k, run in after.items():
        yield k, run, run == k + 1 and (k, run) in chunk, True, digests[k] + digests[run]
    for i, j in sorted(chunk):
        if j > i + 1:
            yield i, j, True, False, hashlib.blake2b(b"".join(digests[i : j + 1]), digest_size=12).digest()


def pair_table(rows: DataFrame) -> DataFrame:
    """Rows (row, first, last, is_chunk, is_run, digest) of (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                at, out = [], []
                for k, t in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                    had = len(out)
                    out += _pairs(t.split(b"\n"))
                    at += [k] * (len(out) - had)
                cols = [*zip(*out)] or [[]] * 5
                kinds = (pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").take(pa.array(at, pa.int32())), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))],
                    ["row", "first", "last", "is_chunk", "is_run", "digest"],
                )

    return rows.select("row", "text").mapInArrow(run, "row bigint, first int, last int, is_chunk boolean, is_run boolean, digest binary")


def _bodies(wanted: DataFrame) -> DataFrame:
    """The wanted pairs (row, text, pairs) one by one, each with the bytes of its lines."""
    pair = "first: int, last: int, digest: binary, salts: array<int>, head: boolean"
    names = [x.split(":")[0] for x in pair.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                pairs = batch.column("pairs")
                flat, counts = pairs.flatten(), pairs.value_lengths().to_pylist()
                first, last, at = flat.field(0).to_pylist(), flat.field(1).to_pylist(), 0
                rows, bodies = [], []
                for k, t in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                    lines = t.split(b"\n")
                    bodies += [lines[first[j]] + b"\n" + lines[last[j]] for j in range(at, at + counts[k])]
                    rows += [k] * counts[k]
                    at += counts[k]
                cols = [batch.column("row").take(pa.array(rows, pa.int32())), *flat.flatten(), pa.array(bodies, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["row", *names, "body"])

    return wanted.select("row", "text", "pairs").mapInArrow(run, "row bigint, " + pair.replace(":", "") + ", body binary")


def repeated(rows: DataFrame, dealt_texts: DataFrame) -> DataFrame:
    """Rows (row, chunks, runs) of (row, key, text), both arrays of (first, last): the chunks whose digest
    occurred before, and the neighbours whose bytes occurred before.  dealt_texts: (row, text) dealt out
    by row."""
    found = written(pair_table(rows))
    order = rows.select("row", F.col("key").isNull().alias("no_key"), "key")
    # Only digests that occur twice need the keys of their rows.  Both sides of the joins by digest are
    # tables, so AQE can split the partition of a digest that is in very many rows.
    twice = written(found.groupBy("digest").agg(F.count_if("is_chunk").alias("n_chunk"), F.count_if("is_run").alias("n_run")).filter("n_chunk > 1 or n_run > 1"))
    hits = written(found.join(twice, "digest").join(order, "row"))
    place = F.struct("no_key", "key", "row", "first")
    heads = written(hits.groupBy("digest").agg(F.min(F.when(F.col("is_chunk"), place)).alias("chunk_at"), F.min(F.when(F.col("is_run"), place)).alias("run_at")))

    def is_head(at: str) -> F.Column:
        return F.coalesce((F.col("row") == F.col(f"{at}.row")) & (F.col("first") == F.col(f"{at}.first")), F.lit(False))

    judged = hits.join(heads, "digest").select(
        "row",
        "first",
        "last",
        "digest",
        (F.col("is_chunk") & ~is_head("chunk_at")).alias("chunk"),
        (F.col("is_run") & (F.col("n_run") > 1)).alias("run"),
        is_head("run_at").alias("head"),
        F.ceil(F.col("n_run") / SALT_ROWS).cast("int").alias("salts"),
    )
    # A first occurrence goes to every salt, any other to one.
    salts = F.when(F.col("head"), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("row", "first"), F.col("salts")).cast("int")))
    # The bytes of a row's pairs and its chunks come from one exchange by row.
    pair = F.when(F.col("run"), F.struct("first", "last", "digest", salts.alias("salts"), "head"))
    span = F.struct("first", "last")
    want = written(judged.filter("chunk or run").groupBy("row").agg(F.collect_list(pair).alias("pairs"), F.collect_set(F.when(F.col("chunk"), span)).alias("chunks")))
    spread = _bodies(dealt_texts.join(want.select("row", "pairs"), "row")).withColumn("salt", F.explode("salts")).drop("salts")
    one = spread.filter("head").select("digest", "salt", F.col("body").alias("first_body"))
    other = spread.filter("not head").select("row", "first", "last", "digest", "salt", "body")
    same = other.join(one, ["digest", "salt"]).filter(F.col("body") == F.col("first_body"))
    runs = same.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("runs"))
    return runs.join(want.select("row", "chunks"), "row")


def _whole_runs(pairs: list[dict]) -> list[tuple[int, int]]:
    """The pairs (first, last; sorted) joined where one ends at the line at which the next begins."""
    out: list[tuple[int, int]] = []
    for p in pairs:
        if out and out[-1][1] == p["first"]:
            out[-1] = out[-1][0], p["last"]
        else:
            out.append((p["first"], p["last"]))
    return out


def _with_chunks(lines: list[str], runs: list[tuple[int, int]], chunks: list[dict]) -> tuple[list[tuple[int, int]], int]:
    """The runs that hold all lines with a word of some chunk, and how many chunks they hold."""
    starts, held, n = [r[0] for r in runs], set(), 0
    for c in chunks:
        first, last = c["first"], c["last"]
        while first < last and not lines[first].strip(_WHITE):
            first += 1
        while last > first and not lines[last].strip(_WHITE):
            last -= 1
        k = bisect_right(starts, first) - 1
        if k >= 0 and last <= runs[k][1]:
            held.add(k)
            n += 1
    return [runs[k] for k in sorted(held)], n


def _without(lines: list[str], spans: list[tuple[int, int]]) -> list[str]:
    """The lines that no span (first, last; sorted, apart) covers."""
    out, at = [], 0
    for first, last in spans:
        out += lines[at:first]
        at = last + 1
    return out + lines[at:]


def line_dedup(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with ``text`` cleaned of repeated chunks and the runs around them, and n_lines, removed_chunks,
    removed_lines, removed_spans (array of (first_line, lines) in the original); text_without_runs, cleaned
    of all repeated runs of two lines and more, and run_lines, the number of its lines that are gone."""
    df = df.drop(*(c for c in OUTPUTS if c not in (key, text)))
    names = [f"c{k}" for k in range(len(df.columns))]  # so that no name can clash
    own = dict(zip(df.columns, names, strict=True))
    held = written(df.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()]).withColumn(own[text], F.col(own[text]).cast("string")).withColumn("row", F.monotonically_increasing_id()))
    rows = held.select("row", F.col(own[key]).alias("key"), F.coalesce(own[text], F.lit("")).alias("text"))
    # Both joins of the texts start from one exchange; it stays one as long as both are inner joins of
    # the same columns, so other columns come by a join of their own.
    dealt = held.select("row", own[text]).repartition("row")
    gone = repeated(rows, dealt.select("row", F.coalesce(own[text], F.lit("")).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, own[text]):
                texts, chunked, paired = (batch.column(c).to_pylist() for c in (own[text], "chunks", "runs"))
                new, without, cols = [], [], [[] for _ in range(5)]
                for t, c, p in zip(texts, chunked, paired, strict=True):
                    lines = t.split("\n") if t is not None else []
                    runs = _whole_runs(p or [])
                    gone_runs, n_chunks = _with_chunks(lines, runs, c or [])
                    kept, rest = _without(lines, gone_runs), _without(lines, runs)
                    new.append("\n".join(kept) if gone_runs else t)
                    without.append("\n".join(rest) if runs else t)
                    spans = [{"first_line": i, "lines": j - i + 1} for i, j in gone_runs]
                    for col, x in zip(cols, (len(lines), n_chunks, len(lines) - len(kept), spans, len(lines) - len(rest)), strict=True):
                        col.append(x)
                spans = pa.array(cols[3], pa.list_(pa.struct([("first_line", pa.int32()), ("lines", pa.int32())])))
                made = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), spans, pa.array(cols[4], pa.int64()), pa.array(without, pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if n == own[text] else batch.column(n) for n in names] + made, [*names, *OUTPUTS])

    kinds = (T.LongType(), T.LongType(), T.LongType(), _SPANS, T.LongType(), T.StringType())
    schema = T.StructType([*(held.schema[n] for n in names), *(T.StructField(c, k) for c, k in zip(OUTPUTS, kinds, strict=True))])
    out = dealt.join(held.drop(own[text]), "row").join(gone, "row", "left").drop("row").mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for c, n in own.items()], *OUTPUTS)
