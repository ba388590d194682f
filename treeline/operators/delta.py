"""Digests, weak rolling checksums, block signatures and block-level deltas.

Signatures and deltas come from contents in rows, or from files of any size by ranges, so that no
file is ever one row.  What can't be read is never taken for unchanged: its row has a null block, and
what is needed of it is a row with null off and len.

A file whose content and whose destination's blocks a task can hold is covered where they meet: the blocks, sorted
before it, are what its windows are looked up in, and after each copy the search goes on behind it.  No match becomes
a row unless it is taken.

The delta of a larger one takes three steps.  Offsets of the source whose weak checksum is among the destination's, by a
bitmap for each path, become rows; joined with the destination's blocks they are matches.  The greedy cover from the
left is found range by range: for each place where a range can be entered the matches that follow lead
to one exit; exits are linked to entries of the next range, and pointer doubling from the first match of a file tells where
each range is entered in fact.  Then each range takes its matches on its own."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from contextlib import ExitStack
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.schema import MIB
from treeline.sinks import stored
from treeline.sources.rooted import Rooted

OFFSET = 31  # added to every byte by the weak checksum
_LOW = 0xFFFF
SIGNED = 20_000  # blocks of a batch of signatures
STRIDE = 16 * MIB  # of a range that is signed or searched, about
FILTER_BITS = 27  # log2 of a bitmap's bits at most; it has 512 for each block below that
MIX = 1_640_531_527  # spreads weak checksums over a bitmap
COVERED = 200_000  # matches whose ranges are covered together, about
RUN_BLOCKS = 4096  # blocks whose runs are found together before runs are joined
ALONE = STRIDE  # of a content that one task covers on its own, at most
KNOWN = 262_144  # blocks of its destination that the task holds beside it, at most
WINDOWS = MIB  # of a content that are searched at a time


def file_digest(content: Column) -> Column:
    return F.sha2(content, 256)


def digest(content: Column, algo: str = "strong") -> Column:
    """strong: 32 bytes; fast: its first 8 bytes; md5.  All as hex."""
    if algo == "strong":
        return F.sha2(content, 256)
    if algo == "fast":
        return F.substring(F.sha2(content, 256), 1, 16)
    if algo == "md5":
        return F.md5(content)
    raise ValueError(f"unknown digest {algo!r}")


def weak_of(pieces: list[bytes]) -> np.ndarray:
    """The weak checksum of each piece: with c[i] = byte + OFFSET, the sum of c[i] in the low half and
    the sum of (n - i) * c[i] in the high half, both modulo 2**16."""
    size = np.fromiter(map(len, pieces), "i8", len(pieces))
    ends = np.cumsum(size)
    c = np.frombuffer(b"".join(pieces), "u1").astype("i8") + OFFSET
    left = np.repeat(ends, size) - np.arange(len(c))  # n - i
    a, b = np.zeros(len(pieces), "i8"), np.zeros(len(pieces), "i8")
    some = size > 0
    if some.any():
        a[some] = np.add.reduceat(c, (ends - size)[some])
        b[some] = np.add.reduceat(left * c, (ends - size)[some])
    return (a & _LOW) + ((b & _LOW) << 16)


def weak_checksum(content: Column) -> Column:
    """weak_of as a column, a batch at a time; null where content is."""

    @F.pandas_udf("bigint")
    def weak(values: pd.Series) -> pd.Series:
        known = values.notna()
        out = pd.Series(pd.NA, values.index, "Int64")
        out[known] = weak_of([bytes(v) for v in values[known]])
        return out

    return weak(content)


def rolling(data: bytes, block: int) -> np.ndarray:
    """The weak checksum of every window of ``block`` bytes, from prefix sums."""
    n = len(data) - block + 1
    if n <= 0:
        return np.zeros(0, "i8")
    c = np.frombuffer(data, "u1").astype("i8") + OFFSET
    s = np.r_[0, np.cumsum(c)]
    t = np.r_[0, np.cumsum(np.arange(len(c), dtype="i8") * c)]
    a = s[block:] - s[:-block]
    # sum of (block - (i - start)) * c[i] over the window
    b = (block + np.arange(n)) * a - (t[block:] - t[:-block])
    return (a & _LOW) + ((b & _LOW) << 16)


def rolling_checksums(content: DataFrame, block: int, path: str = "path") -> DataFrame:
    """Rows (path, off, weak): all windows of each content; off and weak null where content is."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for p, data in zip(part["path"], part["content"], strict=True):
                if data is None:
                    yield pd.DataFrame({"path": [p], "off": pd.array([None], "Int64"), "weak": pd.array([None], "Int64")})
                    continue
                weak = rolling(bytes(data), block)
                for k in range(0, len(weak), 100_000):
                    some = weak[k : k + 100_000]
                    yield pd.DataFrame({"path": p, "off": np.arange(k, k + len(some)), "weak": some})

    return content.select(F.col(path).alias("path"), "content").mapInPandas(run, "path string, off bigint, weak bigint")


def block_contents(content: DataFrame, block: int) -> DataFrame:
    """Rows (path, block, off, len, content) of (path, content): aligned blocks, the last one short."""
    n = F.length("content")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(block))).otherwise(F.array().cast("array<int>"))
    # Cut before they become rows, so that no row has the whole content beside its piece.
    pieces = F.transform(starts, lambda at: F.substring(F.col("content"), at + 1, F.lit(block)))
    each = content.select("path", F.posexplode(pieces).alias("block", "content"))
    return each.select("path", F.col("block").cast("bigint"), (F.col("block").cast("bigint") * block).alias("off"), F.length("content").cast("bigint").alias("len"), "content")


_SIGNATURES = "path string, block bigint, off bigint, len bigint, weak bigint, strong string"
_NAMES = [f.split()[0] for f in _SIGNATURES.split(", ")]


def _unsigned(path: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([path, *(pa.nulls(1, pa.int64()) for _ in range(4)), pa.nulls(1, pa.string())], _NAMES)


def block_signatures(content: DataFrame, block: int) -> DataFrame:
    """Rows (path, block, off, len, weak, strong) of (path, content); null content gives a row with a null block."""

    def signed(batch: pa.RecordBatch, row: list[int], number: list[int], pieces: list[bytes]) -> pa.RecordBatch:
        size, k = np.fromiter(map(len, pieces), "i8", len(pieces)), np.array(number, "i8")
        strong = pa.array([hashlib.sha256(x).hexdigest() for x in pieces], pa.string())
        cols = [pa.array(k), pa.array(k * block), pa.array(size), pa.array(weak_of(pieces)), strong]
        return pa.RecordBatch.from_arrays([batch.column("path").take(pa.array(row, pa.int32())), *cols], _NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, number, pieces = [], [], []
            for k in range(batch.num_rows):
                data = batch.column("content")[k].as_py()
                if data is None:
                    yield _unsigned(batch.column("path").slice(k, 1))
                    continue
                for first in range(0, len(data), block * SIGNED):
                    own = [data[o : o + block] for o in range(first, min(first + block * SIGNED, len(data)), block)]
                    row += [k] * len(own)
                    number += range(first // block, first // block + len(own))
                    pieces += own
                    if len(pieces) >= SIGNED:
                        yield signed(batch, row, number, pieces)
                        row, number, pieces = [], [], []
            if pieces:
                yield signed(batch, row, number, pieces)

    return content.select("path", "content").mapInArrow(run, _SIGNATURES)


def _dealt(files: DataFrame, stride: int) -> DataFrame:
    """Ranges (path, off, len, size) of all files that aren't empty, dealt to tasks; those of a file that lie near each
    other are neighbours in one task."""
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(stride).cast("bigint"))
    ranges = files.filter("size > 0").select("path", F.explode(starts).alias("off"), "size")
    ranges = ranges.select("path", "off", F.least(F.lit(stride).cast("bigint"), F.col("size") - F.col("off")).alias("len"), "size")
    return ranges.repartition(F.xxhash64("path", F.floor(F.col("off") / max(stride, STRIDE)))).sortWithinPartitions("path", "off")


class _Open:
    """The file of the range before stays open while the next one is of it too."""

    def __init__(self, base: Rooted):
        self.base, self.path, self.stack = base, None, ExitStack()

    def at(self, path: str) -> int:
        if path != self.path:
            self.close()
            self.fd = self.stack.enter_context(self.base.reading(path))
            self.path = path
        return self.fd

    def close(self) -> None:
        self.path = None
        self.stack.close()


def file_signatures(files: DataFrame, root: str, block: int, stride: int = STRIDE) -> DataFrame:
    """block_signatures of files (path, size) below root, of any size: ranges cut at multiples of block are read and signed
    in pieces.  A range that can't be read, or ends before its size says, gives a row with a null block."""
    base, step = Rooted(root), max(1, stride // block) * block

    def ranges(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[bytes]]]:
        """(row, first block, pieces) of at most SIGNED blocks; no pieces where a range can't be read."""
        file = _Open(base)
        for k, (path, off, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("path", "off", "len")), strict=True)):
            try:
                for at in range(off, off + n, block * SIGNED):
                    data = _read(file.at(path), at, min(block * SIGNED, off + n - at))
                    yield k, at // block, [data[o : o + block] for o in range(0, len(data), block)]
            except (OSError, ValueError):
                file.close()
                yield k, 0, []
        file.close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, number, pieces = [], [], []
            for k, first, own in chain(ranges(batch), [(None, 0, [])]):
                if k is not None and not own:
                    yield _unsigned(batch.column("path").slice(k, 1))
                row += [k] * len(own)
                number += range(first, first + len(own))
                pieces += own
                if pieces and (k is None or len(pieces) >= SIGNED):
                    size, at = np.fromiter(map(len, pieces), "i8", len(pieces)), np.array(number, "i8")
                    strong = pa.array([hashlib.sha256(x).hexdigest() for x in pieces], pa.string())
                    cols = [pa.array(at), pa.array(at * block), pa.array(size), pa.array(weak_of(pieces)), strong]
                    yield pa.RecordBatch.from_arrays([batch.column("path").take(pa.array(row, pa.int32())), *cols], _NAMES)
                    row, number, pieces = [], [], []

    return _dealt(files, step).select("path", "off", "len").mapInArrow(run, _SIGNATURES)


def _read(fd: int, off: int, size: int) -> bytes:
    """size bytes from off on; fewer raise an error."""
    parts, done = [], 0
    while done < size:
        if not (data := os.pread(fd, size - done, off + done)):
            raise OSError("ends early")
        parts.append(data)
        done += len(data)
    return b"".join(parts)


def need_ranges(sig_src: DataFrame, sig_dst: DataFrame) -> DataFrame:
    """Rows (path, off, len): runs of source blocks that differ from, or lack, the destination's.  Where part of the
    source wasn't read, a row with null off and len too.

    Runs are found among RUN_BLOCKS blocks at a time; then neighbouring runs are joined."""
    old = sig_dst.filter("block is not null").select("path", "block", F.unhex("strong").alias("old"))
    # Spark takes signatures for as small as the names they are made of and would send all of them through the driver to
    # every executor, so the join is told to sort and merge.
    new = sig_src.select("path", "block", "off", "len", F.unhex("strong").alias("new"))
    # Rows without a block meet no other and come out as one run a path, without off and len.
    need = new.join(old.hint("merge"), ["path", "block"], "left").filter(F.col("old").isNull() | (F.col("old") != F.col("new")))
    # Neighbouring blocks have the same difference between number and rank.
    near = need.withColumn("part", F.floor(F.col("block") / RUN_BLOCKS))
    rank = F.row_number().over(Window.partitionBy("path", "part").orderBy("block"))
    runs = near.withColumn("run", F.col("block") - rank).groupBy("path", "part", "run").agg(F.min("off").alias("off"), F.sum("len").alias("len"))
    before = Window.partitionBy("path").orderBy("off")
    end = F.lag(F.col("off") + F.col("len")).over(before)
    whole = runs.withColumn("new", F.when(end == F.col("off"), 0).otherwise(1)).withColumn("n", F.sum("new").over(before))
    return whole.groupBy("path", "n").agg(F.min("off").alias("off"), F.sum("len").alias("len")).select("path", "off", "len")


def weak_filter(sig_dst: DataFrame, block: int) -> DataFrame:
    """Rows (path, bits, words): a bitmap of 2 ** bits of the weak checksums of a path's whole blocks, as its words
    (number, 64 bits) that aren't zero."""
    full = sig_dst.filter(F.col("len") == block).select("path", "weak").distinct()
    bits = F.least(F.greatest(F.ceil(F.log2(F.count("*") * 512)).cast("int"), F.lit(10)), F.lit(FILTER_BITS))
    sized = full.join(full.groupBy("path").agg(bits.alias("bits")), "path")
    # The highest ``bits`` of 32 mixed bits.
    place = F.floor((F.col("weak") * MIX).bitwiseAND(F.lit(0xFFFFFFFF)) / F.pow(F.lit(2.0), F.lit(32) - F.col("bits"))).cast("bigint")
    each = sized.withColumn("place", place).groupBy("path", "bits", F.shiftright("place", 6).alias("number"))
    words = each.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("place") % 64).cast("int"))).alias("word"))
    return words.groupBy("path", "bits").agg(F.collect_list(F.struct("number", "word")).alias("words"))


def _hits(data: bytes, keep: int, block: int, bits: int, number: np.ndarray, word: np.ndarray) -> Iterator[tuple[int, int, str]]:
    """(place, weak, strong) of the first ``keep`` windows that pass the bitmap."""
    weak = rolling(data, block)[:keep]
    table = np.zeros(1 << bits >> 6, "u8")
    table[number] = word.astype("i8").view("u8")
    place = (weak * MIX & 0xFFFFFFFF) >> (32 - bits)
    last, strong = -2, ""
    for k in np.flatnonzero(table[place >> 6] >> (place & 63).astype("u8") & np.uint64(1)).tolist():
        if last != k - 1 or data[k : k + block] != data[last : last + block]:  # else a run of one byte
            strong = hashlib.sha256(data[k : k + block]).hexdigest()
        last = k
        yield k, int(weak[k]), strong


_HITS = "path string, off bigint, weak bigint, strong string"


_KINDS = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}


def _row_batches(found: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    names, kinds = zip(*(f.split() for f in schema.split(", ")), strict=True)
    while rows := list(islice(found, 50_000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, _KINDS[t]) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))


def _words(value: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    return tuple(value.values.field(k).to_numpy() for k in (0, 1))


def rolling_hits(content: DataFrame, sig_dst: DataFrame, block: int) -> DataFrame:
    """Rows (path, off, weak, strong): the windows of (path, content) whose weak checksum may be one of the
    destination's blocks of that path (all that are, and a few more)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, str]]:
        for batch in batches:
            for k, (path, bits) in enumerate(zip(batch.column("path").to_pylist(), batch.column("bits").to_pylist(), strict=True)):
                data = batch.column("content")[k].as_py()
                for hit in _hits(data, len(data), block, bits, *_words(batch.column("words")[k])):
                    yield path, *hit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _row_batches(found(batches), _HITS)

    known = content.select("path", "content").filter("content is not null").join(weak_filter(sig_dst, block), "path")
    return known.select("path", "content", "bits", "words").mapInArrow(run, _HITS)


def file_hits(files: DataFrame, root: str, sig_dst: DataFrame, block: int, stride: int = STRIDE) -> DataFrame:
    """rolling_hits of files (path, size) below root, of any size: ranges that overlap by a window less one byte.  A
    range that can't be read, or ends early, gives a row with a null off."""
    base = Rooted(root)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int | None, int | None, str | None]]:
        file = _Open(base)
        for batch in batches:
            for k, (path, off, n, size, bits) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("path", "off", "len", "size", "bits")), strict=True)):
                try:
                    data = _read(file.at(path), off, min(n + block - 1, size - off))
                except (OSError, ValueError):
                    file.close()
                    yield path, None, None, None
                    continue
                if bits is not None:
                    for at, weak, strong in _hits(data, n, block, bits, *_words(batch.column("words")[k])):
                        yield path, off + at, weak, strong
        file.close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _row_batches(found(batches), _HITS)

    known = _dealt(files, stride).join(weak_filter(sig_dst, block), "path", "left")
    return known.select("path", "off", "len", "size", "bits", "words").mapInArrow(run, _HITS)


class _Ranges:
    """Matches of many ranges (path, part), sorted by path, part and off: for each match the next one of its range that
    doesn't overlap it (its own number where there is none), and the first match of each range."""

    def __init__(self, table: pa.Table, block: int, stride: int):
        self.part, self.offs = table["part"].to_numpy(), table["off"].to_numpy()
        path = table["path"].combine_chunks().dictionary_encode().indices.to_numpy()
        self.head = np.r_[True, (path[1:] != path[:-1]) | (self.part[1:] != self.part[:-1])]
        self.first, self.group = np.flatnonzero(self.head), np.cumsum(self.head) - 1
        self.inside = self.offs - self.part * stride
        line = self.group * (stride + block) + self.inside  # ranges one behind the other, none reaches the next
        after = np.searchsorted(line, line + block)
        near = np.minimum(after, len(line) - 1)
        self.next = np.where((after < len(line)) & (self.group[near] == self.group), after, np.arange(len(line)))


def _by_range(df: DataFrame, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """work over whole ranges, many at a time; df has path, part and off."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in chain(batches, [None]):
            if batch is not None:
                if not batch.num_rows:
                    continue
                held.append(batch)
                rows += batch.num_rows
                if rows < COVERED or all(held[0][c][0] == batch[c][-1] for c in ("path", "part")):
                    continue
            if not rows:
                continue
            table, held, rows = pa.Table.from_batches(held), [], 0
            if batch is not None:  # the last range may go on in the next batch
                part, path = table["part"].to_numpy(), table["path"].combine_chunks().dictionary_encode().indices.to_numpy()
                other = np.flatnonzero((path != path[-1]) | (part != part[-1]))
                cut = int(other[-1]) + 1 if len(other) else 0
                rest = table.slice(cut)
                held, rows, table = rest.to_batches(), rest.num_rows, table.slice(0, cut)
            if table.num_rows:
                yield from work(table).select(names).combine_chunks().to_batches()

    return df.repartition("path", "part").sortWithinPartitions("path", "part", "off").mapInArrow(run, schema)


def cover(matches: DataFrame, sizes: DataFrame, block: int, stride: int = STRIDE) -> DataFrame:
    """Rows (path, off, len, dst_off): each file of sizes (path, size) as matches (path, off, dst_off) of ``block`` bytes, taken
    greedily from the left, and literals (dst_off null) between them.

    A task holds the matches of one range of a file."""
    stride = max(stride, block)
    matches = stored(matches.withColumn("part", F.floor(F.col("off") / stride)))

    def entered(table: pa.Table) -> pa.Table:
        r = _Ranges(table, block, stride)
        jump = r.next
        while ((far := jump[jump]) != jump).any():
            jump = far
        # All that an exit of the range before can lead to.
        way = np.flatnonzero(r.head | np.r_[False, r.inside[:-1] < block])
        known = table.select(["path", "part"]).take(pa.array(way))
        return known.append_column("entry", pa.array(r.offs[way])).append_column("exit", pa.array(r.offs[jump[way]] + block))

    entries = stored(_by_range(matches, entered, "path string, part bigint, entry bigint, exit bigint"))
    # At most block + 1 entries a range, and a row a range.
    ranges = entries.groupBy("path", "part").agg(F.sort_array(F.collect_list("entry")).alias("ways"))
    onward = Window.partitionBy("path").orderBy("part")
    ranges = ranges.select("path", "part", *[F.lead(F.struct("part", "ways"), k).over(onward).alias(f"next{k}") for k in (1, 2)], F.row_number().over(onward).alias("n"))
    ranges = stored(ranges.select("path", "part", "next1", F.struct(F.col("next2.part").alias("part"), F.col("next2.ways")[0].alias("entry")).alias("next2"), "n"))
    landing = F.get(F.filter("next1.ways", lambda x: x >= F.col("exit")), F.lit(0))
    led = entries.join(ranges, ["path", "part"]).withColumn("landing", landing)
    to = F.when(F.col("landing").isNotNull(), F.struct(F.col("next1.part").alias("part"), F.col("landing").alias("entry"))).when(F.col("next2.entry").isNotNull(), F.col("next2"))
    jump = stored(led.withColumn("to", to).filter("to is not null").select("path", "entry", F.col("to.entry").alias("to")))
    reached = stored(entries.join(ranges.filter("n = 1").select("path", "part"), ["path", "part"]).groupBy("path").agg(F.min("entry").alias("entry")))
    while not jump.isEmpty():  # as often as log2 of the ranges of the longest file
        reached = stored(reached.unionByName(reached.join(jump, ["path", "entry"]).select("path", F.col("to").alias("entry"))).distinct())
        jump = stored(jump.join(jump.select("path", F.col("entry").alias("to"), F.col("to").alias("far")), ["path", "to"]).select("path", "entry", F.col("far").alias("to")))

    used = entries.join(reached, ["path", "entry"]).withColumn("done", F.coalesce(F.lag("exit").over(onward), F.lit(0)))
    used = stored(used.select("path", "part", "entry", "exit", "done"))

    def taken(table: pa.Table) -> pa.Table:
        r = _Ranges(table, block, stride)
        entry, done = table["entry"].to_numpy()[r.first], table["done"].to_numpy()[r.first]
        at = np.searchsorted(r.group * (stride + block) + r.inside, np.arange(len(r.first)) * (stride + block) + entry - r.part[r.first] * stride)
        picked, before = [], []
        while len(at):  # a match of each range at a time
            picked.append(at)
            before.append(done)
            on = r.next[at] != at
            done, at = r.offs[at[on]] + block, r.next[at[on]]
        k, done = np.concatenate(picked), np.concatenate(before)
        gap = r.offs[k] > done
        row, lit = np.r_[k, k[gap]], np.r_[np.zeros(len(k), bool), np.ones(int(gap.sum()), bool)]
        off, size = np.r_[r.offs[k], done[gap]], np.r_[np.full(len(k), block), (r.offs[k] - done)[gap]]
        old = pa.array(table["dst_off"].to_numpy()[row], mask=lit)
        return pa.table({"path": table["path"].take(pa.array(row)), "off": off, "len": size, "dst_off": old})

    chosen = _by_range(matches.join(used, ["path", "part"]), taken, "path string, off bigint, len bigint, dst_off bigint")
    ends = used.groupBy("path").agg(F.max("exit").alias("done"))
    rest = sizes.join(ends, "path", "left").select("path", F.coalesce("done", F.lit(0)).cast("bigint").alias("off"), "size").filter("size > off")
    return chosen.unionByName(rest.select("path", "off", (F.col("size") - F.col("off")).alias("len"), F.lit(None).cast("bigint").alias("dst_off")))


def _greedy(data: bytes, block: int, weak: np.ndarray, place: dict[bytes, int], windows: int) -> Iterator[tuple[int, int, int | None]]:
    """(off, len, dst_off) of a whole content: copies of the blocks that have these weak checksums and, by digest, these places,
    taken greedily from the left, and literals (dst_off None) between them; ``windows`` are searched at a time."""
    at = done = 0
    weak = np.unique(weak)
    shift = 32 - max(10, (len(weak) * 32).bit_length())
    seen = np.zeros(1 << 32 - shift, bool)
    seen[(weak * MIX & 0xFFFFFFFF) >> shift] = True
    while place and at <= len(data) - block:
        found = rolling(data[at : at + windows + block - 1], block)
        near = np.flatnonzero(seen[(found * MIX & 0xFFFFFFFF) >> shift])
        near = near[weak[np.minimum(np.searchsorted(weak, found[near]), len(weak) - 1)] == found[near]]
        for k in (near + at).tolist():
            if k < done or (old := place.get(hashlib.sha256(data[k : k + block]).digest())) is None:
                continue
            if k > done:
                yield done, k - done, None
            yield k, block, old
            done = k + block
        at = max(at + windows, done)
    if done < len(data):
        yield done, len(data) - done, None


_ALONE = "path string, off bigint, len bigint, dst_off bigint, ranged boolean"


def _alone(asked: DataFrame, root: str | None, sig_dst: DataFrame, block: int) -> DataFrame:
    """Rows (path, off, len, dst_off, ranged): the deltas of asked (path, size, content), each made by one task, which reads content from
    the file below root, if there is one.  What can't be read has one row with null off; what has more than KNOWN blocks at
    the destination has one too, with ranged, and goes by ranges."""
    base = None if root is None else Rooted(root)

    def content(path: str, size: int) -> bytes:
        with base.reading(path) as fd:
            return _read(fd, 0, size)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, list[int], list[bytes | None]]]:
        """(path, weak checksums, places, digests) of known blocks, which may come in several, then (path, none, sizes, contents)."""
        for batch in batches:
            if not batch.num_rows:
                continue
            path = batch.column("path").dictionary_encode()
            number = path.indices.to_numpy()
            known = batch.column("weak").is_valid().to_numpy(zero_copy_only=False)
            weak = batch.column("weak").fill_null(0).to_numpy()
            at, data = batch.column("at").to_pylist(), batch.column("data").to_pylist()
            cuts = np.flatnonzero((number[1:] != number[:-1]) | (known[1:] != known[:-1])) + 1
            for b, e in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                yield path.dictionary[number[b]].as_py(), weak[b:e] if known[b] else weak[:0], at[b:e], data[b:e]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int | None, int | None, int | None, bool]]:
        of, n, weak, place = None, 0, [], {}
        for path, checksums, at, data in groups(batches):
            if path != of:
                of, n, weak, place = path, 0, [], {}
            if len(checksums):
                n += len(checksums)
                weak = [*weak, checksums] if n <= KNOWN else []
                # The first of equal blocks is the first to come.
                place = dict(zip(data[::-1], at[::-1], strict=True)) | place if n <= KNOWN else {}
                continue
            for size, have in zip(at, data, strict=True):
                if n > KNOWN:
                    yield path, None, None, None, True
                    continue
                try:
                    have = have if base is None else content(path, size)
                except (OSError, ValueError):
                    yield path, None, None, None, False
                    continue
                for row in _greedy(have, block, np.concatenate([checksums, *weak]), place, WINDOWS):
                    yield path, *row, False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _row_batches(found(batches), _ALONE)

    none = F.lit(None).cast("bigint")
    known = sig_dst.filter(F.col("len") == block).select("path", "weak", F.col("off").alias("at"), F.unhex("strong").alias("data"))
    both = known.unionByName(asked.select("path", none.alias("weak"), F.col("size").alias("at"), F.col("content").alias("data")))
    return both.repartition("path").sortWithinPartitions("path", F.col("weak").isNull(), "at").mapInArrow(run, _ALONE)


def _delta(asked: DataFrame, root: str | None, sig_dst: DataFrame, block: int, ranged: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """The deltas of asked (path, size, content): by ``_alone`` where a task can hold both sides, by ``ranged`` (paths, their
    signatures) else."""
    told = stored(_alone(asked.filter((F.col("size") > 0) & (F.col("size") <= ALONE)), root, sig_dst, block))
    large = asked.filter(F.col("size") > ALONE).select("path").unionByName(told.filter("ranged").select("path"))
    told = told.filter("not ranged").drop("ranged")
    if large.isEmpty():
        return told
    large = stored(large)
    return told.unionByName(ranged(large, stored(sig_dst.join(large, "path", "left_semi"))))


def _matched(hits: DataFrame, sig_dst: DataFrame, block: int) -> DataFrame:
    """Hits that are blocks of the destination, with the first place of each."""
    strong = F.unhex("strong").alias("strong")
    first = sig_dst.filter(F.col("len") == block).groupBy("path", "weak", strong).agg(F.min("off").alias("dst_off"))
    return hits.select("path", "off", "weak", strong).join(first, ["path", "weak", "strong"]).select("path", "off", "dst_off")


def matched_windows(content: DataFrame, sig_dst: DataFrame, block: int) -> DataFrame:
    """Rows (path, off, dst_off): all windows of (path, content) that are blocks of the destination."""
    sig_dst = stored(sig_dst)  # read twice
    return _matched(rolling_hits(content, sig_dst, block), sig_dst, block)


def _untold(paths: DataFrame) -> DataFrame:
    none = F.lit(None).cast("bigint")
    return paths.select("path", none.alias("off"), none.alias("len"), none.alias("dst_off"))


def delta_match(src: DataFrame, sig_dst: DataFrame, block: int, stride: int = STRIDE) -> DataFrame:
    """Rows (path, off, len, dst_off): the source content (path, content) as copies of destination blocks (dst_off
    their place, the first of equal ones) and literals (dst_off null), in order and without overlap, copies taken
    greedily from the left.  An empty content has no row; null content has one with null off."""

    def ranged(paths: DataFrame, sig: DataFrame) -> DataFrame:
        own = src.join(paths, "path", "left_semi")
        sizes = own.select("path", F.length("content").cast("bigint").alias("size"))
        return cover(matched_windows(own, sig, block), sizes, block, stride)

    asked = src.select("path", F.length("content").cast("bigint").alias("size"), "content")
    return _delta(asked, None, sig_dst, block, ranged).unionByName(_untold(src.filter("content is null").select("path")))


def file_delta(files: DataFrame, root: str, sig_dst: DataFrame, block: int, stride: int = STRIDE) -> DataFrame:
    """delta_match of files (path, size) below root, of any size.  A file of which part couldn't be read has one row
    with null off alone."""

    def ranged(paths: DataFrame, sig: DataFrame) -> DataFrame:
        own = files.join(paths, "path", "left_semi")
        hits = stored(file_hits(own, root, sig, block, stride))
        bad = hits.filter("off is null").select("path").distinct()
        # Dropped from what is covered: there are far more hits.
        made = cover(_matched(hits.filter("off is not null"), sig, block), own.select("path", "size"), block, stride)
        return made.join(bad, "path", "left_anti").unionByName(_untold(bad))

    return _delta(files.select("path", "size", F.lit(None).cast("binary").alias("content")), root, sig_dst, block, ranged)
