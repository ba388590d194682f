"""Set similarity self-join on word shingles by chosen paths.

Sets are the hashes of a text's runs of SHINGLE words (one shingle of all words where there are
fewer).  Texts with equal sets form one class, whose smallest key represents it.  Classes are joined:

1. In each of several runs a set chooses tokens by a hash shared by all sets; with threshold
   FIRST / size it chooses FIRST on average.  A chosen token is a node; sets that share it meet there.
2. A node of more than BUCKET sets is split: its sets choose again, FURTHER tokens on average, by a
   hash of path and token, level by level.  Similar sets stay together, others part.
3. A node whose sets are alike can't be split.  It is known by its sets' likeness to PIVOTS of them
   (DENSE on average, by sketches) before it is; dense nodes that share a set are united, and each
   union is brute-forced once, instead of each node at each level.
4. Nodes of up to BUCKET sets are brute-forced.  A sketch of 64 minima first drops sets without a
   likely partner outside their union; then the true sets are fetched, and similarity is exact.  What
   is larger (unions; nodes that are large still at the last level) is cut into blocks of BLOCK sets
   and BLOCK_TOKENS tokens on average, and each pair of blocks is a task's group.
5. A pair is counted in the smallest of the nodes that it shares, so counts need no list of pairs;
   links leave a task as one edge per set and node.  Components give the class ids.

The number of runs follows from ``recall``: a pair at the threshold survives a run with probability
at least q, by the recursion q = 1 - exp(-choices * q) over all levels.  That is the worst case: a
pair that meets in a node that isn't split is found at once, and a few runs are enough for it.  So
all sets take part in the first ``base`` runs, which a pair shares no node of with a probability of
exp(-base * FIRST * threshold), a quarter of what recall gives up; sets with a node to be split take
part in all runs.

A union of n sets takes n * n overlaps (products of 0/1 matrices in tasks) and n * n / BLOCK rows.

Null text counts as empty.  A text without words has no shingles: it is a class of its own without
links.  Rows are joined by a number of their own, not by key, so each has its own text's links; null
keys come last where the smallest is chosen.  An empty table gives an empty result.  Only key and
text are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.bpe import slices
from treeline.llm.common import numbered, written
from treeline.llm.components import components

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.99
FIRST, FURTHER, LEVELS = 2.5, 1.4, 5
BUCKET, BLOCK, BLOCK_TOKENS = 256, 2048, 2_000_000
PIVOTS, DENSE = 8, 0.5
PRESELECT = 1 << 20
FEW = 24
SKETCH = 64
MISSED = 1 / 150  # of the pairs that recall gives up, the sketches may cost this part
CACHE_WORDS = 200_000

_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], "u8")
_SEEDS = np.random.default_rng(5).integers(1, 1 << 63, 256, "u8")
_MINIMA = np.random.default_rng(7).integers(1, 1 << 63, SKETCH, "u8")


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


class Shingler:
    def __init__(self, size: int = SHINGLE):
        import xxhash

        self.size, self.hash, self.cache = size, xxhash.xxh3_64_intdigest, {}

    def __call__(self, text: bytes) -> np.ndarray:
        """The sorted set of shingle hashes."""
        words = text.split()
        if not words:
            return np.zeros(0, "u8")
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        got = [*map(self.cache.get, words)]
        if None in got:
            self.cache.update((w, self.hash(w)) for w, g in zip(words, got, strict=True) if g is None)
            got = [*map(self.cache.__getitem__, words)]
        w = np.array(got, "u8")
        n = max(len(w) - self.size + 1, 1)
        out = np.full(n, min(len(w), self.size), "u8")
        for k in range(min(self.size, len(w))):
            out = mix(out * _K[k % 5] + w[k : k + n])
        return np.unique(out)


def _below(size: int, choices: float) -> np.uint64:
    return np.uint64(min(int(choices / size * 2.0**64), 2**64 - 1))


def first_paths(tokens: np.ndarray, runs: range) -> np.ndarray:
    out = [h[h < _below(len(tokens), FIRST)] + _SEEDS[r] for r, h in ((r, mix(tokens ^ _SEEDS[r])) for r in runs)]
    return mix(np.concatenate([*out, np.zeros(0, "u8")]))


def further_paths(path: int, tokens: np.ndarray) -> np.ndarray:
    h = mix(tokens ^ np.uint64(path % (1 << 64)))
    return mix(h[h < _below(len(tokens), FURTHER)] + np.uint64(path % (1 << 64)))


def sketch(tokens: np.ndarray) -> bytes:
    """The lowest byte of each of SKETCH minima."""
    least = np.full(SKETCH, 2**64 - 1, "u8")
    for k in range(0, len(tokens), 4096):
        least = np.minimum(least, mix(tokens[k : k + 4096, None] ^ _MINIMA).min(axis=0))
    return (least & np.uint64(255)).astype("u1").tobytes()


def runs_for(recall: float, threshold: float) -> tuple[int, int]:
    """(base, runs) for a pair at the threshold, the smaller set within the larger (the worst case)."""
    q = 1.0
    for _ in range(LEVELS - 1):
        q = 1 - math.exp(-FURTHER * threshold * q)
    q = 1 - math.exp(-FIRST * threshold * q)
    base = math.ceil(-math.log((1 - recall) / 4) / (FIRST * threshold))
    return base, max(base, math.ceil(math.log(0.75 * (1 - recall)) / math.log(1 - q)))


def likely_for(recall: float, threshold: float) -> int:
    """The number of equal minima that a pair at the threshold has but for a MISSED part of 1 - recall
    (binomial tail)."""
    tail = 0.0
    for k in range(SKETCH):
        tail += math.comb(SKETCH, k) * threshold**k * (1 - threshold) ** (SKETCH - k)
        if tail > MISSED * (1 - recall):
            return k
    return SKETCH


def _signatures(df: DataFrame, size: int, base: int, runs: int) -> DataFrame:
    """paths: nodes of the first base runs; more: those of the others."""
    kind = df.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingles = Shingler(size)
        for whole in batches:
            for batch in slices(whole, "text", 1_000_000):
                digest, n, marks, paths, more = [], [], [], [], []
                for t in batch.column("text").cast(pa.binary()).to_pylist():
                    tokens = shingles(t)
                    digest.append(xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None)
                    n.append(len(tokens))
                    marks.append(sketch(tokens) if len(tokens) else None)
                    paths.append(first_paths(tokens, range(base if len(tokens) else 0)).astype("i8"))
                    more.append(first_paths(tokens, range(base, runs if len(tokens) else base)).astype("i8"))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row"),
                        batch.column("key"),
                        pa.array(digest, pa.binary()),
                        pa.array(n, pa.int32()),
                        pa.array(marks, pa.binary()),
                        *(pa.array(x, pa.list_(pa.int64())) for x in (paths, more)),
                    ],
                    ["row", "key", "digest", "n", "sketch", "paths", "more"],
                )

    return df.mapInArrow(run, f"row bigint, key {kind}, digest binary, n int, sketch binary, paths array<bigint>, more array<bigint>")


def _sets(df: DataFrame, size: int) -> DataFrame:
    """Rows (rep, tokens binary) of (rep, text)."""
    kind = df.schema["rep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(size)
        for whole in batches:
            for batch in slices(whole, "text", 2_000_000):
                tokens = [shingles(t).tobytes() for t in batch.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(tokens, pa.binary())], ["rep", "tokens"])

    return df.select("rep", "text").mapInArrow(run, f"rep {kind}, tokens binary")


def _split(nodes: DataFrame) -> DataFrame:
    """Rows (path, rep) of the next level, from (rep, paths, tokens)."""
    kind = nodes.schema["rep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            tokens = batch.column("tokens")
            for k, paths in enumerate(batch.column("paths").to_pylist()):
                own = np.frombuffer(tokens[k].as_py(), "u8")
                for p in paths:
                    new = further_paths(p, own).astype("i8")
                    out.append(new)
                    rows += [k] * len(new)
            flat = np.concatenate([*out, np.zeros(0, "i8")])
            yield pa.RecordBatch.from_arrays([pa.array(flat), batch.column("rep").take(pa.array(rows, pa.int32()))], ["path", "rep"])

    return nodes.select("rep", "paths", "tokens").mapInArrow(run, f"path bigint, rep {kind}").distinct()


def by_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of rows with equal keys, from batches sorted by them."""
    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_pylist() for k in keys]
        ids = [*zip(*cols, strict=True)]
        start = 0
        for k, i in enumerate(ids):
            if i != last:
                if k > start:
                    rest.append(batch.slice(start, k - start))
                if rest:
                    yield pa.Table.from_batches(rest)
                rest, last, start = [], i, k
        rest.append(batch.slice(start))
    if rest:
        yield pa.Table.from_batches(rest)


def _grouped(df: DataFrame, keys: list[str], work: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_runs(batches, keys):
            out = work(group)
            if out is not None and out.num_rows:
                yield out

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _dense(large: DataFrame, info: DataFrame) -> DataFrame:
    """The paths of those nodes whose sets are, on average, DENSE similar to PIVOTS of them."""
    marked = large.select("path", "rep").join(info.select("rep", "sketch"), "rep").select("path", "rep", "sketch")
    drawn = [F.min(F.struct(F.xxhash64("rep", F.lit(k)).alias("at"), "sketch"))["sketch"] for k in range(PIVOTS)]
    pivots = marked.groupBy("path").agg(F.concat(*drawn).alias("pivots"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mark, pivot = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "u1").reshape(batch.num_rows, -1, SKETCH) for c in ("sketch", "pivots"))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array((mark == pivot).mean(axis=(1, 2)))], ["path", "alike"])

    alike = marked.join(pivots, "path").select("path", "sketch", "pivots").mapInArrow(run, "path bigint, alike double")
    return alike.groupBy("path").agg(F.avg("alike").alias("alike")).filter(F.col("alike") >= DENSE).select("path")


def _united(dense: DataFrame) -> DataFrame:
    """Rows (path, rep) of the unions of nodes that share a set; a union's path is negative."""
    apart = F.col("path").bitwiseOR(F.lit(-(1 << 63)))  # rows' numbers aren't negative
    joined = components(dense.select(apart.alias("u"), F.col("rep").alias("v")))
    return joined.filter("node >= 0").select(F.col("root").alias("path"), F.col("node").alias("rep"))


def _likely(threshold: float, least: int) -> Callable[[pa.Table], pa.RecordBatch | None]:
    """The sets of a small node that have a likely partner, ``least`` equal minima, that isn't in the
    same union (home)."""

    def work(group: pa.Table) -> pa.RecordBatch | None:
        n, home = group["n"].to_numpy(), group["home"].fill_null(0).to_numpy()
        marks = np.frombuffer(b"".join(group["sketch"].to_pylist()), "u1").reshape(len(n), SKETCH)
        equal = (marks[:, None, :] == marks[None, :, :]).sum(axis=2)
        ok = (equal >= least) & (np.minimum.outer(n, n) >= threshold * 0.999 * np.maximum.outer(n, n))
        ok &= (home[:, None] != home) | (home == 0)
        np.fill_diagonal(ok, False)
        rows = np.flatnonzero(ok.any(axis=1))
        kept = group.select(["path", "rep"]).take(pa.array(rows))
        return kept.combine_chunks().to_batches()[0] if len(rows) else None

    return work


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets numbered left with those numbered right.

    Tokens of many sets go through products of 0/1 matrices, those of few by listing their pairs."""
    shape = (len(left), len(right))
    out = np.zeros(shape, "f4")
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = owner[np.argsort(place, kind="stable")]  # token after token
    first = np.cumsum(count) - count
    few = 2 if len(sets) <= 64 else FEW
    many = np.flatnonzero(count >= few)
    width = 4096
    for k in range(0, len(many), width):
        some = many[k : k + width]
        rows = np.concatenate([owner[f : f + c] for f, c in zip(first[some].tolist(), count[some].tolist(), strict=True)])
        m = np.zeros((len(sets), len(some)), "f4")
        m[rows, np.repeat(np.arange(len(some)), count[some])] = 1
        out += m[left] @ m[right].T
    at_left, at_right = np.full(len(sets), -1), np.full(len(sets), -1)
    at_left[left], at_right[right] = np.arange(len(left)), np.arange(len(right))
    for c in range(2, few):
        tokens = first[count == c]
        x, y = np.triu_indices(c, 1)
        step = max(1, 1_000_000 // len(x))
        for k in range(0, len(tokens), step):
            own = owner[tokens[k : k + step, None] + np.arange(c)]
            a, b = own[:, x].ravel(), own[:, y].ravel()
            a, b = at_left[np.concatenate([a, b])], at_right[np.concatenate([b, a])]
            ok = (a >= 0) & (b >= 0)
            out += np.bincount(a[ok] * shape[1] + b[ok], minlength=out.size).reshape(shape)
    return out


def _least(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each of n places the smallest place that the pairs (a, b) connect it with."""
    low = np.arange(n)
    while True:
        before, both = low.copy(), np.minimum(low[a], low[b])
        np.minimum.at(low, low[a], both)
        np.minimum.at(low, low[b], both)
        low = low[low]
        if (low == before).all():
            return low


def _verify(threshold: float) -> Callable[[pa.Table], pa.RecordBatch | None]:
    def work(group: pa.Table) -> pa.RecordBatch | None:
        i, j, path = group["i"][0].as_py(), group["j"][0].as_py(), group["path"][0].as_py()
        group = group.take(np.argsort(group["rep"].to_numpy()))  # the smallest place is the smallest number
        block, copies = group["block"].to_numpy(), group["copies"].to_numpy()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if not len(left) or not len(right):
            return None
        sets = [np.frombuffer(t, "u8") for t in group["tokens"].to_pylist()]
        size = np.array([len(s) for s in sets], "f4")
        both = overlaps(sets, left, right)
        hit = both >= threshold * (size[left][:, None] + size[right] - both) - 1e-3
        if i == j:
            hit = np.triu(hit, 1)
        a, b = np.nonzero(hit)
        if not len(a):
            return None
        # A pair is counted in one of the shared nodes only, the smallest.
        before = [np.array([q for q in nodes if q < path], "i8") for nodes in group["nodes"].to_pylist()]
        hit &= overlaps(before, left, right) < 0.5
        links = np.zeros(len(sets), "i8")
        links[left] += hit @ copies[right]
        links[right] += hit.T @ copies[left]
        a, b = left[a], right[b]
        rows, root = np.unique(np.concatenate([a, b])), _least(len(sets), a, b)
        rep = group["rep"].combine_chunks()
        return pa.RecordBatch.from_arrays([rep.take(pa.array(rows)), pa.array(links[rows]), rep.take(pa.array(root[rows]))], ["rep", "links", "root"])

    return work


def _texts_of(plain: DataFrame, reps: DataFrame) -> DataFrame:
    """Rows (rep, text) of the wanted rows.

    Hash values of their numbers, at most PRESELECT, first drop most other texts at the scan, so that
    few texts are shuffled; with very many rows they drop nothing and the join alone decides."""
    bucket = F.pmod(F.xxhash64("row"), F.lit(PRESELECT)).alias("bucket")
    wanted = reps.select(F.col("rep").alias("row")).distinct()
    near = plain.withColumn("bucket", bucket).join(F.broadcast(wanted.select(bucket).distinct()), "bucket", "left_semi").drop("bucket")
    return near.join(wanted.hint("merge"), "row").select(F.col("row").alias("rep"), "text")


def _distinct_nodes(found: DataFrame) -> DataFrame:
    """Rows of nodes with the same sets: those of the smallest path alone."""
    mark = found.groupBy("path").agg(F.count("*").alias("size"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("a"), F.bit_xor(F.hash("rep", F.lit(1)).cast("bigint")).alias("b"))
    return found.join(mark.groupBy("size", "a", "b").agg(F.min("path").alias("path")).select("path"), "path", "left_semi")


def _sizes(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("path").agg(F.count("*").alias("size")).filter("size > 1")


def judged(
    df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, size: int = SHINGLE, bucket: int = BUCKET, block: int = BLOCK
) -> DataFrame:
    """Rows (row, key, class_id, copy_id, n_links, kept) of a numbered table.  kept: of each
    class one row, whose key is class_id."""
    plain = df.select("row", F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    base, runs = runs_for(recall, threshold)
    signed = written(_signatures(plain, size, base, runs))
    per = signed.filter("digest is not null").groupBy("digest", "n").agg(
        F.min(F.struct(F.col("key").isNull(), "key", "row")).alias("first"),
        F.count("*").alias("copies"),
        *[F.first(c).alias(c) for c in ("sketch", "paths", "more")],
    )
    classes = written(per.withColumns({"rep": F.col("first.row"), "copy_id": F.col("first.key")}).drop("first"))
    info = classes.select("rep", "n", "copies", "sketch")
    leaves, dense = [], []

    def split(nodes: DataFrame) -> DataFrame:
        """Those rows (path, rep) of nodes that are to be split; others go to leaves and dense."""
        sized = written(nodes.join(_sizes(nodes), "path"))
        leaves.append(sized.filter(F.col("size") <= bucket))
        large = sized.filter(F.col("size") > bucket)
        if large.isEmpty():
            return large
        alike = written(_dense(large, info))
        dense.append(large.join(alike, "path", "left_semi"))
        return large.join(alike, "path", "left_anti")

    def nodes_of(sets: DataFrame, paths: str) -> DataFrame:
        return sets.select(F.explode(F.array_distinct(paths)).alias("path"), "rep")

    large = split(nodes_of(classes, "paths"))
    if not large.isEmpty():
        large = large.unionByName(split(nodes_of(classes.join(large.select("rep").distinct(), "rep", "left_semi"), "more")))
        sets = written(_sets(_texts_of(plain, large), size))
        for _ in range(LEVELS - 1):
            held = large.groupBy("rep").agg(F.collect_list("path").alias("paths")).join(sets, "rep")
            large = split(written(_split(held)))
            if large.isEmpty():
                break
    leaves.append(large)
    united = None
    for more in dense:
        united = more if united is None else united.unionByName(more)
    if united is None or united.isEmpty():
        united = large.limit(0).select("path", "rep")
    else:
        united = written(_united(united))
    found = leaves[0]
    for more in leaves[1:]:
        found = found.unionByName(more)
    homes = united.select("rep", F.col("path").alias("home"))
    found = written(_distinct_nodes(found).join(info, "rep").join(homes, "rep", "left"))
    likely = _grouped(
        found.filter(F.col("size") <= bucket).select("path", "rep", "n", "sketch", "home"), ["path"], _likely(threshold, likely_for(recall, threshold)), "path bigint, rep bigint"
    )
    left = written(_distinct_nodes(written(likely.unionByName(found.filter(F.col("size") > bucket).select("path", "rep")).unionByName(united))))
    weighed = left.join(info.select("rep", "n"), "rep").groupBy("path").agg(F.count("*").alias("size"), F.sum("n").alias("tokens")).filter("size > 1")
    blocks = F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("int")
    own = F.pmod(F.xxhash64("rep", "path"), blocks).cast("int")
    inside = left.groupBy("rep").agg(F.collect_list("path").alias("nodes"))
    fetched = written(_sets(_texts_of(plain, inside), size).join(inside, "rep").join(info.select("rep", "copies"), "rep"))
    dealt = (
        left.join(weighed, "path")
        .select("path", "rep", own.alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        .select("path", "rep", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    )
    checked = _grouped(
        dealt.join(fetched, "rep").select("path", "i", "j", "rep", "block", "copies", "nodes", "tokens"),
        ["path", "i", "j"],
        _verify(threshold),
        "rep bigint, links bigint, root bigint",
    )
    verified = written(checked)
    links = verified.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(verified.select(F.col("rep").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("rep"), "root")
    linked = roots.unionByName(roots.select(F.col("root").alias("rep"), "root").distinct()).join(classes.select("rep", "copy_id"), "rep")
    least = linked.groupBy("root").agg(F.min(F.struct(F.col("copy_id").isNull(), "copy_id", "rep")).alias("least"))
    least = linked.select("rep", "root").join(least, "root").select("rep", F.col("least.rep").alias("keep_rep"), F.col("least.copy_id").alias("linked_id"))
    whole = classes.select("digest", "n", "rep", "copy_id", "copies").join(links, "rep", "left").join(least, "rep", "left")
    # Without links a class keeps its own key, and a text without words is a class of its own.
    copy_id = F.when(F.col("rep").isNull(), F.col("key")).otherwise(F.col("copy_id"))
    class_id = F.when(F.col("keep_rep").isNull(), copy_id).otherwise(F.col("linked_id"))
    first = F.col("row") == F.coalesce("keep_rep", "rep", "row")
    return signed.select("row", "key", "digest", "n").join(whole, ["digest", "n"], "left").select(
        "row",
        F.col("key").alias(key),
        class_id.alias("class_id"),
        copy_id.alias("copy_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("bigint").alias("n_links"),
        first.alias("kept"),
    )


def jaccard_join(
    df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, size: int = SHINGLE, bucket: int = BUCKET, block: int = BLOCK
) -> DataFrame:
    """Rows (key, class_id, copy_id, n_links), one per row of df.  class_id: smallest key of all that
    links lead to; copy_id: smallest key with an equal set; n_links: documents at least
    ``threshold`` similar to this one, copies included."""
    return judged(numbered(df.select(key, text)), key, text, threshold, recall, size, bucket, block).drop("row", "kept")
