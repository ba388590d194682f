"""Embedding near-dedup: collisions of one-dimensional projections, counted for each pair.

Vectors of one label and length are compared by cosine.  Each is scaled to length one and projected
on PROJECTIONS random directions.  Every projection is sorted, and around each query's own place a
window of fixed half width is cut out of the order; who lies inside collides with the query.  A pair
that collides often enough is verified by its cosine in double precision, so no link is below the
threshold.  Half width and count follow from ``recall``: two unit vectors at the threshold are
sqrt(2 - 2 * threshold) apart, a Gaussian projection of that gap lies within the half width with a
known probability, so the count of collisions is binomial.  The largest count that such a pair still
reaches with probability ``recall`` is asked for (closer pairs reach it more often), and of all half
widths that which fewest orthogonal pairs pass with.

Groups are cut into blocks of at most BLOCK rows, and each two blocks meet in one task, whatever the
size of a label.  Within a task windows are differences of prefix bit sets of the sorted order, and
counts are added bit by bit, 64 pairs a word.  A task gives a row for each linked vector, with its number
of links and the root of its tree of links, never the pairs, so a group of n near copies is n rows.
Equal vectors of a label are one vector with a number of copies; copies are not compared.  The time
grows with the square of a label's distinct vectors, at about a nanosecond a pair.

Vectors that are null, empty, zero or hold a null or non-finite component, and those without a label,
link with nothing; each is a component of its own.  Rows are told apart by a number of their own, so
rows that share an id, or have none, count as vectors of their own; component_id is the least id that
isn't null.  An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import numbered, written
from treeline.llm.components import components

THRESHOLD = 0.93
PROJECTIONS = 31
RECALL = 0.995
BLOCK, SMALL_BLOCK = 16_384, 2048
BLOCK_NUMBERS = 1 << 23  # components of a block at most
TILE = 1024
SEED = 12


def calibrated(threshold: float = THRESHOLD, projections: int = PROJECTIONS, recall: float = RECALL) -> tuple[float, int]:
    """(half width of a window, collisions asked for)."""

    def reaches(p: float, least: int) -> float:
        return sum(comb(projections, j) * p**j * (1 - p) ** (projections - j) for j in range(least, projections + 1))

    gap = sqrt(max(2 - 2 * threshold, 1e-12))
    best = (2.0, 0.0, 0)
    for step in range(1, 61):
        half = gap * step / 20
        least = max((c for c in range(projections + 1) if reaches(erf(half / gap / sqrt(2)), c) >= recall), default=0)
        best = min(best, (reaches(erf(half / 2), least), half, least))
    return best[1], best[2]


def collisions(queries: np.ndarray, others: np.ndarray, half: float) -> np.ndarray:
    """How many projections (columns) each query's window and each other row share."""
    n, words = len(others), -(-len(others) // 64)
    planes = [np.zeros((len(queries), words), "u8") for _ in range(queries.shape[1].bit_length())]
    for i in range(queries.shape[1]):
        order = np.argsort(others[:, i], kind="stable")
        prefix = np.zeros((n + 1, words), "u8")  # row j: the set of the first j in order
        prefix[np.arange(1, n + 1), order >> 6] = np.left_shift(np.uint64(1), (order & 63).astype("u8"))
        np.bitwise_or.accumulate(prefix, axis=0, out=prefix)
        ranked = others[order, i]
        carry = prefix[np.searchsorted(ranked, queries[:, i] + half, "right")] ^ prefix[np.searchsorted(ranked, queries[:, i] - half, "left")]
        for plane in planes:
            over = plane & carry
            plane ^= carry
            carry = over
    count = np.zeros((len(queries), n), "u1")
    for k, plane in enumerate(planes):
        count += np.unpackbits(plane.view("u1"), axis=1, count=n, bitorder="little") << k
    return count


def unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """root (each node's root, the smallest of its tree) after all links i - j."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        root = root.copy()
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (upper := root[root]).tobytes() != root.tobytes():
            root = upper
    return root


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # else squares may leave the range of doubles
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def links(x: np.ndarray, cut: int, copies: np.ndarray, threshold: float, half: float, least: int, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of the rows of x, between x[:cut] and x[cut:], or within x where cut is 0.  A link
    counts for as many as the other row has copies."""
    unit, n = _unit(x), len(x)
    seen = unit @ directions
    count, root = np.zeros(n, "i8"), np.arange(n)
    for a in range(0, cut or n, TILE):
        a_end = min(a + TILE, cut or n)
        for b in range(cut or a, n, TILE):
            b_end = min(b + TILE, n)
            often = collisions(seen[a:a_end], seen[b:b_end], half) >= least
            if b < a_end:
                often = np.triu(often, 1)  # the tile itself: each pair once
            i, j = np.nonzero(often)
            if len(i) > often.size // 50:
                cosine = (unit[a:a_end] @ unit[b:b_end].T)[i, j]
            else:
                cosine = np.einsum("ij,ij->i", unit[a + i], unit[b + j])
            i, j = a + i[cosine >= threshold], b + j[cosine >= threshold]
            count += np.bincount(i, copies[j], n).astype("i8") + np.bincount(j, copies[i], n).astype("i8")
            root = unite(root, i, j)
    return count, root


def _block_links(reps: DataFrame, threshold: float, projections: int, recall: float, seed: int) -> DataFrame:
    """Rows (rep, n, root) of all tasks of reps (rep, label, embedding, copies)."""
    half, least = calibrated(threshold, projections, recall)
    key = ["label", "dim"]
    reps = reps.withColumn("dim", F.size("embedding"))
    rows = F.least(F.greatest(F.ceil(F.col("n") / 4), F.lit(SMALL_BLOCK)), F.lit(BLOCK), F.greatest(F.floor(F.lit(BLOCK_NUMBERS) / F.col("dim")), F.lit(1)))
    sizes = reps.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").select(*key, F.ceil(F.col("n") / rows).cast("int").alias("blocks"))
    placed = reps.join(sizes, key).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("met", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(*key, F.least("block", "met").alias("lo"), F.greatest("block", "met").alias("hi"), "block", "rep", "copies", "embedding")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("rep", "ascending")])
        block, lo, hi = (table.column(c).to_numpy() for c in ("block", "lo", "hi"))
        order = np.argsort(block, kind="stable") if len(block) and lo[0] != hi[0] else np.arange(len(block))
        cut = int((block == lo[0]).sum()) if lo[0] != hi[0] else 0
        if lo[0] != hi[0] and cut in (0, len(block)):
            order = order[:0]  # one of the blocks has no rows
        rep, copies = (table.column(c).to_numpy()[order] for c in ("rep", "copies"))
        if not len(rep):
            return pa.table({"rep": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        x = table.column("embedding").combine_chunks().flatten().to_numpy().astype("f8").reshape(len(block), -1)[order]
        directions = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], projections))
        n, root = links(x, cut, copies, threshold, half, least, directions)
        has = n > 0
        return pa.table({"rep": rep[has], "n": n[has], "root": rep[root[has]]})

    return dealt.groupBy(*key, "lo", "hi").applyInArrow(run, "rep bigint, n bigint, root bigint")


def near_dedup(
    df: DataFrame, threshold: float = THRESHOLD, projections: int = PROJECTIONS, recall: float = RECALL, seed: int = SEED,
    vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of df."""
    rows = numbered(df.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"), F.col(label).alias("label")))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    usable_rows = rows.filter(usable)
    reps = written(usable_rows.groupBy("label", "embedding").agg(F.min("row").alias("rep"), F.min("vec_id").alias("least"), F.count("*").alias("copies")))
    found = written(_block_links(reps.select("rep", "label", "embedding", "copies"), threshold, projections, recall, seed))
    roots = written(components(found.select(F.col("rep").alias("u"), F.col("root").alias("v"))))
    count = found.groupBy("rep").agg(F.sum("n").alias("n"))
    tied = reps.join(count, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    tied = tied.select("label", "embedding", "least", F.coalesce("root", "rep").alias("root"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    lowest = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    known = tied.join(lowest, "root").select("label", "embedding", "n_links", "component_id")
    linked = usable_rows.select("row", "vec_id", "label", "embedding").join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~usable).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
