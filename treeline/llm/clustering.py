"""Centroid clustering: rounds of nearest centroid and floored mean, all in integers, by Orchard search.

Each component x counts as floor(scale * x).  A search walks a list of all other centroids around the
best one so far, nearest first.  A closer centroid is jumped to at once, and its list begins; whoever
was measured is marked and not measured again.  The list ends strictly beyond twice the current
distance: by the triangle inequality nobody after that is as close.  Of equally close centroids the
smaller number wins, so results are exact whatever the search starts from.

The vectors are a written table of integers, read once a round; a task sends the sums of its own
clusters only, so the driver gets k centroids and nothing else.  Every task makes the k * k lists
anew, so k is meant to stay below some thousands.

Left out: vectors without exactly ``dim`` components, with a null or non-finite one, or with one of
LIMIT or more (squared distances of such integers need not fit a long).  Repeated rows and equal vectors
are vectors of their own; a null id is an id like any other and hashes as empty text.  With fewer
than k vectors there are as many centroids as vectors; an empty table gives an empty result.  A sum
of distances that doesn't fit a long is null.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import written

LIMIT = float(1 << 16)
SEEN = 1 << 23  # marks of a search held at once


def integers(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dim: int = 64, scale: int = 1024) -> DataFrame:
    """Rows (vec_id, point) of the vectors that count."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LIMIT))
    fine = F.coalesce((F.size(embedding) == dim) & fine, F.lit(False))
    point = F.when(fine, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("int")))
    return df.select(F.col(vec_id).alias("vec_id"), point.alias("point")).filter("point is not null")


def lists(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid the others by distance, then number; and their squared distances."""
    k = len(centroids)
    gaps = np.stack([((centroids - c) ** 2).sum(1) for c in centroids])
    gaps[np.arange(k), np.arange(k)] = -1  # itself comes first, and is cut off
    near = np.argsort(gaps, axis=1, kind="stable")[:, 1:]
    return near, np.take_along_axis(gaps, near, 1)


def search(points: np.ndarray, centroids: np.ndarray, near: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance) of each point; all points take their steps together."""
    n, k = len(points), len(centroids)
    axis = int(np.argmax(np.ptp(centroids, axis=0)))
    order = np.argsort(centroids[:, axis], kind="stable")
    best = order[np.minimum(np.searchsorted(centroids[order, axis], points[:, axis]), k - 1)]  # a guess to start from
    dist = ((points - centroids[best]) ** 2).sum(1)
    seen, at, live = np.zeros((n, k), bool), np.zeros(n, "i8"), np.arange(n)
    seen[live, best] = True
    while len(live := live[at[live] < k - 1]):
        live = live[gaps[best[live], at[live]] <= 4 * dist[live]]
        c = near[best[live], at[live]]
        at[live] += 1
        fresh = ~seen[live, c]
        rows, c = live[fresh], c[fresh]
        d = ((points[rows] - centroids[c]) ** 2).sum(1)
        seen[rows, c] = True
        closer = (d < dist[rows]) | ((d == dist[rows]) & (c < best[rows]))
        jump = rows[closer]
        best[jump], dist[jump], at[jump] = c[closer], d[closer], 0
    return best, dist


def _searched(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    near, gaps = lists(centroids)
    step = max(1, SEEN // len(centroids))
    for whole in batches:
        for first in range(0, whole.num_rows, step):
            batch = whole.slice(first, step)
            points = batch.column("point").flatten().to_numpy().astype("i8").reshape(batch.num_rows, -1)
            yield batch, points, *search(points, centroids, near, gaps)


def _moved(points: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round; one without vectors stays."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, "i8"), np.zeros((k, dim), "i8")
        for _, rows, best, _ in _searched(batches, centroids):
            order = np.argsort(best, kind="stable")
            who, first = np.unique(best[order], return_index=True)
            total[who] += np.add.reduceat(rows[order], first, axis=0)
            count += np.bincount(best, minlength=k)
        who = np.flatnonzero(count)
        cols = [pa.array(who), pa.array(count[who]), pa.array(total[who].tolist(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, ["cluster", "n", "total"])

    parts = points.select("point").mapInArrow(run, "cluster bigint, n bigint, total array<bigint>")
    each = parts.select("cluster", "n", F.posexplode("total").alias("axis", "x"))
    moved = centroids.copy()
    for r in each.groupBy("cluster", "axis").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect():
        moved[r.cluster, r.axis] = r.x // r.n
    return moved


def cluster(
    df: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dim: int = 64, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """Rows (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256).  Centroids start as
    the k vectors of smallest sha256 of ``seed:vec_id``."""
    spark = df.sparkSession
    points = written(integers(df, vec_id, embedding, dim, scale))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    centroids = np.array([r.point for r in points.select("point", key.alias("h")).orderBy("h", "point").limit(k).collect()], "i8").reshape(-1, dim)
    if not len(centroids):
        return points.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string"))])
    for _ in range(rounds):
        centroids = _moved(points, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, best, dist in _searched(batches, centroids):
            cols = [batch.column("vec_id"), pa.array(best.astype("i4")), pa.array(dist)]
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "cluster", "distance"])

    kind = points.schema["vec_id"].dataType.simpleString()
    found = written(points.mapInArrow(run, f"vec_id {kind}, cluster int, distance bigint"))
    # At most k rows from here on.
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s"))
    total = sums.agg(F.sum("s").try_cast("bigint").alias("inertia"))
    digests = [(c, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())]
    told = spark.createDataFrame(digests, "cluster int, centroid_sha256 string").join(F.broadcast(sums), "cluster").crossJoin(F.broadcast(total))
    told = told.select("cluster", F.col("s").try_cast("bigint").alias("cluster_inertia"), "inertia", "centroid_sha256")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
