"""Centroid clustering of integer vectors, with n-simplex bounds before exact distances."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.llm.common import stored

#: Pivots of the simplex, at most, and the least height of a pivot above the face of those
#: before it, as a share of the first edge (lower ones would magnify rounding).
PIVOTS, LEAST_HEIGHT = 32, 1e-2
#: Rounds after which pivots are taken anew, from the centroids as they stand then.
KEEP_PIVOTS = 2
#: Bounds on squared distances give way by this share of the squares they are made of,
#: which is above the rounding of apexes, kept in 32 bits.
SLACK = 1e-6
#: Components beyond this would let a squared distance pass 64 bits.
LARGEST = 1 << 27


@dataclass
class Simplex:
    """Pivots and the coordinates of the simplex they span; the first one is its origin.

    A point's distances to the pivots give its apex: the coordinates of its foot on the
    simplex's space, and its height above it.  For two points, the Euclidean distance of
    their apexes is at most their own distance, and with one height turned over at least.
    """

    pivots: np.ndarray  # (m, dims), integers
    edges: np.ndarray  # (m - 1, m - 1), lower triangle: coordinates of the other pivots

    def squares(self, points: np.ndarray) -> np.ndarray:
        """Exact squared distances to the pivots."""
        out = np.empty((len(points), len(self.pivots)), np.int64)
        for i, pivot in enumerate(self.pivots):
            out[:, i] = ((points - pivot) ** 2).sum(axis=1)
        return out

    def apexes(self, squares: np.ndarray) -> np.ndarray:
        """Apex coordinates from squared distances: foot, then height."""
        d = squares.astype(np.float64)
        out = np.zeros(d.shape)
        for i, edge in enumerate(self.edges):
            # |x|^2 - |x - e|^2 + |e|^2 = 2 x.e, and e has coordinates up to i only.
            dot = (d[:, 0] - d[:, i + 1] + (edge**2).sum()) / 2
            out[:, i] = (dot - out[:, :i] @ edge[:i]) / edge[i]
        out[:, -1] = np.sqrt(np.maximum(d[:, 0] - (out[:, :-1] ** 2).sum(axis=1), 0))
        return out


def simplex_of(points: np.ndarray, most: int = PIVOTS) -> Simplex:
    """A simplex of ``points``: the first one, then always the one highest above the others."""
    rest = (points - points[0]).astype(np.float64)
    base, chosen = np.zeros((0, points.shape[1])), [0]
    first = None
    while len(chosen) < min(most, len(points)):
        heights = np.sqrt((rest**2).sum(axis=1))
        top = int(heights.argmax())
        first = heights[top] if first is None else first
        if heights[top] <= LEAST_HEIGHT * first or heights[top] == 0:
            break
        axis = rest[top] / heights[top]
        base = np.vstack([base, axis])
        rest = rest - np.outer(rest @ axis, axis)
        chosen.append(top)
    pivots = points[chosen]
    return Simplex(pivots, np.tril((pivots[1:] - pivots[0]).astype(np.float64) @ base.T))


def nearest(
    points: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, centre_apexes: np.ndarray
) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each point (the first of equal ones), its squared distance, and
    how many distances were computed: those whose lower bound is within the least upper one."""
    foot, height = apexes[:, :-1], apexes[:, -1:]
    c_foot, c_height = centre_apexes[:, :-1], centre_apexes[:, -1]
    size, c_size = (apexes**2).sum(axis=1)[:, None], (centre_apexes**2).sum(axis=1)
    low = size + c_size - 2 * (foot @ c_foot.T)
    cross = 2 * height * c_height
    slack = SLACK * (size + c_size)
    limit = (low + cross + slack).min(axis=1, keepdims=True)
    ask = low - cross - slack <= limit
    cluster = np.full(len(points), -1, np.int32)
    best = np.full(len(points), np.iinfo(np.int64).max)
    for c in range(len(centroids)):
        at = np.flatnonzero(ask[:, c])
        d = ((points[at] - centroids[c]) ** 2).sum(axis=1)
        closer = d < best[at]
        best[at[closer]] = d[closer]
        cluster[at[closer]] = c
    return cluster, best, int(ask.sum())


def integer_vectors(
    vectors: DataFrame, dims: int, id_col: str = "vec_id", vector_col: str = "embedding",
    scale: int = 256,
) -> DataFrame:
    """``(vec_id, ints)`` of the vectors with ``dims`` finite components."""
    x = F.col("x")
    rows = vectors.select(
        vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("x")
    )
    fine = (F.size(x) == dims) & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    )
    whole = F.transform(x, lambda v: F.floor(v * scale))
    inside = F.forall(whole, lambda v: F.abs(v) <= LARGEST)
    told = F.raise_error(F.lit(f"a component is beyond {LARGEST // scale}: distances would not fit 64 bits"))
    return rows.filter(x.isNotNull() & fine).select(
        "vec_id", F.when(inside, whole).otherwise(told.cast("array<bigint>")).cast("array<int>").alias("ints")
    )


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


def _with_apexes(vectors: DataFrame, simplex: Simplex) -> DataFrame:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims, m = simplex.pivots.shape[1], len(simplex.pivots)
        for batch in batches:
            points = _matrix(batch.column("ints"), np.int64, dims)
            apexes = simplex.apexes(simplex.squares(points))
            flat = pa.ListArray.from_arrays(
                np.arange(0, (len(points) + 1) * m, m, np.int32), pa.array(apexes.ravel(), pa.float32())
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("ints"), flat], names=["vec_id", "ints", "apex"]
            )

    return vectors.mapInArrow(add, "vec_id long, ints array<int>, apex array<float>")


def _assigned(batch: pa.RecordBatch, simplex: Simplex, centroids: np.ndarray):
    points = _matrix(batch.column("ints"), np.int64, centroids.shape[1])
    apexes = _matrix(batch.column("apex"), np.float64, len(simplex.pivots))
    of_centres = simplex.apexes(simplex.squares(centroids))
    return points, *nearest(points, apexes, centroids, of_centres)


def _sums(vectors: DataFrame, simplex: Simplex, centroids: np.ndarray) -> DataFrame:
    """``(cluster, place, total, n)``: each task gives one sum per cluster and component."""
    k, dims = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            points, cluster, *_ = _assigned(batch, simplex, centroids)
            order = np.argsort(cluster, kind="stable")
            found, first = np.unique(cluster[order], return_index=True)
            total[found] += np.add.reduceat(points[order], first)
            n += np.bincount(cluster, minlength=k)
        has = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(has, dims).astype(np.int32)),
                pa.array(np.tile(np.arange(dims, dtype=np.int32), len(has))),
                pa.array(total[has].ravel()),
                pa.array(np.repeat(n[has], dims)),
            ],
            names=["cluster", "place", "total", "n"],
        )

    made = vectors.mapInArrow(add, "cluster int, place int, total long, n long")
    # Exact beyond 64 bits, however many vectors there are.
    return made.groupBy("cluster", "place").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")
    )


def _first_centroids(vectors: DataFrame, k: int, seed: int, dims: int) -> np.ndarray:
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.withColumn("drawn", drawn).orderBy(F.asc_nulls_last("drawn"), "ints").limit(k)
    return np.array([r[0] for r in rows.select("ints").collect()], np.int64).reshape(-1, dims)


def cluster_vectors(
    vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64,
    id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256,
) -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, cluster, distance)`` of each vector, and the final centroids.

    Components become integers, ``floor(scale * x)``.  The first centroids are the ``k``
    vectors whose ``seed:vec_id`` has the smallest SHA-256.  Each round gives every vector
    its nearest centroid (squared Euclidean distance, smaller number of equal ones) and
    moves each centroid to the floor of its vectors' mean; one that has none stays.

    Pivots are taken from the centroids.  Distances of all vectors to them become apex
    coordinates, which a stored table keeps for ``KEEP_PIVOTS`` rounds; the bounds from
    these coordinates leave few centroids to a vector, and only those are compared, in
    integers.  Centroids move away from their pivots, hence the new ones.  A round reads
    that table and shuffles one row per task, cluster and component; ``k * dims`` sums
    come to the driver, whatever the size of the table.

    Left out are null vectors, other lengths, and null or infinite components, or not a
    number.  Components beyond ``LARGEST / scale`` raise an error.  Null ids take part, and come last in the
    choice of centroids; repeated rows count each.  With fewer than ``k`` vectors each is
    a centroid; an empty table gives an empty result.  Other columns are not read.
    """
    whole = integer_vectors(vectors, dims, id_col, vector_col, scale)
    centroids = _first_centroids(whole, k, seed, dims)
    if not len(centroids):
        return whole.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    simplex = simplex_of(centroids)
    ready = stored(_with_apexes(whole, simplex), "apexes-0")
    for turn in range(rounds):
        if turn % KEEP_PIVOTS == 1:
            simplex = simplex_of(centroids)
            ready = stored(_with_apexes(ready.select("vec_id", "ints"), simplex), f"apexes-{turn}")
        moved = centroids.copy()
        for r in _sums(ready, simplex, centroids).collect():
            moved[r["cluster"], r["place"]] = int(r["total"]) // r["n"]
        centroids = moved

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, cluster, distance, _ = _assigned(batch, simplex, centroids)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), pa.array(cluster), pa.array(distance)],
                    names=["vec_id", "cluster", "distance"],
                )

    return ready.mapInArrow(assign, "vec_id long, cluster int, distance long"), centroids


def with_inertia(assigned: DataFrame) -> DataFrame:
    """Adds the distances summed up by cluster and in all."""
    rows = stored(assigned, "clusters")
    sums = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    # One row per cluster, as many as there are centroids at most.
    sums = sums.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy(F.lit(0))))
    return rows.join(F.broadcast(sums), "cluster")


def digests(centroids: np.ndarray) -> Column:
    """The SHA-256 of the components of the centroid in column ``cluster``."""
    texts = [F.lit(",".join(map(str, c))) for c in centroids.tolist()]
    return F.sha2(F.element_at(F.array(*texts), F.col("cluster") + 1), 256) if texts else F.lit("")
