"""Centroid clustering of integer vectors, with distances filtered in rotated coordinates.

Vectors are rotated to their principal axes. The leading coordinates and the norm of the rest are
stored with each vector; centroids are rotated alike. The distance in the leading coordinates
plus the squared difference of the two norms is a lower bound of the whole distance. Each round
computes these bounds for all centroids, the whole distance in integers to the centroid of least
bound, and whole distances to those others whose bound does not exceed it. Rotation and bounds only decide what
is left out, with a margin for rounding; every distance that counts is an integer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowwarden.llm.base import query, received, shipped, table
from rowwarden.session import config_frame, stored

CENTROIDS = 40
ROUNDS = 5
COMPONENTS = 64
SCALE = 256
SEED = 2
LEADING_SHARE = 0.9  # of the variance in the leading coordinates
GREATEST = 1 << 27  # absolute component below which squared distances fit a long: 64 * (2 * 2**27)**2 = 2**62
MARGIN = 1e-9  # of the squared norms, against rounding of the bounds
CHUNK = 2048  # vectors whose distances are computed at once


def _scaled(components: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, components)
            whole = np.isfinite(values).all(axis=1)
            floored = np.floor(values[whole] * scale)
            if len(floored) and np.abs(floored).max() >= GREATEST:
                raise OverflowError(f"a scaled component reaches {GREATEST}: squared distances would not fit a long")
            ints = np.ascontiguousarray(floored.astype("<i8"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").filter(pa.array(whole)), pa.array([row.tobytes() for row in ints], pa.binary())], ["vec_id", "v"])
    return run


def integer_vectors(embeddings: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the vectors with exactly ``components`` components, none null or non-finite, as
    little-endian 64-bit integers floor(scale * x)."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    kept = rows.filter((F.size("embedding") == components) & ~F.exists("embedding", lambda x: x.isNull()))
    return kept.mapInArrow(_scaled(components, scale), "vec_id long, v binary")


def _moments(components: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((components + 1, components))
        for batch in batches:
            x = _matrix(batch, components).astype(np.float64)
            total[:-1] += x.T @ x
            total[-1] += x.sum(0)
        line, place = np.divmod(np.arange(total.size), components)
        yield pa.RecordBatch.from_arrays([pa.array(line), pa.array(place), pa.array(total.ravel())], ["line", "place", "total"])
    return run


def _matrix(batch: pa.RecordBatch, components: int, column: str = "v", kind: str = "<i8") -> np.ndarray:
    """The vectors of a batch, one per row."""
    cells = batch.column(column)
    return np.frombuffer(b"".join(cells.to_pylist()), kind).reshape(len(cells), -1 if len(cells) else components)


def rotation(vectors: DataFrame, n: int, components: int = COMPONENTS, share: float = LEADING_SHARE) -> tuple[np.ndarray, int]:
    """Principal axes of all ``n`` vectors, greatest variance first, and how many hold ``share`` of it.

    Each task sends one sum per pair of components."""
    sums = vectors.mapInArrow(_moments(components), "line long, place long, total double").groupBy("line", "place").agg(
        F.sum("total").alias("total"))
    total = np.zeros((components + 1, components))
    for row in sums.collect():  # one row per pair of components
        total[row["line"], row["place"]] = row["total"]
    mean = total[-1] / n
    variance, axes = np.linalg.eigh(total[:-1] / n - np.outer(mean, mean))
    variance, axes = np.maximum(variance[::-1], 0), axes[:, ::-1]
    if not variance.sum():
        return axes, 1
    return axes, 1 + int(np.searchsorted(np.cumsum(variance) / variance.sum(), share))


def rotated(x: np.ndarray, axes: np.ndarray, leading: int) -> np.ndarray:
    """The leading coordinates of each row, then the norm of the others."""
    y = x.astype(np.float64) @ axes
    return np.column_stack([y[:, :leading], np.sqrt((y[:, leading:] ** 2).sum(1))])


def _rotated(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes, leading = received(model)
        for batch in batches:
            found = rotated(_matrix(batch, len(axes)), axes, leading)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([row.tobytes() for row in found], pa.binary())], ["vec_id", "v", "r"])
    return run


def nearest(x: np.ndarray, r: np.ndarray, centroids: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row of ``x`` (ties: the smaller number), its squared distance, and how
    many whole distances were computed. ``r`` and ``turned`` are the rotated vectors and centroids."""
    cluster, distance, computed = np.empty(len(x), np.int64), np.empty(len(x), np.int64), 0
    size_c = (turned ** 2).sum(1)
    for a in range(0, len(x), CHUNK):
        part, low = x[a:a + CHUNK], r[a:a + CHUNK]
        size = (low ** 2).sum(1)
        # the norm of the rest is one more coordinate, so that its squared difference joins the sum
        bound = size[:, None] + size_c - 2 * (low @ turned.T)
        slack = MARGIN * (size[:, None] + size_c) + 1e-3
        guess = bound.argmin(1)
        best = ((part - centroids[guess]) ** 2).sum(1)
        row, column = np.nonzero(bound - slack <= best[:, None])
        exact = ((part[row] - centroids[column]) ** 2).sum(1)
        computed += len(row) + len(part)
        # pairs come by row and then by centroid, so the first of the least is the smaller number
        first = np.searchsorted(row, np.arange(len(part)))
        least = np.minimum.reduceat(exact, first)
        hits = np.flatnonzero(exact == least[row])
        place = hits[np.searchsorted(row[hits], np.arange(len(part)))]
        cluster[a:a + CHUNK], distance[a:a + CHUNK] = column[place], least
    return cluster, distance, computed


def _assigned(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, turned = received(model)
        for batch in batches:
            if batch.num_rows:
                cluster, distance, _ = nearest(
                    _matrix(batch, centroids.shape[1]), _matrix(batch, 0, "r", "<f8"), centroids, turned)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])
    return run


def _summed(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, turned = received(model)
        sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch, centroids.shape[1])
            cluster, _, _ = nearest(x, _matrix(batch, 0, "r", "<f8"), centroids, turned)
            order = np.argsort(cluster, kind="stable")
            some, first = np.unique(cluster[order], return_index=True)
            sums[some] += np.add.reduceat(x[order], first, axis=0)
            counts += np.bincount(cluster, minlength=len(counts))
        some = np.flatnonzero(counts)
        total = np.column_stack([sums, counts])[some]  # the count comes behind the components
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(some, total.shape[1])), pa.array(np.tile(np.arange(total.shape[1]), len(some))), pa.array(total.ravel())],
            ["cluster", "place", "total"])
    return run


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the least SHA-256 of their seeded id, in that order.

    Rows without an id come last; equal ids are ordered by their components' bytes."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(key.alias("key"), "v").orderBy(F.asc_nulls_last("key"), "v").limit(k).collect()
    return np.array([np.frombuffer(row["v"], "<i8") for row in rows], np.int64)


def moved(centroids: np.ndarray, rows: Sequence) -> np.ndarray:
    """Centroids after a round: floored means of exact sums (cluster, place, total), the count in the last place."""
    count = {row["cluster"]: int(row["total"]) for row in rows if row["place"] == centroids.shape[1]}
    out = centroids.copy()
    for row in rows:
        if row["place"] < centroids.shape[1]:
            out[row["cluster"], row["place"]] = int(row["total"]) // count[row["cluster"]]
    return out


def cluster(embeddings: DataFrame, *, k: int = CENTROIDS, rounds: int = ROUNDS, components: int = COMPONENTS,
            scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector of
    ``embeddings`` (vec_id, embedding).

    Vectors that are null, have another number of components, or a null or non-finite one, are left
    out. With fewer than ``k`` vectors each is a centroid; with none there are no rows. Repeated rows
    count as often as they occur; rows without an id are clustered like others, as centroids after
    those with one. Other columns are not read. Scaled components of 2**27 or more raise, since
    squared distances would not fit a long.

    Integers and rotated coordinates are written once and read in every round. A task sends one row per
    centroid and component; centroids and their hashes are the only things the driver holds."""
    spark = embeddings.sparkSession
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    vectors = stored(integer_vectors(embeddings, components, scale), "vectors")
    n = vectors.count()
    centroids = first_centroids(vectors, k, seed)
    if not n:
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).join(
            config_frame(spark, [], schema), "cluster").select("vec_id", "cluster", "distance", *T.StructType.fromDDL(schema).names[1:])
    axes, leading = rotation(vectors, n, components)
    turned = stored(vectors.mapInArrow(_rotated(shipped(spark, (axes, leading))), "vec_id long, v binary, r binary"), "rotated")
    model = lambda: shipped(spark, (centroids, rotated(centroids, axes, leading)))
    for _ in range(rounds):
        sums = turned.mapInArrow(_summed(model()), "cluster long, place long, total long").groupBy("cluster", "place").agg(
            F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        centroids = moved(centroids, sums.collect())  # one row per centroid and component
    found = stored(turned.mapInArrow(_assigned(model()), "vec_id long, cluster int, distance long"), "assigned")
    inertia = {row["cluster"]: row["s"] for row in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    facts = [(c, s, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
             for c, s in inertia.items()]
    return found.join(F.broadcast(config_frame(spark, facts, schema)), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """The rounds as a chain of common table expressions."""
    steps = [f"""
kept AS MATERIALIZED (
  SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {COMPONENTS}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS cluster, v AS c FROM kept
  ORDER BY cluster LIMIT {CENTROIDS})"""]
    for n in range(ROUNDS + 1):
        steps.append(f"""
a{n} AS MATERIALIZED (
  SELECT uid, min((d, cluster)) AS best FROM (
    SELECT uid, cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, c{n})
  GROUP BY uid)""")
        if n < ROUNDS:
            steps.append(f"""
c{n + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(moved, c) AS c FROM c{n} LEFT JOIN (
    SELECT cluster, list((s - ((s % m) + m) % m) // m ORDER BY i)::BIGINT[] AS moved FROM (
      SELECT best[2] AS cluster, i, sum(v[i])::BIGINT AS s, count(*) AS m FROM kept JOIN a{n} USING (uid), range(1, {COMPONENTS + 1}) AS t(i)
      GROUP BY ALL)
    GROUP BY cluster) USING (cluster))""")
    return f"""WITH {",".join(steps)},
f AS (SELECT vec_id, best[2]::INTEGER AS cluster, best[1]::BIGINT AS distance FROM kept JOIN a{ROUNDS} USING (uid))
SELECT vec_id, f.cluster, distance, (sum(distance) OVER (PARTITION BY f.cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM f JOIN c{ROUNDS} AS c ON c.cluster = f.cluster"""


@query("op13_centroids", _oracle())
def op13(spark, sf_dir):
    return cluster(table(spark, sf_dir, "embeddings"))
