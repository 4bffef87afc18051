"""Centroid clustering by rounds over partition-local ball trees.

Vectors are turned into whole numbers, so that every sum and distance is exact and the result is the same in any
cut of the table. Each task builds metric trees of up to TREE of its vectors, which are written once: a ball has
its count, its exact sum and its radius. A round goes down each tree with the centroids; those that the triangle
inequality rules out for a ball are not looked at below it, and a ball with one left is assigned whole, by its
count and sum. Only leaves that stay open are compared exactly, vector by vector. A task hands on one sum for each
centroid, so a round shuffles and sends to the driver a few numbers whatever the size of the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthframe.llm.common import small_batches, table
from hearthframe.staging import stage, tidy

#: Vectors of a tree and of a leaf at most; a leaf has more if all of them are equal.
TREE, LEAF = 4096, 32
#: What components are multiplied with before they are cut down to whole numbers, and how large these may be.
SCALE, LARGEST = 1024, 1 << 27
#: Numbers up to which squares of 64 components are whole in doubles.
EXACT = 1 << 22
#: Centroids, rounds, components, and what stands before a vec_id in the hash that picks the first centroids.
K, ROUNDS, DIMS, SALT = 8, 10, 64, "3:"
_TREE = "ids array<long>, vectors binary, low binary, high binary, left binary, right binary, radius binary, sums binary"


def grown(x: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """An order of the rows of x, and the balls over them: low and high (places in that order), left and right (balls, -1
    for a leaf), radius, and sums."""
    order, low, high, left, right, radius, sums = np.arange(len(x)), [0], [len(x)], [], [], [], []
    at = 0
    while at < len(low):
        lo, hi = low[at], high[at]
        own = x[order[lo:hi]]
        total = own.sum(axis=0)
        away = ((own - total / len(own)) ** 2).sum(axis=1)
        sums.append(total)
        radius.append(np.sqrt(away.max()) * (1 + 1e-9) + 1e-6)
        left.append(-1)
        right.append(-1)
        if hi - lo > LEAF:
            a = own[int(away.argmax())]
            from_a = ((own - a) ** 2).sum(axis=1)
            b = own[int(from_a.argmax())]
            near = from_a <= ((own - b) ** 2).sum(axis=1)
            if not near.all():
                order[lo:hi] = np.concatenate((order[lo:hi][near], order[lo:hi][~near]))
                cut = lo + int(near.sum())
                left[at], right[at] = len(low), len(low) + 1
                low += [lo, cut]
                high += [cut, hi]
        at += 1
    of = dict(low=np.array(low, np.int32), high=np.array(high, np.int32), left=np.array(left, np.int32), right=np.array(right, np.int32))
    return order, of | {"radius": np.array(radius), "sums": np.array(sums, np.int64)}


def labels(x: np.ndarray, balls: dict[str, np.ndarray], centroids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray]:
    """The nearest centroid of each row of x (rows in the order of the balls), the smaller number on ties.

    Also the balls that were assigned whole, with their centroid, and which rows were compared one by one.
    """
    own = np.unique(centroids, axis=0, return_index=True)[1]
    own.sort()  # of equal centroids the first wins every tie
    c = centroids[own]
    of, open_rows, whole = np.zeros(len(x), np.int32), np.zeros(len(x), bool), []
    at, alive = np.zeros(1, np.int64), np.ones((1, len(c)), bool)
    while len(at):
        middle = balls["sums"][at] / (balls["high"][at] - balls["low"][at])[:, None]
        far = np.sqrt(((middle[:, None, :] - c[None]) ** 2).sum(axis=2))
        far[~alive] = np.inf
        least, r = far.min(axis=1), balls["radius"][at]
        # a centroid farther from the middle than the nearest one by twice the radius is no vector's nearest
        alive = far <= (least + 2 * r + 1e-6 * (1 + least + r))[:, None]
        one = alive.sum(axis=1) == 1
        for k in np.flatnonzero(one):
            label = int(own[alive[k].argmax()])
            of[balls["low"][at[k]] : balls["high"][at[k]]] = label
            whole.append((int(at[k]), label))
        leaf = ~one & (balls["left"][at] < 0)
        for k in np.flatnonzero(leaf):
            open_rows[balls["low"][at[k]] : balls["high"][at[k]]] = True
        deeper = ~one & ~leaf
        at, alive = np.concatenate((balls["left"][at[deeper]], balls["right"][at[deeper]])), np.concatenate((alive[deeper], alive[deeper]))
    if open_rows.any():
        rows = x[open_rows]
        kind = np.float64 if max(np.abs(rows).max(), np.abs(c).max()) <= EXACT else np.int64
        apart = (c.astype(kind) ** 2).sum(axis=1) - 2 * (rows.astype(kind) @ c.astype(kind).T)
        of[open_rows] = own[apart.argmin(axis=1)]
    return of, whole, open_rows


def _opened(b: pa.RecordBatch, k: int, dims: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    raw = lambda c, kind: np.frombuffer(b.column(c)[k].as_py(), kind)
    balls = {c: raw(c, np.int32) for c in ("low", "high", "left", "right")} | {"radius": raw("radius", np.float64), "sums": raw("sums", np.int64).reshape(-1, dims)}
    return raw("vectors", np.int32).reshape(-1, dims).astype(np.int64), balls


def kept(vectors: DataFrame, dims: int = DIMS) -> DataFrame:
    """vectors (vec_id, embedding) -> those with exactly dims components, none of them null, NaN or infinite."""
    whole = F.coalesce((F.size("embedding") == dims) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where(whole)


def _whole(values: np.ndarray) -> np.ndarray:
    out = np.floor(SCALE * values)
    if len(out) and np.abs(out).max() > LARGEST:
        raise ValueError(f"components beyond {LARGEST // SCALE} can't be clustered exactly")
    return out.astype(np.int64)


def trees(vectors: DataFrame, dims: int = DIMS) -> DataFrame:
    """kept() vectors -> their written ball trees, rows of _TREE; each vector is in one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, values, held = [], [], 0

        def made() -> pa.RecordBatch:
            x = _whole(np.concatenate(values)).reshape(-1, dims)
            order, balls = grown(x)
            own = pa.concat_arrays(ids).take(pa.array(order))
            cells = [x[order].astype(np.int32).tobytes(), *(balls[n].tobytes() for n in ("low", "high", "left", "right", "radius", "sums"))]
            lists = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
            return pa.RecordBatch.from_arrays([lists, *(pa.array([c], pa.binary()) for c in cells)], [n.split()[0] for n in _TREE.split(", ")])

        for b in batches:
            for lo in range(0, b.num_rows, TREE):
                part = b.slice(lo, TREE)
                while part.num_rows:
                    take = part.slice(0, TREE - held)
                    ids.append(take.column(0))
                    values.append(take.column(1).flatten().to_numpy(zero_copy_only=False))
                    held, part = held + take.num_rows, part.slice(take.num_rows)
                    if held == TREE:
                        yield made()
                        ids, values, held = [], [], 0
        if held:
            yield made()

    return stage(small_batches(vectors).mapInArrow(run, _TREE), "trees")


def first_centroids(vectors: DataFrame, k: int = K, salt: str = SALT) -> np.ndarray:
    """The kept() vectors with the k smallest hashes of their vec_ids, in that order; equal vec_ids go by components, null ones come last."""
    name = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.select(name.alias("name"), "embedding").orderBy(F.asc_nulls_last("name"), "embedding").limit(k).collect()
    return _whole(np.array([r.embedding for r in rows], np.float64).reshape(len(rows), -1 if rows else 0))


def moved(built: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floor of the mean of each one's vectors; those without any stay."""
    sent, (k, dims) = built.sparkSession.sparkContext.broadcast(centroids), centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for b in batches:
            for j in range(b.num_rows):
                x, balls = _opened(b, j, dims)
                of, whole, single = labels(x, balls, sent.value)
                for ball, label in whole:
                    sums[label] += balls["sums"][ball]
                    counts[label] += balls["high"][ball] - balls["low"][ball]
                for label in np.unique(of[single]):
                    rows = x[single & (of == label)]
                    sums[label] += rows.sum(axis=0)
                    counts[label] += len(rows)
        c, d = np.nonzero(np.broadcast_to(counts[:, None] > 0, (k, dims + 1)))
        cells = np.concatenate((sums, counts[:, None]), axis=1)[c, d]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(d.astype(np.int32)), pa.array(cells)], ["cluster", "at", "total"])

    parts = built.mapInArrow(run, "cluster int, at int, total long")
    cells = parts.groupBy("cluster", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    total = {(r.cluster, r.at): int(r.total) for r in cells}
    out = centroids.copy()
    for j in range(k):
        if n := total.get((j, dims), 0):
            out[j] = [total[j, d] // n for d in range(dims)]
    return out


def assigned(built: DataFrame, centroids: np.ndarray) -> DataFrame:
    """trees() -> (vec_id, cluster, distance) of each vector: its nearest centroid and the squared distance to it."""
    sent, dims = built.sparkSession.sparkContext.broadcast(centroids), centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for j in range(b.num_rows):
                x, balls = _opened(b, j, dims)
                of = labels(x, balls, sent.value)[0]
                apart = ((x - sent.value[of]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("ids")[j].values, pa.array(of), pa.array(apart)], ["vec_id", "cluster", "distance"])

    return built.mapInArrow(run, "vec_id long, cluster int, distance long")


@tidy
def clustered(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS) -> DataFrame:
    """vectors (vec_id, embedding) -> (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row for each kept() one.

    Components become floor(SCALE * component); one beyond LARGEST / SCALE is an error, as its distances would not be
    exact. Null vectors, and those of another length or with a null, NaN or infinite component, are left out.
    Equal distances go to the smaller cluster; repeated rows are vectors of their own; a null vec_id is clustered, and
    picked as a first centroid only after all others; fewer vectors than k give as many centroids; an empty table
    gives an empty one. Other columns are ignored. The rounds run when this is called.
    """
    spark, held = vectors.sparkSession, kept(vectors, dims)
    centroids = first_centroids(held, k)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    built = trees(held, dims)
    for _ in range(rounds):
        after = moved(built, centroids)
        if (after == centroids).all():  # and so would be all later ones
            break
        centroids = after
    found = stage(assigned(built, centroids), "assigned")
    far = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    names = {j: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for j, c in enumerate(centroids)}
    each = spark.createDataFrame([(j, n, sum(far.values()), names[j]) for j, n in far.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12(spark, sf_dir: str) -> DataFrame:
    """All vectors of embeddings in K clusters after ROUNDS rounds; nulls, ties and odd vectors as in clustered()."""
    return clustered(table(spark, sf_dir, "embeddings"))


def _round_sql(r: int) -> str:
    return f"""
a{r} AS MATERIALIZED (SELECT vec_id, arg_min(cluster, (distance, cluster)) AS cluster, CAST(min(distance) AS BIGINT) AS distance FROM (SELECT vec_id, cluster, sum((x - c) * (x - c)) AS distance FROM flat JOIN c{r} USING (d) GROUP BY vec_id, cluster) GROUP BY vec_id),
s{r} AS (SELECT cluster, d, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{r} JOIN flat USING (vec_id) GROUP BY cluster, d),
c{r + 1} AS MATERIALIZED (SELECT o.cluster, o.d, coalesce((s - ((s % n) + n) % n) // n, o.c) AS c FROM c{r} o LEFT JOIN s{r} USING (cluster, d)),"""


OP12_SQL = f"""
WITH kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = {DIMS}),
flat AS MATERIALIZED (SELECT vec_id, unnest(e) AS x, unnest(range({DIMS})) AS d FROM kept),
first AS (SELECT CAST(row_number() OVER (ORDER BY sha256('{SALT}' || vec_id)) - 1 AS INTEGER) AS cluster, e FROM kept),
c0 AS MATERIALIZED (SELECT cluster, unnest(e) AS c, unnest(range({DIMS})) AS d FROM first WHERE cluster < {K}),
{"".join(map(_round_sql, range(ROUNDS)))}
last AS MATERIALIZED (SELECT vec_id, arg_min(cluster, (distance, cluster)) AS cluster, CAST(min(distance) AS BIGINT) AS distance FROM (SELECT vec_id, cluster, sum((x - c) * (x - c)) AS distance FROM flat JOIN c{ROUNDS} USING (d) GROUP BY vec_id, cluster) GROUP BY vec_id),
names AS (SELECT cluster, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY cluster)
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM last JOIN names USING (cluster)
"""
