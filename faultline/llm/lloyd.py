"""Centroid clustering: Lloyd's rounds on integer vectors whose dimensions are dealt over column shards.

Rows are cut into blocks and each block's columns into slices of ``WIDTH`` dimensions; a (block, shard) slice is the unit of
work. In a round, every slice's task computes exact partial squared distances against its shard's centroid slices; partials
of a block meet by its key, are added up and give each row's nearest centroid; labels travel back to the slices, which stay
where they are, and each shard divides its own sums to get its new centroid slices. All arithmetic is on integers.

Only centroids (``clusters`` x dimensions numbers) reach the driver. A row costs ``clusters`` numbers for each shard and
round on the way to its sum, so a slice should be wider than the number of clusters.
"""
from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from faultline.llm import common
from faultline.session import cut_lineage

CLUSTERS, ROUNDS, SEED, SCALE, DIMENSIONS = 8, 10, 3, 1024, 64
WIDTH = 32                             # dimensions of a shard
BLOCK = 8192                           # rows of a block at most
SAFE = 1 << 26                         # components beyond it are counted in Python integers
TOP = (1 << 63) - 1


def packed(a: np.ndarray) -> tuple[str, bytes]:
    """An integer matrix in the narrowest type that holds it exactly."""
    if a.dtype == object:
        return "json", json.dumps(a.tolist()).encode()
    low, high = (int(a.min()), int(a.max())) if a.size else (0, 0)
    kind = next(k for k in ("<i2", "<i4", "<i8") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return kind, a.astype(kind).tobytes()


def unpacked(kind: str, data: bytes, rows: int) -> np.ndarray:
    if kind == "json":
        return np.array(json.loads(data), object).reshape(rows, -1)
    return np.frombuffer(data, kind).reshape(rows, -1).astype(np.int64)


def scaled(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles; Python integers where 64 bits could overflow later on."""
    if x.size and np.abs(x).max() > SAFE / scale:
        return np.array([math.floor(scale * v) if abs(v) < 2**53 else scale * int(v) for v in x.ravel().tolist()], object).reshape(x.shape)
    return np.floor(scale * x).astype(np.int64)


def partial_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to centroid slices, (rows, clusters)."""
    if x.dtype != object and centroids.dtype != object and x.size:
        most = max(int(np.abs(x).max()), int(np.abs(centroids).max()))
        if 4 * x.shape[1] * most * most < 1 << 53:                   # doubles are exact: the fast product
            a, c = x.astype(np.float64), centroids.astype(np.float64)
            return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)
    else:
        x, centroids = x.astype(object), centroids.astype(object)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], 1).reshape(len(x), len(centroids))


def slices(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE, width: int = WIDTH) -> DataFrame:
    """``(block, shard, rows, kind, data, ids)`` of ``(vec_id, embedding)``; shard -1 holds the ids of a block's rows."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        made = TaskContext.get().partitionId() << 32
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                part = b.slice(lo, BLOCK)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
                v = scaled(x, scale)
                rows = [(made, s, len(v), *packed(v[:, at:at + width]), None) for s, at in enumerate(range(0, dimensions, width))]
                rows.append((made, -1, len(v), "", b"", part.column(0).to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
                    pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64())), strict=True)],
                    ["block", "shard", "rows", "kind", "data", "ids"])
                made += 1

    return vectors.mapInArrow(cut, "block long, shard int, rows long, kind string, data binary, ids array<long>")


def kept(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """``(vec_id, embedding)`` of the vectors with exactly ``dimensions`` components, all of them finite numbers."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
            .where((F.size("embedding") == dimensions) & ~bad))


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED,
              dimensions: int = DIMENSIONS, scale: int = SCALE, width: int = WIDTH) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` for each kept vector of ``(vec_id, embedding)``.

    Vectors that are null, of another length, or hold a null, NaN or infinite component are left out. Centroids start as
    the vectors with the smallest sha256 of "seed:vec_id" (null ids last, equal ids by their components); fewer vectors
    than clusters make fewer centroids. Ties go to the smaller cluster number. Repeated rows count again; rows without a
    vec_id are clustered like any other. Distances beyond a long are compared exactly and shown as its largest value. Other
    columns are not read. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = kept(vectors, dimensions)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    start = rows.orderBy(order.asc_nulls_last(), "vec_id", "embedding").limit(clusters).collect()
    if not start:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    common.small_batches(spark)
    stored = cut_lineage(slices(rows, dimensions, scale, width))
    centroids = scaled(np.array([r["embedding"] for r in start], np.float64), scale)
    shards = -(-dimensions // width)
    n = max(common.parallelism(spark), shards)
    held = (stored.where("shard >= 0").select("block", "shard", "rows", "kind", "data").rdd
            .map(lambda r: ((r[0], r[1]), (r[2], r[3], bytes(r[4])))).partitionBy(n))

    def nearest(centroids: np.ndarray):
        at = [centroids[:, lo:lo + width] for lo in range(0, dimensions, width)]

        def partial(item):
            (block, shard), (size, kind, data) = item
            return block, (size, *packed(partial_distances(unpacked(kind, data, size), at[shard])))

        def add(a, b):
            x, y = unpacked(*a[1:], a[0]), unpacked(*b[1:], b[0])
            if x.dtype == object or y.dtype == object:
                x, y = x.astype(object), y.astype(object)
            return (a[0], *packed(x + y))

        def least(summed):
            d = unpacked(*summed[1:], summed[0])
            label = d.argmin(1)                                      # the first of equal ones
            return label.astype(np.uint16).tobytes(), np.minimum(d[np.arange(len(d)), label], TOP).astype("<i8").tobytes()

        return held.map(partial).reduceByKey(add, n).mapValues(least)

    def new_slice(kv):
        shard, (count, total) = kv
        old = centroids[:, shard * width:(shard + 1) * width].astype(object)
        return shard, [[int(s) // int(c) for s in row] if c else list(o) for c, row, o in zip(count, total, old, strict=True)]

    def sums(item):
        (_, shard), ((size, kind, data), label) = item
        x, label = unpacked(kind, data, size), np.frombuffer(label, np.uint16)
        total = np.zeros((len(centroids), x.shape[1]), object)
        for k in np.unique(label):
            total[k] = x[label == k].sum(0)
        return shard, (np.bincount(label, minlength=len(centroids)), total.astype(object))

    for _ in range(rounds):
        labels = nearest(centroids).flatMap(lambda kv: [((kv[0], s), kv[1][0]) for s in range(shards)]).partitionBy(n)
        met = held.join(labels, n)                                   # the slices stay where they are
        found = dict(met.map(sums).reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1]), shards).map(new_slice).collect())
        centroids = np.concatenate([np.array(found[s], object).reshape(len(centroids), -1) for s in range(shards)], 1)
        if np.abs(centroids).max() <= SAFE:
            centroids = centroids.astype(np.int64)
    assigned = spark.createDataFrame(nearest(centroids).map(lambda kv: (kv[0], *kv[1])), "block long, labels binary, distances binary")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, labels, distances in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.frombuffer(labels, np.uint16).astype(np.int32)),
                                                  pa.array(np.frombuffer(distances, "<i8"))], ["vec_id", "cluster", "distance"])

    names = stored.where("shard = -1").select("block", "ids")
    out = cut_lineage(names.join(assigned, "block").select("ids", "labels", "distances")
                      .mapInArrow(expand, "vec_id long, cluster int, distance long"))
    total = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()      # a row for each cluster
    inertia = {r["cluster"]: min(int(r["s"]), TOP) for r in total}
    whole = min(sum(int(r["s"]) for r in total), TOP)
    facts = spark.createDataFrame([(k, v, whole, digest(centroids[k])) for k, v in inertia.items()],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def sql(clusters: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """The same rounds in DuckDB SQL, a pair of queries for each round, over table ``embeddings``."""
    def assign(name: str, centres: str) -> str:
        square = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
        return f"{name} AS MATERIALIZED (SELECT row, min({square}::BIGINT * {clusters} + c.k) AS best FROM v, {centres} c GROUP BY row)"

    def update(name: str, marks: str, before: str) -> str:
        return f"""{name} AS MATERIALIZED (SELECT b.k, coalesce(m.x, b.x) AS x FROM {before} b LEFT JOIN (
            SELECT k, list(floor(s / n)::BIGINT ORDER BY j) AS x FROM (SELECT a.best % {clusters} AS k, j, sum(v.x[j])::DOUBLE AS s, count(*) AS n
              FROM v JOIN {marks} a USING (row), range(1, {DIMENSIONS + 1}) AS d(j) GROUP BY 1, 2) GROUP BY k) m USING (k))"""

    steps = [f"""v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)::BIGINT) AS x
        FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda c: isfinite(c))) = {DIMENSIONS})""",
             f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS k, x FROM v
        ORDER BY sha256('{SEED}:' || vec_id) LIMIT {clusters})"""]
    for i in range(rounds):
        steps += [assign(f"a{i}", f"c{i}"), update(f"c{i + 1}", f"a{i}", f"c{i}")]
    steps.append(assign("last", f"c{rounds}"))
    return f"""WITH {", ".join(steps)}
        SELECT vec_id, k::INTEGER AS cluster, best // {clusters} AS distance, (sum(best // {clusters}) OVER (PARTITION BY k))::BIGINT AS cluster_inertia,
          (sum(best // {clusters}) OVER ())::BIGINT AS inertia, sha256(array_to_string(centre, ',')) AS centroid_sha256
        FROM v JOIN (SELECT row, best, best % {clusters} AS k FROM last) USING (row) JOIN (SELECT k, x AS centre FROM c{rounds}) USING (k)"""
