"""Nearest neighbours by an inverted file with product-quantised residuals.

Coarse centroids and codebooks are fitted on a bounded sample; every vector is then filed under its nearest
centroid with the codes of its residual and their error. A query probes its nearest cells; asymmetric distance
tables, less the errors, bound the distances of their rows from below, and every row whose bound does not exceed
the exact distance of the k-th is ranked by exact distances on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import stored

#: Vectors that the model is fitted on, at most.
TRAIN = 16_384
MOST_CELLS = 4_096
#: Rows of a cell in one task, and queries against them at once.
ROWS, QUERIES = 8_192, 512


def usable(embedding: Column) -> Column:
    """Not null, not zero, and no component null or not finite."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(embedding.isNotNull() & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _nearest(points: np.ndarray, centroids: np.ndarray, block: int = 4_096) -> np.ndarray:
    """Number of the nearest centroid of each point, in blocks."""
    norms = (centroids**2).sum(axis=1)
    out = [np.argmin(norms - 2 * points[i : i + block] @ centroids.T, axis=1) for i in range(0, len(points), block)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _kmeans(points: np.ndarray, k: int, rounds: int, seed: int = 0) -> np.ndarray:
    """Lloyd's algorithm from random distinct rows; an emptied centroid moves to the point farthest from its own."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(points, axis=0)
    centroids = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(points, centroids)
        counts = np.bincount(own, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, points)
        filled = counts > 0
        centroids[filled] = sums[filled] / counts[filled, None]
        if not filled.all():
            far = np.argsort(-((points - centroids[own]) ** 2).sum(axis=1))[: (~filled).sum()]
            centroids[np.flatnonzero(~filled)[: len(far)]] = points[far]
    return centroids


@dataclass(frozen=True)
class Model:
    """centroids: cells x d; books: parts of (codes x width); edges: where the parts begin and end."""

    centroids: np.ndarray
    books: list[np.ndarray]
    edges: list[int]

    def encode(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells, codes, and how far each point lies from what its codes stand for."""
        cells = _nearest(points, self.centroids)
        rest = points - self.centroids[cells]
        codes = [_nearest(rest[:, a:b], book).astype(np.uint8) for book, a, b in zip(self.books, self.edges, self.edges[1:])]
        coded = np.concatenate([book[c] for book, c in zip(self.books, codes)], axis=1)
        return cells, np.stack(codes, axis=1), np.sqrt(((rest - coded) ** 2).sum(axis=1))

    def tables(self, query: np.ndarray, cell: int) -> np.ndarray:
        """parts x 256 squared distances from the query's residual to every code."""
        rest = query - self.centroids[cell]
        out = np.zeros((len(self.books), 256), np.float32)
        for j, (book, a, b) in enumerate(zip(self.books, self.edges, self.edges[1:])):
            out[j, : len(book)] = ((book - rest[a:b]) ** 2).sum(axis=1)
        return out


def fit(vectors: DataFrame, n: int, parts: int = 16, rounds: int = 8) -> Model:
    """Fits on at most ``TRAIN`` vectors, those of the smallest id hashes; about sqrt(n) cells, at most ``MOST_CELLS``."""
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(TRAIN).select("embedding").toPandas()["embedding"]
    points = np.stack(sample.to_numpy()).astype(np.float32)
    centroids = _kmeans(points, min(MOST_CELLS, max(1, round(n**0.5))), rounds)
    rest = points - centroids[_nearest(points, centroids)]
    d = points.shape[1]
    edges = sorted({round(i * d / min(parts, d)) for i in range(min(parts, d) + 1)})
    books = [_kmeans(rest[:, a:b], 256, rounds) for a, b in zip(edges, edges[1:])]
    return Model(centroids, books, edges)


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return flat.reshape(len(column), -1)


def index(vectors: DataFrame, model) -> DataFrame:
    """(vec_id, cell, code, error, embedding) of every vector; ``model`` is a broadcast Model."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells, codes, errors = model.value.encode(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(errors, pa.float32()), batch.column(1)], names=["vec_id", "cell", "code", "error", "embedding"])

    return vectors.select("vec_id", "embedding").mapInArrow(mapped, "vec_id long, cell int, code binary, error float, embedding array<float>")


def _bins(counts: np.ndarray) -> np.ndarray:
    """Bin of each cell: cells follow one another into bins of about ``ROWS`` rows, so that small cells share one."""
    return (np.maximum(np.cumsum(counts), 1) - 1) // ROWS


def _probes(queries: DataFrame, model, counts: np.ndarray, probe: float, least: int) -> DataFrame:
    """(query_id, bin, cells, vector): the nearest cells, a share ``probe`` of them and until they hold ``least`` vectors."""
    most = max(1, -(-int(len(counts) * probe * 1000) // 1000))
    bins = _bins(counts)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = model.value.centroids
        for batch in batches:
            ids = batch.column(0).to_pylist()
            points = _matrix(batch.column(1)) if ids else np.zeros((0, 1), np.float32)
            out: list[tuple] = []
            for query, point in zip(ids, points):
                order = np.argsort(((centroids - point) ** 2).sum(axis=1), kind="stable")
                held = np.cumsum(counts[order])
                enough = int(np.searchsorted(held, least)) + 1
                probed = order[: max(most, enough)]
                probed = probed[counts[probed] > 0]
                out += [(query, int(n), probed[bins[probed] == n].tolist(), point) for n in np.unique(bins[probed])]
            if out:
                q, n, c, v = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(n, pa.int32()), pa.array(c, pa.list_(pa.int32())), pa.array([x.tolist() for x in v], pa.list_(pa.float32()))], names=["query_id", "bin", "cells", "vector"])

    return queries.mapInArrow(mapped, "query_id long, bin int, cells array<int>, vector array<float>")


def _exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double, components added in order."""
    total = np.zeros(len(vectors))
    for j in range(vectors.shape[1]):
        total += (vectors[:, j].astype(np.float64) - np.float64(query[j])) ** 2
    return np.sqrt(total)


def _scan(model, k: int):
    """The ``k`` nearest rows, by exact distance, of a block of a bin's rows for a block of queries, over each one's cells."""

    def ranked(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out_q, out_v, out_d = [], [], []
        if rows.num_rows and asked.num_rows:
            by_cell = np.argsort(rows.column("cell").to_numpy(), kind="stable")
            cells, ids = rows.column("cell").to_numpy()[by_cell], rows.column("vec_id").to_numpy()[by_cell]
            codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)[by_cell].astype(np.intp)
            errors = rows.column("error").to_numpy()[by_cell].astype(np.float64)
            originals = _matrix(rows.column("embedding").combine_chunks())[by_cell]
            at = np.arange(codes.shape[1])
            vectors = _matrix(asked.column("vector").combine_chunks())
            longest = np.sqrt((originals.astype(np.float64) ** 2).sum(axis=1).max())
            for query, probed, vector in zip(asked.column("query_id").to_pylist(), asked.column("cells").to_pylist(), vectors):
                spans = [(c, *np.searchsorted(cells, [c, c + 1])) for c in probed]
                found = [(np.arange(a, b), model.value.tables(vector, c)[at, codes[a:b]].sum(axis=1)) for c, a, b in spans if a < b]
                if not found:
                    continue
                near, table = (np.concatenate(x) for x in zip(*found))
                other = ids[near] != query
                near, table = near[other], np.sqrt(table[other].astype(np.float64))
                if len(near) > k:
                    reach = _exact(originals[near[np.argpartition(table, k - 1)[:k]]], vector).max()
                    slack = 1e-4 * (longest + np.linalg.norm(vector.astype(np.float64)))  # for sums in single precision
                    near = near[table - errors[near] <= reach + slack]
                distance = _exact(originals[near], vector)
                best = np.lexsort((ids[near], distance))[:k]
                out_q.append(np.full(len(best), query))
                out_v.append(ids[near[best]])
                out_d.append(distance[best])
        joined = lambda xs, kind: pa.array(np.concatenate(xs) if xs else [], kind)
        return pa.table({"query_id": joined(out_q, pa.int64()), "vec_id": joined(out_v, pa.int64()), "score": joined(out_d, pa.float64())})

    return ranked


def candidates(filed: DataFrame, asked: DataFrame, model, counts: np.ndarray, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the ``k`` rows of its probed cells that are nearest, ties to the smaller vec_id.

    Cells share bins of about ``ROWS`` rows, and a bin is dealt to tasks in blocks of about ``ROWS`` rows and
    ``QUERIES`` queries, so neither a cell with a third of all rows nor one that most queries probe fills a
    task, and a query gets ``k`` rows a block rather than a cell.
    """
    spark = filed.sparkSession
    bins = _bins(counts)
    rows = np.bincount(bins, weights=counts).astype(int)
    wanted = {r["bin"]: r["count"] for r in asked.groupBy("bin").count().collect()}
    of_cell = spark.createDataFrame([(i, n) for i, n in enumerate(bins.tolist())], "cell int, bin int")
    sizes = spark.createDataFrame([(n, -(-int(held) // ROWS), -(-wanted.get(n, 1) // QUERIES)) for n, held in enumerate(rows) if held], "bin int, shards int, blocks int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = filed.join(F.broadcast(of_cell), "cell").join(F.broadcast(sizes), "bin").withColumn("shard", F.pmod(F.xxhash64("vec_id"), "shards").cast("int")).withColumn("block", every("blocks"))
    right = asked.join(F.broadcast(sizes), "bin").withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks").cast("int")).withColumn("shard", every("shards"))
    keys = ["bin", "shard", "block"]
    found = left.select(*keys, "cell", "vec_id", "code", "error", "embedding").groupBy(*keys).cogroup(right.select(*keys, "query_id", "cells", "vector").groupBy(*keys)).applyInArrow(_scan(model, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(embeddings: DataFrame, is_query: Column, k: int = 10, probe: float = 0.7, refine: int = 200) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query, by Euclidean distance in double.

    ``embeddings`` has vec_id and embedding. Queries are its rows where ``is_query`` holds; candidates are all
    other rows. Ties go to the smaller vec_id. Vectors that are null, zero or hold null or non-finite components
    take no part, nor do rows with a null vec_id or of another length than most. Rows that share a vec_id count
    once (one of them). Within the probed cells, a share ``probe`` of all and until they hold over ``refine`` rows, the
    result is exact. A query gets fewer than ``k`` only if there are no more candidates.
    """
    spark = embeddings.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    good = embeddings.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    sizes = sorted(((-r["count"], r["d"]) for r in good.groupBy(F.size("embedding").alias("d")).count().collect()))
    if not sizes:
        return spark.createDataFrame([], schema)
    plain = good.where(F.size("embedding") == sizes[0][1]).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>"), is_query.alias("asks"))
    vectors = stored(plain.dropDuplicates(["vec_id"]), "ann-vectors")
    model = spark.sparkContext.broadcast(fit(vectors, vectors.count()))
    filed = stored(index(vectors, model), "ann-index")
    counts = {r["cell"]: r["count"] for r in filed.groupBy("cell").count().collect()}
    by_cell = np.array([counts.get(i, 0) for i in range(len(model.value.centroids))])
    asked = stored(_probes(vectors.where("asks").select("vec_id", "embedding"), model, by_cell, probe, refine + 1), "ann-probes")
    return candidates(filed, asked, model, by_cell, k)
