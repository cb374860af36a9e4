"""Approximate nearest neighbours with randomly rotated one-bit codes.

Index: vectors are dealt to lists by their nearest centroid (k-means on a bounded sample). A vector
is kept as the sign bits of its residual, turned at random into a space of ``BITS_PER_DIM`` times
as many dimensions, with two scalars: the residual's length and the inner product of the code with
the residual's direction. Of equal vectors the k + 1 smallest ids are kept, as no answer can hold
more.

Search: popcounts of a code with the bits of the query's turned residual, quantized to four bits,
give the code's inner product with it; divided by the second scalar this estimates the true inner
product without bias, with an error that is bounded with high probability.

1. In the lists nearest to a query, the vectors with the smallest estimates are reranked on their
   original numbers. The k-th best is a bound that all further work of this query carries.
2. Lists that the bound excludes (centroid too far, even less the list's radius) are left out. In the
   others, vectors whose lower bound is within the query's bound are reranked.

Only codes are scanned; original vectors are joined to what is to be reranked. Lists are cut into
blocks of bounded size and the queries of a list into blocks as well, so a list that holds any share
of the vectors is searched by as many tasks as it needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coursemill.session import ship, stash

SAMPLE = 20_000
MOST_LISTS = 2_048
LIST_ROWS = 4_096
BLOCK_ROWS = 16_384
QUERY_BLOCK = 1_024
BITS_PER_DIM = 4
#: Width of the error bound in standard deviations.
EPSILON = 3.0
#: How many of each block are reranked for the first bound, as a multiple of k.
FIRST_RERANKED = 2
SEED = 11


def rotation(dim: int, bits: int, seed: int = SEED) -> np.ndarray:
    """A random matrix of ``bits`` rows with orthonormal columns: a rotation of vectors filled up with zeros."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, dim)))
    return q * np.sign(np.diag(r))


def fit_centroids(sample: np.ndarray, n_lists: int, rounds: int = 8, seed: int = SEED) -> np.ndarray:
    """Plain k-means; a centroid that loses all its vectors stays where it is."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), min(n_lists, len(sample)), replace=False)].astype(np.float64)
    for _ in range(rounds):
        near = nearest(sample, centroids)
        counts = np.bincount(near, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    return centroids


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each vector."""
    half = (centroids**2).sum(1) / 2
    return np.concatenate([(half - vectors[k : k + 4096] @ centroids.T).argmin(1) for k in range(0, len(vectors), 4096)] or [np.zeros(0, int)])


def _pack(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=-1).view(np.uint64)


def encode(residuals: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, norm, align) of residuals: packed sign bits, lengths, and <code, direction>; align is 1 for a zero residual, whose distance needs no estimate."""
    turned = residuals @ turn.T
    norm = np.linalg.norm(turned, axis=1)
    along = np.abs(turned).sum(1) / np.sqrt(len(turn))
    return _pack(turned > 0), norm, np.where(norm > 0, along / np.maximum(norm, 1e-300), 1.0)


def bounds(words: np.ndarray, norm: np.ndarray, align: np.ndarray, residual: np.ndarray, turn: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds and estimates of the squared distances of codes to a query, given by its residual to the same centroid."""
    bits = len(turn)
    r = turn @ residual
    length = float(np.linalg.norm(r))
    if not length:
        return norm**2, norm**2
    unit = r / length
    low, high = float(unit.min()), float(unit.max())
    step = (high - low) / 15 or 1.0
    level = np.rint((unit - low) / step).astype(np.int64)
    inner = np.zeros(len(norm))
    for k in range(4):
        inner += float(1 << k) * np.bitwise_count(words & _pack((level >> k & 1).astype(bool))).sum(1, dtype=np.int32)
    ones = np.bitwise_count(words).sum(1, dtype=np.int32)
    # <code, unit> with code = (2 bits - 1) / sqrt(bits) and unit ~ low + step * level
    cosine = (2 * (step * inner + low * ones) - (step * level.sum() + low * bits)) / np.sqrt(bits) / align
    slack = (epsilon * np.sqrt(np.maximum(1 - align**2, 0) / max(bits - 1, 1)) + step / 2) / align
    square = norm**2 + length**2
    return square - 2 * norm * length * (cosine + slack), square - 2 * norm * length * cosine


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and vec (array of double) of the rows that take part: not null or zero, all components finite."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vec")).filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()).filter(F.coalesce(fine, F.lit(False)))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten()).reshape(-1, dim)


def search(vectors: DataFrame, k: int = 10, query_step: int = 100, n_lists: int | None = None, sample: int = SAMPLE, block_rows: int = BLOCK_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose vec_id is divisible by ``query_step``.

    score is the Euclidean distance of the original vectors in double precision; ties go to the
    smaller vec_id, repeated ids to either row. Vectors that are null, zero, or hold null or
    non-finite components take no part, nor do those whose length isn't the most common one, as
    they have no distance to the others. No vectors, no rows. Centroids are fitted on at most
    ``sample`` vectors, the first in the order of a hash of their ids; every vector is indexed.
    n_lists: by default one for each LIST_ROWS vectors, MOST_LISTS at most.
    """
    spark = vectors.sparkSession
    ship(spark)
    fine = valid_vectors(vectors)
    shape = fine.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if shape is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total = shape["dim"], shape["count"]
    fine = fine.filter(F.size("vec") == dim)
    drawn = np.array([r["vec"] for r in fine.orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id").select("vec").limit(sample).collect()])
    centroids = fit_centroids(drawn, n_lists or min(MOST_LISTS, max(1, total // LIST_ROWS)))
    turn = rotation(dim, -(-dim * BITS_PER_DIM // 64) * 64)
    model = spark.sparkContext.broadcast((centroids, turn))  # at most MOST_LISTS centroids

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, t = model.value
        for batch in batches:
            if batch.num_rows:
                own = np.asarray(batch.column(1).flatten()).reshape(-1, dim)
                near = nearest(own, c)
                words, norm, align = encode(own - c[near], t)
                packed = pa.array([w.tobytes() for w in words], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(near.astype(np.int32)), packed, pa.array(norm), pa.array(align)], names=["vec_id", "h1", "h2", "list", "words", "norm", "align"])

    hashed = fine.select("vec_id", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit("vec"), "vec").alias("h2"))
    codes = hashed.mapInArrow(code, "vec_id long, h1 long, h2 long, list int, words binary, norm double, align double")
    copy = F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    index = stash(codes.withColumn("copy", copy).filter(F.col("copy") <= k + 1).select("vec_id", "list", "words", "norm", "align"), "codes")
    # one row per list, at most MOST_LISTS
    stats = {r["list"]: r for r in index.groupBy("list").agg(F.count("*").alias("n"), F.max("norm").alias("radius")).collect()}
    radius = np.array([stats[i]["radius"] if i in stats else -np.inf for i in range(len(centroids))])
    near_lists = max(1, round(len(stats) ** 0.5))
    reach = spark.sparkContext.broadcast(radius)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The lists of a query: without a bound the nearest ones, with one those that may hold something within it."""
        c, far = model.value[0], reach.value
        for batch in batches:
            if batch.num_rows:
                own, bound = np.asarray(batch.column(1).flatten()).reshape(-1, dim), batch.column(2).to_pylist()
                lists = []
                for q, b in zip(own, bound, strict=True):
                    d = np.where(far >= 0, np.sqrt(((c - q) ** 2).sum(1)), np.inf)
                    chosen = np.argsort(d, kind="stable")[:near_lists] if b is None else np.flatnonzero(d - far <= b * (1 + 1e-9) + 1e-12)
                    lists.append(chosen[np.isfinite(d[chosen])].astype(np.int32))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int32()))], names=["query_id", "query", "bound", "lists"])

    def scan(codes: pa.Table, queries: pa.Table) -> pa.Table:
        """(query_id, vec_id) to be reranked, of a block of codes and a block of queries of one list."""
        found_q, found_v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if codes.num_rows and queries.num_rows:
            c, t = model.value
            ids, norm, align = (codes.column(x).to_numpy() for x in ("vec_id", "norm", "align"))
            words = np.frombuffer(b"".join(codes.column("words").to_pylist()), np.uint64).reshape(len(ids), -1)
            residuals = _matrix(queries.column("query"), dim) - c[codes.column("list")[0].as_py()]
            for query_id, bound, residual in zip(queries.column("query_id").to_pylist(), queries.column("bound").to_pylist(), residuals, strict=True):
                lower, estimate = bounds(words, norm, align, residual, t)
                if bound is None:
                    estimate[ids == query_id] = np.inf
                    chosen = np.argpartition(estimate, FIRST_RERANKED * k)[: FIRST_RERANKED * k] if len(ids) > FIRST_RERANKED * k else np.arange(len(ids))
                else:
                    chosen = np.flatnonzero(lower <= bound**2 * (1 + 1e-9) + 1e-12)
                chosen = chosen[ids[chosen] != query_id]
                found_q.append(np.full(len(chosen), query_id))
                found_v.append(ids[chosen])
        return pa.table({"query_id": np.concatenate(found_q), "vec_id": np.concatenate(found_v)})

    queries = stash(fine.filter(F.col("vec_id") % query_step == 0).select(F.col("vec_id").alias("query_id"), F.col("vec").alias("query")), "queries")

    def to_rerank(asking: DataFrame) -> DataFrame:
        """(query_id, vec_id) of all blocks; asking: query_id, query, bound."""
        asked = asking.mapInArrow(ask, "query_id long, query array<double>, bound double, lists array<int>")
        asked = stash(asked.select("query_id", "query", "bound", F.explode("lists").alias("list")), "asked")
        # at most MOST_LISTS rows
        cuts = asked.groupBy("list").agg(F.ceil(F.count("*") / query_block).cast("int").alias("query_cuts"))
        blocks = spark.createDataFrame([(i, -(-r["n"] // block_rows)) for i, r in stats.items()], "list int, blocks int")
        cuts = F.broadcast(cuts.join(F.broadcast(blocks), "list"))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = index.join(cuts, "list").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).withColumn("cut", every("query_cuts"))
        right = asked.join(cuts, "list").withColumn("cut", F.pmod(F.xxhash64("query_id"), F.col("query_cuts")).cast("int")).withColumn("block", every("blocks"))
        keys = ["list", "block", "cut"]
        return left.select(*keys, "vec_id", "words", "norm", "align").groupBy(*keys).cogroup(right.select(*keys, "query_id", "query", "bound").groupBy(*keys)).applyInArrow(scan, "query_id long, vec_id long")

    def reranked(pairs: DataFrame) -> DataFrame:
        """query_id, vec_id, score of the k best pairs of each query by the original vectors, and their rank."""
        both = pairs.join(fine, "vec_id").join(queries, "query_id")
        # the squares added up in the order of the components
        score = F.sqrt(F.aggregate(F.zip_with("vec", "query", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x))
        best = both.select("query_id", "vec_id", score.alias("score")).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        return best.withColumn("rank", rank).filter(F.col("rank") <= k)

    first = stash(reranked(to_rerank(queries.withColumn("bound", F.lit(None).cast("double")))), "first-found")
    limits = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("score")).otherwise(F.lit(float("inf"))).alias("bound"))
    asking = queries.join(limits, "query_id", "left").select("query_id", "query", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    # what the first step found stays, whatever the bounds say
    pairs = to_rerank(asking).unionByName(first.select("query_id", "vec_id")).distinct()
    return reranked(pairs).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS vec FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.vec, c.vec), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
