"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosines, components.

1. Equal vectors are one class. A class has a sketch: the sides of random hyperplanes that it lies on,
   ``bits`` for each of several tables. The bits of a table are its bucket there. There are so many
   tables that a pair just at the threshold shares a bucket with probability ``recall``; closer ones
   do so more surely. Bits grow with the logarithm of the number of classes, so that buckets stay small.
2. Buckets are compared by sketches alone: the number of differing bits of all tables estimates the
   angle. Only classes that have someone within the threshold's bits and SLACK deviations stay in a
   bucket; the others' vectors are never moved.
3. The buckets of what is left are compared on the vectors in double precision. A pair counts in the
   first table whose bucket it shares, so numbers of links are exact sums over buckets. A bucket
   returns one number for a class and a spanning forest of its links, never its pairs.
4. The forests' links are joined to components.

A bucket of more than TILE classes is cut into tiles, each pair of which is compared by one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursemill.llm.components import components
from coursemill.session import release, ship, small_side, stash

COSINE, RECALL = 0.95, 0.999
#: Classes of a bucket on average, at most, and of a tile.
BUCKET, TILE = 64, 1_024
#: How many deviations more differing bits than expected at the threshold a pair may have.
SLACK = 5.0
SEED = 12
#: Cosines that differ less from the threshold are computed anew with exact sums.
CLOSE = 1e-9


def hashing(classes: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables) for so many classes."""
    bits = min(30, max(4, round(math.log2(max(classes, 1) / BUCKET)) if classes > BUCKET else 4))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def most_differing(bits: int, cosine: float = COSINE) -> int:
    """How many of so many bits a pair at the threshold may differ in."""
    p = math.acos(cosine) / math.pi
    return math.floor(bits * p + SLACK * math.sqrt(bits * p * (1 - p)))


def units(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1, without overflow on the way."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def sketches(vectors: np.ndarray, bits: int, tables: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(packed signs, bucket in each table) of vectors. Hyperplanes depend on the seed and the dimension alone."""
    planes = np.random.default_rng([seed, vectors.shape[1]]).standard_normal((tables * bits, vectors.shape[1]))
    signs = units(vectors) @ planes.T > 0
    packed = np.packbits(np.pad(signs, ((0, 0), (0, -signs.shape[1] % 64))), axis=1)
    return packed, buckets(packed, bits, tables)


def buckets(packed: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The buckets of sketches: ``bits`` of each table as a number."""
    signs = np.unpackbits(packed, axis=1, count=bits * tables).reshape(-1, tables, bits)
    return signs.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))


def cosine_of(a: np.ndarray, b: np.ndarray) -> float:
    """The cosine of two vectors with exactly added products."""
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))


def forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest position that links (x, y) reach from each of n."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def tiles(batches: Iterator[pa.RecordBatch], rows: int = 8_192) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows in the order of their first column, as tables cut where a tile ends, and the tiles' edges."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            table = pa.Table.from_batches(held)
            key = table.column(0).to_numpy()
            earlier = np.flatnonzero(key != key[-1])
            if len(earlier):
                yield _edges(table.slice(0, int(earlier[-1]) + 1))
                held = table.slice(int(earlier[-1]) + 1).to_batches()
    if held:
        yield _edges(pa.Table.from_batches(held))


def _edges(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    key = table.column(0).to_numpy()
    return table, np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))


def _sketch_column(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _near(packed: np.ndarray, side: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a < b) of one tile whose sketches differ in at most ``most`` bits; in a tile of two sides, of different ones."""
    words = packed.view(np.uint64)
    differ = np.zeros((len(words), len(words)), np.int32)
    for w in words.T:
        differ += np.bitwise_count(w[:, None] ^ w[None, :])
    near = np.triu(differ <= most, 1)
    if side.min() != side.max():
        near &= side[:, None] != side[None, :]
    return np.nonzero(near)


def _placed(rows: DataFrame, label: str, tile: int) -> DataFrame:
    """``rows`` (tab, bucket, ...) dealt to tiles: place and side first, in the order of places."""
    large = rows.groupBy("tab", "bucket").agg(F.count("*").alias("m")).filter(F.col("m") > tile).select("tab", "bucket", F.ceil(F.col("m") / tile).cast("int").alias("cuts"))
    large = stash(large, f"{label}-large")  # at most tables x classes / tile rows
    cut = F.pmod(F.xxhash64("cid"), F.col("cuts")).cast("int")
    at = F.xxhash64("tab", "bucket")
    pair = lambda u: F.struct(F.xxhash64("tab", "bucket", F.least(u, cut), F.greatest(u, cut)).alias("place"), F.when(u == cut, 0).otherwise((u < cut).cast("int") + 1).alias("side"))
    spread = F.when(F.col("cuts").isNull(), F.array(F.struct(at.alias("place"), F.lit(0).alias("side")))).otherwise(F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), pair))
    out = rows.join(small_side(large), ["tab", "bucket"], "left").withColumn("t", F.explode(spread))
    out = out.select("t.place", "t.side", *rows.columns)
    return out.repartition("place").sortWithinPartitions("place", "tab", "bucket")


def linked_vectors(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding).

    Two rows are linked if the cosine of their vectors is ``cosine`` or more; none below it is linked,
    and one just at it is found with probability ``recall``. n_links: linked other rows; component_id:
    the smallest vec_id that links reach; kept: whether that is the row's own. Vectors that are null,
    zero or hold null or non-finite components, and rows without a vec_id, link with nothing, nor do
    vectors of different dimensions. Rows of one vec_id are rows like others, equal ones are linked. Other
    columns are ignored, however they are named. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0) & F.col("vec_id").isNotNull()
    fine = F.coalesce(fine, F.lit(False))
    classes = rows.filter(fine).groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"))
    classes = stash(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    bits, tables = hashing(classes.count(), cosine, recall)
    most = most_differing(bits * tables, cosine)

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array(batch.column(1).value_lengths())
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                packed, found = sketches(np.asarray(own.column(1).flatten()).reshape(-1, dim), bits, tables)
                # vectors of different dimensions have no bucket in common
                found = found + (dim << 32)
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array([p.tobytes() for p in packed], pa.binary()), pa.array(list(found), pa.list_(pa.int64()))], names=["cid", "sketch", "found"])

    sketch = stash(classes.select("cid", "vec").mapInArrow(sketched, "cid long, sketch binary, found array<long>"), "sketches")
    every = sketch.select(F.posexplode("found").alias("tab", "bucket"), "cid", "sketch")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(tab, bucket, cid) of what has someone near in its tile. Places are hashes, so buckets that share one are kept apart."""
        for table, edges in tiles(batches):
            side, cid = table.column("side").to_numpy(), table.column("cid").to_numpy()
            tab, bucket = table.column("tab").to_numpy(), table.column("bucket").to_numpy()
            packed = _sketch_column(table.column("sketch"))
            keep = np.zeros(len(cid), bool)
            for a, b in _same_bucket(edges, tab, bucket):
                if b - a > 1:
                    x, y = _near(packed[a:b], side[a:b], most)
                    keep[a + x] = keep[a + y] = True
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (tab, bucket, cid)], names=["tab", "bucket", "cid"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, b, n): n rows linked with class a (b null), or a link of the bucket's forest (n null)."""
        for table, edges in tiles(batches):
            side, cid, m = (table.column(c).to_numpy() for c in ("side", "cid", "m"))
            tab, bucket = table.column("tab").to_numpy(), table.column("bucket").to_numpy()
            packed, vec = _sketch_column(table.column("sketch")), table.column("vec")
            found = buckets(packed, bits, tables)
            links = np.zeros(len(cid), np.int64)
            up = np.arange(len(cid))
            for a, b in _same_bucket(edges, tab, bucket):
                if b - a < 2:
                    continue
                x, y = _near(packed[a:b], side[a:b], most)
                # not in a table before this one
                first = np.ones(len(x), bool)
                for t in range(int(tab[a])):
                    first &= found[a + x, t] != found[a + y, t]
                x, y = x[first], y[first]
                if not len(x):
                    continue
                own = np.asarray(vec.slice(a, b - a).combine_chunks().flatten()).reshape(b - a, -1)
                unit = units(own)
                cos = np.concatenate([np.einsum("ij,ij->i", unit[x[k : k + 65_536]], unit[y[k : k + 65_536]]) for k in range(0, len(x), 65_536)])
                linked = cos >= cosine
                for k in np.flatnonzero(np.abs(cos - cosine) < CLOSE).tolist():
                    linked[k] = cosine_of(own[x[k]], own[y[k]]) >= cosine
                x, y = x[linked], y[linked]
                np.add.at(links, a + x, m[a + y])
                np.add.at(links, a + y, m[a + x])
                up[a:b] = a + forest(b - a, x, y)
            some, tied = np.flatnonzero(links), np.flatnonzero(up != np.arange(len(up)))
            none = lambda k: pa.nulls(k, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(cid[some]), none(len(some)), pa.array(links[some])], names=["a", "b", "n"])
            yield pa.RecordBatch.from_arrays([pa.array(cid[tied]), pa.array(cid[up[tied]]), none(len(tied))], names=["a", "b", "n"])

    # a tile of two sides holds twice the classes of one; the same class is in several tiles of a large bucket
    near = stash(_placed(every, "sketches", tile).mapInArrow(candidates, "tab int, bucket long, cid long").distinct(), "candidates")
    left = near.join(sketch.select("cid", "sketch"), "cid").join(classes.select("cid", "m", "vec"), "cid").select("tab", "bucket", "cid", "sketch", "m", "vec")
    found = stash(_placed(left, "vectors", tile).mapInArrow(compared, "a long, b long, n long"), "vector-links")
    release(near, sketch)
    links = found.filter("b IS NULL").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    labels = components(found.filter("b IS NOT NULL").select("a", "b"))
    named = classes.select("cid", "rep").join(labels.withColumnRenamed("node", "cid"), "cid")
    named = named.join(named.groupBy("component").agg(F.min("rep").alias("first")), "component").select("cid", "first")
    known = classes.join(links, "cid", "left").join(named, "cid", "left")
    known = known.select("vec", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("first", "rep").alias("component_id"))
    out = rows.filter(fine).join(known, "vec").select("vec_id", "n_links", "component_id")
    alone = rows.filter(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _same_bucket(edges: np.ndarray, tab: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, int]]:
    """The runs of rows of one place and one bucket."""
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if tab[a] == tab[b - 1] and bucket[a] == bucket[b - 1]:
            yield a, b
        else:  # two buckets whose hashes are equal
            cut = [a, *(a + 1 + np.flatnonzero((tab[a + 1 : b] != tab[a : b - 1]) | (bucket[a + 1 : b] != bucket[a : b - 1]))).tolist(), b]
            yield from zip(cut[:-1], cut[1:], strict=True)


# All pairs, and what links reach.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS vec FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.vec, y.vec) >= 0.95::DOUBLE),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(m, e.vec_id)) AS component_id, e.vec_id <= coalesce(m, e.vec_id) AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON e.vec_id = l.a LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON e.vec_id = r.a
"""
