"""Mixing sources to target weights by systematic sampling.

Within a source every document expects the same number of copies, target / source size. The
expected copies are prefix-summed over the source's documents in order of size; with one random
offset for the source, a document is emitted once for every integer that its own stretch of the
prefix sum crosses. As neighbours in that order have nearly the same size, the words taken differ
from the target by little more than the largest document.

The prefix sum runs on a range partitioning by (source, size, doc_id, text hash), which splits a
source of any size over as many tasks as it needs: every task numbers its own rows, the counts of
(task, source) are summed up, and each row adds the count before its task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coursemill.session import ship, stash

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3.0
SEED = 20240229


def source_targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES) -> dict[str | None, float]:
    """Words to take from each source: all words shared by weight, no source above ``most`` times its size.

    Sources stand in order of code points, null last, and take the weights in turn. What a full
    source can't take is shared again by weight among the others, until none is above.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, open_, target = float(sum(sizes.values())), list(order), {}
    while open_:
        left, shared = total - sum(target.values()), sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / shared > most * sizes[s]]
        if not full:
            target.update({s: left * weight[s] / shared for s in open_})
            break
        target.update({s: most * float(sizes[s]) for s in full})
        open_ = [s for s in open_ if s not in target]
    return target


def source_offset(source: str | None, seed: int) -> float:
    """The source's one random offset in [0, 1)."""
    name = "null" if source is None else "s" + source
    return int(hashlib.md5(f"{seed}:{name}".encode("utf-8", "surrogatepass")).hexdigest()[:12], 16) / 2.0**48


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of each run of equal sources in this partition, which is sorted by source."""
    part = TaskContext.get().partitionId()
    last, seen = None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        key = batch.column(batch.schema.get_field_index("mix_key"))
        codes = np.asarray(key.dictionary_encode().indices)
        starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        rank = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
        if key[0].as_py() == last:
            head = starts[1] if len(starts) > 1 else n
            rank[:head] += seen
        last, seen = key[n - 1].as_py(), int(rank[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(rank.astype(np.int64))], names=[*batch.schema.names, "part", "rank"])


def mix(docs: DataFrame, carry: list[str], weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """Every document with the number of copies that the mix takes of it.

    Returns row (a struct of the columns named in ``carry``), size, source_size (long), target
    (double) and copies (int). size counts the words of the text (null: 0). Documents without words
    take part, but their copies weigh nothing; a source without words has target 0 and gives no
    copies. Repeated rows are separate documents. Reruns agree: the order within a source is total
    up to equal rows. An empty table gives no rows. The driver holds one row per source.
    """
    spark = docs.sparkSession
    ship(spark)
    words = docs.select(
        F.struct(*[F.col(c) for c in carry]).alias("row"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source"))).alias("mix_key"),
        F.col("doc_id").cast("long").alias("id"),
        F.xxhash64("text").alias("tie"),
    )
    if "text" not in carry:
        words = stash(words, "sizes")  # narrow rows, read twice: for the ranges and for the shuffle
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["mix_key", "size", "id", "tie"]
    dealt = words.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("id", "tie")
    schema = T.StructType([*dealt.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("rank", T.LongType())])
    numbered = stash(dealt.mapInArrow(_number, schema), "mix")

    per_part = numbered.groupBy("mix_key", "part").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    per_source = per_part.groupBy("mix_key").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).collect()
    name = lambda key: None if key == "n" else key[1:]
    target = source_targets({name(r["mix_key"]): int(r["words"]) for r in per_source}, weights, most)
    rows = [(r["mix_key"], int(r["words"]), float(target[s]), target[s] / r["words"] if r["words"] else 0.0, source_offset(s, seed)) for r in per_source for s in [name(r["mix_key"])]]
    stats = spark.createDataFrame(rows, "mix_key string, source_size long, target double, rate double, offset double")
    before = Window.partitionBy("mix_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("mix_key", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")).join(stats, "mix_key")
    at = F.col("before") + F.col("rank")
    crossed = F.floor(F.col("rate") * (at + 1) + F.col("offset")) - F.floor(F.col("rate") * at + F.col("offset"))
    return numbered.join(offsets, ["mix_key", "part"]).select("row", "size", "source_size", "target", crossed.cast("int").alias("copies"))


def mixed_sizes(docs: DataFrame, **params) -> DataFrame:
    """doc_id, size, source_size, target, taken (words taken, repeats counted) and copies of every document. Cases as in mix(); columns beside doc_id, text and source are ignored, whatever their names."""
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mix(docs, ["doc_id"], **params).select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", taken, "copies")


def mixed_documents(docs: DataFrame, **params) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs`` alone, whatever their names. Texts of any length are taken whole, and no more than three times. An empty table gives no rows."""
    out = mix(docs, docs.columns, **params)
    return out.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")


# Targets by one level for all: a source takes its weight times the level, or three times its size if that is less.
ORACLE = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0::DOUBLE, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
r AS (SELECT *, 3 * source_size / w AS ratio FROM s),
p AS (SELECT *, row_number() OVER (ORDER BY ratio, source) AS k, (SELECT sum(source_size) FROM s) - coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_, sum(w) OVER (ORDER BY ratio, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_ FROM r),
level AS (SELECT arg_min(left_ / open_, k) FILTER (left_ / open_ <= ratio) AS level FROM p),
t AS (SELECT source, source_size, CASE WHEN level IS NULL OR 3 * source_size < level * w THEN 3.0::DOUBLE * source_size ELSE level * w END AS target,
  ('0x' || substr(md5('{SEED}:' || CASE WHEN source IS NULL THEN 'null' ELSE 's' || source END), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS shift FROM s, level),
k AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.shift, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate, row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) - 1 AS i FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (floor(rate * (i + 1) + shift) - floor(rate * i + shift))::INTEGER AS copies FROM k)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM c
"""
