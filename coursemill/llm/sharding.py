"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into a fixed number of cells. Each virtual node stands on a cell; a key belongs to
the cell of its hash and walks clockwise to the first virtual node whose shard has room. Only the
number of keys of each cell reaches the driver (at most ``2**cell_bits`` rows, whatever the input),
where the walk is done for whole runs of keys; every row then finds its shard and slot by its rank
among all, by ranges of the ring that are cut anywhere, between equal rows too. Capacities are the row count dealt out evenly, so shard sizes differ by one at most.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursemill.operators.numbering import numbered
from coursemill.session import stash

CELL_BITS = 12
VIRTUAL_NODES = 64


def ring_nodes(n_shards: int, virtual_nodes: int = VIRTUAL_NODES, cell_bits: int = CELL_BITS) -> list[tuple[int, int]]:
    """(cell, shard) of all virtual nodes, clockwise. A shard's nodes do not depend on how many shards there are."""
    out = []
    for shard in range(n_shards):
        for v in range(virtual_nodes):
            digest = hashlib.blake2b(f"node:{shard}:{v}".encode(), digest_size=8).digest()
            out.append((int.from_bytes(digest, "big") >> (64 - cell_bits), shard))
    return sorted(out)


def capacities(total: int, n_shards: int) -> list[int]:
    """Even loads: the first ``total % n_shards`` shards hold one more."""
    return [total // n_shards + (s < total % n_shards) for s in range(n_shards)]


def walk_ring(counts: dict[int, int], n_shards: int, virtual_nodes: int = VIRTUAL_NODES, cell_bits: int = CELL_BITS) -> list[tuple[int, int, int, int, int]]:
    """Runs (cell, first rank, end rank, shard, first slot) that place every key.

    Cells take their turn in a fixed pseudo-random order that no shard count changes. A run that
    does not fit into a shard continues clockwise. There are at most cells + shards runs: each
    further run of a cell comes from a shard that has just become full.
    """
    nodes = ring_nodes(n_shards, virtual_nodes, cell_bits)
    cells = [c for c, _ in nodes]
    room = capacities(sum(counts.values()), n_shards)
    filled = [0] * n_shards
    turn = sorted((c for c in counts if counts[c]), key=lambda c: (hashlib.blake2b(f"cell:{c}".encode(), digest_size=8).digest(), c))
    runs = []
    for cell in turn:
        done, at = 0, bisect_left(cells, cell)
        while done < counts[cell]:
            shard = nodes[at % len(nodes)][1]
            at += 1
            take = min(room[shard] - filled[shard], counts[cell] - done)
            if take:
                runs.append((cell, done, done + take, shard, filled[shard]))
                filled[shard] += take
                done += take
    return runs


def assign_shards(docs: DataFrame, n_shards: int = 16, virtual_nodes: int = VIRTUAL_NODES, cell_bits: int = CELL_BITS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the UTF-8 length plus 1; a null text counts as empty. Documents without an id are
    hashed by their text, so that those of one text walk from one cell. Equal rows are
    interchangeable: which of them gets which slot is open, the set of returned rows is not. Texts of any
    length count whole. Other columns are ignored, whatever their names; an empty table gives no rows.
    law is ``rows``: shard sizes differ by one at most, so grown_shard is null.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    place = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.lit("key"))).otherwise(F.xxhash64(F.lit("no id"), "text_crc32", "size"))
    # ``turn`` counts places from the start of the ring, and ``tie`` tells equal rows apart, so that ranges may cut between them
    keyed = keyed.withColumn("turn", place.bitwiseXOR(F.lit(-(2**63)))).withColumn("cell", F.shiftrightunsigned(place, 64 - cell_bits).cast("int"))
    keyed = stash(keyed.withColumn("tie", F.monotonically_increasing_id()), "ring-keys")
    counts = {r["cell"]: r["n"] for r in keyed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    before = dict(zip(sorted(counts), accumulate((counts[c] for c in sorted(counts)), initial=0), strict=False))
    walked = walk_ring(counts, n_shards, virtual_nodes, cell_bits)
    runs = spark.createDataFrame([(cell, before[cell] + first, before[cell] + past, shard, slot) for cell, first, past, shard, slot in walked], "run_cell int, first long, past long, shard int, slot0 long")
    ranked = numbered(keyed, "rank", ["turn", F.col("doc_id").asc_nulls_first(), "size", "text_crc32", "tie"]).withColumn("rank", F.col("rank") - 1)
    # runs has at most 2**cell_bits + n_shards rows
    placed = ranked.join(F.broadcast(runs), (F.col("cell") == F.col("run_cell")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("past")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("slot0") + F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
