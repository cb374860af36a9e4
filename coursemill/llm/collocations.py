"""Phrase collocations by hierarchical pair naming.

Documents are dealt to blocks of about ``BLOCK_BYTES`` of text. A block is a stream of numbers, one for
each word in order, and 0 where a piece ends; a table of the block says which name each number
stands for. Then, for k = 1 to 5:

1. The k-grams of a block are counted: for k = 1 its words, else the pairs of names that are next to
   each other, as the k-gram at a place is the pair of the (k-1)-grams at it and at the next place.
   They leave the block once each, sorted and packed by buckets of their hashes.
2. A bucket adds up what all blocks have sent it. What is frequent gets a name, a number that is
   unique in all data, and every block is answered with the names of those of its k-grams that have one.
3. The block replaces its k-grams by their names, others by 0, and runs of zeros by one.

So streams never pass through a shuffle token by token, k-grams pass it once for each block and what
is rare never comes back, and no table of names has to fit into a task: a block has the names of its
own k-grams only. Streams are written as tables bucketed by block, so that answers come to them, and
they are not moved at all.

Both halves of a pair's name are its parents. They lead to the frequencies of all first and last
parts, from which the cuts of a phrase are scored; and as a longer phrase is never more frequent than
one inside it, a phrase is subsumed by any longer one just if it is by one that it is a parent of.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coursemill.session import Bucketed, release, ship, stash

LEAST, LONGEST, TOP = 100, 5, 2_000
BLOCK_BYTES = 1 << 23
#: Words of the corpus for each bucket of k-grams.
BUCKET_WORDS = 1 << 22
#: Candidates that are ranked in one task at first.
RANKED_AT_ONCE = 200_000
UNKNOWN = "und"
_BREAK = b"\xff"  # no byte of UTF-8
_CLASSES = bytes(0xFF if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b for b in range(256))
#: Rows of a block: its stream and the names of its numbers; k-grams for a bucket, the numbers of which begin with ``first``; words of a language.
STREAM, GRAMS, TOTAL = 0, 1, 2
BLOCKS = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("first", pa.int64()), ("data", pa.binary()), ("keys", pa.binary()), ("lang", pa.string())])
#: What a bucket returns: a name, or the names of a block's k-grams.
NAME, ANSWER = 0, 1
BUCKETS = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("left_id", pa.int64()), ("right_id", pa.int64()), ("f", pa.int64()), ("block", pa.int64()), ("first", pa.int64()), ("data", pa.binary())])
_TYPES = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_TYPES[f.type]}" for f in schema)


def _rows(schema: pa.Schema, n: int, **columns) -> pa.RecordBatch:
    """A batch of n rows; columns that are not given are null, single values repeated."""
    value = lambda f: pa.nulls(n, f.type) if f.name not in columns else pa.array(columns[f.name] if isinstance(columns[f.name], (list, np.ndarray)) else [columns[f.name]] * n, f.type)
    return pa.RecordBatch.from_arrays([value(f) for f in schema], schema=schema)


class _Numbers(dict):
    """Numbers from 1 for the words that are asked for, and 0 for a break."""

    def __init__(self):
        super().__init__({_BREAK: 0})

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


def words_of(text: str) -> list[bytes]:
    """The words of a text, A-Z lower-cased, and a break between pieces."""
    return text.encode().lower().translate(_CLASSES).replace(_BREAK, b" \xff ").split()


def pack(*arrays: np.ndarray) -> bytes:
    """Whole numbers, compressed: the bytes of equal weight of all numbers stand together, as many as the numbers need."""
    head, planes = [len(arrays)], [np.zeros(0, np.uint8)]
    for a in arrays:
        width = 8 if len(a) and a.min() < 0 else max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
        head += [len(a), width]
        planes += [(a >> 8 * k & 255).astype(np.uint8) for k in range(width)]
    return struct.pack(f"<{len(head)}q", *head) + pa.compress(np.concatenate(planes), "zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    n = struct.unpack_from("<q", data)[0]
    head = struct.unpack_from(f"<{2 * n}q", data, 8)
    total = sum(size * width for size, width in zip(head[::2], head[1::2], strict=True))
    raw = np.frombuffer(pa.decompress(data[8 + 16 * n :], total, "zstd", asbytes=True), np.uint8) if total else np.zeros(0, np.uint8)
    out, at = [], 0
    for size, width in zip(head[::2], head[1::2], strict=True):
        own = np.zeros(size, np.int64)
        for k in range(width):
            own |= raw[at : at + size].astype(np.int64) << 8 * k
            at += size
        out.append(own)
    return out


def without_repeated_zeros(stream: np.ndarray) -> np.ndarray:
    return stream[(stream != 0) | (np.append(stream[1:], 0) != 0)]


def bucket_of(left: np.ndarray, right: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a pair of names."""
    x = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ right.astype(np.uint64)
    for _ in range(2):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(buckets)).astype(np.int64)


def numbered_pairs(stream: np.ndarray, ids: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(numbers at the stream's places, then for each number from 1: bucket, left name, right name, count) of the pairs of names that are next to each other. ids: the name of each number of the stream, none for 0. Numbers go by bucket and names."""
    left, right = stream[:-1], stream[1:]
    both = (left > 0) & (right > 0)
    pairs, number, f = np.unique(left[both] * len(ids) + right[both], return_inverse=True, return_counts=True)
    left, right = ids[pairs // len(ids)], ids[pairs % len(ids)]
    bucket = bucket_of(left, right, buckets)
    order = np.lexsort((right, left, bucket))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    at = np.zeros(len(both), np.int64)
    at[both] = rank[number]
    return at, bucket[order], left[order], right[order], f[order]


def _cuts(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, start, end) of every run."""
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(bucket) else np.zeros(1, int)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(bucket[a]), a, b


def block_of_pairs(block: int, stream: np.ndarray, ids: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """A block's rows: its stream with the names, and its pairs for every bucket."""
    stream = without_repeated_zeros(stream)
    yield _rows(BLOCKS, 1, block=block, kind=STREAM, data=pack(stream, ids))
    _, bucket, left, right, f = numbered_pairs(stream, ids, buckets)
    made = [(x, a + 1, pack(np.diff(left[a:b], prepend=0), right[a:b], f[a:b])) for x, a, b in _cuts(bucket)]
    if made:
        own, first, data = map(list, zip(*made, strict=True))
        yield _rows(BLOCKS, len(made), block=block, kind=GRAMS, bucket=own, first=first, data=data)


def word_blocks(docs: DataFrame, buckets: int, size: int = BLOCK_BYTES) -> DataFrame:
    """The blocks of the words of ``docs``: a task begins a new one once the one before holds ``size`` bytes."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made, held = TaskContext.get().partitionId() << 32, 0, 0
        numbers: dict[str, _Numbers] = {}
        streams: list[tuple[str, np.ndarray]] = []

        def block() -> Iterator[pa.RecordBatch]:
            # the stream has words in the order in which they come first, one language after the other: so it packs well
            shift = dict(zip(numbers, np.cumsum([0, *(len(own) - 1 for own in numbers.values())]).tolist(), strict=False))
            stream = without_repeated_zeros(np.concatenate([np.where(s > 0, s + np.int32(shift[x]), 0) for x, s in streams]))
            f = np.bincount(stream)
            for x, own in numbers.items():
                yield _rows(BLOCKS, 1, block=first + made, kind=TOTAL, first=int(f[shift[x] + 1 : shift[x] + len(own)].sum()), lang=x)
            # a key is language, break, word; they are sent by bucket and key
            listed = [x.encode() + _BREAK + w for x, own in numbers.items() for w, n in own.items() if n]
            bucket = np.fromiter((zlib.crc32(key) % buckets for key in listed), np.int64, len(listed))
            keys = pa.array(listed, pa.large_binary())
            order = pc.sort_indices(pa.table({"bucket": bucket, "key": keys}), [("bucket", "ascending"), ("key", "ascending")]).to_numpy().astype(np.int64)
            rank = np.zeros(len(order) + 1, np.int64)
            rank[order + 1] = np.arange(1, len(order) + 1)
            yield _rows(BLOCKS, 1, block=first + made, kind=STREAM, data=pack(stream, rank))
            keys, bucket, f = keys.take(pa.array(order)), bucket[order], f[order + 1]
            edges, text = np.frombuffer(keys.buffers()[1], np.int64), keys.buffers()[2]
            packed = []
            for own, a, b in _cuts(bucket):
                packed.append((own, a + 1, pack(np.diff(edges[a : b + 1]), f[a:b]), pa.compress(text.slice(int(edges[a]), int(edges[b] - edges[a])), "zstd", asbytes=True)))
            if packed:
                own, at, data, shown = map(list, zip(*packed, strict=True))
                yield _rows(BLOCKS, len(packed), block=first + made, kind=GRAMS, bucket=own, first=at, data=data, keys=shown)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = numbers.get(lang)
                if own is None:
                    own = numbers[lang] = _Numbers()
                listed = words_of(text)
                streams.append((lang, np.append(np.fromiter(map(own.__getitem__, listed), np.int32, len(listed)), np.int32(0))))
                held += len(text)
                if held >= size:
                    yield from block()
                    numbers, streams, held, made = {}, [], 0, made + 1
        if streams:
            yield from block()

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, _ddl(BLOCKS))


def named_words(blocks: DataFrame, least: int, buckets: int) -> DataFrame:
    """The frequent ones of all blocks' words with names, and the answers to the blocks."""

    def run(found: pa.Table) -> pa.Table:
        rows = [(r["block"], r["first"], *unpack(r["data"]), r["keys"]) for r in found.to_pylist()]
        bucket = found.column("bucket")[0].as_py()
        count: dict[bytes, int] = {}
        listed = []
        for _, _, lengths, f, keys in rows:
            text = pa.decompress(keys, int(lengths.sum()), "zstd", asbytes=True)
            edges = np.concatenate(([0], np.cumsum(lengths))).tolist()
            own = [text[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
            listed.append(own)
            for key, n in zip(own, f.tolist(), strict=True):
                count[key] = count.get(key, 0) + n
        names = {key: bucket + 1 + buckets * k for k, key in enumerate(sorted(key for key, n in count.items() if n >= least))}
        parts = [key.split(_BREAK, 1) for key in names]
        out = [_rows(BUCKETS, len(names), kind=NAME, id=list(names.values()), lang=[x.decode() for x, _ in parts], word=[w.decode() for _, w in parts], f=[count[key] for key in names])]
        for (block, first, *_), own in zip(rows, listed, strict=True):
            ids = np.fromiter((names.get(key, 0) for key in own), np.int64, len(own))
            out += _answer(block, first, ids)
        return pa.Table.from_batches(out, BUCKETS)

    return blocks.filter(F.col("kind") == GRAMS).groupBy("bucket").applyInArrow(run, _ddl(BUCKETS))


def named_pairs(blocks: DataFrame, least: int, buckets: int) -> DataFrame:
    """The frequent ones of all blocks' pairs with names, and the answers to the blocks."""

    def run(found: pa.Table) -> pa.Table:
        rows = [(r["block"], r["first"], *unpack(r["data"])) for r in found.to_pylist()]
        bucket = found.column("bucket")[0].as_py()
        left, right, f = np.concatenate([np.cumsum(r[2]) for r in rows]), np.concatenate([r[3] for r in rows]), np.concatenate([r[4] for r in rows])
        order = np.lexsort((right, left))
        x, y = left[order], right[order]
        new = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
        starts = np.flatnonzero(new)
        total = np.add.reduceat(f[order], starts)
        chosen = total >= least
        names = np.zeros(len(starts), np.int64)
        names[chosen] = bucket + 1 + buckets * np.arange(int(chosen.sum()))
        ids = np.empty(len(order), np.int64)
        ids[order] = names[np.cumsum(new) - 1]
        at = starts[chosen]
        out = [_rows(BUCKETS, len(at), kind=NAME, id=names[chosen], left_id=x[at], right_id=y[at], f=total[chosen])]
        edges = np.concatenate(([0], np.cumsum([len(r[3]) for r in rows])))
        for (block, first, *_), a, b in zip(rows, edges[:-1], edges[1:], strict=True):
            out += _answer(block, first, ids[a:b])
        return pa.Table.from_batches(out, BUCKETS)

    return blocks.filter(F.col("kind") == GRAMS).groupBy("bucket").applyInArrow(run, _ddl(BUCKETS))


def _answer(block: int, first: int, ids: np.ndarray) -> list[pa.RecordBatch]:
    """The k-grams of a block, by their numbers, that have names; nothing where none has."""
    some = np.flatnonzero(ids)
    return [_rows(BUCKETS, 1, kind=ANSWER, block=block, first=first, data=pack(np.diff(some, prepend=0), ids[some]))] if len(some) else []


def next_blocks(blocks: DataFrame, answers: DataFrame, buckets: int, sent: int | None) -> DataFrame:
    """The blocks with their k-grams replaced by the names in the answers. sent: the buckets that the k-grams were sent to, None for words."""

    def run(streams: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[pa.RecordBatch] = []
        for row in streams.to_pylist():
            if sent is None:
                stream, rank = unpack(row["data"])
                numbers = rank[stream]
            else:
                numbers = numbered_pairs(*unpack(row["data"]), sent)[0]
            names = np.zeros(int(numbers.max(initial=0)) + 1, np.int64)
            for first, data in zip(answers.column("first").to_pylist(), answers.column("data").to_pylist(), strict=True):
                at, ids = unpack(data)
                names[first + np.cumsum(at)] = ids
            known, stream = np.unique(np.concatenate(([0], names[numbers])), return_inverse=True)
            out += block_of_pairs(row["of_block"], stream[1:], known, buckets)
        return pa.Table.from_batches(out, BLOCKS)

    streams = blocks.filter(F.col("kind") == STREAM).select(F.col("block").alias("of_block"), "data")
    return streams.groupBy("of_block").cogroup(answers.select("block", "first", "data").groupBy("block")).applyInArrow(run, _ddl(BLOCKS))


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, percent: int = 100, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """lang, phrase, words, a, l, r, n, score, subsumed: all candidates, which are phrases of 2 to ``longest`` words that occur ``least`` times or more.

    Everything is counted per lang. n: all words of the language; a, l, r: occurrences of the phrase, of
    its first part and of the rest at the cut with the smallest score, ties to the shorter first
    part; score: floor(1000 a n / (l r)), exact up to 38 digits. subsumed: a longer candidate that
    holds the phrase has at least ``percent`` hundredths of its occurrences. A null lang is ``und``, a
    null text empty. Rows count as often as they are repeated, ids don't matter. Texts are never
    cut; one of any length is within one block. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tables = [Bucketed(word_blocks(docs, parts, block_bytes), "words", "block", parts, "kind")]
    totals = tables[0].read().filter(F.col("kind") == TOTAL).groupBy("lang").agg(F.sum("first").alias("n"))
    totals = stash(totals, "totals")  # one row for each language
    buckets = max(parts, -(-(totals.agg(F.sum("n")).first()[0] or 0) // BUCKET_WORDS))
    found = stash(named_words(tables[0].read(), least, parts), "named1")
    tables[0].remove(GRAMS)
    name = found.filter(F.col("kind") == NAME)
    # first_f and last_f: occurrences of the first and of the last 1, 2, ... words
    none = F.array().cast("array<bigint>")
    names = name.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", none.alias("first_f"), none.alias("last_f"))
    levels, sent = [names], None
    for k in range(2, longest + 1):
        blocks = Bucketed(next_blocks(tables[-1].read(), found.filter(F.col("kind") == ANSWER), buckets, sent), f"blocks{k}", "block", parts, "kind")
        tables.pop().drop()
        tables.append(blocks)
        sent = buckets
        found = stash(named_pairs(blocks.read(), least, buckets), f"named{k}")
        blocks.remove(GRAMS)
        left = names.select(F.col("id").alias("left_id"), F.col("lang").alias("of"), F.col("phrase").alias("head"), F.col("f").alias("lf"), "first_f")
        right = names.select(F.col("id").alias("right_id"), F.col("last").alias("tail"), F.col("f").alias("rf"), "last_f")
        made = found.filter(F.col("kind") == NAME).select("id", "left_id", "right_id", "f").join(left, "left_id").join(right, "right_id")
        made = made.select("id", "left_id", "right_id", F.col("of").alias("lang"), F.concat_ws(" ", "head", "tail").alias("phrase"), F.col("tail").alias("last"), "f", F.concat("first_f", F.array("lf")).alias("first_f"), F.concat("last_f", F.array("rf")).alias("last_f"))
        names = stash(made, f"names{k}")
        levels.append(names)
    tables.pop().drop()
    out = None
    wide = lambda c: c.cast("decimal(20,0)")
    for k, own in enumerate(levels[1:], 2):
        own = own.join(F.broadcast(totals), "lang")  # one row for each language
        cuts = [(F.col("first_f")[j - 1], F.col("last_f")[k - j - 1], j) for j in range(1, k)]
        score = lambda l, r: F.call_function("div", (wide(F.lit(1000) * F.col("f")) * wide(F.col("n"))), wide(l) * wide(r))  # noqa: E731, E741
        worst = F.array_min(F.array(*[F.struct(score(l, r).alias("score"), F.lit(j).alias("j"), l.alias("l"), r.alias("r")) for l, r, j in cuts]))  # noqa: E741
        own = own.select("id", "lang", "phrase", F.lit(k).alias("words"), F.col("f").alias("a"), worst.alias("cut"), "n")
        if k < longest:
            child = levels[k].select(F.explode(F.array("left_id", "right_id")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("inside"))
            own = own.join(child, "id", "left").withColumn("subsumed", F.coalesce(100 * F.col("inside") >= percent * F.col("a"), F.lit(False)))
        else:
            own = own.withColumn("subsumed", F.lit(False))
        own = own.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "n", "cut.score", "subsumed")
        out = own if out is None else out.unionByName(own)
    return out


def collocations(docs: DataFrame, top: int = TOP, **params) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` of phrases() that are not subsumed, by score descending, a descending, phrase ascending by its bytes.

    Candidates are ranked in parts of about RANKED_AT_ONCE first, and the parts' first ones together.
    """
    left = stash(phrases(docs, **params).filter("NOT subsumed"), "phrases")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    parts = 1 + left.count() // RANKED_AT_ONCE
    part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
    first = left.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w WHERE len(w) > 0),
total AS (SELECT lang, count(*) AS n FROM i GROUP BY ALL),
g AS (SELECT lang, w[i:i + k - 1] AS g, count(*) AS f FROM i, (VALUES (1), (2), (3), (4), (5)) AS v(k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT g.lang, g.g, g.f AS a, k, x.f AS l, y.f AS r, n, (1000::HUGEINT * g.f * n) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, len(g))) AS k FROM g WHERE len(g) > 1) g JOIN g x ON x.lang = g.lang AND x.g = g.g[1:k] JOIN g y ON y.lang = g.lang AND y.g = g.g[k + 1:] JOIN total t ON t.lang = g.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
longer AS (SELECT lang, f, g[s:e] AS g FROM (SELECT lang, f, g, s, unnest(range(s + 1, len(g) + 1)) AS e FROM (SELECT *, unnest(range(1, len(g))) AS s FROM g WHERE len(g) > 2)) WHERE e - s + 1 < len(g)),
inside AS (SELECT lang, g, max(f) AS f FROM longer GROUP BY ALL),
kept AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, l, r, n, score FROM best b LEFT JOIN inside i ON b.lang = i.lang AND b.g = i.g WHERE i.f IS NULL OR 100 * i.f < 100 * a),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM kept)
SELECT * FROM ranked WHERE rank <= 2000
"""
