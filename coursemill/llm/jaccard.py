"""N-gram Jaccard join: exact links between the word-shingle sets of documents.

1. A document becomes its set of shingle hashes. Equal sets are one class, known by a 128-bit
   digest; a class has a hashed bitmap of about two bits or more for each element.
2. Sets fall into bands by size; a link only joins sets of the same or of neighbouring bands. Two
   linked sets of a band differ in at most ``H`` elements, so of more than ``H`` parts of the hash
   range at least one holds the same elements in both. Every set gives one key for each part; only
   sets that share a key may be linked. Parts are wide enough that few are empty, and there are as
   many parts more as empty ones are expected; so a set with no more empty parts than that leaves
   them out. Keys pass one shuffle. Sets that share a key within a map task are combined before it:
   one of them stands for all, and the others go elsewhere, so that no key brings all its rows to
   one task.
3. First, every set of a key is compared with one set of it. The bit counts of two bitmaps bound
   the overlap from above; only pairs whose bound reaches the threshold have their texts read and
   their sorted arrays intersected. This gives nearly all links, as near copies share many keys.
4. Then, in keys whose sets are not all connected yet, those that are not connected are compared:
   a key's sets are cut into tiles of a bounded number, and tiles are compared in pairs, by bit
   counts and then exactly, as before. What is connected already is not compared. A key in which
   nearly all are connected needs tile pairs of the few others with all, not of all with all. Keys
   that have the same largest connected group are taken together where that makes fewer pairs.
5. The links of both steps are joined to components.

Groups are never closed over chains of keys, so work goes with the sets of single keys.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coursemill.llm.components import components
from coursemill.session import release, ship, small_side, stash

BAND_RATIO = 1.4
#: Sets of a tile, and pairs whose bits are counted at once.
TILE_SETS = 2_000
PAIRS_AT_ONCE = 200_000
#: Keys that a map task combines at once.
KEYS_AT_ONCE = 500_000
#: Bits of a bitmap for each element, at least, and the most 64-bit words of a bitmap.
BITS_PER_ITEM, MOST_WORDS = 2, 4_096
#: Bytes of a word that are mixed in NumPy.
LONG_WORD = 512
#: Sets that share the first half of their digests with another, at most.
MOST_RENAMED = 100_000
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of every word, in order; words are runs of other bytes than blanks.

    A word is taken in blocks of eight bytes. Each is mixed with the hash of those before it by steps
    that are not linear, as sums of powers have patterns of words that collide for every base. Of words
    of more than LONG_WORD bytes a digest is taken.
    """
    data = np.frombuffer(raw, np.uint8)
    solid = ~BLANK[data]
    if not solid.any():
        return np.zeros(0, np.uint64)
    edges = np.diff(np.concatenate(([False], solid, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    lengths = ends - starts
    # eight bytes from every place on, as one number
    eights = np.ndarray(len(data), np.dtype("<u8"), raw + bytes(8), strides=(1,))
    out = lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in np.flatnonzero(lengths > LONG_WORD).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(raw[starts[k] : ends[k]], digest_size=8).digest(), "little")
    open_ = np.flatnonzero(lengths <= LONG_WORD)
    for done in range(0, min(int(lengths.max()), LONG_WORD), 8):
        left = lengths[open_] - done
        keep = np.where(left >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (np.uint64(8) * np.minimum(left, 7).astype(np.uint64))) - np.uint64(1))
        out[open_] = mix64((out[open_] ^ (eights[starts[open_] + done] & keep)) + np.uint64(0x9E3779B97F4A7C15))
        open_ = open_[left > 8]
    return out


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles, A-Z lower-cased. A text with fewer words is one shingle, one without words none."""
    h = word_hashes(text.encode().lower()) if text else np.zeros(0, np.uint64)
    if not len(h):
        return h
    n = min(words, len(h))
    made = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        made = mix64(made * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(made)


class Bands:
    """Size bands, and for each the number of parts that makes the keys complete for a threshold of ``percent`` hundredths."""

    def __init__(self, percent: int, ratio: float = BAND_RATIO):
        self.percent, self.ratio = percent, max(ratio, 100 / percent + 0.01)
        self.starts = [1]

    def start(self, band: int) -> int:
        """The smallest size of a band. A band is at least as wide as the sizes that can be linked differ."""
        while len(self.starts) <= band + 1:
            low = self.starts[-1]
            self.starts.append(max(low + 1, math.floor(low * self.ratio), low * 100 // self.percent + 1))
        return self.starts[band]

    def of(self, size: int) -> int:
        band = 0
        while self.start(band + 1) <= size:
            band += 1
        return band

    @lru_cache(maxsize=None)  # noqa: B019 - lives as long as the task
    def parts(self, band: int) -> tuple[int, int]:
        """(parts, spare): two linked sets, the larger of this band, have an equal part even without up to ``spare`` empty ones."""
        largest = self.start(band + 1) - 1
        differ = (100 - self.percent) * 2 * largest // (100 + self.percent)
        least = self.start(band) * self.percent / 100
        spare = 0
        for _ in range(20):
            n = differ + 1 + spare
            empty = n * math.exp(-least / n)
            need = math.ceil(empty + 2 * math.sqrt(empty)) if differ else 0
            if need <= spare:
                break
            spare = need
        return differ + 1 + spare, spare


def part_keys(items: np.ndarray, bands: Bands) -> np.ndarray:
    """The keys of a set: those of its own band, and those of the next band where it can be linked to a set of that."""
    size = len(items)
    own = bands.of(size)
    out = []
    for band in (own, own + 1):
        if band > own and size * 100 < bands.percent * bands.start(band):
            break
        n, spare = bands.parts(band)
        part = ((items >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        sums = np.add.reduceat(mix64(items), first)
        filled = part[first]
        if n - len(filled) > spare:
            empty = np.setdiff1d(np.arange(n, dtype=np.uint64), filled)
            filled, sums = np.concatenate((filled, empty)), np.concatenate((sums, np.zeros(len(empty), np.uint64)))
        out.append(mix64(sums + mix64(filled + np.uint64(band << 40))))
    return np.concatenate(out)


def set_digest(items: np.ndarray) -> tuple[int, int, int]:
    """The size of a set and 128 bits that stand for it."""
    digest = hashlib.blake2b(items.tobytes(), digest_size=16).digest()
    return len(items), int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def bitmap(items: np.ndarray) -> np.ndarray:
    """A hashed bitmap of a set: a power of two of 64-bit words, BITS_PER_ITEM bits an element or more."""
    words = 1
    while words * 64 < BITS_PER_ITEM * len(items) and words < MOST_WORDS:
        words *= 2
    bits = np.zeros(words * 64, np.uint8)
    bits[(items & np.uint64(words * 64 - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def combine_keys(keys: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lead, extra) for each row: rows that share a key have the smallest class as lead, and all but one of them are extra. Rows alone in their key have none (lead 0, extra false)."""
    order = np.lexsort((classes, keys))
    k, c = keys[order], classes[order]
    starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    n = np.diff(np.append(starts, len(k)))
    lead, extra = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    lead[order] = np.where(np.repeat(n, n) > 1, np.repeat(c[starts], n), 0)
    extra[order] = np.arange(len(k)) != np.repeat(starts, n)
    return lead, extra


def within_bound(sizes: np.ndarray, maps: list[np.ndarray], a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs (positions a, b) may reach the threshold, by their sizes and by the bit counts of their bitmaps.

    Each differing bit stands for a differing element at least, so |A| + |B| - 2 |A and B| >=
    differing bits. Where one bitmap is longer it is folded to the length of the other, which keeps that true.
    """
    small, large = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
    fine = 100 * small >= percent * large
    lengths = np.array([len(m) for m in maps])
    least = np.minimum(lengths[a], lengths[b])
    for words in np.unique(least[fine]).tolist():
        chosen = np.flatnonzero(fine & (least == words))
        used = np.unique(np.concatenate((a[chosen], b[chosen])))
        table = np.stack([np.bitwise_or.reduce(maps[k].reshape(-1, words), axis=0) for k in used.tolist()])
        step = max(1, PAIRS_AT_ONCE * 16 // words)
        for at in range(0, len(chosen), step):
            part = chosen[at : at + step]
            x, y = np.searchsorted(used, a[part]), np.searchsorted(used, b[part])
            differ = np.bitwise_count(table[x] ^ table[y]).sum(1, dtype=np.int64)
            both = small[part] + large[part]
            bound = np.minimum((both - differ) // 2, small[part])
            fine[part] = 100 * bound >= percent * (both - bound)
    return fine


def tile_pairs(tiles: np.ndarray, side: np.ndarray, group: np.ndarray, sizes: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (positions) of rows of one tile that differ in group, and in side where the tile has two, and whose sizes can be linked.

    Rows are sorted by tile; a tile is taken in order of size, so that partners of a row follow it.
    Pairs come in runs of about PAIRS_AT_ONCE.
    """
    order = np.lexsort((sizes, tiles))
    t, s = tiles[order], sizes[order]
    starts = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
    rank = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(t))))
    own = side[order]
    mixed = (np.maximum.reduceat(own, starts) != np.minimum.reduceat(own, starts))[rank]
    # one ascending number for (tile, size)
    room = int(s.max()) * 100 // percent + 2
    place = rank.astype(np.int64) * room
    last = np.searchsorted(place + s, place + s * 100 // percent, side="right")
    n = np.maximum(last - np.arange(len(t)) - 1, 0)
    begin = 0
    done = np.cumsum(n)
    while begin < len(t):
        end = max(begin + 1, int(np.searchsorted(done, (done[begin - 1] if begin else 0) + PAIRS_AT_ONCE, side="right")))
        count = n[begin:end]
        first = np.repeat(np.arange(begin, end), count)
        second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(count) - count, count)
        x, y = order[first], order[second]
        keep = (group[x] != group[y]) & (~mixed[first] | (side[x] != side[y]))
        yield x[keep], y[keep]
        begin = end


def whole_tiles(batches: Iterator[pa.RecordBatch], rows: int = 20_000, size: int = 1 << 25) -> Iterator[pa.Table]:
    """Batches in the order of their first column, put together to so many rows or bytes, and cut where a tile ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < rows and sum(b.nbytes for b in held) < size:
            continue
        table = pa.Table.from_batches(held)
        tiles = table.column(0).to_numpy()
        earlier = np.flatnonzero(tiles != tiles[-1])
        if len(earlier):
            cut = int(earlier[-1]) + 1
            yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def new_names(known: DataFrame, classes: DataFrame) -> DataFrame | None:
    """(c1, c2, name) of the sets that share c1 with another set, but for the one with the smallest c2; None if there are none.

    About n * n / 2**65 of n sets do, so MOST_RENAMED, far more than any corpus has, is an error.
    """
    clashing = classes.filter("low <> high").select("c1", "low")
    if clashing.isEmpty():
        return None
    pairs = known.select("c1", "c2").join(clashing, "c1").filter("c2 <> low").select("c1", "c2").distinct().limit(MOST_RENAMED + 1)
    pairs = stash(pairs, "clashing")
    if pairs.count() > MOST_RENAMED:
        raise RuntimeError("too many sets share the first half of their digests")
    salt = 0
    while True:
        out = stash(pairs.withColumn("name", F.xxhash64(F.lit(salt), "c1", "c2")), "new-names")
        if out.groupBy("name").count().filter("count > 1").isEmpty() and out.join(classes.select(F.col("c1").alias("name")), "name", "left_semi").isEmpty():
            return out
        salt += 1


def jaccard_classes(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id: the components of all documents whose shingle sets have at least ``percent`` hundredths of their union in common.

    component_id is the smallest doc_id that links reach. A document without words (or text) has
    n_shingles 0 and is linked with nothing. Equal sets are linked. Rows without a doc_id take part
    in nothing: component_id is null. Rows of one doc_id are one document, whatever their texts. An
    empty table gives no rows; other columns are ignored. A text of any length is one set. Elements are
    64-bit hashes of shingles. Sets are told apart by 128 bits of digest: the first 64 name a set, but
    for those that share them with another set, which get other names.
    """
    spark = docs.sparkSession
    ship(spark)
    bands = (percent, BAND_RATIO)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                sets = [shingles(t, words) for t in rows.column(1).to_pylist()]
                found = zip(*map(set_digest, sets), strict=True)
                yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c, pa.int64()) for c in found), pa.array([bitmap(s).tobytes() for s in sets], pa.binary())], names=["doc_id", "n_shingles", "c1", "c2", "bits"])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen, moved = Bands(*bands), set(), renamed.value
        held: list[tuple[np.ndarray, int]] = []

        def combined() -> Iterator[pa.RecordBatch]:
            key = np.concatenate([k for k, _ in held])
            c1 = np.repeat(np.array([c for _, c in held], np.int64), [len(k) for k, _ in held])
            lead, extra = combine_keys(key, c1)
            key = key.view(np.int64)
            # an extra row has a place of its own, and names its key
            place = np.where(extra, mix64(key.view(np.uint64) ^ mix64(c1.view(np.uint64))).view(np.int64), key)
            for k in range(0, len(key), 65_536):
                part = slice(k, k + 65_536)
                yield pa.RecordBatch.from_arrays([pa.array(place[part]), pa.array(c1[part]), pa.array(lead[part], mask=lead[part] == 0), pa.array(key[part], mask=~extra[part])], names=["place", "c1", "lead", "key"])
            held.clear()

        total = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for text in batch.slice(at, 256).column(0).to_pylist():
                    items = shingles(text, words)
                    digest = set_digest(items)
                    if len(items) and digest not in seen:  # copies in this task leave once
                        seen.add(digest)
                        held.append((part_keys(items, own), moved.get(digest[1:], digest[1])))
                        total += len(held[-1][0])
                        if total >= KEYS_AT_ONCE:
                            yield from combined()
                            total = 0
        if held:
            yield from combined()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every = stash(plain.mapInArrow(digests, "doc_id long, n_shingles long, c1 long, c2 long, bits binary"), "shingle-sets")
    known = every.filter("doc_id IS NOT NULL AND n_shingles > 0")
    summed = lambda df: stash(df.groupBy("c1").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").cast("int").alias("n"), F.first("bits").alias("bits"), F.min("c2").alias("low"), F.max("c2").alias("high")), "classes")
    classes = summed(known)
    other_names = new_names(known, classes)
    renamed = spark.sparkContext.broadcast({(r["c1"], r["c2"]): r["name"] for r in other_names.collect()} if other_names is not None else {})
    if other_names is not None:
        known = known.join(F.broadcast(other_names), ["c1", "c2"], "left").withColumn("c1", F.coalesce("name", "c1")).drop("name")
        classes = summed(known)

    # sets that share a key: each with one that it is compared with first; of keys that just two sets have, no more than that is kept
    shared = plain.filter("doc_id IS NOT NULL").select("text").mapInArrow(keys, "place long, c1 long, lead long, key long")
    at = Window.partitionBy("place")
    shared = shared.withColumns({"centre": F.min("c1").over(at), "m": F.count("*").over(at), "led": F.max("lead").over(at).isNotNull()})
    two = (F.col("m") == 2) & ~F.col("led")
    shared = shared.filter((F.col("m") > 1) | F.col("led")).filter(~(two & (F.col("c1") == F.col("centre"))))
    # a lead that stands for others is one of the key's sets like any other
    members = stash(shared.select(F.when(~two, F.coalesce("key", "place")).alias("key"), "c1", F.when(F.col("key").isNull(), F.col("centre")).otherwise(F.col("lead")).alias("centre")), "key-members")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b, na, nb, ma, mb = batch.columns
                n = batch.num_rows
                sizes = np.concatenate((na.to_numpy(), nb.to_numpy())).astype(np.int64)
                maps = [np.frombuffer(m, np.uint64) for column in (ma, mb) for m in column.to_pylist()]
                fine = within_bound(sizes, maps, np.arange(n), np.arange(n, 2 * n), percent)
                yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(fine))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_tiles(batches):
            tiles, side, c1, group, sizes = (table.column(k).to_numpy() for k in range(5))
            sizes = sizes.astype(np.int64)
            maps = [np.frombuffer(m, np.uint64) for m in table.column(5).to_pylist()]
            for x, y in tile_pairs(tiles, side, group, sizes, percent):
                if len(x):
                    fine = within_bound(sizes, maps, x, y, percent)
                    a, b = c1[x[fine]], c1[y[fine]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by (a, cut), in each the text of a first: what follows is intersected with it."""
        centre, items, other, moved = None, np.zeros(0, np.uint64), np.zeros(0, np.uint64), renamed.value
        for batch in batches:
            found = []
            for k in range(batch.num_rows):
                a, b, text = batch.column(0)[k].as_py(), batch.column(2)[k].as_py(), batch.column(3)[k].as_py()
                own = shingles(text, words)
                digest = set_digest(own)
                if moved.get(digest[1:], digest[1]) != (a if b is None else b):
                    continue  # another text of the same doc_id
                if b is None:
                    centre, items = a, own
                elif centre == a:
                    other = np.concatenate((items, own))
                    other.sort(kind="stable")
                    common = int(np.count_nonzero(other[1:] == other[:-1]))
                    if 100 * common >= percent * (len(other) - common):
                        found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else ([], []))], names=["a", "b"])

    def exact(pairs: DataFrame, label: str) -> DataFrame:
        """The pairs (a, b) that are linked. Each text is moved once for every pair, a centre's once for each cut of its partners."""
        pairs = stash(pairs, f"{label}-pairs")
        nodes = pairs.select(F.col("a").alias("c1")).union(pairs.select("b")).distinct()
        nodes = stash(classes.select("c1", "rep").join(nodes, "c1", "left_semi"), f"{label}-nodes")
        texts = stash(plain.join(small_side(nodes), plain["doc_id"] == nodes["rep"]).select("c1", "text"), f"{label}-texts")
        cuts = pairs.groupBy("a").agg(F.ceil(F.count("*") / TILE_SETS).cast("int").alias("cuts"))
        leads = cuts.join(texts, cuts["a"] == texts["c1"]).select("a", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), F.lit(None).cast("long").alias("b"), "text")
        dealt = pairs.join(cuts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("cuts")).cast("int").alias("cut"), "b")
        followers = dealt.join(texts, dealt["b"] == texts["c1"]).select("a", "cut", "b", "text")
        rows = leads.union(followers).repartition("a", "cut").sortWithinPartitions("a", "cut", F.col("b").asc_nulls_first())
        out = stash(rows.mapInArrow(intersect, "a long, b long").distinct(), f"{label}-links")
        release(pairs, nodes, texts)
        return out

    # each set with its key's centre
    pairs = members.filter("c1 <> centre").select(F.col("centre").alias("a"), F.col("c1").alias("b")).distinct()
    sized = [classes.select(F.col("c1").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits_{x}")) for x in "ab"]
    pairs = pairs.join(sized[0], "a").join(sized[1], "b").filter(F.least("na", "nb") * 100 >= percent * F.greatest("na", "nb"))
    links = exact(pairs.select("a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(bounded, "a long, b long"), "centres")
    # rows of one doc_id are one document
    several = known.select("doc_id", "c1").distinct()
    same = several.groupBy("doc_id").agg(F.min("c1").alias("a"), F.count("*").alias("m")).filter("m > 1").join(several, "doc_id").select("a", F.col("c1").alias("b"))
    labels = components(links.union(same))

    # the rest: sets of a key that are not connected yet
    rest = members.filter("key IS NOT NULL").select("key", "c1").join(small_side(labels.withColumnRenamed("node", "c1")), "c1", "left")
    open_sets = stash(rest.select("key", "c1", F.coalesce("component", "c1").alias("grp")), "key-groups")
    per_group = open_sets.groupBy("key", "grp").agg(F.count("*").alias("m"))
    # the largest group of a key is its main one; of equal ones the first, so that keys with the same sets agree
    per_key = per_group.groupBy("key").agg(F.sum("m").alias("m"), F.max("m").alias("most"), F.max_by("grp", F.struct("m", -F.col("grp"))).alias("main"), F.count("*").alias("groups")).filter("groups > 1")
    per_key = stash(per_key.select("key", "main", "m", (F.col("m") - F.col("most")).alias("few")), "open-keys")
    rest = open_sets.join(small_side(per_key), "key")
    # keys with one main group mostly have the same sets: they are taken together where that makes fewer pairs
    together = stash(rest.select("main", "c1", "grp").distinct(), "together")
    cost = per_key.groupBy("main").agg(F.sum(F.col("m") * F.col("few")).alias("cost"))
    as_one = together.groupBy("main").agg(F.count("*").alias("m"), F.sum((F.col("grp") != F.col("main")).cast("long")).alias("few")).join(cost, "main")
    as_one = stash(as_one.filter(F.col("m") * F.col("few") <= F.col("cost")).drop("cost"), "as-one")
    groups = together.join(small_side(as_one), "main").select(F.xxhash64(F.lit("main"), "main").alias("key"), "main", "c1", "grp", "m", "few")
    groups = groups.unionByName(rest.join(small_side(as_one).select("main"), "main", "left_anti").select(*groups.columns))
    groups = groups.withColumns({"all_cuts": F.ceil(F.col("m") / TILE_SETS).cast("int"), "few_cuts": F.ceil(F.col("few") / TILE_SETS).cast("int")})
    whole, few = F.col("all_cuts") == 1, F.col("grp") != F.col("main")
    cut = lambda seed, cuts: F.pmod(F.xxhash64("c1", F.lit(seed)), F.col(cuts)).cast("int")
    tile = lambda u, v: F.xxhash64("key", u, v)
    one = F.array(F.struct(F.col("key").alias("tile"), F.lit(0).alias("side")))
    side_all = F.transform(F.sequence(F.lit(0), F.col("few_cuts") - 1), lambda u: F.struct(tile(u, cut(1, "all_cuts")).alias("tile"), F.lit(1).alias("side")))
    side_few = F.when(few, F.transform(F.sequence(F.lit(0), F.col("all_cuts") - 1), lambda v: F.struct(tile(cut(2, "few_cuts"), v).alias("tile"), F.lit(0).alias("side")))).otherwise(F.array().cast("array<struct<tile:bigint,side:int>>"))
    placed = groups.select("c1", "grp", F.explode(F.when(whole, one).otherwise(F.concat(side_few, side_all))).alias("t"))
    placed = placed.join(classes.select("c1", "n", "bits"), "c1").select("t.tile", "t.side", "c1", "grp", "n", "bits")
    placed = placed.repartition("tile").sortWithinPartitions("tile")
    more = exact(placed.mapInArrow(compared, "a long, b long").distinct(), "tiles")
    release(members, open_sets, per_key, together, as_one)
    if not more.isEmpty():
        # between what is connected: links of components
        to = [labels.select(F.col("node").alias(x), F.col("component").alias(f"{x}_in")) for x in "ab"]
        between = more.join(to[0], "a", "left").join(to[1], "b", "left").select(F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b"))
        joined = components(between)
        both = labels.unionByName(between.select(F.col("a").alias("node")).union(between.select("b")).distinct().select("node", F.col("node").alias("component")))
        both = both.join(joined.select(F.col("node").alias("component"), F.col("component").alias("next")), "component", "left")
        labels = stash(both.select("node", F.coalesce("next", "component").alias("component")).distinct(), "components")

    # a component is named by its smallest doc_id
    named = classes.select("c1", "rep").join(labels.withColumnRenamed("node", "c1"), "c1")
    named = named.join(named.groupBy("component").agg(F.min("rep").alias("linked")), "component").select("c1", "linked")
    out = known.select("doc_id", "n_shingles", "c1").join(classes.select("c1", "rep"), "c1").join(named, "c1", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("linked", "rep").alias("component_id"))
    unlinked = every.filter("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(unlinked)


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest doc_id.

    Documents without words or id stay, as do all rows of a doc_id that stays. An empty table gives no rows.
    """
    found = stash(jaccard_classes(docs, words, percent).filter("doc_id <> component_id").select("doc_id").distinct(), "left-out")
    return docs.join(small_side(found), "doc_id", "left_anti").select(*docs.columns)


# All pairs that share a shingle, and what links reach.
ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, least(len(w), 1) + 1)::BIGINT)) AS i FROM w WHERE len(w) > 0),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM places),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 90 * (x.n + y.n - c)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM ways UNION SELECT r.a, l.b FROM reach r JOIN ways l ON r.b = l.a)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON w.doc_id = r.a
"""
