"""Similar students: an exact top-k join of sparse vectors by cosine, which leaves out what cannot be among the best.

1. Students with equal vectors are one class, which is compared once; its first ids stand for it.
2. Classes are dealt to the nearest of a few pivots, directions that are fitted on a bounded sample,
   and those of a pivot to rings by their angle to it: blocks of at most so many. Pivots decide
   how much is left out, never what is found.
3. Two bounds hold for the cosine of a class with all of a block: by the triangle inequality of
   angles, the cosine of the angle that is left between it and the ring; and the sum over
   courses of its weights times the largest ones of the pivot's students.
4. Every class is compared with its own block and with the blocks of the largest bounds. The last
   of its best is the threshold that it carries: then it is compared with the blocks whose bound
   reaches that, in rounds, as every round raises thresholds for the next.

Blocks are put together to slabs, and a task compares the blocks of two slabs, in both directions at
once. Cosines are taken in single precision first; those that reach the threshold, less all that
single precision can be off, are taken anew in double precision. Vectors move once for each slab that
they are compared with. Where nothing can be left out, as with ratings at random, that is every slab,
and all pairs of classes are compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursemill.operators.numbering import numbered
from coursemill.operators.recommend import PLACES, by_score, top_n
from coursemill.session import large_side, release, ship, small_side, stash

#: Students of a block, and of a slab: two slabs meet in one task.
BLOCK, ASKED = 2_048, 32_768
#: Weights of a slab as a table, at most; with more courses slabs are smaller, down to a block, and with more than WIDE only courses of both sides are put into tables, so many at once.
SLAB_WEIGHTS, WIDE = 32_000_000, 4_096
#: Pivots, and the most rated courses that they have weights of, at most; students that they are fitted on.
MOST_PIVOTS, PIVOT_COURSES, SAMPLE = 128, 1_500, 4_096
#: Rings of equal width that a half turn is cut into.
RINGS = 256
#: Other blocks that every student is compared with first.
FIRST_BLOCKS = 1
#: Rounds meet slabs at distances below 2, 8, 32, ...: each some four times as many as all before.
ROUNDS = 4
#: Bounds this little below a threshold still reach it: half a unit of the rounded score, and what angles and sums of floating-point numbers are off.
SLACK = 0.5 * 10.0**-PLACES + 1e-7
SEED = 5
VECTOR = "student_id string, places array<int>, r array<double>"
FOUND = "student_id string, similar_id string, sim double, pairs long"


def weights(places: pa.Array, r: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(students x the first courses, norms, norms of the rest): weights of lists of places and ratings, not divided by their norms."""
    owner = np.repeat(np.arange(len(places)), np.asarray(places.value_lengths()))
    place, r = np.asarray(places.flatten()), np.asarray(r.flatten())
    out = np.zeros((len(places), width))
    known = place < width
    out[owner[known], place[known]] = r[known]
    square = lambda chosen: np.bincount(owner[chosen], r[chosen] ** 2, len(places))
    return out, np.sqrt(square(np.ones(len(r), bool))), np.sqrt(square(~known))


class Vectors:
    """Sparse vectors of one task: their cosines in single precision, tile by tile, and exactly, for chosen pairs."""

    def __init__(self, places: pa.Array, r: pa.Array, width: int):
        self.size = np.asarray(places.value_lengths()).astype(np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.place, self.r = np.asarray(places.flatten()).astype(np.int64), np.asarray(r.flatten())
        owner = np.repeat(np.arange(len(self.size)), self.size)
        self.norm = np.sqrt(np.bincount(owner, self.r**2, len(self.size)))
        self.unit = (self.r / self.norm[owner]).astype(np.float32)
        self.width = width
        #: What the cosines of roughly() are off at most: a rounding for each product, sum and weight.
        self.off = (self.size.max() + 8) * 2.0**-24
        #: Without ratings below 0 nothing cancels, so what has a course in common is above 0 in single precision too.
        self.least = np.finfo(np.float32).smallest_subnormal if self.r.min() > 0 else -self.off
        self.table = None
        if width <= WIDE:
            self.table = np.zeros((len(self.size), width), np.float32)
            self.table[owner, self.place] = self.unit

    def cells(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the cells of some rows: which row of these, and where the cell is."""
        size = self.size[rows]
        which = np.repeat(np.arange(len(rows)), size)
        return which, np.arange(len(which)) + np.repeat(self.start[rows] - (np.cumsum(size) - size), size)

    def roughly(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[x] @ self.table[y].T
        (own, at), (theirs, there) = self.cells(x), self.cells(y)
        common = np.intersect1d(self.place[at], self.place[there])
        total = np.zeros((len(x), len(y)), np.float32)
        for k in range(0, len(common), WIDE):
            part = common[k : k + WIDE]
            total += self._part(own, at, len(x), part) @ self._part(theirs, there, len(y), part).T
        return total

    def _part(self, which: np.ndarray, at: np.ndarray, rows: int, courses: np.ndarray) -> np.ndarray:
        column = np.minimum(np.searchsorted(courses, self.place[at]), len(courses) - 1)
        known = courses[column] == self.place[at]
        out = np.zeros((rows, len(courses)), np.float32)
        out[which[known], column[known]] = self.unit[at[known]]
        return out

    def exactly(self, x: np.ndarray, y: np.ndarray, at_once: int = 100_000) -> np.ndarray:
        """Cosines of pairs in double precision; courses of a row are in order."""
        found = [np.zeros(0)]
        for k in range(0, len(x), at_once):
            one, other = x[k : k + at_once], y[k : k + at_once]
            (own, at), (theirs, there) = self.cells(one), self.cells(other)
            keys, wanted = theirs * self.width + self.place[there], own * self.width + self.place[at]
            where = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            both = keys[where] == wanted
            dots = np.bincount(own[both], self.r[at[both]] * self.r[there[where[both]]], len(one))
            found.append(dots / (self.norm[one] * self.norm[other]))
        return np.concatenate(found)


class Best:
    """The first n + 1 found for the rows of a block, by the rounded score, ties by place among all ids; ``low`` is what a cosine must reach to be one of them. What is added waits until it is twice the rows."""

    def __init__(self, n: int, rows: int, low: np.ndarray, tie: np.ndarray):
        self.n, self.patience, self.low, self.tie = n, 2 * rows, low, tie
        self.x = self.y = np.zeros(0, np.int64)
        self.sim = np.zeros(0)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, x: np.ndarray, y: np.ndarray, sim: np.ndarray) -> None:
        """x: rows of the whole task, as in ``low``."""
        good = (sim > 0) & (sim >= self.low[x])
        if good.any():
            self.waiting.append((x[good], y[good], sim[good]))
            if sum(len(w[0]) for w in self.waiting) >= self.patience:
                self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        x, y, sim = (np.concatenate(parts) for parts in zip((self.x, self.y, self.sim), *self.waiting, strict=True))
        self.waiting = []
        units = np.floor(sim * 10**PLACES + 0.5)
        order = np.lexsort((self.tie[y], -units, x))
        x, units = x[order], units[order]
        starts = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
        rank = np.arange(len(x)) - np.repeat(starts, np.diff(np.append(starts, len(x))))
        keep = rank <= self.n
        self.x, self.y, self.sim = x[keep], y[order][keep], sim[order][keep]
        last = rank == self.n
        self.low[x[last]] = np.maximum(self.low[x[last]], units[last] * 10.0**-PLACES - SLACK)


def places_of(mask: np.ndarray) -> np.ndarray:
    """np.flatnonzero for masks that are nearly empty: eight cells are looked at together."""
    if mask.size % 8:
        return np.flatnonzero(mask)
    some = np.flatnonzero(mask.reshape(-1).view(np.uint64))
    which, at = np.nonzero(mask.reshape(-1, 8)[some])
    return some[which] * 8 + at


def meet(v: Vectors, n: int, x: np.ndarray, y: np.ndarray, own: Best, theirs: Best | None, asking: np.ndarray | None, rows: int = 1_024, columns: int = 1_024) -> None:
    """Compare rows x with rows y, for x and, of y, for those that ask, too."""
    for i in range(0, len(x), rows):
        a = x[i : i + rows]
        for j in range(0, len(y), columns):
            b = y[j : j + columns]
            sim = v.roughly(a, b)

            def cut(low: np.ndarray) -> np.ndarray:
                return np.maximum(low - v.off, v.least).astype(np.float32)

            down = cut(own.low[a])
            across = cut(np.where(asking[b], theirs.low[b], np.inf)) if theirs else None
            reach = lambda: sim >= down[:, None] if across is None else (sim >= down[:, None]) | (sim >= across)
            at = places_of(reach())
            if len(at) > 16 * (len(a) + len(b)):  # thresholds are still low: what n + 1 others of the tile surely surpass isn't among the best
                margin = 2 * v.off + 2 * SLACK
                if len(b) > n:
                    down = np.maximum(down, np.partition(sim, len(b) - n - 1, axis=1)[:, len(b) - n - 1] - np.float32(margin))
                if across is not None and len(a) > n:
                    across = np.maximum(across, np.partition(sim, len(a) - n - 1, axis=0)[len(a) - n - 1] - np.float32(margin))
                at = places_of(reach())
            if not len(at):
                continue
            p, q = np.divmod(at, len(b))
            exact = v.exactly(a[p], b[q])
            rough = sim[p, q]
            one = rough >= down[p]
            own.add(a[p[one]], b[q[one]], exact[one])
            if across is not None:
                other = rough >= across[q]
                theirs.add(b[q[other]], a[p[other]], exact[other])


def compare_slabs(table: pa.Table, n: int, width: int) -> pa.Table:
    """The best for all students of two slabs that ask: student_id, places, r, least, block and the asked blocks of the other slab. One more row has the number of pairs compared."""
    table = table.take(pc.sort_indices(table.column("block"))).combine_chunks()
    column = lambda name: table.column(name).combine_chunks()
    ids, block, asks = column("student_id"), np.asarray(column("block")), column("asks")
    v = Vectors(column("places"), column("r"), width)
    tie = np.empty(len(ids), np.int64)
    tie[np.asarray(pc.sort_indices(ids))] = np.arange(len(ids))
    low = np.maximum(np.asarray(column("least")) - SLACK, 0)
    starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    rows = {int(block[s]): np.arange(s, e) for s, e in zip(starts, np.append(starts[1:], len(block)), strict=True)}
    best = {b: Best(n, len(at), low, tie) for b, at in rows.items()}
    who, asked = np.repeat(np.arange(len(ids)), np.asarray(asks.value_lengths())), np.asarray(asks.flatten())
    order = np.lexsort((asked, block[who]))
    who, asked = who[order], asked[order]
    cuts = np.flatnonzero(np.append(True, (block[who][1:] != block[who][:-1]) | (asked[1:] != asked[:-1]))) if len(who) else np.zeros(0, np.int64)
    askers = {(int(block[who[s]]), int(asked[s])): np.sort(who[s:e]) for s, e in zip(cuts, np.append(cuts[1:], len(who)), strict=True)}
    pairs, none = 0, np.zeros(0, np.int64)
    for a, b in sorted({(min(k), max(k)) for k in askers if k[1] in rows}):
        one, other = askers.get((a, b), none), askers.get((b, a), none)
        if a == b:
            other = none
        asking = np.zeros(len(ids), bool)
        asking[other] = True
        meet(v, n, one, rows[b], best[a], best[b] if len(other) else None, asking)
        rest = rows[a][~np.isin(rows[a], one)] if len(other) else none
        meet(v, n, other, rest, best[b], None, None)
        pairs += len(one) * len(rows[b]) + len(other) * len(rest)
    for k in best.values():
        k.settle()
    x, y, sim = (np.concatenate([getattr(k, name) for k in best.values()]) for name in ("x", "y", "sim"))
    found = pa.table({"student_id": ids.take(pa.array(x)), "similar_id": ids.take(pa.array(y)), "sim": sim, "pairs": pa.nulls(len(x), pa.int64())})
    work = pa.table({"student_id": pa.nulls(1, pa.string()), "similar_id": pa.nulls(1, pa.string()), "sim": pa.nulls(1, pa.float64()), "pairs": pa.array([pairs], pa.int64())})
    return pa.concat_tables([found, work])


def fit_pivots(sample: np.ndarray, n: int, rounds: int = 6, seed: int = SEED) -> np.ndarray:
    """Directions by k-means on unit vectors; a pivot without students stays where it is."""
    rng = np.random.default_rng(seed)
    pivots = sample[rng.choice(len(sample), min(n, len(sample)), replace=False)]
    for _ in range(rounds):
        near = (sample @ pivots.T).argmax(1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, near, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        pivots = np.where(length > 0, sums / np.where(length > 0, length, 1), pivots)
    return pivots


def cut_rings(counts: dict[tuple[int, int], int], block: int) -> tuple[dict[tuple[int, int], tuple[int, int]], np.ndarray]:
    """(first block, blocks) of every (pivot, ring), and pivot, lower and upper edge of every block. Rings next to each other share one while they fit; a larger ring has several."""
    where, made, held = {}, [], 0
    width = np.pi / RINGS
    for pivot, ring in sorted(counts):
        n = counts[pivot, ring]
        low, high = ring * width, (ring + 1) * width
        if made and made[-1][0] == pivot and held + n <= block:
            held += n
            made[-1][2] = high
            where[pivot, ring] = len(made) - 1, 1
        else:
            parts = -(-n // block)
            where[pivot, ring] = len(made), parts
            made += [[pivot, low, high] for _ in range(parts)]
            held = n if parts == 1 else block
    return where, np.array(made, float).reshape(-1, 3)


def cut_slabs(sizes: list[int], slab: int) -> np.ndarray:
    """The slab of every block: blocks next to each other share one while they fit."""
    out, held = [], 0
    for size in sizes:
        new = not out or held + size > slab
        out.append((out[-1] + 1 if out else 0) if new else out[-1])
        held = size if new else held + size
    return np.array(out, np.int64)


def rounds_of(slabs: int) -> np.ndarray:
    """(slabs x slabs) The round from 1 in which two slabs meet, by their distance on a ring."""
    at = np.arange(slabs)
    apart = np.abs(at[:, None] - at)
    apart = np.minimum(apart, slabs - apart)
    out, edge = np.ones((slabs, slabs), np.int64), 2
    while edge <= apart.max():
        out += apart >= edge
        edge *= ROUNDS
    return out


def similar_users_and_work(matrix: DataFrame, n: int = 5, block: int = BLOCK, asked: int = ASKED) -> tuple[DataFrame, DataFrame]:
    """similar_users(), and how many pairs of classes each of its rounds has compared: (step, pairs). asked: students of a slab, at most, but for a block."""
    spark = matrix.sparkSession
    ship(spark)
    rated = matrix.groupBy("course_id").agg(F.count("*").alias("n"))
    courses = stash(numbered(stash(rated, "courses-rated"), "number", [F.desc("n"), "course_id"]).select("course_id", (F.col("number") - 1).cast("int").alias("place")), "course-places")
    width = courses.count()
    if not width:
        return spark.createDataFrame([], "student_id string, similar_id string, score double, rank int"), spark.createDataFrame([], "step int, pairs long")
    cells = F.array_sort(F.collect_list(F.struct("place", "r")))
    students = matrix.join(small_side(courses), "course_id").groupBy("student_id").agg(cells.alias("cells"))
    students = stash(students.select("student_id", F.col("cells.place").alias("places"), F.col("cells.r").alias("r")), "student-rows")
    same = top_n(students, ["places", "r"], [F.col("student_id")], n + 1).groupBy("places", "r").agg(F.array_sort(F.collect_list("student_id")).alias("ids"))
    classes = stash(same.select(F.col("ids")[0].alias("student_id"), "places", "r", "ids"), "student-classes")
    total = classes.count()
    first_courses = min(width, PIVOT_COURSES)
    drawn = classes.orderBy(F.xxhash64("student_id", F.lit(SEED)), "student_id").select("places", "r").limit(SAMPLE).toArrow().combine_chunks()
    sample, norm, _ = weights(drawn.column(0).combine_chunks(), drawn.column(1).combine_chunks(), first_courses)
    pivots = fit_pivots(sample / norm[:, None], min(MOST_PIVOTS, max(1, total // block)))
    model = spark.sparkContext.broadcast(pivots)  # at most MOST_PIVOTS x PIVOT_COURSES weights

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                w, norm, rest = weights(part.column(1), part.column(2), pivots.shape[1])
                cos = np.clip(w @ pivots.T / norm[:, None], -1, 1)
                near = cos.argmax(1)
                ring = np.minimum((np.arccos(cos[np.arange(len(near)), near]) * RINGS / np.pi).astype(np.int32), RINGS - 1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near.astype(np.int32)), pa.array(ring), pa.array(norm), pa.array(rest / norm)], names=[*part.schema.names, "pivot", "ring", "norm", "rest"])

    vectors = classes.select("student_id", "places", "r", F.size("ids").alias("members"))
    dealt = stash(vectors.mapInArrow(deal, f"{VECTOR}, members int, pivot int, ring int, norm double, rest double"), "students-dealt")
    found = dealt.groupBy("pivot", "ring").agg(F.count("*").alias("n"), F.max("rest").alias("rest")).collect()  # at most MOST_PIVOTS x RINGS rows
    where, blocks = cut_rings({(r["pivot"], r["ring"]): r["n"] for r in found}, block)
    rest = np.zeros(len(pivots))
    for r in found:
        rest[r["pivot"]] = max(rest[r["pivot"]], r["rest"])
    weighed = dealt.select("pivot", "norm", F.inline(F.arrays_zip(F.col("places").alias("place"), F.col("r").alias("w")))).filter(F.col("place") < first_courses)
    largest = weighed.groupBy("pivot", "place").agg(F.max(F.abs(F.col("w")) / F.col("norm")).alias("most")).toArrow()
    most = np.zeros((len(pivots), first_courses))
    most[largest.column("pivot").to_numpy(), largest.column("place").to_numpy()] = largest.column("most").to_numpy()
    places = spark.createDataFrame([(p, r, b, k) for (p, r), (b, k) in where.items()], "pivot int, ring int, first int, parts int")
    own_block = (F.col("first") + F.pmod(F.xxhash64("student_id"), F.col("parts"))).cast("int")
    index = stash(dealt.join(F.broadcast(places), ["pivot", "ring"]).select("student_id", "places", "r", "members", own_block.alias("block")), "student-blocks")
    sizes = {r["block"]: r["count"] for r in index.groupBy("block").count().collect()}  # one row for each block
    tasks = 4 * spark.sparkContext.defaultParallelism
    slab = max(block, min(asked, SLAB_WEIGHTS // min(width, WIDE), max(BLOCK, int(total / (2 * tasks) ** 0.5) + 1)))
    slab_of = cut_slabs([sizes.get(b, 0) for b in range(len(blocks))], slab)
    edges = np.flatnonzero(np.append(True, slab_of[1:] != slab_of[:-1]))
    rounds = rounds_of(len(edges))
    bounds = spark.sparkContext.broadcast((blocks, most, rest, slab_of, edges, rounds))

    def choices(step: int) -> Callable[[pa.RecordBatch], Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]]:
        """Of parts of a batch: the part, each one's own block, and the blocks that it is compared with: first some, and with a threshold those of the round that may reach it."""

        def chosen(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
            pivots, (blocks, most, rest, slab_of, _, rounds) = model.value, bounds.value
            pivot = blocks[:, 0].astype(np.int64)
            many = max(1, 500_000 // len(blocks))
            for at in range(0, batch.num_rows, many):
                part = batch.slice(at, many)
                own = np.asarray(part.column(3))
                w, norm, out = weights(part.column(1), part.column(2), pivots.shape[1])
                w, out = w / norm[:, None], out / norm
                angle = np.arccos(np.clip(w @ pivots.T, -1, 1))[:, pivot]
                gap = np.maximum(np.maximum(angle - blocks[:, 2], blocks[:, 1] - angle), 0)
                shared = (np.abs(w) @ most.T + out[:, None] * rest)[:, pivot]
                bound = np.minimum(np.cos(gap), shared) + SLACK
                rank = bound.copy()
                rank[np.arange(len(rank)), own] = np.inf
                first = np.zeros(bound.shape, bool)
                np.put_along_axis(first, np.argsort(-rank, axis=1, kind="stable")[:, : 1 + FIRST_BLOCKS], True, axis=1)
                again = ~first & (shared > 0) & (bound >= np.asarray(part.column(4))[:, None])
                yield part, own, first if not step else again & (rounds[slab_of[own]][:, slab_of] == step)

        return chosen

    def compared(asking: DataFrame, step: int) -> DataFrame:
        """asking: student_id, places, r, own block, least (the threshold)."""
        chosen = choices(step)

        def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Which slab asks which block."""
            slab_of, edges = bounds.value[3:5]
            hit = np.zeros((len(edges), len(slab_of)), bool)
            for batch in batches:
                for _, own, asks in chosen(batch):
                    for s in np.unique(slab_of[own]):
                        hit[s] |= asks[slab_of[own] == s].any(0)
            s, b = np.nonzero(hit)
            yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int32)), pa.array(b.astype(np.int32))], names=["slab", "asked"])

        hits = asking.mapInArrow(meetings, "slab int, asked int").distinct().toArrow()  # at most slabs x blocks pairs of numbers
        if not hits.num_rows:
            return spark.createDataFrame([], FOUND)
        met = np.zeros((len(slab_of), len(edges)), bool)
        met[hits.column("asked").to_numpy(), hits.column("slab").to_numpy()] = True
        told = spark.sparkContext.broadcast(met)
        pairs = len({(min(s, t), max(s, t)) for s, t in zip(hits.column("slab").to_pylist(), slab_of[hits.column("asked").to_numpy()].tolist(), strict=True)})

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Every student once for each slab that it asks or that asks its block, with the blocks that it asks there."""
            (slab_of, edges), met = bounds.value[3:5], told.value
            for batch in batches:
                for part, own, asks in chosen(batch):
                    count = np.add.reduceat(asks, edges, axis=1, dtype=np.int32)
                    who, other = np.nonzero((count > 0) | met[own])
                    listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count[who, other])), pa.int32()), pa.array(np.nonzero(asks)[1], pa.int32()))
                    home = slab_of[own[who]]
                    lo, hi = (pa.array(f(home, other), pa.int32()) for f in (np.minimum, np.maximum))
                    taken = part.take(pa.array(who))
                    yield pa.RecordBatch.from_arrays([*taken.columns, listed, lo, hi], names=[*taken.schema.names, "asks", "lo", "hi"])

        sent = asking.mapInArrow(send, f"{VECTOR}, block int, least double, asks array<int>, lo int, hi int").repartition(min(4 * pairs, 4_096), "lo", "hi")
        return stash(sent.groupBy("lo", "hi").applyInArrow(lambda table: compare_slabs(table, n, width), FOUND), f"found-{step}")

    best = work = None
    for step in range(int(rounds.max()) + 1):
        # classes with more than n members have none that is better than these; without n + 1 found any similarity above 0 may count
        least = F.when(F.col("members") > n, F.lit(1.0)).otherwise(F.lit(0.0))
        asking = index
        if best is not None:
            reached = best.filter(F.col("rank") == n + 1).select(F.col("student_id").alias("of"), F.col("score").alias("reached"))
            asking = index.join(large_side(reached), F.col("student_id") == F.col("of"), "left")
            least = F.greatest(least, F.coalesce("reached", F.lit(0.0)))
        asking = stash(asking.select("student_id", "places", "r", "block", least.alias("least")), f"asking-{step}")
        out = compared(asking, step)
        release(asking)
        scored = out.filter("student_id IS NOT NULL").select("student_id", "similar_id", F.round("sim", PLACES).alias("score"))
        pairs = out.filter("student_id IS NULL").select(F.lit(step + 1).alias("step"), "pairs")
        best = stash(top_n(scored if best is None else best.drop("rank").unionByName(scored), ["student_id"], by_score(tie="similar_id"), n + 1), f"best-{step}")
        work = pairs if work is None else work.unionByName(pairs)
    work = work.groupBy("step").agg(F.sum("pairs").alias("pairs"))
    if total < students.count():
        ids = classes.select(F.col("student_id").alias("similar_id"), "ids")
        opened = best.join(large_side(ids), "similar_id").select("student_id", F.explode("ids").alias("similar_id"), "score")
        opened = stash(top_n(opened, ["student_id"], by_score(tie="similar_id"), n + 1), "best-opened").withColumnRenamed("student_id", "of")
        of = students.join(large_side(classes.select("places", "r", F.col("student_id").alias("of"))), ["places", "r"]).select("student_id", "of")
        best = large_side(of).join(opened, "of").select("student_id", "similar_id", "score", "rank")
    return best.filter("rank > 1").withColumn("rank", F.col("rank") - 1), work


def similar_users(matrix: DataFrame, n: int = 5, block: int = BLOCK) -> DataFrame:
    """Of every student, the students at ranks 2 to n + 1 by cosine: the top row goes by position, which is the student but for ties. Students with nothing in common have no row."""
    return similar_users_and_work(matrix, n, block)[0]
