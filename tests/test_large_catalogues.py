"""Recommenders whose work may not grow with students times courses or pairs of students, against plain loops."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from coursemill.operators import evaluation, ml, neighbours
from coursemill.operators import recommend as rec
from coursemill.session import stash

MATRIX = "student_id string, course_id string, r double"


def ranked(found):
    return {(r["student_id"], r["similar_id"], r["rank"], r["score"]) for r in found.collect()}


def plain_similar(cells, n):
    students = sorted({s for s, _ in cells})
    courses = sorted({c for _, c in cells})
    m = np.zeros((len(students), len(courses)))
    for (s, c), r in cells.items():
        m[students.index(s), courses.index(c)] = r
    sim = m @ m.T / np.outer(np.linalg.norm(m, axis=1), np.linalg.norm(m, axis=1))
    want = set()
    for i, s in enumerate(students):
        best = sorted((-float(np.floor(sim[i, j] * 1e6 + 0.5) / 1e6), students[j]) for j in np.flatnonzero(sim[i] > 0))
        want |= {(s, other, k, round(-score, 6)) for k, (score, other) in enumerate(best[: n + 1]) if k}
    return want


def test_similar_users_leave_out_what_is_far(spark):
    """Forty tastes of their own courses and some that all take: less than a tenth of the pairs is compared, and nothing is lost."""
    rng = random.Random(2)
    cells = {}
    for i in range(1600):
        for c in rng.sample(range(8), 6):
            cells[f"s{i:04d}", f"t{i % 40:02d}-{c}"] = float(rng.randrange(1, 6))
        if i % 7 == 0:
            cells[f"s{i:04d}", "all"] = 1.0
    m = spark.createDataFrame([(*k, r) for k, r in cells.items()], MATRIX)
    found, work = neighbours.similar_users_and_work(m, block=40)
    assert ranked(found) == plain_similar(cells, 5)
    assert sum(r["pairs"] for r in work.collect()) < 0.1 * 1600 * 1600


@pytest.mark.parametrize("block, asked, courses", [(16, 5, 6), (1000, 4096, 6), (16, 5, 2)])
def test_similar_users_at_random(spark, monkeypatch, block, asked, courses):
    """Ties, students like each other only in courses that pivots have no weights of, one with nothing in common with anyone, and a student with one rating."""
    monkeypatch.setattr(neighbours, "PIVOT_COURSES", courses)
    rng = random.Random(3)
    cells = {(f"s{i:03d}", f"c{j:02d}"): float(rng.randrange(1, 6)) for i in range(150) for j in range(20) if rng.random() < 0.25}
    cells |= {("twin1", "c01"): 3.0, ("twin2", "c01"): 5.0, ("twin3", "c01"): 1.0, ("alone", "only"): 2.0}
    m = spark.createDataFrame([(*k, r) for k, r in cells.items()], MATRIX)
    found, work = neighbours.similar_users_and_work(m, block=block, asked=asked)
    assert ranked(found) == plain_similar(cells, 5)
    n = len({s for s, _ in cells})
    assert sum(r["pairs"] for r in work.collect()) <= n * n
    assert neighbours.similar_users(m.limit(0)).count() == 0


def test_similar_users_compare_copies_once(spark):
    """Students with equal vectors are compared as one: no more pairs than those of the 30 vectors, though students are seven times as many; ids decide among copies."""
    rng = random.Random(4)
    vectors = [{f"c{j:02d}": float(rng.randrange(1, 6)) for j in rng.sample(range(12), 5)} for _ in range(30)]
    vectors[1] = {c: 2 * r for c, r in vectors[0].items()}  # another vector, the same direction
    times = [1, 2, 3, 5, 6, 7, 30]
    copies = [k for k in range(30) for _ in range(times[k % 7])]
    rng.shuffle(copies)
    cells = {(f"s{i:03d}", c): r for i, k in enumerate(copies) for c, r in vectors[k].items()}
    m = spark.createDataFrame([(*k, r) for k, r in cells.items()], MATRIX)
    found, work = neighbours.similar_users_and_work(m, block=8, asked=16)
    assert ranked(found) == plain_similar(cells, 5)
    assert sum(r["pairs"] for r in work.collect()) <= 30 * 30


def test_similar_users_compare_pairs_once(spark):
    """At random, where nothing can be left out, a pair is compared once for both of its students, over all rounds; ratings below 0 too."""
    rng = random.Random(6)
    cells = {(f"s{i:03d}", f"c{j:02d}"): rng.choice([-2.0, 1.0, 2.5, 4.0, 5.0]) for i in range(240) for j in range(40) if rng.random() < 0.5}
    m = spark.createDataFrame([(*k, r) for k, r in cells.items()], MATRIX)
    found, work = neighbours.similar_users_and_work(m, block=30, asked=30)
    assert ranked(found) == plain_similar(cells, 5)
    steps = {r["step"]: r["pairs"] for r in work.collect()}
    assert len(steps) == 3 and sum(steps.values()) < 0.7 * 240 * 240


@pytest.mark.parametrize("wide", [4_096, 7])
def test_cosines_in_both_precisions(monkeypatch, wide):
    """As tables and, with very many courses, over courses of both sides only; single precision is off by less than is allowed for."""
    monkeypatch.setattr(neighbours, "WIDE", wide)
    rng = np.random.default_rng(7)
    m = np.where(rng.random((50, 90)) < 0.3, rng.integers(1, 11, (50, 90)) / 2, 0)
    places = pa.array([np.flatnonzero(row).tolist() for row in m], pa.list_(pa.int32()))
    r = pa.array([row[row > 0].tolist() for row in m], pa.list_(pa.float64()))
    v = neighbours.Vectors(places, r, 90)
    want = m @ m.T / np.outer(np.linalg.norm(m, axis=1), np.linalg.norm(m, axis=1))
    x, y = np.arange(3, 40), np.arange(10, 50)
    assert np.abs(v.roughly(x, y) - want[3:40, 10:]).max() < v.off < 1e-5
    p, q = rng.integers(0, 50, 500), rng.integers(0, 50, 500)
    assert np.allclose(v.exactly(p, q, at_once=60), want[p, q], rtol=0, atol=1e-14)


def test_places_of_sparse_masks():
    rng = np.random.default_rng(8)
    for shape in ((16, 24), (5, 7)):
        for share in (0, 0.02, 1):
            mask = rng.random(shape) < share
            assert neighbours.places_of(mask).tolist() == np.flatnonzero(mask).tolist()


def test_the_best_wait_to_be_settled():
    """Whatever waits, the first three of each row are the same; the threshold is the third's score."""
    rng = np.random.default_rng(9)
    x, y, sim = rng.integers(0, 6, 400), np.arange(400), rng.integers(1, 60, 400) / 60
    for patience in (1, 500):
        low = np.zeros(6)
        best = neighbours.Best(2, patience, low, np.arange(400)[::-1].copy())
        for k in range(0, 400, 30):
            best.add(x[k : k + 30], y[k : k + 30], sim[k : k + 30])
        best.settle()
        for row in range(6):
            want = sorted(((-np.floor(s * 1e6 + 0.5), -j) for a, j, s in zip(x, y, sim, strict=True) if a == row))[:3]
            assert [-j for _, j in want] == best.y[best.x == row].tolist()
            assert abs(low[row] - (-want[2][0] / 1e6 - neighbours.SLACK)) < 1e-12


def test_rings_hold_every_student_once():
    counts = {(0, 3): 10, (0, 4): 5, (0, 9): 40, (1, 0): 16, (1, 1): 1}
    where, blocks = neighbours.cut_rings(counts, 16)
    assert where == {(0, 3): (0, 1), (0, 4): (0, 1), (0, 9): (1, 3), (1, 0): (4, 1), (1, 1): (5, 1)}
    width = np.pi / neighbours.RINGS
    assert blocks[:, 0].tolist() == [0, 0, 0, 0, 1, 1] and np.allclose(blocks[0, 1:], [3 * width, 5 * width])


def plain_walk(student, m, seen, quota, seed=42):
    p = ml.next_prime(m)
    number = lambda what: int(hashlib.md5(f"{student}|{seed}|{what}".encode()).hexdigest()[:12], 16)
    start, step = number("start") % p, 1 + number("step") % (p - 1)
    walk = [x for j in range(p) if (x := (start + j * step) % p) < m]
    assert sorted(walk) == list(range(m))
    return [x for x in walk if x not in seen][:quota]


@pytest.mark.parametrize("m", [1, 2, 3, 24, 97])
def test_negatives_walk_the_catalogue(spark, m):
    courses = spark.createDataFrame([(f"c{k:03d}",) for k in range(m)], "course_id string")
    rng = random.Random(m)
    rows = [(f"s{i}", f"c{j:03d}", rng.choice([0.0, 0.3, 0.9]), rng.random() < 0.5) for i in range(12) for j in rng.sample(range(m), min(m, 1 + i % 5))]
    rows += [("all", f"c{j:03d}", 0.9, True) for j in range(m)] + [("gone", "not a course", 0.9, True)]
    train = spark.createDataFrame(rows, "student_id string, course_id string, preference_score double, positive_label boolean")
    want = set()
    for s in {r[0] for r in rows if r[2] > 0}:
        seen = [r for r in rows if r[0] == s and r[2] > 0]
        quota = 2 * max(1, sum(r[3] for r in seen))
        want |= {(s, f"c{x:03d}") for x in plain_walk(s, m, {int(r[1][1:]) for r in seen if r[1] != "not a course"}, quota)}
    out = ml.sampled_negatives(train, courses)
    got = [tuple(r) for r in out.collect()]
    assert set(got) == want and len(got) == len(want) and not [s for s, _ in got if s == "all"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "Window" not in plan


def test_content_scores_are_the_same_rows_for_every_catalogue(spark):
    """1,001 courses, just beyond the catalogue that goes to the tasks: one definition of the rows, by either way."""
    m = 1001
    courses = spark.createDataFrame([(f"c{k:04d}",) for k in range(m)], "course_id string")
    sims = {(f"c{a:04d}", f"c{b:04d}"): 1.0 / (1 + abs(a - b)) for a in range(m) for b in range(max(0, a - 6), min(m, a + 7))}
    history = {"few": [0, 5], "many": list(range(0, 400, 7)), "first": list(range(30)), "gone": [], "all": list(range(m))}
    rows = [(s, f"c{k:04d}") for s, own in history.items() for k in own] + [("few", "c0000"), ("gone", "no course")]
    seen = spark.createDataFrame(rows, "student_id string, course_id string")
    table = stash(spark.createDataFrame([(*k, v) for k, v in sims.items()], "a string, b string, sim double"), "sims")
    want = {}
    for s, own in history.items():
        if not own:
            continue
        score = {}
        for k in own:
            for b in range(max(0, k - 6), min(m, k + 7)):
                score[b] = score.get(b, 0) + sims[f"c{k:04d}", f"c{b:04d}"]
        some = {b: x for b, x in score.items() if b not in own}
        zeros = [b for b in range(m) if b not in own and b not in some][: max(0, 20 - len(some))]
        want |= {(s, f"c{b:04d}"): x for b, x in some.items()} | {(s, f"c{b:04d}"): 0.0 for b in zeros}
    for most in (2_000, 1_000):
        found = rec.content_scores(seen, table, courses, least=20, most_courses=most).collect()
        got = {(r["student_id"], r["course_id"]): r["score"] for r in found}
        assert got.keys() == want.keys() and len(found) == len(got) and all(abs(got[k] - want[k]) < 2e-6 for k in want)


@pytest.mark.parametrize(("cells", "best"), [(10**6, None), (10**6, 4), (90, None), (90, 4)])
def test_content_scores_are_made_by_blocks_of_courses(spark, monkeypatch, cells, best):
    """Histories were joined with all similarities: a row for each course of a history and each course like it."""
    monkeypatch.setattr(rec, "BLOCK_CELLS", cells)
    monkeypatch.setattr(rec, "ASKED_RATINGS", 40)
    rng = random.Random(4)
    courses = spark.createDataFrame([(f"c{j:02d}",) for j in range(30)], "course_id string")
    sims = stash(spark.createDataFrame([(f"c{a:02d}", f"c{b:02d}", rng.random()) for a in range(30) for b in range(30) if abs(a - b) < 3], "a string, b string, sim double"), "sims")
    rows = [(k, f"s{i:02d}", f"c{j:02d}") for k in range(2) for i in range(20) for j in range(30) if rng.random() < 0.03 * (i % 7)] + [(0, "gone", "c99"), (0, "s01", "c99")]
    seen = spark.createDataFrame(rows, "fold int, student_id string, course_id string")
    shown = lambda df: sorted((r["fold"], r["student_id"], r["course_id"], r["score"]) for r in df.collect())
    made = rec.content_scores(seen, sims, courses, by=("fold",), most_courses=0, best=best)
    assert shown(made) == shown(rec.content_scores(seen, sims, courses, by=("fold",), best=best))
    assert cells < 900 or "FlatMapCoGroupsInArrow" in made._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most_courses", [1000, 3])
def test_item_scores_have_the_first_of_the_shared_list(spark, most_courses):
    """Courses x0 to x29 are like nothing that s has rated; the three of best mean stand for all of them."""
    cells = [("s", "a", 4.0), ("t", "a", 5.0), ("t", "b", 2.0), *((f"u{k}", f"x{k:02d}", float(1 + k % 5)) for k in range(30))]
    m = spark.createDataFrame(cells, MATRIX)
    got = {(r["student_id"], r["course_id"]): r["score"] for r in rec.item_cf_scores(m, least=3, most_courses=most_courses).collect()}
    assert {k: v for k, v in got.items() if k[0] == "s"} == {("s", "b"): 4.0, ("s", "x04"): 5.0, ("s", "x09"): 5.0, ("s", "x14"): 5.0}
    assert {k: v for k, v in got.items() if k[0] == "u4"} == {("u4", "x09"): 5.0, ("u4", "x14"): 5.0, ("u4", "x19"): 5.0}
    if most_courses == 3:
        plan = rec.item_cf_scores(m, least=3, most_courses=most_courses)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


RATINGS = "rating_id string, student_id string, course_id string, rating double"


@pytest.fixture(scope="module")
def repeated(spark):
    rng = random.Random(8)
    rows = [(f"r{k:04d}", f"s{rng.randrange(40):02d}", f"c{rng.randrange(12):02d}", float(rng.randrange(1, 6))) for k in range(600)]
    return spark.createDataFrame([*rows, ("r9", "one", "c01", 5.0)], RATINGS)


def test_holdout_rows_are_the_holdout(spark, repeated):
    want = {(r["fold"], r["student_id"], r["course_id"], r["rating"]) for r in evaluation.holdout(repeated, 3).filter("is_test").collect()}
    got, n = set(), 0
    for r in evaluation.holdout_rows(repeated, 3).collect():
        for fold, places in enumerate(r["tests"]):
            n += len(places)
            got |= {(fold, r["student_id"], r["cells"][k]["course_id"], r["cells"][k]["rating"]) for k in places}
    assert got == want and n == evaluation.holdout(repeated, 3).filter("is_test").count()


def test_holdout_errors_by_either_way(spark, repeated):
    a, b = (sorted(tuple(r) for r in evaluation.holdout_errors(repeated, 4, most_cells=most).collect()) for most in (2_000_000, 0))
    assert len(a) == 4 and [x[:2] for x in a] == [x[:2] for x in b]
    assert all(abs(x - y) < 2e-6 for p, q in zip(a, b, strict=True) for x, y in zip(p[2:], q[2:], strict=True))
    assert evaluation.holdout_errors(repeated.limit(0), 4).count() == 0


@pytest.mark.parametrize("skip_empty", [True, False])
def test_holdout_metrics_are_made_where_the_student_is(spark, repeated, skip_empty):
    """Lists of all models, students and folds were shuffled and written; the counts of their hits are the same."""
    courses = spark.createDataFrame([(f"c{j:02d}",) for j in range(1, 15)], "course_id string")  # c00 is rated, but not offered
    sims = stash(spark.createDataFrame([(f"c{a:02d}", f"c{b:02d}", 0.25 * (1 + (a + b) % 2)) for a in range(15) for b in range(15) if abs(a - b) < 3], "a string, b string, sim double"), "sims")
    split = stash(evaluation.holdout(repeated, 3), "split")
    train = split.filter("NOT is_test")
    matrix, history = rec.rating_matrix(train, by=("fold",)), train.select("fold", "student_id", "course_id").distinct()
    content = stash(rec.content_scores(history, sims, courses, by=("fold",)), "content")
    cf = stash(rec.user_cf_scores(matrix, by=("fold",)), "cf")
    scores = {"content": content, "collaborative": cf, "hybrid": rec.hybrid_scores(content, cf, history, by=("fold",))}
    recs = None
    for model, found in scores.items():
        own = rec.recommendations(found, 10, by=("fold",)).withColumn("model", F.lit(model))
        recs = own if recs is None else recs.unionByName(own)
    relevant = split.filter("is_test AND rating >= 4").select("fold", "student_id", "course_id")
    want = evaluation.ranking_metrics(recs, relevant, courses, keys=("model", "fold"), skip_empty=skip_empty)
    got = evaluation.holdout_metrics(repeated, courses, sims, 3, skip_empty)
    shown = lambda df: sorted(tuple(r) for r in df.collect())
    assert got.columns == want.columns and shown(got) == shown(want) and got.count() == 9
    assert evaluation.holdout_metrics(repeated, courses, sims, 3, most_cells=10) is None
    assert evaluation.holdout_metrics(repeated.limit(0), courses, sims, 3).count() == 0


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_the_best_of_scores_are_their_first_ones(spark, most):
    """Cut in the task that scores or by a window: the same rows as of all scores, ties to the first course."""
    rng = random.Random(5)
    cells = [(f"s{i:02d}", f"c{j:02d}", float(rng.randrange(1, 4))) for i in range(25) for j in range(30) if rng.random() < 0.3]
    m = stash(spark.createDataFrame(cells, MATRIX), "m")
    shown = lambda df: sorted((r["student_id"], r["course_id"], r["score"]) for r in df.collect())
    want = rec.top_n(rec.user_cf_scores(m, most_cells=most), ["student_id"], rec.by_score(), 4).drop("rank")
    assert shown(rec.user_cf_scores(m, most_cells=most, best=4)) == shown(want)
    courses = spark.createDataFrame([(f"c{j:02d}",) for j in range(30)], "course_id string")
    sims = stash(spark.createDataFrame([(f"c{a:02d}", f"c{b:02d}", 0.25 * (1 + (a + b) % 2)) for a in range(30) for b in range(30) if abs(a - b) < 4], "a string, b string, sim double"), "sims")
    own = m.select("student_id", "course_id")
    courses_at_most = 1000 if most else 0
    want = rec.top_n(rec.content_scores(own, sims, courses, most_courses=courses_at_most), ["student_id"], rec.by_score(), 4).drop("rank")
    assert shown(rec.content_scores(own, sims, courses, most_courses=courses_at_most, best=4)) == shown(want)


@pytest.mark.parametrize("cells, rated_too, best", [(1_000_000, False, None), (60, False, None), (60, True, None), (60, False, 3), (1_000_000, False, 3)])
def test_item_scores_are_made_by_blocks_of_courses(spark, monkeypatch, cells, rated_too, best):
    """Ratings were joined with similar courses, and all of these rows sorted. By one block and by many: the rows of the small catalogue's way."""
    rng = random.Random(11)
    rows = [(f"s{i:02d}", f"c{j:02d}", float(rng.randrange(1, 6))) for i in range(40) for j in range(24) if (i + j) % 4 < 2 and rng.random() < 0.5]
    rows += [("one", "c03", 4.0), ("far", "x1", 3.0), ("far2", "x2", 5.0)]
    m = stash(spark.createDataFrame(rows, MATRIX), "m")
    monkeypatch.setattr(rec, "ASKED_RATINGS", 50)
    monkeypatch.setattr(rec._item_scores_by_blocks, "__defaults__", (cells,))
    shown = lambda most: sorted((r["student_id"], r["course_id"], r["score"]) for r in rec.item_cf_scores(m, neighbours=3, most_courses=most, rated_too=rated_too, least=4, best=best).collect())
    want, got = shown(1_000), shown(0)
    assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want], atol=2e-6)
    if cells > 60 and best is None:
        plan = rec.item_cf_scores(m, most_courses=0)._jdf.queryExecution().executedPlan().toString()
        assert "CoGroup" in plan and "windowspecdefinition(student_id" not in plan


def test_a_forest_is_fitted_in_parts(spark):
    """All trees at once keep a number for each row and tree. Their probability is the mean of the parts', and features go to the fit without a join."""
    from coursemill.operators import hybrid

    rng = random.Random(2)
    rows = [(f"s{k % 9}", f"c{k:02d}", k % 2, *[rng.random() + 0.2 * (k % 2) for _ in ml.HYBRID_FEATURES]) for k in range(90)]
    labelled = spark.createDataFrame(rows, "student_id string, course_id string, label int, " + ", ".join(f"{c} double" for c in ml.HYBRID_FEATURES))
    forest = ml.fit_hybrid(labelled, trees=7, at_once=3)
    assert [part.getNumTrees for part in forest] == [3, 2, 2] and len({part.toDebugString.split(chr(10), 1)[1] for part in forest}) == 3
    asked = labelled.select("student_id", "course_id", F.array(*ml.HYBRID_FEATURES).alias("features"))
    got = {(r["student_id"], r["course_id"]): r["score"] for r in hybrid.first_ranked(forest, asked, 10).collect()}
    alone = [{(r["student_id"], r["course_id"]): r["score"] for r in hybrid.first_ranked([part], asked, 10).collect()} for part in forest]
    assert len(got) == 90 and all(abs(got[k] - sum(n * a[k] for n, a in zip((3, 2, 2), alone, strict=True)) / 7) < 2e-6 for k in got)


def test_a_forest_is_read_by_numpy_as_spark_reads_it(spark):
    """Spark took every candidate to a vector and through each part's trees one by one; also values on a threshold, and none."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from coursemill.operators import hybrid

    rng = random.Random(3)
    rows = [(f"s{k % 9}", f"c{k:03d}", int(rng.random() < 0.5), *[rng.randrange(40) / 40 for _ in ml.HYBRID_FEATURES]) for k in range(400)]
    labelled = spark.createDataFrame(rows, "student_id string, course_id string, label int, " + ", ".join(f"{c} double" for c in ml.HYBRID_FEATURES))
    parts = ml.fit_hybrid(labelled, trees=7, at_once=4)
    forest = hybrid.forest_of(parts)
    assert len(forest.trees) == 7 and max(len(leaves) for _, leaves in forest.trees) > 8
    x = np.array([r[3:] for r in rows])
    x[0, :], x[1, ::2] = np.nan, np.inf
    for f, edges in forest.edges.items():
        x[2 : 2 + len(edges), f] = edges
    df = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "k int, a array<double>").withColumn("features", array_to_vector("a"))
    want = np.zeros(len(x))
    for part in parts:
        scored = part.transform(df).select("k", vector_to_array("probability")[1].alias("p"))
        for r in scored.collect():
            want[r["k"]] += r["p"] * part.getNumTrees / 7
    assert np.allclose(forest.probability(x), want, rtol=0, atol=1e-12) and len(set(want)) > 50
    assert len(forest.probability(x[:0])) == 0


def test_labels_go_with_the_students_row(spark):
    """Features were shuffled to meet their labels. A pair that stands twice, once drawn as unseen, has two rows."""
    from coursemill.operators import hybrid

    courses = spark.createDataFrame([(f"c{k}", "X", "Beginner") for k in range(4)], "course_id string, category string, difficulty string")
    train = stash(spark.createDataFrame([("s", "c0", 0.5, 1.0, 2.0, True), ("s", "c1", 0.0, 1.0, 2.0, False), ("t", "c2", 1.0, 1.0, 2.0, True), ("t", "gone", 1.0, 1.0, 2.0, True)], "student_id string, course_id string, preference_score double, enrollment_progress double, avg_quiz_score double, positive_label boolean"), "train")
    sims = stash(spark.createDataFrame([("c0", "c1", 0.5), ("c1", "c0", 0.5)], "a string, b string, sim double"), "sims")
    matrix = stash(rec.rating_matrix(ml.train_inputs(train)), "matrix")
    asked = spark.createDataFrame([("s", ["c0", "c1", "c1", "gone"], [1, 0, 0, 1]), ("t", ["c2"], [1])], "student_id string, wanted array<string>, labels array<int>")
    tables = hybrid.tables_for(train, matrix, courses, sims)
    made = hybrid.feature_rows(tables, train, matrix, asked)
    assert sorted((r["student_id"], r["course_id"], r["label"]) for r in made.collect()) == [("s", "c0", 1), ("s", "c1", 0), ("s", "c1", 0), ("t", "c2", 1)]
    plain = {(r["student_id"], r["course_id"]): r["features"] for r in hybrid.feature_rows(tables, train, matrix, asked.drop("labels")).collect()}
    assert all(r["features"] == plain[r["student_id"], r["course_id"]] for r in made.collect())
